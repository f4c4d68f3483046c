"""The rank's specification: what each sub-metric of each factor is worth."""

from __future__ import annotations

# Factors, fields, weights, ranges and lookups of the rank, in the
# order of its published configuration.  A row: factor, sub-metric, field, kind,
# weight, low, high, zero below, zero above, floor.  Kinds: higher, lower
# (percentile ranks), sweet (100 inside low..high, falling outside, 50 where no zero
# is given), lookup.

#: (factor, weight)
FACTORS = [
    ("valuation", 0.12),
    ("quality_growth", 0.12),
    ("technical_momentum", 0.11),
    ("earnings_catalyst", 0.10),
    ("analyst_estimates", 0.08),
    ("volatility_regime", 0.08),
    ("setup_quality", 0.10),
    ("positioning", 0.10),
    ("sentiment_catalyst", 0.10),
    ("macro_regime", 0.09),
    ("seasonality", 0.05),
]
SUB_METRICS = [
    ("valuation", "trailing_pe", "trailing_pe", "sweet", 0.20, 8, 22, 3, 60, None),
    ("valuation", "forward_pe", "forward_pe", "sweet", 0.20, 8, 20, 3, 50, None),
    ("valuation", "peg_ratio", "peg_ratio", "sweet", 0.15, 0.8, 2.0, 0.3, 4.0, None),
    ("valuation", "price_to_book", "price_to_book", "sweet", 0.10, 1.0, 5.0, 0.3, 15.0, None),
    ("valuation", "price_to_sales", "price_to_sales", "sweet", 0.10, 0.5, 4.0, 0.2, 12.0, None),
    ("valuation", "ev_to_ebitda", "ev_to_ebitda", "sweet", 0.15, 6, 16, 2, 35, None),
    ("valuation", "earnings_yield", "earnings_yield", "higher", 0.05, None, None, None, None, None),
    ("valuation", "fcf_yield", "fcf_yield", "higher", 0.05, None, None, None, None, None),
    ("quality_growth", "roe", "roe", "higher", 0.15, None, None, None, None, None),
    ("quality_growth", "roa", "roa", "higher", 0.05, None, None, None, None, None),
    ("quality_growth", "return_on_assets", "roa", "higher", 0.10, None, None, None, None, None),
    ("quality_growth", "operating_margin", "operating_margin", "higher", 0.15, None, None, None, None, None),
    ("quality_growth", "profit_margin", "profit_margin", "higher", 0.05, None, None, None, None, None),
    ("quality_growth", "revenue_growth", "revenue_growth", "higher", 0.15, None, None, None, None, None),
    ("quality_growth", "earnings_growth", "earnings_growth", "higher", 0.10, None, None, None, None, None),
    ("quality_growth", "debt_to_equity", "debt_to_equity", "lower", 0.10, None, None, None, None, None),
    ("quality_growth", "cash_conversion", "cash_conversion", "higher", 0.10, None, None, None, None, None),
    ("quality_growth", "fcf_yield_q", "fcf_yield", "higher", 0.05, None, None, None, None, None),
    ("technical_momentum", "rs_1m_vs_spy", "rs_1m", "higher", 0.10, None, None, None, None, None),
    ("technical_momentum", "rs_3m_vs_spy", "rs_3m", "higher", 0.18, None, None, None, None, None),
    ("technical_momentum", "rs_6m_vs_spy", "rs_6m", "higher", 0.18, None, None, None, None, None),
    ("technical_momentum", "rs_12m_vs_spy", "rs_12m", "higher", 0.10, None, None, None, None, None),
    ("technical_momentum", "dist_50d_ma_pct", "dist_50d", "higher", 0.10, None, None, None, None, None),
    ("technical_momentum", "dist_200d_ma_pct", "dist_200d", "higher", 0.10, None, None, None, None, None),
    ("technical_momentum", "rsi_14", "rsi", "sweet", 0.10, 50, 70, 30, 80, None),
    ("technical_momentum", "trend_slope_50d", "slope_50d", "higher", 0.07, None, None, None, None, None),
    ("technical_momentum", "macd_histogram", "macd_hist", "higher", 0.07, None, None, None, None, None),
    ("earnings_catalyst", "days_to_next_earnings", "days_to_earnings", "sweet", 0.30, 14, 45, 1, 90, None),
    ("earnings_catalyst", "earnings_window_drift", "earnings_drift", "higher", 0.30, None, None, None, None, None),
    ("earnings_catalyst", "recent_surprise_pct", "surprise_pct", "higher", 0.20, None, None, None, None, None),
    ("earnings_catalyst", "earnings_growth", "earnings_growth", "higher", 0.20, None, None, None, None, None),
    ("analyst_estimates", "target_upside_pct", "target_upside", "higher", 0.30, None, None, None, None, None),
    ("analyst_estimates", "analyst_rating", "analyst_rating", "lower", 0.30, None, None, None, None, None),
    ("analyst_estimates", "analyst_coverage", "analyst_coverage", "higher", 0.10, None, None, None, None, None),
    ("analyst_estimates", "recent_revisions", "revisions", "higher", 0.30, None, None, None, None, None),
    ("volatility_regime", "vol_ratio", "vol_ratio", "lower", 0.30, None, None, None, None, None),
    ("volatility_regime", "atr_pct_vs_spy", "atr_less_market", "lower", 0.25, None, None, None, None, None),
    ("volatility_regime", "max_dd_60d", "max_dd_60d", "lower", 0.20, None, None, None, None, None),
    ("volatility_regime", "iv_percentile", "vol_percentile", "lower", 0.25, None, None, None, None, None),
    ("setup_quality", "setup_type", "setup", "lookup", 0.40, None, None, None, None, None),
    ("setup_quality", "range_percentile", "range_pctile", "sweet", 0.20, 30, 70, 10, 90, None),
    ("setup_quality", "dist_50d_atr", "dist_50d_atr", "sweet", 0.15, 0, 2, None, 5, None),
    ("setup_quality", "room_to_resist", "room_atr", "sweet", 0.15, 1, 5, None, None, None),
    ("setup_quality", "volume_profile_pos", "profile_pos", "sweet", 0.10, 0.3, 0.7, None, None, None),
    ("positioning", "short_interest_chg", "short_change", "lower", 0.25, None, None, None, None, None),
    ("positioning", "short_interest_pct", "short_float", "sweet", 0.20, 0.02, 0.15, None, 0.30, None),
    ("positioning", "days_to_cover", "days_to_cover", "sweet", 0.15, 1, 5, None, 10, None),
    ("positioning", "institutional_pct", "institutions", "sweet", 0.20, 0.30, 0.85, None, None, None),
    ("positioning", "insider_pct", "insiders", "higher", 0.10, None, None, None, None, None),
    ("positioning", "net_flow_signal", "net_flow", "higher", 0.10, None, None, None, None, None),
    ("sentiment_catalyst", "adv_usd_m", "adv_musd", "higher", 0.15, None, None, None, None, 50),
    ("sentiment_catalyst", "volume_ratio", "volume_ratio", "sweet", 0.10, 0.9, 1.5, None, None, None),
    ("sentiment_catalyst", "news_count_7d", "news_count", "higher", 0.10, None, None, None, None, None),
    ("sentiment_catalyst", "news_sentiment", "news_sentiment", "higher", 0.20, None, None, None, None, None),
    ("sentiment_catalyst", "stocktwits_bullish", "bullish_share", "sweet", 0.10, 0.20, 0.50, None, None, None),
    ("sentiment_catalyst", "stocktwits_volume", "messages", "sweet", 0.05, 50, 500, None, 2000, None),
    ("sentiment_catalyst", "analyst_upside", "target_upside", "higher", 0.10, None, None, None, None, None),
    ("sentiment_catalyst", "event_window", "event_window", "higher", 0.10, None, None, None, None, None),
    ("macro_regime", "macro_regime_score", "macro_score", "higher", 0.25, None, None, None, None, None),
    ("macro_regime", "bear_risk_score", "bear_risk", "lower", 0.20, None, None, None, None, None),
    ("macro_regime", "regime_confidence", "regime_confidence", "higher", 0.10, None, None, None, None, None),
    ("macro_regime", "sector_fit", "sector_fit", "higher", 0.30, None, None, None, None, None),
    ("macro_regime", "credit_stress", "credit_stress", "lower", 0.15, None, None, None, None, None),
    ("seasonality", "month_of_year_drift", "month_drift", "higher", 0.50, None, None, None, None, None),
    ("seasonality", "earnings_window_drift", "earnings_drift", "higher", 0.50, None, None, None, None, None),
]
#: Scores of a setup; other setups score 50.
SETUPS = {"breakout": 100, "pullback_retest": 95, "continuation": 70, "reversal": 50, "range_approach": 50, "mean_reversion": 30, "unavailable": 40}

#: The variant without fundamentals, for backtests.
TECHNICAL_FACTORS = [("sentiment_catalyst", 0.1), ("setup_quality", 0.4), ("technical_momentum", 0.35), ("volatility_regime", 0.15)]
TECHNICAL = [
    ("sentiment_catalyst", "adv_usd_m", "adv_musd", "higher", 0.4, None, None, None, None, 50),
    ("sentiment_catalyst", "analyst_upside", "target_upside", "higher", 0.3, None, None, None, None, None),
    ("sentiment_catalyst", "volume_ratio", "volume_ratio", "sweet", 0.3, 0.9, 1.5, None, None, None),
    ("setup_quality", "dist_50d_atr", "dist_50d_atr", "sweet", 0.15, 0, 2, None, 5, None),
    ("setup_quality", "range_percentile", "range_pctile", "sweet", 0.25, 30, 70, 10, 90, None),
    ("setup_quality", "room_to_resist", "room_atr", "sweet", 0.2, 1, 5, None, None, None),
    ("setup_quality", "setup_type", "setup", "lookup", 0.4, None, None, None, None, None),
    ("technical_momentum", "dist_200d_ma_pct", "dist_200d", "higher", 0.1, None, None, None, None, None),
    ("technical_momentum", "dist_50d_ma_pct", "dist_50d", "higher", 0.2, None, None, None, None, None),
    ("technical_momentum", "rs_20d", "rs_1m", "higher", 0.2, None, None, None, None, None),
    ("technical_momentum", "rs_60d", "rs_3m", "higher", 0.2, None, None, None, None, None),
    ("technical_momentum", "rsi_14", "rsi", "sweet", 0.15, 50, 70, 30, 80, None),
    ("technical_momentum", "trend_slope", "slope_50d", "higher", 0.15, None, None, None, None, None),
    ("volatility_regime", "atr_pct_vs_spy", "atr_less_market", "lower", 0.3, None, None, None, None, None),
    ("volatility_regime", "max_dd_60d", "max_dd_60d", "lower", 0.3, None, None, None, None, None),
    ("volatility_regime", "vol_ratio", "vol_ratio", "lower", 0.4, None, None, None, None, None),
]
#: What the contrarian variant turns round: these sub-metrics, the range of rsi_14, and the setups' scores.
TURNED = ("dist_200d_ma_pct", "dist_50d_ma_pct", "rs_20d", "rs_60d", "trend_slope")
CONTRARIAN_RSI = (30, 50)
CONTRARIAN_SETUPS = {"breakout": 30, "pullback_retest": 50, "continuation": 40, "reversal": 95, "range_approach": 70, "mean_reversion": 100, "unavailable": 40}

#: What is added to a factor's weight in each kind of regime.
TILTS = {
    "defensive": {"valuation": 0.05, "quality_growth": 0.05, "technical_momentum": -0.03, "earnings_catalyst": 0.02, "macro_regime": 0.05},
    "offensive": {"technical_momentum": 0.03, "earnings_catalyst": 0.02, "valuation": -0.02},
}
CANDIDATE_MIN, AVOID_MAX = 70, 30


def variants() -> list[tuple]:
    """(variant, factor, factor_weight, sub_metric, field, kind, weight, low, high, below, above, floor) of all variants."""
    def rows(name: str, factors: list[tuple], subs: list[tuple]) -> list[tuple]:
        of = dict(factors)
        return [(name, f, of[f], sub, field, kind, w, *(None if x is None else float(x) for x in rest)) for f, sub, field, kind, w, *rest in subs]

    turned = []
    for f, sub, field, kind, w, low, high, below, above, floor in TECHNICAL:
        if sub in TURNED:
            kind = "lower"
        if sub == "rsi_14":
            low, high = CONTRARIAN_RSI
        turned.append((f, sub, field, kind, w, low, high, below, above, floor))
    return rows("default", FACTORS, SUB_METRICS) + rows("technical", TECHNICAL_FACTORS, TECHNICAL) + rows("contrarian", TECHNICAL_FACTORS, turned)


def setup_scores() -> list[tuple]:
    """(variant, setup, setup_score)."""
    return [(v, s, float(x)) for v, of in (("default", SETUPS), ("technical", SETUPS), ("contrarian", CONTRARIAN_SETUPS)) for s, x in of.items()]
