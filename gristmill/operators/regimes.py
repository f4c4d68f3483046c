"""Volatility regimes: states fitted to features of returns, and their smoothed probabilities."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import indicators as I

#: Bars that a task smooths at once; a longer history is so many blocks.
BLOCK = 256
NAMES = ("low_vol", "mid_vol", "high_vol")


@dataclass(frozen=True)
class States:
    """Gaussian states, ordered by the mean of the first feature, with the chain between them."""

    columns: tuple[str, ...]
    means: np.ndarray
    covariances: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    log_likelihood: float
    n: int

    @property
    def parameters(self) -> int:
        """Free parameters: moves, means and full covariances."""
        k, d = self.means.shape
        return k * (k - 1) + k * d + k * d * (d + 1) // 2

    @property
    def aic(self) -> float:
        return 2 * self.parameters - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return self.parameters * math.log(max(self.n, 1)) - 2 * self.log_likelihood


def densities(x: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(densities of each row under each state, divided by the row's largest; the logarithm of that one)."""
    logs = np.empty((len(x), len(means)))
    for i, (mean, cov) in enumerate(zip(means, covariances, strict=True)):
        away = x - mean
        logs[:, i] = -0.5 * ((away @ np.linalg.inv(cov) * away).sum(1) + np.linalg.slogdet(cov)[1] + len(mean) * math.log(2 * math.pi))
    top = logs.max(1)
    return np.exp(logs - top[:, None]), top


def fit_states(rows: DataFrame, columns: Sequence[str] = ("rv", "cum", "moved"), k: int = 3, seed: int = 7, iterations: int = 30, ridge: float = 1e-9) -> States:
    """DOM33: a Gaussian mixture of rows(symbol, d, columns) over all symbols, and the moves that its most likely states make.

    A mixture and counted moves, not a chain fitted by expectation over paths:
    means and covariances come from one pass over the rows for each iteration,
    moves from one window.  One is added to each count, so that no move is
    impossible.  The likelihood is the mixture's.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    known = rows.dropna(subset=list(columns))
    assembled = VectorAssembler(inputCols=list(columns), outputCol="_raw").transform(known)
    scaler = StandardScaler(inputCol="_raw", outputCol="_x").fit(assembled)
    scaled = scaler.transform(assembled)
    model = GaussianMixture(k=k, seed=seed, maxIter=iterations, featuresCol="_x", predictionCol="_state", probabilityCol="_p").fit(scaled)
    scale = np.array(scaler.std.toArray())
    scale[scale == 0] = 1.0
    gaussians = model.gaussiansDF.collect()  # k rows
    means = np.array([g["mean"].toArray() for g in gaussians]) * scale
    covs = np.array([g["cov"].toArray() for g in gaussians]) * np.outer(scale, scale) + np.eye(len(columns)) * ridge
    order = np.argsort(means[:, 0], kind="stable")
    place = {int(old): new for new, old in enumerate(order)}
    by = Window.partitionBy("symbol").orderBy("d")
    states = model.transform(scaled).select("symbol", "d", F.col("_state").alias("to"), F.lag("_state").over(by).alias("of"))
    start, moves, n = np.ones(k), np.ones((k, k)), 0
    for r in states.groupBy("of", "to").agg(F.count("*").alias("n")).collect():  # k x (k + 1) rows
        n += r["n"]
        if r["of"] is None:
            start[place[r["to"]]] += r["n"]
        else:
            moves[place[r["of"]], place[r["to"]]] += r["n"]
    likelihood = float(model.summary.logLikelihood) - n * float(np.log(scale).sum())
    return States(tuple(columns), means[order], covs[order], start / start.sum(), moves / moves.sum(1, keepdims=True), likelihood, n)


def _matrix(dens: np.ndarray, moves: np.ndarray, first: bool) -> np.ndarray:
    """What a block does to a forward vector, up to scale: the product of moves and densities of its rows."""
    out = np.eye(len(moves))
    for t, row in enumerate(dens):
        out = (out if first and t == 0 else out @ moves) * row
        out /= out.max()
    return out


def _inside(dens: np.ndarray, moves: np.ndarray, ahead: np.ndarray, behind: np.ndarray, first: bool) -> np.ndarray:
    """Smoothed probabilities of a block's rows from the forward vector before it and the backward vector after it."""
    n, k = dens.shape
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    v = ahead
    for t in range(n):
        v = (v if first and t == 0 else v @ moves) * dens[t]
        alpha[t] = v = v / v.sum()
    v = behind
    for t in range(n - 1, -1, -1):
        beta[t] = v
        v = moves @ (dens[t] * v)
        v = v / v.sum()
    p = alpha * beta
    return p / p.sum(1, keepdims=True)


def smoothed(rows: DataFrame, states: States, block: int = BLOCK) -> DataFrame:
    """DOM33: (symbol, d, state, p, probabilities, duration) of rows(symbol, d, columns): the smoothed state of each bar, how likely it is, and for how many bars it has lasted.

    A two-level scan: each block of a symbol's bars is summed up in a k x k
    matrix, the matrices, one for each block, are multiplied along the symbol
    from both ends, and each block is then smoothed on its own between the
    vectors that it is given.  No task holds more than a block of bars, or a
    symbol's blocks.  Rows without a feature are left out.
    """
    columns = list(states.columns)
    means, covs, moves, start = states.means, states.covariances, states.moves, states.start
    numbered = rows.dropna(subset=columns).select("symbol", "d", *columns).withColumn("_block", F.floor((F.row_number().over(I.in_order()) - 1) / block))

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        at = int(pdf["_block"].iloc[0])
        dens, _ = densities(pdf[columns].to_numpy(float), means, covs)
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "_block": [at], "m": [_matrix(dens, moves, at == 0).ravel().tolist()]})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        k = len(start)
        each = [np.array(m).reshape(k, k) for m in pdf["m"]]
        ahead, behind = [start], [np.ones(k)]
        for m in each[:-1]:
            v = ahead[-1] @ m
            ahead.append(v / v.sum())
        for m in each[:0:-1]:
            v = m @ behind[-1]
            behind.append(v / v.sum())
        return pd.DataFrame({"symbol": pdf["symbol"], "_block": pdf["_block"], "ahead": [v.tolist() for v in ahead], "behind": [v.tolist() for v in behind[::-1]]})

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        dens, _ = densities(pdf[columns].to_numpy(float), means, covs)
        p = _inside(dens, moves, np.array(pdf["ahead"].iloc[0]), np.array(pdf["behind"].iloc[0]), int(pdf["_block"].iloc[0]) == 0)
        return pd.DataFrame({"symbol": pdf["symbol"], "d": pdf["d"], "state": p.argmax(1).astype("int32"), "p": p.max(1), "probabilities": p.tolist()})

    summed = numbered.groupBy("symbol", "_block").applyInPandas(sum_up, "symbol string, _block long, m array<double>")
    carried = summed.groupBy("symbol").applyInPandas(scan, "symbol string, _block long, ahead array<double>, behind array<double>")
    got = numbered.join(carried, ["symbol", "_block"]).groupBy("symbol", "_block").applyInPandas(inside, "symbol string, d date, state int, p double, probabilities array<double>")
    return I.run_lengths(got, "state")


def regimes_now(smooth: DataFrame) -> DataFrame:
    """DOM33: each symbol's regime at its last bar: name, probability of each state, and bars that it has lasted."""
    last = smooth.groupBy("symbol").agg(F.max_by(F.struct("d", "state", "p", "probabilities", "duration"), "d").alias("x")).select("symbol", "x.*")
    name = F.get(F.array(*map(F.lit, NAMES)), F.col("state"))
    return last.select("symbol", "d", name.alias("regime"), F.round("p", 6).alias("confidence"), "duration", *(F.round(F.col("probabilities")[i], 6).alias(f"p_{n}") for i, n in enumerate(NAMES)))


def by_terciles(rows: DataFrame, column: str = "rv") -> DataFrame:
    """rows with state 0, 1 or 2 by the terciles of a column over all rows: regimes that need no fit."""
    cut = rows.agg(F.round(F.percentile(column, 1 / 3), 6).alias("_low"), F.round(F.percentile(column, 2 / 3), 6).alias("_high"))  # one row
    state = F.when(F.col(column) <= F.col("_low"), 0).when(F.col(column) <= F.col("_high"), 1).otherwise(2)
    return rows.join(F.broadcast(cut)).withColumn("state", state).drop("_low", "_high")
