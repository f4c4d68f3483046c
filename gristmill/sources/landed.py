"""SRC13: typed records of landed provider files, with what doesn't fit kept beside them.

A provider's answer is a JSON document a line.  It is parsed as a variant, so
fields may be missing, come under another name, be added, or hold numbers as
text.  A specification says which names a field goes by, its type, and whether
a record is of use without it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Field:
    """A column: the JSON names that it goes by, the first that has a value of its type counts."""

    name: str
    kind: str
    names: tuple[str, ...]
    required: bool = False


@dataclass(frozen=True)
class Kind:
    """fields of the document itself; lists: name of a nested list to the value that its records have in the column `of`; items: fields of its records."""

    fields: tuple[Field, ...]
    lists: tuple[tuple[str, str], ...] = ()
    of: str = ""
    items: tuple[Field, ...] = ()


def _f(name: str, kind: str, *names: str, required: bool = False) -> Field:
    return Field(name, kind, (name, *names), required)


# The fields of each provider's answers and the names that they go by.
KINDS = {
    "quote": Kind((_f("symbol", "string", "ticker", required=True), _f("price", "double", "last", "regularMarketPrice", required=True), _f("bid", "double"), _f("ask", "double"), _f("volume", "long", "regularMarketVolume"), _f("quoted_at", "timestamp", "timestamp", "last_timestamp"))),
    "chain": Kind(
        (_f("underlying", "string", "symbol", required=True), _f("expiration", "date", "expiry", "expiration_date", required=True), _f("fetched_at", "timestamp")),
        (("calls", "C"), ("puts", "P")),
        "side",
        (_f("strike", "double", required=True), _f("bid", "double"), _f("ask", "double"), _f("last", "double"), _f("vol", "long", "volume"), _f("oi", "long", "open_interest", "openInterest"), _f("iv", "double", "impliedVolatility"), _f("delta", "double")),
    ),
    "fundamentals": Kind((_f("symbol", "string", required=True), _f("trailing_pe", "double", "trailingPE"), _f("forward_pe", "double", "forwardPE"), _f("market_cap", "double", "marketCap"), _f("shares_short", "long", "sharesShort"), _f("short_ratio", "double", "shortRatio"), _f("institutions", "double", "heldPercentInstitutions"), _f("report_epoch", "long", "earningsTimestamp"), _f("ex_dividend_epoch", "long", "exDividendDate"), _f("target", "double", "targetMeanPrice"), _f("rating", "double", "recommendationMean"))),
    "news": Kind((_f("symbol", "string", "ticker", required=True), _f("text", "string", "title", "headline", required=True), _f("published", "timestamp", "providerPublishTime", "pubDate"), _f("source", "string", "publisher"))),
    "probe": Kind((_f("site", "string", "host", required=True), _f("kind", "string", "class", required=True), _f("url", "string"), _f("status", "int", "status_code", required=True), _f("body", "string", "text"))),
}


def _value(of: str, field: Field) -> Column:
    return F.coalesce(*(F.try_variant_get(of, f"$.{n}", field.kind) for n in field.names)).alias(field.name)


def _tagged(tag: str):
    return lambda v: F.struct(F.lit(tag).alias("tag"), v.alias("item"))


def parsed(lines: DataFrame, kind: Kind | str) -> DataFrame:
    """Records of lines(value): the kind's columns, fault and rescued.

    fault is null for a record of use; else it says what is wrong (malformed
    JSON, a missing list, or the required fields that have no value of their
    type), and rescued has the document or the list's record as it came, so
    that nothing is lost.  A field that can't be read as its type is null.
    Blank lines are left out; a document with lists gives a row for each of
    their records, and none for empty lists.
    """
    k = KINDS[kind] if isinstance(kind, str) else kind
    docs = lines.where(F.trim("value") != "").select("value", F.try_parse_json("value").alias("_doc"))
    docs = docs.select("value", "_doc", *(_value("_doc", f) for f in k.fields))
    needed = list(k.fields)
    if k.lists:
        each = [F.transform(F.try_variant_get("_doc", f"$.{name}", "array<variant>"), _tagged(tag)) for name, tag in k.lists]
        none = F.expr("cast(null as array<struct<tag: string, item: variant>>)")
        found = F.coalesce(*[F.when(e.isNotNull(), F.concat(*(F.coalesce(x, F.expr("cast(array() as array<struct<tag: string, item: variant>>)")) for x in each))) for e in each], none)
        docs = docs.withColumn("_list", found).withColumn("_each", F.explode_outer("_list")).where("_each is not null or _list is null")
        docs = docs.select(*docs.columns, F.col("_each.tag").alias(k.of), F.col("_each.item").alias("_item"))
        docs = docs.select(*docs.columns, *(_value("_item", f) for f in k.items))
        needed += k.items
    missing = F.array_compact(F.array(*(F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in needed if f.required), F.lit(None).cast("string")))
    fault = F.when(F.col("_doc").isNull(), "malformed")
    if k.lists:
        fault = fault.when(F.col("_list").isNull(), "no list")
    fault = fault.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, " ")))
    whole = F.to_json("_item") if k.lists else F.lit(None).cast("string")
    names = [f.name for f in k.fields] + ([k.of, *(f.name for f in k.items)] if k.lists else [])
    return docs.withColumn("fault", fault).select(*names, "fault", F.when(F.col("fault").isNotNull(), F.coalesce(whole, F.col("value"))).alias("rescued"))


def read_landed(spark: SparkSession, path: str, kind: Kind | str) -> DataFrame:
    """parsed() of the JSON lines of a file or folder."""
    return parsed(spark.read.text(path), kind)


def option_chain(records: DataFrame, quotes: DataFrame, tier: Column | None = None) -> DataFrame:
    """FIL4's input from parsed chains and quotes: (underlying, tier, spot, as_of, dte, side, strike, bid, ask, mid, oi, vol, iv) of records without a fault whose underlying is quoted.

    tier: index, etf or stock, an expression of underlying; stock by default.
    """
    spot = quotes.where("fault is null").groupBy(F.col("symbol").alias("underlying")).agg(F.max_by("price", "quoted_at").alias("spot"), F.to_date(F.max("quoted_at")).alias("as_of"))
    df = records.where("fault is null").join(spot, "underlying")
    return df.select("underlying", (F.lit("stock") if tier is None else tier).alias("tier"), "spot", "as_of", F.datediff("expiration", "as_of").alias("dte"), "side", "strike", "bid", "ask", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), F.coalesce("oi", F.lit(0)).alias("oi"), F.coalesce("vol", F.lit(0)).alias("vol"), "iv")
