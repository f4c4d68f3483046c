"""A training corpus in five stages, from the documents table to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents (doc_id, text, lang, source, n_chars and what else
the table has); rows that a stage keeps are unchanged, except for the masked
texts of the fourth.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import AtomicType

from gristmill.llm import byte_bpe, decontaminate, ngram_join, pii, queries, toxicity
from gristmill.llm._text import checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 8 doesn't call toxic; a row without doc_id is judged by its text too, a null text counts as empty.

    The model learns from labelled rows that are not held out, as in its query;
    rows are then judged one by one, so that nothing is joined or moved.
    """
    return toxicity.kept(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of operator 1: the one whose doc_id names the group.

    Documents without words and rows without doc_id are linked with nothing and
    stay.  Of rows alike in doc_id and text, and of texts under one doc_id that
    fall into one group, one stays; texts under one doc_id that fall into
    different groups are judged apart.
    """
    groups = ngram_join.ngram_jaccard_nodes(docs.select("doc_id", "text")).checkpoint()
    linked = groups.where("n_shingles > 0 and doc_id is not null")
    named = linked.where("doc_id = component_id")
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    alone = docs.where(F.col("doc_id").isNull() | blank)
    worded = docs.where(F.col("doc_id").isNotNull() & ~blank)
    twice = linked.groupBy("doc_id").count().where("count > 1").select("doc_id").checkpoint()
    if twice.isEmpty():
        kept = worded.join(named.select("doc_id").distinct(), "doc_id", "left_semi")
    else:  # sets are made anew and whole rows moved, so only where a doc_id occurs twice
        first = named.groupBy("component").agg(F.min("doc_id").alias("doc_id"), F.min("node").alias("_node")).checkpoint()
        kept = worded.join(twice, "doc_id", "left_anti").join(first.select("doc_id").distinct(), "doc_id", "left_semi")
        own = ngram_join.with_node(worded.join(twice, "doc_id", "left_semi")).join(first, ["doc_id", "_node"], "left_semi")
        order = ["text", *(f.name for f in docs.schema.fields if isinstance(f.dataType, AtomicType))]
        own = own.groupBy("doc_id", "_node").agg(F.min_by(F.struct(*docs.columns), F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(order)))).alias("row"))
        kept = kept.select(docs.columns).unionByName(own.select("row.*"))
    return kept.unionByName(alone).select(docs.columns)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which operator 10 finds no benchmark item; each row is judged by its own text, a null text holds none."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def _unused(name: str, docs: DataFrame) -> str:
    """A column name that docs has not, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans of operator 5 masked in their texts and n_chars counted anew where a text changed.

    A null text stays null; rows stay apart; other columns are as they were.
    """
    was = _unused("length_before", docs)
    masked = pii.masked(docs.withColumn(was, F.char_length("text")), pii.train(pii.labelled_table(spark)))
    if "n_chars" in docs.columns:
        changed = F.col(was) != F.char_length("text")
        masked = masked.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of operator 3: digests of each document's ids and of what they decode to.

    A null or empty text has no ids; rows stay apart, those of one doc_id or none too.
    """
    return byte_bpe.round_trip_digests(docs.select("doc_id", "text"), queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern())


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", near_duplicates_out),
    ("decontamination", contaminated_out),
    ("pii", personal_data_masked),
    ("byte_bpe", token_ids),
]

#: Classifiers, Viterbi and BPE have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the checkpoint folder and read again."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
