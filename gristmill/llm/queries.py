"""The registered queries of the text operators: thin digests of their outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, centroids, chat_format, decontaminate, fingerprints, license_scan, ngram_join, pii, token_alignment, token_counts, token_files, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """What cuts a text into pre-tokens."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_budget(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), 1024)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.shared_folder(spark)
    token_files.write_token_files(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), 2, folder)
    return token_files.read_token_files(spark, folder)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_documents(spark, sf_dir), pii.train(pii.labelled_table(spark)))


#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged_by_rules_and_model(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(_documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


#: A conversation whose texts are themselves control strings.
QUOTED = -7, "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = spark.createDataFrame([(QUOTED[0], i, role, QUOTED[1]) for i, role in enumerate(("user", "assistant"))], rows.schema)
    return chat_format.read_back(chat_format.formatted(rows.unionByName(quoted)), in_order=True)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 40, 5, 64, 256, "2:")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_files": op4_token_files,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_fingerprints": op7_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_decontamination": op10_decontamination,
    "op11_chat_format": op11_chat_format,
    "op12_centroids": op12_centroids,
    "op13_token_alignment": op13_token_alignment,
}

_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"

_OP11 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({QUOTED[0]}, 0, 'user', '{QUOTED[1]}'), ({QUOTED[0]}, 1, 'assistant', '{QUOTED[1]}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST][/INST]</s>') + 1 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def _op12(k: int = 40, rounds: int = 5) -> str:
    """Each round is two steps: the nearest centroid of every vector, then the floors of the means."""
    steps = ["""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c
  FROM (SELECT v, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, v LIMIT {k}))"""]  # fmt: skip
    near = """a{i} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'distance': d, 'cluster': cluster}}) AS best FROM (
    SELECT row, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM (SELECT *, row_number() OVER () AS row FROM v) CROSS JOIN c{i}) GROUP BY row)"""
    mean = """c{j} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY p) AS m FROM (
      SELECT best.cluster AS cluster, p, sum(v[p]) AS s, count(*) AS n
      FROM a{i} CROSS JOIN (SELECT unnest(range(1, 65)) AS p) GROUP BY best.cluster, p) GROUP BY cluster) USING (cluster))"""
    for i in range(rounds):
        steps += [near.format(i=i), mean.format(i=i, j=i + 1)]
    steps.append(near.format(i=rounds))
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.best.cluster AS INTEGER) AS cluster, CAST(a.best.distance AS BIGINT) AS distance,
  CAST(sum(a.best.distance) OVER (PARTITION BY a.best.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.best.cluster = c.cluster"""


ORACLE_SQL: dict[str, str] = {"op11_chat_format": _OP11, "op12_centroids": _op12()}
