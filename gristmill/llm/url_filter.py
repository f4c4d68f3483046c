"""URL filters (operator 6), in DataFrame functions and Spark ML only.

Rules decide by host suffix and path prefix, the longest first.  Other URLs are
judged by logistic regression on hashed character n-grams of host and path,
trained from a small labelled URL table.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FEATURES = 1 << 12
SIZES = (3, 4)
#: URLs allowed by a rule that the query's model learns from, at most.
SAMPLE = 2000
SEED_WEIGHT = 3.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Parts of the small labelled URL table: hosts and paths that a reviewer would block or allow.
BLOCK_WORDS = "spam casino porn adult xxx viagra pills betting lottery warez crack phishing malware clickbait escort replica-watches link-farm free-money payday-loan torrent".split()
ALLOW_WORDS = "news library museum university school science history garden travel recipes weather health docs research archive forum blog journal music sports".split()
PATHS = ("/", "/en/about", "/fr/12", "/de/page/3", "/es/index.html", "/articles/2020/05")


def parts(url: Column | str) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without "://"."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages(host, path, ...) with rule and ruled: the longest rule (verdict, host, path) that fits, else null.

    A rule fits its host and every subdomain where the path starts with the
    rule's.  Of equally long rules the last in string order counts.  The rules
    are part of the plan; a list of up to some hundred is meant.
    """
    if not rules:
        return pages.withColumn("rule", F.lit(None).cast("string")).withColumn("ruled", F.lit(None).cast("string"))
    every = F.array(*(F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules))
    fits = F.filter(every, lambda r: F.col("path").startswith(r["p"]) & ((F.col("host") == r["h"]) | F.col("host").endswith(F.concat(F.lit("."), r["h"]))))
    return pages.withColumn("_rule", F.array_max(fits)).withColumn("rule", F.col("_rule.rule")).withColumn("ruled", F.col("_rule.verdict")).drop("_rule")


def with_features(pages: DataFrame) -> DataFrame:
    """pages(host, path, ...) with features: counts of hashed character n-grams, host and path apart."""
    marked = [F.concat(F.lit("h^"), F.col("host"), F.lit("$")), F.concat(F.lit("p^"), F.col("path"), F.lit("$"))]

    def grams(text: Column, n: int) -> Column:
        # the n-gram with its field's letter before it
        return F.transform(F.sequence(F.lit(2), F.greatest(F.char_length(text) - n + 1, F.lit(2))), lambda i: F.concat(F.substr(text, F.lit(1), F.lit(1)), F.substr(text, i, F.lit(n))))

    pages = pages.withColumn("_h", marked[0]).withColumn("_p", marked[1])
    pages = pages.withColumn("_grams", F.concat(*(grams(F.col(c), n) for c in ("_h", "_p") for n in SIZES)))
    return HashingTF(numFeatures=FEATURES, inputCol="_grams", outputCol="features").transform(pages).drop("_h", "_p", "_grams")


def seed_table(spark: SparkSession) -> DataFrame:
    """(url, label, weight): the small labelled table; label 1 is block."""
    rows = []
    for label, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)):
        for i, w in enumerate(words):
            for j, top in enumerate(("com", "org", "net")):
                rows.append((f"https://{('www.', '', 'm.')[j]}{w}-{('site', 'hub', 'online')[(i + j) % 3]}.{top}{PATHS[(i + j) % len(PATHS)]}", label, SEED_WEIGHT))
                rows.append((f"http://{w}.example.{top}{PATHS[(i + j + 3) % len(PATHS)]}", label, SEED_WEIGHT))
    return spark.createDataFrame(rows, "url string, label int, weight double")


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """A model from labelled(url, label, weight); rows without url or label are left out."""
    host, path = parts("url")
    rows = labelled.where("url is not null and label is not null").select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))
    return LogisticRegression(maxIter=40, regParam=0.01, weightCol="weight").fit(with_features(rows).coalesce(1))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], model: LogisticRegressionModel) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages(page_id, url).

    score: the model's probability of block.  verdict: the rule's, else block
    from 0.5 on.  A null URL or one without "://" has empty host and path.
    Rows stay apart; no shuffle.
    """
    host, path = parts("url")
    rows = with_rule(pages.select("page_id", host.alias("host"), path.alias("path")), rules)
    rows = model.transform(with_features(rows)).withColumn("score", vector_to_array("probability")[1])
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def judged_by_rules_and_model(pages: DataFrame, rules: list[tuple[str, str, str]], sample: int = SAMPLE) -> DataFrame:
    """judged() with a model trained from the seed table and at most sample distinct URLs of pages that a rule allows.

    The seed table alone says what to block: a rule against a section of a site
    tells nothing about other sites.
    """
    host, path = parts("url")
    ruled = with_rule(pages.select("url", host.alias("host"), path.alias("path")), rules).where("ruled = 'allow' and url is not null")
    ruled = ruled.select("url", F.lit(0).alias("label"), F.lit(1.0).alias("weight")).distinct()
    rows = ruled.orderBy(F.xxhash64("url"), "url").limit(sample).collect()  # the sample's size is a parameter
    known = pages.sparkSession.createDataFrame(rows, ruled.schema).union(seed_table(pages.sparkSession))  # so that the fit doesn't read pages again
    return judged(pages, rules, train(known))
