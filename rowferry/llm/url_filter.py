"""URL filters: rules by host and path, and boosted trees on lexical features for the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.scratch import stored

# The rules in force, host and path together.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Labelled urls of each verdict that the trees learn from, at most.
TRAINING_ROWS = 5_000
TREES, DEPTH, STEP = 20, 4, 0.2

FEATURES = (
    "n_url", "n_host", "n_path", "depth", "n_labels", "n_hyphens", "digits", "host_digits", "entropy",
    "n_params", "n_query", "has_fragment", "secure", "longest_label", "suffix_blocked", "suffix_seen",
)


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ? or #; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. Of rules as long, the first in order of text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True)[::-1]:
        of_host, slash, of_path = text.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    of_one = lambda c: (n - F.length(F.replace(text, c))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda total, c: total - F.when(c == "", 0.0).otherwise(of_one(c) * F.log2(of_one(c))))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict, suffix and the features of each url's text."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select("page_id", url.alias("u"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"))
    query = F.regexp_extract("u", r"\?([^#]*)", 1)
    share = lambda text: F.regexp_count(text, F.lit("[0-9]")) / F.greatest(F.length(text), F.lit(1))
    labels = F.split("host", r"\.")
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.element_at(labels, -1).alias("suffix"),
        F.length("u").alias("n_url"), F.length("host").alias("n_host"), F.length("path").alias("n_path"),
        F.regexp_count("path", F.lit("/")).alias("depth"), F.size(labels).alias("n_labels"), F.regexp_count("host", F.lit("-")).alias("n_hyphens"),
        share(F.col("u")).alias("digits"), share(F.col("host")).alias("host_digits"), _entropy(F.col("u")).alias("entropy"),
        F.regexp_count(query, F.lit("=")).alias("n_params"), F.length(query).alias("n_query"), F.contains(F.col("u"), F.lit("#")).cast("int").alias("has_fragment"),
        F.startswith(F.col("u"), F.lit("https")).cast("int").alias("secure"),
        F.array_max(F.transform(labels, lambda label: F.length(label))).alias("longest_label"),
    )


def judge(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, blocked (the trees' probability, null without trees).

    Urls that a rule decides are the labels; at most TRAINING_ROWS of each
    verdict, those whose page_id hashes least, are learned from. Where the rules
    leave one verdict or none to learn, other urls get that one, or are allowed.
    Null and empty urls have an empty host and path and are judged like the rest.
    Other columns are not read.
    """
    rows = lexical(pages)
    found = [rows.where(F.col("ruled") == v).orderBy(F.xxhash64("page_id"), "page_id").limit(TRAINING_ROWS) for v in ("allow", "block")]
    labelled = reduce(DataFrame.unionByName, found).withColumn("label", (F.col("ruled") == "block").cast("double"))
    labelled, _ = stored(spark, labelled, "labelled-urls")
    # As many suffixes as training rows at most, so the table of them may be sent to all.
    suffixes = labelled.groupBy("suffix").agg(((F.sum("label") + 1) / (F.count("*") + 2)).alias("suffix_blocked"), F.log1p(F.count("*")).alias("suffix_seen"))
    seen = {row.label for row in labelled.select("label").distinct().collect()}
    verdict = lambda blocked: F.coalesce("ruled", F.when(blocked, "block").otherwise("allow"))
    if len(seen) < 2:
        return rows.select("page_id", "host", "path", "rule", verdict(F.lit(seen == {1.0})).alias("verdict"), F.lit(None).cast("double").alias("blocked"))

    def described(df: DataFrame) -> DataFrame:
        known = df.join(F.broadcast(suffixes), "suffix", "left").fillna({"suffix_blocked": 0.5, "suffix_seen": 0.0})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known)

    # One partition: sums of few rows then have one order, and runs agree.
    training = described(labelled).select("features", "label", "page_id").coalesce(1).sortWithinPartitions("page_id")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=6, checkpointInterval=-1).fit(training)
    judged = trees.transform(described(rows)).withColumn("blocked", vector_to_array("probability")[1])
    return judged.select("page_id", "host", "path", "rule", verdict(F.col("blocked") >= 0.5).alias("verdict"), "blocked")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
