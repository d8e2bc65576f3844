"""URL verdicts: explicit rules first, else gradient-boosted trees on lexical features.

Rules name a host and a path prefix; a rule fits its host and all subdomains, the longest that fits
wins. Other URLs get the verdict of boosted trees over length, depth, digit ratio, entropy, parameter
counts, host shape and suffix statistics. The trees learn from labelled URLs, at most
``max_labelled`` distinct ones; the suffix statistics come from one half of the hosts, the trees from the
other, so a suffix's rate never contains the row that it describes. The rates, at most one for each URL
learned from, are joined to the rows.

All of it is column expressions and Spark's own tree ensemble: no Python runs on the executors.

Edge cases: a null URL and one without ``://`` have an empty host and path and fit no rule; the trees
judge them like any other; repeated rows get equal verdicts; labels of only one kind make that kind
the verdict of all; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
MAX_RULES = 1_000
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
# Host words that mark a URL as unwanted where no better labels are given.
SEED_WORDS = ["ads", "adult", "bet", "bets", "casino", "cheap", "farm", "free", "pills", "porn", "poker", "spam", "track", "win", "xxx"]

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "host_digits", "host_entropy", "path_entropy", "parameters", "host_hyphens", "host_labels", "longest_label", "last_word_rate", "suffix_rate"]


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def with_parts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    return urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that fits ``host`` and ``path`` best, as text and as verdict; nulls if none does. At most MAX_RULES rules."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(F.transform(chars, share), F.lit(0.0), lambda total, p: total - p * F.log2(p))


def with_features(parts: DataFrame, url_col: str = "url") -> DataFrame:
    """Numeric columns from the text alone, and the two suffixes whose rates are looked up."""
    url, host, path = F.coalesce(F.col(url_col), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    labels = F.split(host, r"\.")
    return parts.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "depth": F.length(F.regexp_replace(path, "[^/]", "")).cast("double"),
            "digit_ratio": digits(url) / F.greatest(F.length(url), F.lit(1)),
            "host_digits": digits(host).cast("double"),
            "host_entropy": _entropy(host),
            "path_entropy": _entropy(path),
            "parameters": F.when(query == "", 0.0).otherwise(F.length(F.regexp_replace(query, "[^&]", "")) + 1.0),
            "host_hyphens": F.length(F.regexp_replace(host, "[^-]", "")).cast("double"),
            "host_labels": F.size(labels).cast("double"),
            "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
            "last_word": F.regexp_extract(host, r"([^.-]*)(?:\.[^.]*){0,2}$", 1),
            "suffix": F.regexp_extract(host, r"([^.]*)$", 1),
        }
    )


class UrlFilter:
    """Boosted trees and the suffix rates they were fitted with: rows of at most ``MAX_LABELLED`` values for each kind of suffix."""

    def __init__(self, model: PipelineModel | None, constant: float, rates: dict[str, DataFrame], prior: float):
        self.model, self.constant, self.rates, self.prior = model, constant, rates, prior

    def _with_rates(self, rows: DataFrame) -> DataFrame:
        for column, table in self.rates.items():
            # bounded by the labelled URLs it was counted from
            rows = rows.join(F.broadcast(table.withColumnRenamed("rate", f"{column}_rate")), column, "left").fillna(self.prior, [f"{column}_rate"])
        return rows

    def chance(self, parts: DataFrame, url_col: str = "url") -> DataFrame:
        """``parts`` (with host and path) with ``block_chance``; their other columns stay whatever their names."""
        if self.model is None:
            return parts.withColumn("block_chance", F.lit(self.constant))
        apart = parts.select(F.col(url_col).alias("url"), "host", "path", F.struct(*parts.columns).alias("row_as_given"))
        scored = self.model.transform(self._with_rates(with_features(apart)))
        return scored.select(*(F.col("row_as_given").getField(c).alias(c) for c in parts.columns), vector_to_array("probability")[1].alias("block_chance"))


def seed_labels(urls: DataFrame, words: list[str] = SEED_WORDS, url_col: str = "url") -> DataFrame:
    """url, label: 1 where a word of the host's labels is one of ``words``, else 0; URLs without a host have no label."""
    host = host_of(F.col(url_col))
    hit = F.arrays_overlap(F.split(host, r"[.\-_]"), F.array(*map(F.lit, words)))
    return urls.where(host != "").select(F.col(url_col).alias("url"), hit.cast("int").alias("label"))


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED, max_iter: int = 12, max_depth: int = 4, seed: int = 7) -> UrlFilter:
    """Learn from at most ``max_labelled`` distinct labelled URLs, those of the smallest hashes."""
    spark = labelled.sparkSession
    rows = labelled.where("url is not null and label is not null")
    # of a URL with several labels the higher counts
    one = rows.groupBy("url").agg(F.max("label").alias("label"))
    one = one.orderBy(F.xxhash64("url"), "url").limit(max_labelled)
    sample = with_features(with_parts(one)).withColumn("half", F.pmod(F.xxhash64("host", F.lit("half")), F.lit(2)))
    sample = spark.createDataFrame(sample.toArrow())  # bounded by max_labelled; fixes the rows that the two halves hold
    total, blocked = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = (blocked + 1) / (total + 2)
    if blocked in (0, total):
        return UrlFilter(None, float(blocked > 0), {}, prior)
    rates = {}
    for column in ("last_word", "suffix"):
        table = sample.where("half = 0").groupBy(column).agg(((F.sum("label") + 8 * prior) / (F.count(F.lit(1)) + 8)).cast("double").alias("rate"))
        rates[column] = spark.createDataFrame(table.toArrow())  # at most a row for each URL learned from
    fitted = UrlFilter(None, 0.0, rates, prior)
    train = fitted._with_rates(sample.where("half = 1")).select(*FEATURES, F.col("label").cast("double").alias("label")).cache()
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth, maxBins=64, seed=seed, checkpointInterval=-1)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    if train.agg(F.countDistinct("label")).first()[0] < 2:
        fitted.constant = float(blocked * 2 > total)
    else:
        fitted.model = PipelineModel([assembler, trees.fit(assembler.transform(train))])
    train.unpersist()
    return fitted


def judge(urls: DataFrame, model: UrlFilter, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """``urls`` with host, path, rule, block_chance and verdict."""
    parts = with_parts(urls.drop("host", "path", "rule", "verdict", "block_chance"), url_col)
    name, said = rule_columns(rules)
    judged = model.chance(parts, url_col)
    by_trees = F.when(F.col("block_chance") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumns({"rule": name, "verdict": F.coalesce(said, by_trees)})
