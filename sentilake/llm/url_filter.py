"""URL filters: host and path rules, and logistic regression on hashed character n-grams. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentilake.llm.common import ascii_lower, own_columns

#: Rule list of the registered query: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MAX_RULES = 1000
BUCKETS = 1 << 16
GRAMS = (3, 4)
LABELLED = 4096


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    found = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(found > 0, F.substr(url, found + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_index(host: Column, path: Column, rules) -> Column:
    """Position of the longest rule that fits, null where none does. Ties: the longer host, then the earlier rule."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are put into the plan")
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0] + rules[i][1]), -len(rules[i][0]), i))
    fits = [
        F.when(((host == rules[i][0]) | host.endswith("." + rules[i][0])) & path.startswith(rules[i][1]), F.lit(i))
        for i in order
    ]
    return F.coalesce(*fits, F.lit(None).cast("int"))


def grams(host: Column, path: Column, lengths: tuple[int, ...] = GRAMS) -> Column:
    """Character n-grams of host and path, marked by their part. A short part is one gram."""

    def of(part: Column, mark: str, n: int) -> Column:
        chars = F.split(F.concat(F.lit("^"), part, F.lit("$")), "")
        chars = F.array_remove(chars, "")
        starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.array_join(F.slice(chars, i, n), "")))

    return F.concat(*[of(part, mark, n) for part, mark in ((host, "h"), (path, "p")) for n in lengths])


@dataclass(frozen=True)
class UrlModel:
    """A fitted model, or a constant verdict where the labelled table held one class or none."""

    buckets: int
    fitted: LogisticRegressionModel | None
    constant: float

    def probability(self, df: DataFrame, url: str, output: str) -> DataFrame:
        """Add the probability of ``block``."""
        if self.fitted is None:
            return df.withColumn(output, F.lit(self.constant))
        vectors = _vectors(df, F.col(url), self.buckets)
        scored = self.fitted.transform(vectors)
        return scored.withColumn(output, vector_to_array("_p")[1]).drop("_grams", "_vector", "_raw", "_p", "_label")


def _vectors(df: DataFrame, url: Column, buckets: int) -> DataFrame:
    named = df.withColumn("_grams", grams(host_of(url), path_of(url)))
    return HashingTF(numFeatures=buckets, binary=True, inputCol="_grams", outputCol="_vector").transform(named)


def labelled_urls(judged: DataFrame, url: str, block: Column, limit: int = LABELLED) -> DataFrame:
    """The small labelled table: up to ``limit / 2`` distinct URLs of each verdict, in hash order.

    ``limit`` is the documented bound of the training sample; every other URL is scored, none is dropped.
    """
    known = judged.select(F.col(url).alias("url"), block.cast("double").alias("block")).dropna().distinct()
    order = (F.xxhash64("url"), F.col("url"))
    return (
        known.filter("block = 1").orderBy(*order).limit(limit // 2)
        .unionByName(known.filter("block = 0").orderBy(*order).limit(limit // 2))
    )


def fit_url_model(labelled: DataFrame, buckets: int = BUCKETS, reg: float = 1e-4, iterations: int = 100) -> UrlModel:
    """Logistic regression on a small labelled table (url, block 0/1). One class or no row: a constant."""
    classes = sorted(r["block"] for r in labelled.select("block").distinct().collect())
    if len(classes) < 2:
        return UrlModel(buckets, None, classes[0] if classes else 0.0)
    rows = _vectors(labelled, F.col("url"), buckets).select("_vector", "block")
    learner = LogisticRegression(
        featuresCol="_vector", labelCol="block", probabilityCol="_p", rawPredictionCol="_raw",
        predictionCol="_label", regParam=reg, maxIter=iterations,
    )
    return UrlModel(buckets, learner.fit(rows), 0.0)


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, model: UrlModel | None = None, limit: int = LABELLED) -> DataFrame:
    """Add host, path, rule and verdict to every row.

    A rule's verdict stands; URLs that no rule fits get the model's (block from probability 0.5). Without a model one
    is fitted on URLs of this table that a rule judges. Host and path of null or of a text without ``://`` are empty and
    such rows are judged by the model. Result columns replace columns of the same name; repeated rows stay.
    """
    names = [host + path for host, path, _ in rules]
    # The caller's row travels in one column, so that no name of its own meets those used here.
    split = df.select(F.struct(*own_columns(df)).alias("_row"), F.col(url).alias("_url"))
    split = split.withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
    split = split.withColumn("_rule", rule_index(F.col("_host"), F.col("_path"), rules))
    blocked = F.get(F.array(*[F.lit(verdict == "block") for _, _, verdict in rules]), F.col("_rule"))
    if model is None:
        model = fit_url_model(labelled_urls(split.filter("_rule IS NOT NULL"), "_url", blocked, limit))
    scored = model.probability(split, "_url", "_chance")
    verdict = F.when(F.coalesce(blocked, F.col("_chance") >= 0.5), "block").otherwise("allow")
    rule = F.get(F.array(*[F.lit(n) for n in names]), F.col("_rule"))
    results = {"host": F.col("_host"), "path": F.col("_path"), "rule": rule, "verdict": verdict}
    kept = [F.col("_row").getField(c).alias(c) for c in df.columns if c.lower() not in results]
    return scored.select(*kept, *[value.alias(name) for name, value in results.items()])
