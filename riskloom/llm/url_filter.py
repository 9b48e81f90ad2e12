"""URL filter: rules first, else logistic regression on hashed character n-grams.

Host and path are cut from the url with SQL functions; their character n-grams
(marked by part) are hashed into a fixed number of slots, and a logistic
regression fitted on a small labelled URL table judges what no rule fits. All of
it runs as DataFrame and SQL functions with Spark's own machine-learning stages:
no shuffle beyond picking the labelled sample, no Python on the executors.

Defined results: a null url or one without ``://`` has empty host and path, fits
no rule and gets the method's verdict; rows with null or repeated ids are judged
like any other; without labels of both classes the method says the only label
known, and allow without labels; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the hashed n-grams, their lengths, and the bound on labelled rows.
SLOTS, SIZES, MAX_LABELLED = 1 << 12, (3, 4, 5), 2000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def best_rule(host_col: Column, path_col: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits.

    ``rules`` are (verdict, host/path) pairs; the list is part of the query. Of
    equally long rules the last wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host_col == rule_host) | host_col.endswith("." + rule_host)) & path_col.startswith(slash + rest)
        # a longer rule, met later, goes before the shorter ones
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, mark: str) -> Column:
    """All n-grams of the text between start and end marks."""
    whole = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(whole) - n + 1),
                            lambda i: F.concat(F.lit(f"{mark}{n}:"), whole.substr(i, F.lit(n))))
        return F.when(F.length(whole) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of_size(n) for n in SIZES))


def features(df: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds ``grams`` and their hashed counts ``features`` to rows with host and path."""
    df = df.withColumn("grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))
    return HashingTF(numFeatures=slots, binary=True, inputCol="grams", outputCol="features").transform(df)


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED, slots: int = SLOTS):
    """Logistic regression on at most ``max_rows`` distinct rows (url, label 0/1; 1 = allow),
    taken in hash order, so a repeated url takes one place; without labels of both classes
    the one label, None without any."""
    rows = (labelled.select("url", "label").filter("url IS NOT NULL AND label IS NOT NULL").distinct()
            .orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
            .select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                    F.col("label").cast("double").alias("label")))
    rows = features(rows, slots).select("features", "label")
    known = sorted(r.label for r in rows.select("label").distinct().collect())
    if len(known) < 2:
        return known[0] if known else None
    return LogisticRegression(maxIter=50, regParam=0.01, tol=1e-5).fit(rows)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None,
                id_col: str = "page_id", url_col: str = "url", max_rows: int = MAX_LABELLED) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict and score (the method's probability of
    allow; null where no model could be fitted).

    ``labelled`` is a table (url, label 0/1). If None, the urls that a rule decides
    are the labelled table.
    """
    url = F.col("url")
    src = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url").select(
        "page_id", "url", host(url).alias("host"), path(url).alias("path"))
    rule, says = best_rule(F.col("host"), F.col("path"), rules)
    judged = src.withColumns({"rule": rule, "says": says})
    if labelled is None:
        labelled = judged.filter("rule IS NOT NULL").select(
            "url", F.when(F.col("says") == "allow", 1).otherwise(0).alias("label"))
    model = train(labelled, max_rows)
    if model is None or isinstance(model, float):
        method = F.lit("block" if model == 0.0 else "allow")
        return judged.select("page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"),
                             F.lit(None).cast("double").alias("score"))
    scored = model.transform(features(judged).drop("grams"))
    score = vector_to_array("probability")[1]
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("says", F.when(score >= 0.5, "allow").otherwise("block")).alias("verdict"),
                         score.alias("score"))
