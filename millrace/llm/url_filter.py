"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame expressions and Spark ML's DataFrame-based LogisticRegression only; no Python runs on rows.

Defined cases: a null url, or one without `://`, has an empty host and path, matches no rule and is scored on no
n-grams (the intercept decides). Repeated rows are judged alike, very long urls whole; extra columns stay, but columns of
the operator's own names (host, path, rule, verdict, block_probability) are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import let

#: The rules of the contract as (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: The labelled URLs, hosts and paths of either kind.
BLOCKED = [
    "http://spam-farm.example.org/en/1", "https://www.spam-farm.example.com/offers", "https://cheap-pills.example.com/en/450",
    "http://www.cheap-pills.example.net/buy-now", "https://casino-bonus.example.net/win", "http://free-casino.example.com/spins/99",
    "https://adult-cams.example.org/live", "http://xxx-video.example.net/watch/3", "https://click-bait.example.com/you-wont-believe",
    "http://win-prizes.example.org/claim?id=3", "https://fast-loans.example.net/apply-now", "http://replica-watches.example.com/sale",
    "https://blog.spam-farm.example.net/de/72", "https://m.cheap-pills.example.org/fr/8", "http://spam-links.example.com/es/33",
    "https://discount-pills.example.net/en/17", "http://poker-casino.example.org/es/4", "https://link-farm.example.net/fr/61",
    "http://ads-click.example.org/banner/3", "https://ad-track.example.net/pixel?id=9", "http://tracker-ads.example.com/px/22",
    "https://ads-server.example.org/en/4", "http://ads-popunder.example.net/de/31", "https://m.ad-tracking.example.com/fr/6",
    "https://adult-chat.example.com/en/17", "http://adult-dating.example.net/fr/90", "https://www.adult-movies.example.org/es/5",
    "http://blog.adult-video.example.com/de/40", "https://casino-royal.example.net/de/77", "http://www.online-casino.example.com/fr/12",
    "http://casino-slots.example.org/en/3", "https://win-jackpot.example.net/es/8", "http://m.spam-mail.example.org/de/5",
    "https://pills-shop.example.com/es/41", "http://generic-pills.example.net/de/2", "https://www.spam-seo.example.com/en/610",
]
ALLOWED = [
    "https://thther.example.org/en/762", "http://www.ththan.example.net/en/960", "https://blog.thertion.example.org/fr/978",
    "https://m.therou.example.com/de/474.html", "http://ththed.example.org/de/252", "https://news.example.com/2024/05/story",
    "https://docs.example.org/guide/install.html", "http://library.example.net/catalogue/8812", "https://www.university.example.org/research/physics",
    "https://blog.garden.example.com/en/roses", "http://recipes.example.net/fr/soupe", "https://museum.example.org/es/12",
    "https://wiki.example.net/en/Rivers", "http://www.weather.example.com/de/berlin", "https://m.tionsh.example.net/fr/51",
    "https://theatre.example.org/en/season/3", "http://ththble.example.net/es/797", "https://school.example.com/fr/9",
    "http://address-book.example.com/en/14", "https://adventure.example.net/fr/8", "http://www.winter-sports.example.org/de/3",
    "https://window-shop.example.com/es/70", "http://farmers.example.org/en/55", "https://tracks.example.net/de/music/4",
    "http://www.academy.example.com/fr/61", "https://m.roads.example.org/en/2", "http://adults-education.example.net/en/course/7",
    "https://casper.example.com/de/19", "http://mail.example.org/es/inbox", "https://blog.spark.example.net/en/808",
    "http://www.therith.example.com/fr/33", "https://therest.example.org/es/417", "http://m.ionther.example.net/en/91",
    "https://heron.example.com/de/608", "http://blog.andthe.example.org/en/5", "https://hats.example.net/fr/72",
]


def host_of(url: Column) -> Column:
    """Text after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty without `://`."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, lower)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ngrams(host: Column, path: Column, n: int, buckets: int) -> Column:
    """Buckets of the character n-grams of `^host/path$`, separately for host and path."""

    def of(part: Column, salt: int) -> Column:
        def grams(chars: Column) -> Column:
            """Each n characters in a row, or all of fewer; the text is cut once, so a long one costs in proportion to its length."""
            gram = lambda i: F.concat_ws("", *(F.get(chars, i + k) for k in range(n)))
            return F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), gram)

        padded = F.split(F.concat(F.lit("^"), part, F.lit("$")), "", -1)
        hashed = F.transform(let(F.filter(padded, lambda c: c != ""), grams), lambda g: F.pmod(F.xxhash64(g, F.lit(salt)), F.lit(buckets)).cast("int"))
        return F.when(F.char_length(part) > 0, hashed).otherwise(F.array().cast("array<int>"))

    return F.concat(of(host, 1), of(path, 2))


def train(spark: SparkSession, n: int, buckets: int, blocked: list[str], allowed: list[str]) -> tuple[list[float], float]:
    """Weights per bucket and intercept; the labelled table is small and fixed, the weights are `buckets` doubles. Each distinct n-gram counts once, as a sparse vector."""
    rows = [(u, 1.0) for u in blocked] + [(u, 0.0) for u in allowed]
    data = spark.createDataFrame(rows, "url string, label double").coalesce(1)
    grams = F.transform(ngrams(host_of(F.col("url")), path_of(F.col("url")), n, buckets), lambda b: b.cast("string"))
    vectors = CountVectorizerModel.from_vocabulary([str(b) for b in range(buckets)], inputCol="grams", outputCol="features").setBinary(True)
    # fit() caches what it is given, so the n-grams are made once
    model = LogisticRegression(maxIter=50, regParam=0.01, standardization=False).fit(vectors.transform(data.select("label", grams.alias("grams"))).select("label", "features"))
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def url_filter(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None, n: int = 4, buckets: int = 4096, threshold: float = 0.5, blocked: list[str] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """pages with host, path, rule, block_probability and verdict. Longest fitting rule wins; without one, block if the model's probability is at least the threshold."""
    weights, intercept = train(pages.sparkSession, n, buckets, blocked or BLOCKED, allowed or ALLOWED)
    table = F.split(F.lit(" ".join(repr(w) for w in weights)), " ").cast("array<double>")  # folded to one constant
    df = pages.drop("host", "path", "rule", "verdict", "block_probability").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    host, path = F.col("host"), F.col("path")
    # Each distinct n-gram counts once, as in training.
    margin = F.aggregate(F.array_distinct(ngrams(host, path, n, buckets)), F.lit(intercept), lambda s, b: s + F.element_at(table, b + 1))
    ordered = sorted(RULES if rules is None else rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    first = lambda values: reduce(lambda acc, fv: F.when(fv[0], F.lit(fv[1])).otherwise(acc), reversed(list(zip(fits, values, strict=True))), F.lit(None).cast("string"))
    df = df.withColumns({"rule": first([h + p for _, h, p in ordered]), "block_probability": 1 / (1 + F.exp(-margin))})
    ruled = first([v for v, _, _ in ordered])
    return df.withColumn("verdict", F.coalesce(ruled, F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", F.round("block_probability", 6).alias("block_probability"))
