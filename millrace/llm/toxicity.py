"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - theta_k), with one weight vector for all of the ordered thresholds theta. x holds 1 + ln(tf)
of the words of a text. Weights have an L1 penalty, so most are zero and only a short word list goes to the executors.
The expected severity is the sum of P(grade > k); a text is toxic at an expected severity of `reject` or more.

The labels table knows only toxic or not. Grades of toxic texts come from it by weak supervision: marker words are those
far more frequent in toxic than in clean labelled texts, and a toxic text has grade 1, 2 or 3 by the third of the toxic
texts that its number of markers falls in. fit() takes any ordered grades.

Defined cases: a null or empty text has no words and gets the severity of the thresholds alone. Repeated rows are scored
alike; of labelled rows that repeat a doc_id one trains, that with the least hash of its text. Very long texts are scored
whole. Extra columns stay, columns named severity, grade or toxic are replaced. Without labels of both kinds every
severity is 0. An empty table gives an empty result. Training reads at most MAX_TOXIC and MAX_CLEAN labelled rows, taken
in the order of a hash of their ids, and keeps at most MAX_WORDS words, the most frequent ones: a bound of the classifier
that is fitted, as an unbounded sample would bring unbounded words to the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ROW, enclosed, materialize, small_batches, table

MAX_TOXIC, MAX_CLEAN, MAX_WORDS, MIN_DOCS = 3_000, 7_000, 100_000, 3
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class OrdinalModel:
    """Weights by word and ascending thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def chances(self, text: str | None) -> list[float]:
        """P(grade > k) for each threshold."""
        known = self.weights
        hits = Counter(w for w in words_of(text) if w in known)
        margin = sum(known[w] * (1 + np.log(n)) for w, n in hits.items())
        return [1 / (1 + np.exp(np.clip(t - margin, -500, 500))) for t in self.thresholds]


Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]  # row, column and value of each entry


def loss(x: Sparse, grades: np.ndarray, each: np.ndarray, w: np.ndarray, first: float, gaps: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Log loss without the penalty, and its gradients in the weights, the first threshold and the logarithms of the gaps. each: weight of each row."""
    row, col, val = x
    n, k = len(grades), len(gaps) + 1
    theta = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
    margin = np.bincount(row, val * w[col], n)
    p = 1 / (1 + np.exp(np.clip(theta[None, :] - margin[:, None], -500, 500)))
    # P(grade = j) = p[j-1] - p[j]; gradient of its log with respect to the margin and each threshold
    upper = np.hstack([np.ones((n, 1)), p])[np.arange(n), grades]
    lower = np.hstack([p, np.zeros((n, 1))])[np.arange(n), grades]
    mass = np.maximum(upper - lower, 1e-12)
    d_upper, d_lower = upper * (1 - upper), lower * (1 - lower)
    g_margin = -(d_upper - d_lower) / mass * each
    g_theta = np.zeros((n, k + 2))
    g_theta[np.arange(n), grades] += d_upper / mass * each
    g_theta[np.arange(n), grades + 1] -= d_lower / mass * each
    g_theta = g_theta[:, 1 : k + 1].sum(axis=0)
    g_gaps = np.array([g_theta[j + 1 :].sum() for j in range(k - 1)]) * np.exp(gaps)
    return float(-(np.log(mass) * each).sum()), np.bincount(col, val * g_margin[row], len(w)), float(g_theta.sum()), g_gaps


def fit(x: Sparse, grades: np.ndarray, columns: int, l1: float = 3e-5, rounds: int = 300, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient descent on the cumulative-link log loss; weight: of each row, 1 on average."""
    row, col, val = x
    n, k = len(grades), int(grades.max(initial=0))
    each = (np.ones(n) if weight is None else weight / weight.mean()) / n
    above = (grades[:, None] > np.arange(k)[None, :]).astype(float)
    share = (above * each[:, None]).sum(axis=0).clip(1e-3, 1 - 1e-3)
    theta0 = np.log((1 - share) / share)
    # Thresholds are theta_0, theta_0 + exp(g_1), ...: always in order.
    gaps = np.log(np.maximum(np.diff(theta0), 1e-2))
    w, first = np.zeros(columns), float(theta0[0])
    norm = float((np.bincount(row, val * val, n) * each).sum())
    step = 1.0 / (0.25 * max(norm, 1.0))
    scale = np.bincount(col, val * val * each[row], columns)  # diagonal step sizes: rare words move as fast as frequent ones
    steps = np.minimum(1.0 / np.maximum(0.25 * np.sqrt(scale * norm), 1e-4), 200 * step)
    z, z_first, z_gaps, t = w.copy(), first, gaps.copy(), 1.0
    best, pace, momentum = (np.inf, z, z_first, z_gaps), 1.0, 0.0
    for _ in range(rounds):
        value, g_w, g_first, g_gaps = loss(x, grades, each, z, z_first, z_gaps)
        value += l1 * float(np.abs(z).sum())
        if value <= best[0]:
            best = value, z, z_first, z_gaps
        else:  # go on from the best point: without momentum, or with shorter steps if there was none
            pace, t = pace if momentum else pace / 2, 1.0
            _, z, z_first, z_gaps = best
            w, first, gaps = z, z_first, z_gaps
            _, g_w, g_first, g_gaps = loss(x, grades, each, z, z_first, z_gaps)
        new = z - pace * steps * g_w
        new = np.sign(new) * np.maximum(np.abs(new) - pace * steps * l1, 0)
        new_first = z_first - 2.0 * pace * g_first
        new_gaps = np.clip(z_gaps - 2.0 * pace * g_gaps, -5, 5)
        if np.dot(z - new, new - w) > 0:  # restart when the momentum points uphill
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = (t - 1) / t_new
        z, z_first, z_gaps = new + momentum * (new - w), new_first + momentum * (new_first - first), new_gaps + momentum * (new_gaps - gaps)
        w, first, gaps, t = new, new_first, new_gaps, t_new
    if loss(x, grades, each, w, first, gaps)[0] + l1 * float(np.abs(w).sum()) > best[0]:
        _, w, first, gaps = best
    return w, np.concatenate([[first], first + np.cumsum(np.exp(gaps))])


def weak_grades(counts: Sparse, toxic: np.ndarray, columns: int) -> np.ndarray:
    """0 for clean texts; 1 to 3 for toxic ones, by thirds of their number of marker words. counts: words of each text."""
    row, col, val = counts
    in_toxic = np.bincount(col, toxic[row], columns)
    in_clean = np.bincount(col, 1 - toxic[row], columns)
    rate = (in_toxic + 0.1) / max(toxic.sum(), 1) / ((in_clean + 0.1) / max((1 - toxic).sum(), 1))
    marker = (rate > 20) & (in_toxic >= MIN_DOCS)
    strength = np.bincount(row, val * marker[col], len(toxic))
    low, high = np.quantile(strength[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + (strength > low) + (strength > high), 0)
    return np.unique(grades, return_inverse=True)[1].reshape(-1)  # a third may be empty


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits on a bounded sample of labelled rows; labels: doc_id, toxic."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = dict(known.groupBy((F.col("toxic") > 0).alias("t")).count().collect())  # two rows
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = known.where("toxic > 0").orderBy(*order).limit(MAX_TOXIC).unionByName(known.where("toxic <= 0").orderBy(*order).limit(MAX_CLEAN))
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")

    @F.pandas_udf("map<string,int>")
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: dict(Counter(words_of(t))))

    # Of rows that repeat a doc_id the one with the least hash of its text trains, whatever their order.
    text = F.coalesce("text", F.lit(""))
    with small_batches(spark):
        counted = materialize(marked.select("doc_id", "toxic", F.sha2(text, 256).alias("sha"), counts(text).alias("counts")), "labelled")
    found = counted.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min_by("counts", "sha").alias("counts"))
    vocabulary = found.select(F.explode(F.map_keys("counts")).alias("word")).groupBy("word").count().where(F.col("count") >= MIN_DOCS)
    words = [r[0] for r in vocabulary.orderBy(F.desc("count"), "word").limit(MAX_WORDS).collect()]
    index = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    @F.pandas_udf("struct<at:binary,n:binary>")
    def encode(maps: pd.Series) -> pd.DataFrame:
        rows = [[(index.value[w], n) for w, n in dict(m).items() if w in index.value] for m in maps]
        pack = lambda k: [np.array([r[k] for r in row], "<i4").tobytes() for row in rows]
        return pd.DataFrame({"at": pack(0), "n": pack(1)})

    sampled = found.select("doc_id", "toxic", encode("counts").alias("x")).select("doc_id", "toxic", "x.at", "x.n").toPandas().sort_values("doc_id")
    index.destroy()
    toxic = (sampled["toxic"].to_numpy() > 0).astype(float)
    if not len(words) or not 0 < toxic.sum() < len(toxic):
        return OrdinalModel()
    col, n = (np.frombuffer(b"".join(sampled[c]), "<i4") for c in ("at", "n"))
    row = np.repeat(np.arange(len(sampled), dtype=np.int32), [len(a) // 4 for a in sampled["at"]])
    del sampled
    grades = weak_grades((row, col, n), toxic, len(words))
    # Each class weighs as much as it does among all labelled rows, whatever its share of the sample.
    weight = np.where(toxic == 1, totals[True] / toxic.sum(), totals[False] / (1 - toxic).sum())
    w, thresholds = fit((row, col, (1 + np.log(n)).astype(np.float32)), grades, len(words), weight=weight)
    return OrdinalModel({words[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-9)}, [float(t) for t in thresholds])


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject: float = 0.4) -> DataFrame:
    """docs with severity (expected grade), grade (thresholds with a chance above a half) and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_WORDS words at most

    @F.pandas_udf("struct<severity:double,grade:int>")
    def severity(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            p = [shared.value.chances(t) for t in s]
            yield pd.DataFrame({"severity": [float(sum(x)) for x in p], "grade": [sum(v > 0.5 for v in x) for x in p]})

    df = enclosed(docs.drop("severity", "grade", "toxic")).withColumn("s", severity(F.col(ROW)[text_col]))
    return df.select(f"{ROW}.*", F.col("s.severity").alias("severity"), F.col("s.grade").alias("grade"), (F.col("s.severity") >= reject).alias("toxic"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.round("severity", 6).alias("severity"), "grade", "toxic", (~F.col("toxic")).alias("kept"))
