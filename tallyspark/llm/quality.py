"""Quality scores by a regularised quadratic discriminant.

Each whole text gives a vector of transformed statistics (lengths, shares of
character classes, repetition of words and lines). Each class has a mean and a
shrunken covariance: (1 - a) of its own and a of the pooled one, then g of the
average variance on the diagonal. The Cholesky factors are computed once and
kept; a score is the logistic of the difference of the two log densities
(Mahalanobis distances and log determinants) and the log ratio of the priors.

The class sums are aggregated over all labelled rows of the training fold; only
those sums (13 + 13 x 13 / 2 numbers a class) reach the driver. Labels, lang,
source and doc_id are never inputs of a score.

Rows: a null or empty text has the statistics of an empty text and is scored
too; a null doc_id is in the training fold; repeated rows are scored each; labels
that are null or neither 0 nor 1 are left out; if the training fold lacks a
class, every score is the share of label 1 there (0.5 without labels). Other
columns are kept or ignored as the caller selects; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import held_out, staged

FEATURES = ["words", "word_len", "upper", "digit", "stop", "symbol", "marked", "distinct", "top", "runs", "lines", "line_rep", "space"]
CUT = 0.3
_CLASS: np.ndarray | None = None
_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _SYMBOL = range(6)


def _classes() -> np.ndarray:
    """Class of each code point, built once per worker from Unicode's tables."""
    global _CLASS
    if _CLASS is None:
        def one(c: str) -> int:
            if c.isalpha():
                return _UPPER if c.isupper() else _LOWER
            if c.isspace():
                return _SPACE
            if c.isnumeric():
                return _DIGIT
            return _STOP if c in ".,;:'\"-?()" else _SYMBOL
        _CLASS = np.fromiter((one(c) for c in map(chr, range(0x110000))), np.uint8, 0x110000)
    return _CLASS


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text, in the order of FEATURES."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    k = np.bincount(_classes()[codes], minlength=6) if n else np.zeros(6)
    letters, words = k[_LOWER] + k[_UPPER], text.split()
    seen = Counter(words)
    w = len(words)
    lines = [x for x in text.split("\n") if x]
    marked = sum(c for x, c in seen.items() if not (x[-1].isalnum() or x[-1] in ".,") or not x[0].isalnum())
    runs = sum(map(str.__eq__, words, words[1:]))
    share = lambda x, of: math.log(1e-3 + x / max(of, 1))
    return [math.log1p(w), math.log1p((n - k[_SPACE]) / max(w, 1)), share(k[_UPPER], letters), share(k[_DIGIT], n),
            share(k[_STOP], n), share(k[_SYMBOL], n), share(marked, w), math.log((len(seen) + 1) / (w + 1)) / (1 + math.log1p(w)),
            share(max(seen.values(), default=0) if w > 20 else 0, w), share(runs, w), math.log1p(len(lines)) - math.log1p(w) / 2,
            share(len(lines) - len(set(lines)), len(lines)), share(k[_SPACE], n)]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the array column ``stats`` in place of the text."""
    rest = [c for c in docs.columns if c != text_col]
    fields = [docs.schema[c] for c in rest]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[rest].assign(stats=[statistics(t) for t in b[text_col]])

    from pyspark.sql.types import ArrayType, DoubleType, StructType
    return docs.mapInPandas(run, StructType(fields).add("stats", ArrayType(DoubleType())))


class Discriminant:
    """Two Gaussians with cached Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], own: float = 0.1, ridge: float = 0.01):
        """moments: class -> (rows, sums, sums of products); own: weight a of the
        pooled covariance; ridge: weight g of the average variance."""
        total = sum(m[0] for m in moments.values())
        self.prior = (moments.get(1, (0,))[0] / total) if total else 0.5
        self.parts: list[tuple[np.ndarray, np.ndarray, float]] = []
        if len(moments) < 2:
            return
        cov = {}
        for c, (n, s, ss) in moments.items():
            mean = s / n
            cov[c] = (mean, ss / n - np.outer(mean, mean))
        pooled = sum(moments[c][0] * cov[c][1] for c in cov) / total
        scale = np.diag(pooled).clip(1e-9)
        for c in (0, 1):
            mean, own_cov = cov[c]
            mixed = (1 - own) * own_cov + own * pooled
            mixed = (1 - ridge) * mixed + ridge * np.diag(scale)
            factor = np.linalg.cholesky(mixed + 1e-12 * np.eye(len(mean)))
            log_det = 2 * np.log(np.diag(factor)).sum()
            self.parts.append((mean, np.linalg.inv(factor), log_det + -2 * math.log(max(moments[c][0], 1) / total)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.prior)
        d = []
        for mean, inverse, constant in self.parts:
            z = (x - mean) @ inverse.T
            d.append(np.einsum("ij,ij->i", z, z) + constant)
        return 1 / (1 + np.exp(np.clip((d[1] - d[0]) / 2, -60, 60)))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fit on the labelled rows outside the evaluation fold."""
    d = len(FEATURES)
    y = labels.select(F.col(id_col).cast("long").alias("y_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    rows = stats.where(~held_out(id_col)).join(y, F.col(id_col) == F.col("y_id")).select("y", *[F.col("stats")[i].alias(f"x{i}") for i in range(d)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    moments = {}
    for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect():  # two rows
        ss = np.zeros((d, d))
        for i, j in pairs:
            ss[i, j] = ss[j, i] = r[f"p{i}_{j}"]
        moments[r["y"]] = (float(r["n"]), np.asarray([r[f"s{i}"] for i in range(d)]), ss)
    return Discriminant(moments)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``stats`` with score and predicted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.scores(np.stack(b["stats"].to_list())) if len(b) else np.empty(0)
            yield b.drop(columns="stats").assign(score=s, predicted=(s >= CUT).astype(np.int32))

    from pyspark.sql.types import DoubleType, IntegerType, StructType
    out = StructType([f for f in stats.schema.fields if f.name != "stats"]).add("score", DoubleType()).add("predicted", IntegerType())
    return stats.mapInPandas(run, out)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = staged(with_statistics(rows), "quality-stats")
    out = score(stats, fit(stats, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_quality(spark, sf_dir) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier, trained on the labels
    of the documents given, does not reject; all their columns."""
    text = F.col("text").cast("string")
    names = list(docs.columns)
    # One pass over the texts; what the stage returns is scored in the same row, so no join is needed.
    stats = staged(with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))), "quality-stats")
    model = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def good(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=bool)
        return pd.Series(model.scores(np.asarray([statistics(t) for t in texts])) >= CUT)

    return docs.where(F.pandas_udf(good, "boolean")(text)).select(*names)
