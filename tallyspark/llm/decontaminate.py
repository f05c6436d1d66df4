"""Benchmark items inside documents, by size-partitioned MinHash containment.

Test items are short and documents long, so the two are never compared whole.
Items are partitioned by size: class g holds those of g + 1 to 2g distinct
five-word shingles. For each class that occurs, every document is cut into
windows of 3g shingles, one each g, so that a run of up to 2g shingles lies
whole in a window of like size; there containment c means a Jaccard similarity
of at least c g / (3g + (1 - c) g). Items and windows that share one of ``hashes``
minima are candidates (at c = 0.8 a pair is missed with a chance below 1e-4, at
c = 1 below 1e-6), and a candidate counts if the document, as a whole, holds at least
``threshold`` of the item's shingles, counted exactly.

Size bounds: items are taken in blocks of about ``block_shingles`` shingles (8
bytes each); each block is sent to every task, and a larger benchmark makes more
blocks, each a pass over the documents. No pass shuffles documents.

Rows: null or empty texts, on either side, match nothing; an item of one to four
words is one shingle, found only in a document of just these words; null ids
are kept as null; repeated rows are each matched; other columns are ignored; an
empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import staged
from ._words import mix, shingle_hashes, word_hashes

THRESHOLD = 0.8
HASHES = 40
BLOCK_SHINGLES = 500_000


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return seeds[:n], seeds[n:] | np.uint64(1)


class Items:
    """One block of benchmark items: their shingles, and minima by size class."""

    def __init__(self, ids: list, shingles: list[np.ndarray], hashes: int = HASHES, threshold: float = THRESHOLD):
        self.ids, self.threshold = ids, threshold
        self.shingles = [np.unique(s) for s in shingles]
        self.xor, self.times = _seeds(hashes)
        by_class: dict[int, list[int]] = {}
        for i, s in enumerate(self.shingles):
            if len(s):
                by_class.setdefault(1 << max(0, (len(s) - 1).bit_length() - 1), []).append(i)
        self.classes = []
        for g, members in sorted(by_class.items()):
            minima = []
            with np.errstate(over="ignore"):
                for x, t in zip(self.xor, self.times):
                    m = np.asarray([((self.shingles[i] ^ x) * t).min() for i in members], np.uint64)
                    order = np.argsort(m)
                    minima.append((m[order], np.asarray(members)[order]))
            self.classes.append((g, minima))

    def find(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(text, item, containment) of all that reach the threshold."""
        sh, n = shingle_hashes(*word_hashes(texts))
        if not len(sh) or not self.classes:
            return []
        starts = np.cumsum(n) - n
        grids = []
        for g, minima in self.classes:
            blocks = -(-n // g)
            owner = np.repeat(np.arange(len(n)), blocks)
            at = starts[owner] + g * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            grids.append((minima, owner, at, owner[1:] == owner[:-1], owner[2:] == owner[:-2]))
        pairs: set[tuple[int, int]] = set()
        for j in range(len(self.xor)):
            with np.errstate(over="ignore"):
                h = (sh ^ self.xor[j]) * self.times[j]
            for minima, owner, at, next1, next2 in grids:
                low = np.minimum.reduceat(h, at)
                window = low.copy()
                np.minimum(window[:-1], low[1:], out=window[:-1], where=next1)
                np.minimum(window[:-2], low[2:], out=window[:-2], where=next2)
                values, members = minima[j]
                lo = np.searchsorted(values, window, "left")
                hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == window)
                for w in hit.tolist():
                    k = int(lo[w])
                    while k < len(values) and values[k] == window[w]:
                        pairs.add((int(owner[w]), int(members[k])))
                        k += 1
        out = []
        sets: dict[int, np.ndarray] = {}
        for d, i in sorted(pairs):
            if d not in sets:
                sets = {d: np.unique(sh[starts[d]:starts[d] + n[d]])}
            item = self.shingles[i]
            at = np.minimum(np.searchsorted(sets[d], item), len(sets[d]) - 1)
            share = float((sets[d][at] == item).sum()) / len(item)
            if share >= self.threshold - 1e-12:
                out.append((d, i, share))
        return out


def item_blocks(benchmark: DataFrame, block_shingles: int = BLOCK_SHINGLES, **how) -> Iterator[Items]:
    """The benchmark in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sh, n = shingle_hashes(*word_hashes(b["text"].tolist()))
            yield b[["item_id"]].assign(sh=[x.tobytes() for x in np.split(sh, np.cumsum(n)[:-1])], n=n).astype({"item_id": "Int64"})

    items = staged(rows.mapInPandas(run, "item_id long, sh binary, n long").where("n > 0"), "benchmark-shingles")
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_shingles))
    for k in range(blocks if total else 0):
        part = items.where(F.pmod(F.xxhash64("item_id", "sh"), F.lit(blocks)) == k).collect()  # block_shingles x 8 bytes
        yield Items([r["item_id"] for r in part], [np.frombuffer(r["sh"], np.uint64) for r in part], **how)


def _batched(texts: list, find, most_chars: int = 2_000_000):
    from ._shared import text_slabs
    for lo, hi in text_slabs([t or "" for t in texts], most_chars):
        for d, i, share in find(texts[lo:hi]):
            yield lo + d, i, share


def contained_items(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, containment) of every document and item it holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id long, item_id long, containment double")
    for block in item_blocks(benchmark, **how):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids = b["doc_id"].astype("Int64")
                found = list(_batched(b["text"].tolist(), shared.value.find))
                yield pd.DataFrame({"doc_id": ids.take([d for d, _, _ in found]).array,
                                    "item_id": pd.array([shared.value.ids[i] for _, i, _ in found], dtype="Int64"),
                                    "containment": [c for _, _, c in found]})

        out = out.unionByName(rows.mapInPandas(run, "doc_id long, item_id long, containment double"))
    return out


def op3_decontamination(spark, sf_dir) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _clean(shared):
    def clean(texts: pd.Series) -> pd.Series:
        out = np.ones(len(texts), bool)
        for d, _, _ in _batched(texts.tolist(), shared.value.find):
            out[d] = False
        return pd.Series(out)

    return F.pandas_udf(clean, "boolean")


def keep_uncontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item; all their columns."""
    for block in item_blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        docs = docs.where(_clean(spark.sparkContext.broadcast(block))(F.col("text").cast("string")))
    return docs
