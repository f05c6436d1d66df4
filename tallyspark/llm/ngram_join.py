"""N-gram Jaccard join by MinHash banding.

Texts with the same words are one text (a class of copies). Each text's set of
five-word shingles gives ``bands`` hashes of ``rows`` minima each; band and row
counts are chosen so that a pair at the threshold shares a band with the target
recall: the most rows (the fewest false candidates) that the hash budget allows.
Texts meet where a band hash is equal. Within a bucket each text is tied to its
smallest member only, so a bucket of any size gives as many ties as members; the
components of these ties are the candidate groups. A group's texts are
compared in blocks of bounded size, all pairs of blocks, on their full shingle sets,
so that every link between different texts is found and counted, and no pair
becomes a row: a block pair returns one row a text.

The result has one row a document: text_id (smallest doc_id with the same words),
class_id (smallest doc_id of the texts connected by links) and n_links (other
texts with a Jaccard similarity of at least ``threshold``).

Rows: a null text, or one without words, is linked to nothing and a class of its
own (its text_id and class_id are its doc_id); a null doc_id is kept and never is
a class id unless the class has no other; repeated rows are copies; other columns are
ignored or, in the pipeline stage, kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import staged, text_slabs
from ._words import mix, shingle_hashes, word_hashes

THRESHOLD = 0.8
RECALL = 0.9995
MOST_HASHES = 128
BLOCK_TEXTS = 256
BLOCK_SHINGLES = 200_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall within the budget."""
    best = (most, 1)
    for rows in range(1, most + 1):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def signatures(texts: list[str | None], bands: int, rows: int) -> list[tuple]:
    """(key1, key2, n_shingles, band hashes) of each text; keys hash its words."""
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
    out: list[tuple] = []
    for lo, hi in text_slabs([t or "" for t in texts], 1_000_000):
        words, counts = word_hashes(texts[lo:hi])
        sh, n = shingle_hashes(words, counts)
        some = n > 0
        minima = np.zeros((len(n), bands), np.uint64)
        keys = np.zeros((len(n), 2), np.uint64)
        if some.any():
            at = (np.cumsum(n) - n)[some]
            with np.errstate(over="ignore"):
                for b in range(bands):
                    got = np.full(int(some.sum()), b, np.uint64)
                    for r in range(rows):
                        k = b * rows + r
                        got = mix(got ^ np.minimum.reduceat((sh ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), at))
                    minima[some, b] = got
                starts = np.cumsum(counts) - counts
                nth = np.arange(len(words), dtype=np.uint64) - np.repeat(starts, counts).astype(np.uint64)
                for k, salt in enumerate((np.uint64(0x51ED270B), np.uint64(0xC2B2AE3D27D4EB4F))):
                    keys[some, k] = np.add.reduceat(mix(words ^ mix(nth + salt)), starts[some])
        minima, keys = minima.view(np.int64), keys.view(np.int64)
        out += [(int(keys[i, 0]), int(keys[i, 1]), int(n[i]), minima[i] if n[i] else []) for i in range(len(n))]
    return out


def _union(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def compare(nodes: list[int], sets: list[np.ndarray], first: int, same: bool, threshold: float) -> list[tuple[int, int, int]]:
    """(node, links, smallest node joined) of two blocks: the first ``first``
    texts against the others or, if both blocks are the ``same``, against each other."""
    n = len(nodes)
    sizes = np.asarray([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max()) + 1, np.int64)
    links, parent = np.zeros(n, np.int64), list(range(n))
    for i in range(first):
        lo = i + 1 if same else first
        if lo >= n:
            break
        own = ids[starts[i]:starts[i] + sizes[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids[starts[lo]:]], starts[lo:] - starts[lo])
        mark[own] = 0
        # |A & B| >= t |A | B|, in whole numbers where t has few decimals
        hit = np.flatnonzero(both >= threshold * (sizes[i] + sizes[lo:] - both) - 1e-9) + lo
        links[i] += len(hit)
        links[hit] += 1
        for j in hit.tolist():
            a, b = _union(parent, i), _union(parent, j)
            if a != b:
                parent[max(a, b, key=lambda x: nodes[x])] = min(a, b, key=lambda x: nodes[x])
    return [(nodes[i], int(links[i]), nodes[_union(parent, i)]) for i in range(n) if links[i]]


def linked_texts(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(texts, links) of ``rows`` (row_id unique, text): texts has row_id and node, the
    smallest row with the same words; links has node, root, n_links of every
    linked node, root being the smallest node connected to it."""
    bands, per_band = choose_bands(threshold, recall)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = signatures(b["text"].tolist(), bands, per_band)
            yield pd.DataFrame({"row_id": b["row_id"], "k1": [x[0] for x in s], "k2": [x[1] for x in s], "n": [x[2] for x in s],
                                "bands": [x[3] for x in s]})

    signed = staged(rows.mapInPandas(sign, "row_id long, k1 long, k2 long, n long, bands array<long>"), "signatures")
    worded = signed.where("n > 0")
    texts = staged(worded.groupBy("k1", "k2").agg(F.min("row_id").alias("node")), "texts")
    members = worded.select("row_id", "k1", "k2").join(texts, ["k1", "k2"]).select("row_id", "node")
    members = members.unionByName(signed.where("n = 0").select("row_id", F.col("row_id").alias("node")))

    # A bucket is a band's hash (the band number is mixed into it).
    heads = signed.join(texts.select(F.col("node").alias("row_id")), "row_id", "left_semi")
    spread = heads.select(F.col("row_id").alias("node"), F.explode("bands").alias("h"))
    buckets = spread.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("h", "low")
    ties = spread.join(buckets, "h").where("node > low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    groups = components(ties).withColumnRenamed("root", "grp")

    # Blocks of bounded size within each candidate group, and all pairs of blocks.
    sized = staged(groups.join(heads.select(F.col("row_id").alias("node"), "n"), "node"), "candidates")
    blocks = sized.groupBy("grp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).select(
        "grp", F.greatest(F.ceil(F.col("c") / BLOCK_TEXTS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = sized.join(blocks, "grp").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Sort-merge at every size: the candidates are few here, but nothing bounds them, so they are not broadcast.
    wanted = rows.join(placed.select(F.col("node").alias("row_id"), "grp", "b", "blocks").hint("merge"), "row_id")

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts_ = b["text"].tolist()
            sets: list[bytes] = []
            for lo, hi in text_slabs([t or "" for t in texts_], 1_000_000):
                sh, n = shingle_hashes(*word_hashes(texts_[lo:hi]))
                sets += [np.unique(x).tobytes() for x in np.split(sh, np.cumsum(n)[:-1])]
            yield b[["row_id", "grp", "b", "blocks"]].assign(sh=sets)

    sets = wanted.select("row_id", "grp", "b", "blocks", "text").mapInPandas(shingles, "row_id long, grp long, b int, blocks int, sh binary")
    paired = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("row_id", "grp", "b", "sh", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(second=pdf["b"] != pdf["b1"]).sort_values(["second", "row_id"], kind="stable")
        # The second block may hold no text at all, so that rows don't tell whether a block meets itself.
        found = compare(pdf["row_id"].tolist(), [np.frombuffer(x, np.uint64) for x in pdf["sh"]],
                        int((~pdf["second"]).sum()), bool(pdf["b1"].iloc[0] == pdf["b2"].iloc[0]), threshold)
        return pd.DataFrame(found, columns=["node", "links", "root"])

    found = staged(paired.groupBy("grp", "b1", "b2").applyInPandas(verify, "node long, links long, root long"), "links")
    classes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    return members, classes.join(links, "node").select("node", "root", "n_links")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text_id, class_id, n_links of every document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(rows, "join-rows")
    members, links = linked_texts(rows.select("row_id", "text"), threshold, recall)
    named = rows.select("row_id", "doc_id").join(members, "row_id")
    # per text first, so that a class of many copies is small before it is gathered
    texts = named.groupBy("node").agg(F.min("doc_id").alias("text_id")).join(links, "node", "left")
    texts = texts.select("node", "text_id", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classes = texts.groupBy("root").agg(F.min("text_id").alias("class_id"))
    return named.join(texts.join(classes, "root"), "node").select("doc_id", "text_id", "class_id", "n_links")


def op4_ngram_jaccard_join(spark, sf_dir) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every class the row with the smallest doc_id (nulls last)
    stays; all columns of ``docs``."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = staged(kept.select(F.monotonically_increasing_id().alias("row_id"), "doc"), "join-rows")
    members, links = linked_texts(rows.select("row_id", F.col("doc.text").cast("string").alias("text")))
    texts = members.join(links.select("node", "root"), "node", "left").select("row_id", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("doc.doc_id").isNull(), F.col("doc.doc_id"), F.col("row_id"))
    ranked = rows.select("row_id", order.alias("o")).join(texts, "row_id")
    first = ranked.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.row_id").alias("row_id"))
    return rows.join(first, "row_id", "left_semi").select("doc.*")
