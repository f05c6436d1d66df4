"""Packing documents into fixed-length token sequences.

First-fit decreasing over a tournament tree of bin capacities, run on its own
in randomised groups of documents. A document longer than a sequence gives full
sequences and one remainder; the remainders of a group are placed in decreasing
order, each in the first bin with room, found by walking down the tree whose
nodes hold the largest room below. Then the emptiest bins are cut up to fill the
gaps of the others, so that a group pads only its last sequence.

Rows: each group is the documents of one hash bucket; the number of groups
follows the total text, so a group's size is bounded however large the corpus.
The bucket hashes the row's partition and text with its id, so many rows of one
doc_id spread out. Null or empty texts hold the end id alone; repeated rows are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tokens import encoder, vocabulary

SEQUENCE = 2048
GROUP_CHARS = 4_000_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, group_no long")


class RoomTree:
    """Tournament tree over bins: a node holds the largest room below it."""

    def __init__(self, n: int, size: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.room = [size] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """The first bin with room for ``need``, its room reduced by it."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < need:
                i += 1
        bin_no = i - self.leaves
        room[i] -= need
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return bin_no


def pack_lengths(lengths: list[int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, bin, offset) that hold each id of each
    document once; in every bin the offsets have no gap."""
    pieces, bins, rests = [], 0, []
    for d, n in enumerate(lengths):
        whole = n // size
        for k in range(whole):
            pieces.append((d, k * size, size, bins, 0))
            bins += 1
        if n % size:
            rests.append((n % size, d, whole * size))
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree = RoomTree(max(1, len(rests)), size)
    placed: dict[int, list[tuple[int, int, int]]] = {}
    for n, d, start in rests:
        placed.setdefault(tree.first_fit(n), []).append((d, start, n))
    filled = sorted(([sum(p[2] for p in items), k, items] for k, items in placed.items()), key=lambda b: (-b[0], b[1]))
    lo, hi = 0, len(filled) - 1  # fill the fullest bins from the emptiest
    while lo < hi:
        gap = size - filled[lo][0]
        while gap and lo < hi:
            d, start, n = filled[hi][2].pop()
            take = min(n, gap)
            filled[lo][2].append((d, start + n - take, take))
            filled[lo][0] += take
            filled[hi][0] -= take
            gap -= take
            if n > take:
                filled[hi][2].append((d, start, n - take))
            elif not filled[hi][2]:
                hi -= 1
        lo += 1
    for _, _, items in filled[:hi + 1]:
        at = 0
        for d, start, n in items:
            pieces.append((d, start, n, bins, at))
            at += n
        bins += bool(items)
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = SEQUENCE,
         group_chars: int = GROUP_CHARS) -> DataFrame:
    """Pieces of all documents, one row each (see SCHEMA)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text").cast("long")).alias("c"), F.count(F.lit(1)).alias("n")).first()
    groups = max(1, -(-((total["c"] or 0) + 64 * total["n"]) // group_chars))
    key = F.xxhash64("doc_id", F.crc32("text"), F.spark_partition_id())
    rows = rows.withColumn("group_no", F.pmod(key, F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        enc, end = encoder(tokenizer_path), np.asarray([end_id], "<u4").tobytes()
        pdf = pdf.sort_values(["doc_id", "text"], kind="stable", na_position="first", ignore_index=True)
        ids = [b + end for b in enc.encode_many(pdf["text"].tolist())]
        lengths = [len(b) // 4 for b in ids]
        doc_ids = pdf["doc_id"].astype("Int64")
        base = int(pdf["group_no"].iloc[0])
        out = pack_lengths(lengths, size)
        d, start, n, seq, at = map(np.asarray, zip(*out))
        return pd.DataFrame({
            "doc_id": doc_ids.take(d).array, "start": start, "length": n,
            "ids_crc32": [zlib.crc32(memoryview(ids[i])[4 * s:4 * (s + k)]) for i, s, k, _, _ in out],
            "doc_tokens": np.asarray(lengths)[d], "sequence_id": (base << 32) + seq, "offset": at, "group_no": base})

    return rows.groupBy("group_no").applyInPandas(run, SCHEMA)


def op8_packing(spark, sf_dir) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
