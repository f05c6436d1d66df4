"""Token-ID files: patched frame-of-reference blocks.

``write_token_files`` encodes every whole text and writes the ids, documents in
ascending ``doc_id`` order, to binary files in a shared folder;
``read_token_files`` reads them back, one row per document.

A file holds blocks of 1,024 ids. Each block stores its minimum, the residuals
(id - minimum) packed at the width that holds the chosen percentile of them,
and an exception list (position, whole residual) for the outliers. The footer
indexes where each block starts and lists the documents, so a reader can seek
to any block.

    file    = blocks, footer, footer length (u64), magic b"PFR1"
    block   = minimum u32 | n u16 | width u8 | pad u8 | exceptions u16 | pad u16
              | packed residuals | positions u16[] | residuals u32[]
    footer  = n_blocks u64 | n_docs u64 | n_ids u64 | block starts u64[]
              | doc ids i64[] | doc id is null u8[] | ids of each document u64[]

Rows: documents are dealt out by ranges of doc_id, each range is one task that
writes one or more files under names no other attempt uses; only files listed
in the manifest count, so a lost or repeated attempt leaves no trace. A null or
empty text has only the end id; null doc_ids come first; equal doc_ids are
ordered by text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import shared_folder, staged
from ._tokens import encoder, vocabulary

BLOCK = 1024
MAGIC = b"PFR1"
_HEAD = struct.Struct("<IHBBHH")


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs (0 for 0)."""
    return np.where(v > 0, np.floor(np.log2(np.maximum(v, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """Blocks of up to 1,024 ids (the last may be shorter)."""
    out: list[bytes] = []
    for lo in range(0, len(ids), BLOCK * 256):
        part = ids[lo:lo + BLOCK * 256].astype(np.int64)
        full = len(part) // BLOCK
        if full:
            out += _encode_rows(part[:full * BLOCK].reshape(full, BLOCK), percentile)
        if len(part) > full * BLOCK:
            out += _encode_rows(part[full * BLOCK:].reshape(1, -1), percentile)
    return out


def _encode_rows(rows: np.ndarray, percentile: float) -> list[bytes]:
    n = rows.shape[1]
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    k = min(n - 1, int(percentile * n))
    width = _widths(np.partition(rest, k, axis=1)[:, k])
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        mine = rest[at]
        over = mine >= (1 << w)
        kept = np.where(over, 0, mine)
        packed = np.empty((len(at), 0), np.uint8)
        if w:
            bits = ((kept[:, :, None] >> np.arange(w)) & 1).astype(np.uint8)
            packed = np.packbits(bits.reshape(len(at), n * w), axis=1, bitorder="little")
        for i, row in enumerate(at.tolist()):
            where = np.flatnonzero(over[i])
            out[row] = b"".join((_HEAD.pack(int(low[row]), n, w, 0, len(where), 0), packed[i].tobytes(),
                                 where.astype("<u2").tobytes(), mine[i][where].astype("<u4").tobytes()))
    return out


def decode_block(buf: memoryview) -> np.ndarray:
    low, n, w, _, n_over, _ = _HEAD.unpack_from(buf)
    at = _HEAD.size
    size = (n * w + 7) // 8
    if w:
        bits = np.unpackbits(np.frombuffer(buf, np.uint8, size, at), bitorder="little")[:n * w].reshape(n, w)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :w] = bits
        rest = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    else:
        rest = np.zeros(n, np.uint32)
    at += size
    where = np.frombuffer(buf, "<u2", n_over, at)
    rest[where] = np.frombuffer(buf, "<u4", n_over, at + 2 * n_over)
    return rest + np.uint32(low)


class _FileWriter:
    """Streams ids into one file; holds at most a slab of ids in memory."""

    SLAB = BLOCK * 256

    def __init__(self, fs, path: str, percentile: float):
        self.fs, self.path, self.percentile = fs, path, percentile
        self.out = fs.open_output_stream(path)
        self.at, self.starts, self.pending, self.n_pending, self.n_ids = 0, [], [], 0, 0
        self.doc_ids, self.nulls, self.counts = [], [], []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(0 if doc_id is None else int(doc_id))
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.pending.append(ids)
        self.n_pending += len(ids)
        self.n_ids += len(ids)
        if self.n_pending >= self.SLAB:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, "<u4")
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in encode_blocks(ids[:cut], self.percentile):
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.pending, self.n_pending = [ids[cut:]], len(ids) - cut

    def close(self) -> tuple[int, int]:
        self._flush(True)
        foot = b"".join((struct.pack("<QQQ", len(self.starts), len(self.counts), self.n_ids),
                         np.asarray(self.starts, "<u8").tobytes(), np.asarray(self.doc_ids, "<i8").tobytes(),
                         np.asarray(self.nulls, np.uint8).tobytes(), np.asarray(self.counts, "<u8").tobytes()))
        self.out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        self.out.close()
        return len(self.counts), self.n_ids


class TokenFile:
    """Reader of one file's bytes: ``docs()`` yields (doc_id or None, first id, ids)."""

    def __init__(self, buf):
        self.buf = memoryview(buf)
        if bytes(self.buf[-4:]) != MAGIC:
            raise ValueError("not a token file")
        size, = struct.unpack_from("<Q", self.buf, len(self.buf) - 12)
        at = len(self.buf) - 12 - size
        n_blocks, n_docs, self.n_ids = struct.unpack_from("<QQQ", self.buf, at)
        at += 24
        self.starts = np.frombuffer(self.buf, "<u8", n_blocks, at)
        at += 8 * n_blocks
        self.doc_ids = np.frombuffer(self.buf, "<i8", n_docs, at)
        at += 8 * n_docs
        self.nulls = np.frombuffer(self.buf, np.uint8, n_docs, at)
        at += n_docs
        self.counts = np.frombuffer(self.buf, "<u8", n_docs, at).astype(np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Any range of ids, from the blocks that hold it."""
        if not n:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        part = [decode_block(self.buf[int(self.starts[b]):]) for b in range(first, last + 1)]
        return np.concatenate(part)[start - first * BLOCK:][:n]

    def docs(self) -> Iterator[tuple]:
        """Document by document, each block decoded once."""
        at, have, lo, block = 0, np.empty(0, np.uint32), 0, 0
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.counts.tolist()):
            parts = [have]
            size = len(have)
            while size < at + n - lo:
                parts.append(decode_block(self.buf[int(self.starts[block]):]))
                size += len(parts[-1])
                block += 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield None if null else doc_id, at, have[at - lo:at - lo + n]
            at += n
            have, lo = have[at - lo:], at


def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, percentile: float = 0.9,
                      file_ids: int = 32_000_000, folder: str | None = None) -> DataFrame:
    """Write the files; return the manifest (part, seq, path, n_docs, n_tokens, start),
    where ``start`` counts the ids of all files before. ``file_ids`` bounds the
    ids of one file: a task that has more begins another file."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        context, enc = TaskContext.get(), encoder(tokenizer_path)
        fs, base = _open(folder)
        end = np.asarray([end_id], "<u4").tobytes()
        out, writer = [], None

        def finish():
            n_docs, n_ids = writer.close()
            out.append((context.partitionId(), len(out), f"{folder}/{writer.path.rsplit('/', 1)[-1]}", n_docs, n_ids))

        for batch in batches:
            for doc_id, null, ids in zip(batch["doc_id"], batch["no_id"], enc.encode_many(batch["text"].tolist())):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(out):04d}.pfr"
                    writer = _FileWriter(fs, f"{base}/{name}", percentile)
                writer.add(None if null else doc_id, np.frombuffer(ids + end, "<u4"))
                if writer.n_ids >= file_ids:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pd.DataFrame(out, columns=["part", "seq", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = (rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
            .select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text"))
    manifest = staged(rows.mapInPandas(write, "part int, seq int, path string, n_docs long, n_tokens long"), "token-manifest")
    # One row per file: the running sum is over the number of files, not of documents.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 of the ids read back."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                fs, inner = _open(path)
                with fs.open_input_file(inner) as f:
                    data = TokenFile(f.read_buffer())
                rows = []
                for doc_id, at, ids in data.docs():
                    rows.append((doc_id, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    n = max(1, manifest.count())
    return (manifest.select("path", "start").repartition(n, "path")
            .mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def _frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64"})


def op2_token_files(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, vocabulary("word_bpe_49k.json")))
