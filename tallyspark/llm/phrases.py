"""Phrase collocation mining by top-order marginalisation.

A text, lower-cased in A-Z, is cut at ``SEPARATORS`` into pieces and these at spaces
and tabs into words. Every occurrence of a phrase of any length starts one window of
``longest`` words, padded beyond the end of its piece. So only these windows are
counted, and Spark's ROLLUP over their lead columns w1, w2, .. sums the shorter
prefixes: f of each phrase and, at its top level, n of each language.

1. ``windows``: each task counts its windows: the words as numbers, the lead columns
   as shifted arrays, one sort. They leave as packed lists, one a hash bucket.
2. ``settle``: a bucket holds every count of its windows, so it knows which are rare
   (f < ``least``). A rare window can't be a candidate nor a part of one; what counts
   is its share in its prefixes. Its last word becomes a pad, and it goes on to the
   bucket of its prefix, until a frequent prefix or a single word is left. A frequent
   window stays as it is and marks its prefix frequent. Nothing is dropped: the sums of
   every frequent prefix, and n, are the exact ones.
3. ROLLUP over (w1, w2, ..) within a language over the rows left.
4. Each cut of a candidate takes both its parts' f by a join; the lowest score counts.
   Scores are DECIMAL(38, 0) divisions, so exact while 1000000 * f * f fits 38 digits.
   Candidates inside a longer one with at least half their count go.

Skew: windows are hashed with all their words, prefixes once they are sums, so a hot
word or word pair arrives pre-aggregated: one number a task or bucket. The number of
buckets follows the text; a bucket holds about BUCKET_WORDS windows. The best of a
language are ranked in two steps, of SHARES groups and of their best.

Rows: null text is empty, null lang is ``und`` (as a lang of that name); doc_id is not
read, so repeated rows count each; ties in a score are ordered by count, then by the
phrase's bytes; an empty table, or one without frequent phrases, gives no rows;
other columns are ignored; long texts are counted in slabs, and a piece may run on
over any number of them.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import staged
from ._words import mix

SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
PAD = b"A"  # no word: texts are in lower case
LONGEST, LEAST, TOP = 3, 10, 2000
TASK_WINDOWS = 2_000_000
SLAB_BYTES = 1_000_000
BUCKET_WORDS = 1_500_000
SHARES = 256
_TO_LINES = bytes(10 if b in SEPARATORS else b for b in range(256))
# Windows of one bucket in columns: the j-th words of all, and how often each window occurred.
PACKED = "lang string, bucket long, words array<binary>, counts binary"
_PACKED = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.binary())])


class _Numbers(dict):
    """Word -> number, in order of arrival."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _slabs(data: bytes):
    """A text in parts that end between words."""
    lo = 0
    while len(data) - lo > SLAB_BYTES:
        hi = max(data.find(b" ", lo + SLAB_BYTES), data.find(b"\n", lo + SLAB_BYTES, lo + 2 * SLAB_BYTES))
        if hi < 0:
            break
        yield data[lo:hi]
        lo = hi
    yield data[lo:]


def _pack(data) -> bytes:
    data = pa.py_buffer(data)
    return data.size.to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _pack_words(words: pa.Array) -> bytes:
    """Words, which hold no line end, one a line."""
    lines = pc.binary_join_element_wise(words, pa.scalar(b"", words.type), pa.scalar(b"\n", words.type))
    _, offsets, data = lines.buffers()
    ends = np.frombuffer(offsets, np.int64)[lines.offset:lines.offset + len(lines) + 1]
    return _pack(data.slice(ends[0], ends[-1] - ends[0])) if len(lines) else _pack(b"")


def _unpack_words(data: bytes) -> pa.Array:
    """The lines, each with its line end: equal ones stay equal."""
    lines = _unpack(data)
    ends = np.flatnonzero(np.frombuffer(lines, np.uint8) == 10) + 1
    offsets = np.concatenate([np.zeros(1, np.int64), ends])
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(lines)])


def _batch(lang: str, bucket: np.ndarray, words: list[pa.Array], counts: np.ndarray):
    """Windows in the order of their buckets as rows of PACKED, bucket by bucket."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        row = [_pack_words(w.slice(lo, hi - lo)) for w in words]
        yield pa.RecordBatch.from_pylist([{"lang": lang, "bucket": int(bucket[lo]), "words": row, "counts": _pack(counts[lo:hi].astype("<i8"))}], _PACKED)


def _bucket(lang: str, words: list[np.ndarray], buckets: int) -> np.ndarray:
    """The bucket of each window, from its words' hashes."""
    h = np.full(len(words[0]), zlib.crc32(lang.encode("utf-8", "surrogatepass")), np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            h = mix(h * np.uint64(31) + w)
    return (h % np.uint64(buckets)).astype(np.int64)


def _word_hashes(words) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


class _Counter:
    """Counts of the windows of one task's texts, given away at TASK_WINDOWS."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.pads = b" " + b" ".join([PAD] * (longest - 1)) + b" "
        self.most_words = 1 << (63 // longest)
        self.clear()

    def clear(self):
        self.numbers, self.streams, self.size = _Numbers({PAD: 0}), {}, 0

    def add(self, lang: str, text: str):
        """Full counts of windows, if any, while one text is added."""
        data = text.encode("utf-8", "surrogatepass").lower().translate(_TO_LINES)
        for slab in _slabs(data):
            words = slab.replace(b"\n", self.pads).split()
            for lo in range(0, len(words), self.most_words // 2):  # numbers stay below most_words
                part = words[lo:lo + self.most_words // 2]
                if self.size + len(part) > TASK_WINDOWS or len(self.numbers) + len(part) > self.most_words:
                    yield from self.flush(lang)
                self.streams.setdefault(lang, array("I")).extend(map(self.numbers.__getitem__, part))
                self.size += len(part)
        self.streams.setdefault(lang, array("I")).extend([0] * (self.longest - 1))

    def flush(self, open_lang: str | None = None):
        """Rows of PACKED. The last words of ``open_lang``, whose text goes on,
        are kept: their windows aren't full yet."""
        names, m, carry = list(self.numbers), self.longest, []
        hashes = _word_hashes(names)
        words = pa.array(names, pa.large_binary())
        for lang, stream in self.streams.items():
            ids = np.frombuffer(stream, np.uint32).astype(np.uint64)
            if lang == open_lang:
                carry = [names[i] for i in stream[-(m - 1):]]
            n = len(ids) - (m - 1)
            if n <= 0:
                continue
            lead = [ids[j:n + j] for j in range(m)]
            key, base = lead[0], np.uint64(len(names))
            for col in lead[1:]:
                key = key * base + col
            key, counts = np.unique(key[lead[0] != 0], return_counts=True)
            if not len(key):
                continue
            cols = []
            for _ in range(m):
                cols.append((key % base).astype(np.int64))
                key = key // base
            cols.reverse()
            bucket = _bucket(lang, [hashes[c] for c in cols], self.buckets)
            order = np.argsort(bucket, kind="stable")
            yield from _batch(lang, bucket[order], [words.take(pa.array(c[order])) for c in cols], counts[order])
        self.clear()
        if carry:
            self.streams[open_lang] = array("I", map(self.numbers.__getitem__, carry))
            self.size = len(carry)


def windows(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Counts of all padded windows as PACKED."""
    def run(batches):
        counter = _Counter(longest, buckets)
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                yield from counter.add(lang, text.as_py())
        yield from counter.flush()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return texts.where("text <> ''").mapInArrow(run, PACKED)


def _merged(codes: np.ndarray, counts: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal columns of ``codes`` (numbers below ``base``) as one: the columns, the sums
    and the least of their counts."""
    if not len(counts):
        return codes, counts, counts
    if base ** len(codes) < 1 << 63:
        key = codes[0]
        for c in codes[1:]:
            key = key * base + c
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(codes[::-1])
    codes = codes[:, order]
    first = np.flatnonzero(np.concatenate([[True], (codes[:, 1:] != codes[:, :-1]).any(0)]))
    return codes[:, first], np.add.reduceat(counts[order], first), np.minimum.reduceat(counts[order], first)


def settle(packed: DataFrame, size: int, least: int, buckets: int) -> DataFrame:
    """Windows of ``size`` words by bucket: rows (lang, w, f) of the frequent ones (w: the
    words, without pads), and the others under their prefixes as PACKED (as rows, once
    these are single words). A count of 0 marks a prefix that is frequent by a window
    that stays."""
    cols = [f"w{j}" for j in range(size)]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, packs = key[0].as_py(), table["words"].to_pylist()
        counts = np.concatenate([np.frombuffer(_unpack(c), "<i8") for c in table["counts"].to_pylist()])
        coded = pa.chunked_array([_unpack_words(row[j]) for j in range(size) for row in packs]).dictionary_encode()
        words = pc.replace_substring(coded.chunk(0).dictionary, "\n", "")
        codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64).reshape(size, -1)
        codes, counts, least_count = _merged(codes, counts, len(words))
        often = (counts >= least) | (least_count == 0)  # or marked
        stays = often & (counts > 0)
        pad = pc.index(words, pa.scalar(PAD, words.type)).as_py()
        names = words.to_pylist() if stays.any() else []
        rows = [b" ".join(names[i] for i in ws if i != pad).decode("utf-8", "replace") for ws in codes[:, stays].T.tolist()]
        out = [pa.table({"w": pa.array(rows, pa.string()), "f": pa.array(counts[stays], pa.int64())})]
        rare, sums, _ = _merged(codes[:-1, ~often], counts[~often], len(words))
        if size == 2:  # single words need no further bucket
            out.append(pa.table({"w": words.take(pa.array(rare[0])).cast(pa.large_string()).cast(pa.string()), "f": pa.array(sums, pa.int64())}))
        else:
            heads, _, _ = _merged(codes[:-1, often], counts[often], len(words))
            codes, sums = np.concatenate([rare, heads], 1), np.concatenate([sums, np.zeros(heads.shape[1], np.int64)])
            if len(sums):
                hashes = _word_hashes(words.to_pylist())
                bucket = _bucket(lang, [hashes[c] for c in codes], buckets)
                order = np.argsort(bucket, kind="stable")
                more = pa.Table.from_batches(list(_batch(lang, bucket[order], [words.take(pa.array(c[order])) for c in codes], sums[order])))
                out.append(more.select(["bucket", "words", "counts"]))
        done = pa.concat_tables(out, promote_options="default")
        done = done.append_column("lang", pa.array([lang] * len(done), pa.string()))
        for name in ("bucket", "words", "counts"):
            if name not in done.column_names:
                done = done.append_column(name, pa.nulls(len(done), _PACKED.field(name).type))
        return done.select(["w", "f", "lang", "bucket", "words", "counts"])

    return packed.groupBy("lang", "bucket").applyInArrow(run, f"w string, f long, {PACKED}")


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, w, f): every phrase of 1 to ``longest`` words with f >= least, as the
    array of its words; an empty array counts all words of the language."""
    if longest < 2:
        raise ValueError("phrases have two words or more")
    total = docs.agg(F.sum(F.length(F.col("text").cast("string")).cast("long")).alias("c")).first()["c"] or 0
    buckets = 1 + total // (6 * BUCKET_WORDS)
    packed, rows = windows(docs, longest, buckets), []
    for size in range(longest, 1, -1):
        done = staged(settle(packed, size, least, buckets), f"phrases-{size}")
        rows.append(done.where("w is not null").select("lang", "w", "f"))
        packed = done.where("words is not null").select("lang", "bucket", "words", "counts")
    left = rows[0]
    for more in rows[1:]:
        left = left.union(more)
    ws = [f"w{j}" for j in range(1, longest + 1)]
    left = left.select("lang", "f", *[F.coalesce(F.get(F.split("w", " "), F.lit(j)), F.lit("")).alias(w) for j, w in enumerate(ws)])
    sums = left.rollup("lang", *ws).agg(F.sum("f").alias("f")).where("lang is not null")
    # Level j: the words beyond are rolled up (null); a pad as its last word is no phrase of j words.
    last = F.lit("all")
    for w in ws:
        last = F.when(F.col(w).isNotNull(), F.col(w)).otherwise(last)
    size = sum((F.col(w).isNotNull().cast("int") for w in ws), F.lit(0))
    return sums.where((last != "") & ((F.col("f") >= least) | (size == 0))).select("lang", F.array_compact(F.array(*ws)).alias("w"), "f")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = staged(phrase_counts(docs, longest, least), "phrase-counts")
    n = counts.where("size(w) = 0").select("lang", F.col("f").alias("n"))
    text = lambda w: F.array_join(w, " ")
    f = counts.where("size(w) > 0").select("lang", text("w").alias("part"), F.col("f").alias("part_f"))
    cand = counts.where("size(w) > 1").select("lang", "w", text("w").alias("phrase"), F.col("f").alias("a"))
    # every cut with the counts of both parts
    cuts = cand.select("lang", "w", "phrase", "a", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", text(F.expr("slice(w, 1, k)")).alias("head"), text(F.expr("slice(w, k + 1, size(w))")).alias("tail"))
    cuts = cuts.join(f.select("lang", F.col("part").alias("head"), F.col("part_f").alias("l")), ["lang", "head"])
    cuts = cuts.join(f.select("lang", F.col("part").alias("tail"), F.col("part_f").alias("r")), ["lang", "tail"])
    whole = lambda c: f"cast({c} as decimal(15, 0))"
    cuts = cuts.withColumn("score", F.expr(f"cast((1000000 * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')}) as long)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # phrases inside a longer one of at least half their count
    inner = cand.where("size(w) > 2").select("lang", "a", F.explode(F.expr(
        "flatten(transform(sequence(2, size(w) - 1), s -> transform(sequence(1, size(w) - s + 1), i -> array_join(slice(w, i, s), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    best = best.join(inner, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 50 * a")
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    best = best.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
