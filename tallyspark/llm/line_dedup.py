"""Line dedup: an exact set-similarity join over lines, in DataFrame functions only.

A line is a set of lower-case words (what stands between white space). A line goes if an
earlier one, in the same document or in one with a smaller doc_id, has a Jaccard
similarity of at least NUM / DEN (0.8) with it; a line without words neither goes nor
makes others go. Sets are held, compared and verified as 64-bit hashes of their words.

Each line's set is computed once, into a table bucketed by document, so that no later
step splits a text or moves the sets: what is decided comes back to them as a bit a
line, by document. Documents are numbered in their order, so a line is one number.

1. Lines with equal sets: only the first occurrence stays, one number for each set. What
   the join then sees are different sets, however many copies a line has.
2. Words are ordered by rarity. The prefix of each line gives postings (a pair at the
   threshold shares a word there), bucketed and sorted by word. Of the first lines of its
   words, each line is compared with the one whose signature differs least. What is found
   here needs no other partner, so a group of near copies takes as many rows as members.
3. The lines left meet all earlier lines of their words. Pairs of 2 and 3 pass the
   length filter, the positional filter (what can still be common after this word) and a
   parity signature of the set of 64 to 256 bits, by its size, whose differing bits
   can't outnumber the differing words; then they are verified on their sets.

Rarity is the count of the word's hash bucket over all lines, on a logarithmic
scale: one small number for each of BUCKETS buckets, whatever the corpus, goes to
every task. The order among words decides how many pairs are compared, not which
are found. Tables go as soon as no step reads them; none is left after a run but the
result.

Rows: null or empty texts stay as they are; a null doc_id comes first;
rows that repeat doc_id and text are one document (both keep the same lines);
equal doc_ids are ordered by a hash of the text; other columns are kept; an
empty table gives no rows. The numbers of documents and of the longest document's lines
must fit 63 bits together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Workspace, staged, with_conf

NUM, DEN = 4, 5
BUCKETS = 1 << 18
KEY_BITS = 31
SIZES = 96, 192  # sets of more words have signatures of two, of four longs
SLICES, MOST_SENT = 4, 1_000_000
_NO_ID = -(1 << 63)
_KEY = ["did", "h"]
# White space but the space and the line end; each becomes a space.
_ASCII_SPACES, _FAR_SPACES, _OTHER_SPACES = "\t\x0b\x0c\r", "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f", "\x85\xa0\u1680\u205f\u3000"
_SPACES = r"[\x{09}\x{0B}-\x{0D}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SET = "sort_array(array_distinct(array_remove(transform(split(line, ' '), w -> xxhash64(w)), xxhash64(''))))"
_CONF = {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",  # tables of equal buckets are written from each other as they are
         "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",  # buckets of one file are sorted as they were written
         "spark.sql.maxConcurrentOutputFileWriters": "4",  # a task writes one bucket: no sort by its number
         "spark.sql.codegen.aggregate.fastHashMap.capacityBit": str(BUCKETS.bit_length() - 1),  # the counts of all buckets
         "spark.sql.maxPlanStringLength": "20000"}  # the rarity of all buckets is a literal


def _keyed(docs: DataFrame) -> DataFrame:
    """did, h (the document), text, doc (all columns)."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(text).alias("h"), text.alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"))


def _spaced(text: Column) -> Column:
    """``text`` with a space for each other white space; few texts have any, which byte
    searches tell much sooner than a regular expression: four of them, if all is ASCII,
    else six more, and those for U+2000 to U+202F only where their first two bytes are."""
    has = lambda spaces: reduce(Column.__or__, [text.contains(c) for c in spaces])
    ascii_ = F.octet_length(text) == F.char_length(text)
    far = F.contains(text.cast("binary"), F.lit(_FAR_SPACES[0].encode()[:2])) & has(_FAR_SPACES)
    return F.when(has(_ASCII_SPACES) | (~ascii_ & (has(_OTHER_SPACES) | far)), F.regexp_replace(text, _SPACES, " ")).otherwise(text)


def _numbered(work: Workspace, keys: DataFrame) -> DataFrame:
    """(did, h, dn): the documents' numbers, in their order."""
    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    keys = keys.distinct().repartitionByRange(parts, *_KEY).sortWithinPartitions(*_KEY)
    keys = work.staged(keys.withColumn("id", F.monotonically_increasing_id()), "keys")  # partition << 33 | row
    row = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    bits = (keys.agg(F.max(row).alias("m")).first()["m"] or 0).bit_length()
    return keys.select(*_KEY, F.shiftleft(F.shiftright("id", 33), bits).bitwiseOR(row).alias("dn"))


def _bits(lines: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the lines ``no`` of each document as an array of bits."""
    words = lines.groupBy(*keys, F.shiftright("no", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, no & 63))").alias("b"))
    maps = words.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", "b"))).alias("m"), F.max("at").alias("last"))
    return maps.select(*keys, F.expr("transform(sequence(0, last), i -> coalesce(m[i], 0L))").alias(name))


def _has(name: str, no: str = "no") -> Column:
    """Whether a document's bits hold line ``no``."""
    return F.expr(f"coalesce((shiftright(get({name}, shiftright({no}, 6)), {no} & 63) & 1) = 1, false)")


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, few and narrow for each document, as the hashed side of a join: the other side, texts or sets, isn't sorted."""
    return rows.hint("shuffle_hash")


def _alpha(a: str, b: str) -> str:
    """The least overlap of two lines at the threshold."""
    return f"(({NUM} * ({a}.n + {b}.n) + {NUM + DEN - 1}) div {NUM + DEN})"


def _signed(sets: DataFrame) -> DataFrame:
    """``sets`` with the signature s0 .. s3: bit w mod 64 m of a set's m longs is the
    parity of its words there; m is 1, 2 or 4, by SIZES. The longs
    not used are 0, so that folding a longer signature gives the shorter one."""
    long = "aggregate({0}, 0L, (s, w) -> s ^ shiftleft(1L, cast(w & 63 as int)))"
    part = lambda m, j: long.format(f"filter(t, w -> (shiftright(w, 6) & {m - 1}) = {j})")
    sig = [f"case when n <= {SIZES[0]} then {long.format('t')} when n <= {SIZES[1]} then {part(2, 0)} else {part(4, 0)} end",
           f"case when n <= {SIZES[0]} then 0L when n <= {SIZES[1]} then {part(2, 1)} else {part(4, 1)} end",
           *[f"case when n <= {SIZES[1]} then 0L else {part(4, j)} end" for j in (2, 3)]]
    return sets.select("*", *[F.expr(x).alias(f"s{j}") for j, x in enumerate(sig)])


_SIGNED = ["n", "s0", "s1", "s2", "s3"]


def _differ(a: str, b: str) -> str:
    """The differing bits of two signatures, folded to the shorter one."""
    bits = lambda *js: "bit_count(" + " ^ ".join(f"{x}.s{j}" for x in (a, b) for j in js) + ")"
    return (f"case when least({a}.n, {b}.n) > {SIZES[1]} then {bits(0)} + {bits(1)} + {bits(2)} + {bits(3)} "
            f"when least({a}.n, {b}.n) > {SIZES[0]} then {bits(0, 2)} + {bits(1, 3)} else {bits(0, 1, 2, 3)} end")


def _filters(a: str, b: str) -> str:
    """Length, position and signature filter of two postings of one word."""
    return (f"{b}.n * {NUM} <= {a}.n * {DEN} and {a}.n * {NUM} <= {b}.n * {DEN} and least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {_alpha(a, b)} "
            f"and {_differ(a, b)} <= {a}.n + {b}.n - 2 * {_alpha(a, b)}")


def _rarity(work: Workspace, sets: DataFrame) -> Column:
    """The logarithm of each hash bucket's word count, an array as a literal."""
    counts = sets.select(F.explode("t").alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).count()
    scale = F.least(F.lit(94), F.floor(3 * F.log2(F.col("count") + 1))).cast("int")
    got = [0] * BUCKETS
    for r in work.staged(counts.select("b", scale.alias("c")), "counts").collect():  # at most BUCKETS rows, whatever the input
        got[r["b"]] = r["c"]
    work.drop("counts")
    return F.split(F.lit(",".join(map(str, got))), ",").cast("array<tinyint>")


class _Lines:
    """The table of sets, and what the steps ask of it."""

    def __init__(self, work: Workspace, docs: DataFrame):
        self.work, n = work, int(work.spark.conf.get("spark.sql.shuffle.partitions"))
        self.n, texts = n, _keyed(docs).select(*_KEY, "text")
        self.order = work.staged(_numbered(work, texts.select(*_KEY)), "order")
        work.drop("keys")
        # lowered and spaced as columns of their own before the shuffle: a generator would do it anew wherever it is named
        texts = texts.where("text is not null").withColumn("low", F.lower("text")).select(*_KEY, _spaced(F.col("low")).alias("low"))
        lines = texts.repartition(n, *_KEY).join(_small(self.order), _KEY)
        lines = lines.select(*_KEY, "dn", F.posexplode(F.split("low", "\n")).alias("no", "line"))
        # not "size(t) > 0", which the optimizer moves below the set and so computes it twice
        sets = lines.where("trim(line) <> ''").withColumn("t", F.expr(_SET)).drop("line")
        sets = sets.withColumn("n", F.size("t")).withColumn("k", F.xxhash64("t")).withColumn("k2", F.hash("t"))
        sets = _signed(sets)
        # a column chunk holds each word hash once, and small numbers for where it stands
        self.sets = work.bucketed(sets, "sets", n, _KEY, {"parquet.dictionary.page.size": str(16 << 20)})
        most = self.sets.agg(F.max("no").alias("no"), F.max("dn").alias("dn"), F.max("n").alias("n")).first()
        self.shift, self.n_bits = (most["no"] or 0).bit_length(), (most["n"] or 0).bit_length()
        if (most["dn"] or 0).bit_length() + self.shift > 63:
            raise ValueError("the numbers of documents and lines don't fit 63 bits")
        self.sets = self.sets.withColumn("ln", F.shiftleft("dn", self.shift).bitwiseOR(F.col("no").cast("long")))

    def bits(self, numbers: DataFrame, name: str) -> DataFrame:
        """(did, h, name): line numbers ``ln`` as the bits of their documents."""
        lines = numbers.select(F.shiftright("ln", self.shift).alias("dn"), F.col("ln").bitwiseAND(F.lit((1 << self.shift) - 1)).cast("int").alias("no"))
        return _bits(lines.repartition(self.n, "dn"), ["dn"], name).join(self.order, "dn").select(*_KEY, name)

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """(ln) of the written pairs (ln, e) whose sets reach the threshold. The sets of
        all lines in question are taken from their buckets once."""
        wanted = pairs.select("ln").union(pairs.select("e")).distinct()
        wanted = self.work.staged(self.bits(wanted, "wanted"), f"{name}-wanted")
        sets = self.sets.select(*_KEY, "no", "ln", "t").join(_small(wanted), _KEY).where(_has("wanted")).select("ln", "t")
        sets = self.work.staged(sets, f"{name}-sets")
        both = pairs.join(sets, "ln").join(sets.select(F.col("ln").alias("e"), F.col("t").alias("u")), "e")
        both = both.withColumn("common", F.expr("size(array_intersect(t, u))"))
        found = both.where(f"common * {DEN} >= (size(t) + size(u) - common) * {NUM}").select("ln").distinct()
        found = self.work.staged(found, f"{name}-found")
        self.work.drop(f"{name}-wanted", f"{name}-sets")
        return found

    def repeats(self) -> DataFrame:
        """(did, h, again): the bits of the lines whose set an earlier line has: all
        lines but the first of each set, so that no line is joined with its set."""
        first = self.bits(self.sets.groupBy("k", "k2").agg(F.min("ln").alias("ln")), "first")
        lines = _bits(self.sets.select(*_KEY, "no"), _KEY, "every").join(_small(first), _KEY, "left")
        again = F.expr("transform(every, (x, i) -> x & ~coalesce(get(first, i), 0L))").alias("again")
        return lines.select(*_KEY, again).where("exists(again, x -> x <> 0)")

    def postings(self, again: DataFrame) -> DataFrame:
        """(w, ln, n, s0 .. s3, pos) of the prefix of each line that repeats no other, bucketed
        by w and sorted by w and ln, which no step has to do again; a word of one prefix alone
        has no posting, and the window that tells so sorts what is written. w is KEY_BITS of the word's hash: words that share them cost comparisons
        that the filters or the sets end. Shuffled and written as narrow as it goes: n and pos
        in one number, and what is mostly 0 side by side, so that it compresses."""
        rarity = _rarity(self.work, self.sets)
        common = lambda w: F.get(rarity, w.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        word = lambda w: F.shiftleft(common(w).cast("long"), 55).bitwiseOR(w.bitwiseAND(F.lit((1 << 55) - 1)))
        sets = self.sets.join(_small(again), _KEY, "left").where(~_has("again")).select("ln", *_SIGNED, F.sort_array(F.transform("t", word)).alias("t"))
        prefix = F.slice("t", F.lit(1), F.expr(f"n - (({NUM} * n + {DEN - 1}) div {DEN}) + 1").cast("int"))
        posts = sets.select("ln", *_SIGNED, F.posexplode(prefix).alias("pos", "w"))
        key = F.col("w").bitwiseAND(F.lit((1 << KEY_BITS) - 1)).cast("int").alias("w")
        place = F.shiftleft(F.col("n").cast("long"), self.n_bits).bitwiseOR(F.col("pos").cast("long")).alias("place")
        posts = posts.select(key, "ln", "s0", place, "s1", "s2", "s3").repartition(self.n, "w")
        word = Window.partitionBy("w").orderBy("ln")
        posts = posts.withColumn("met", F.coalesce(F.lag("ln").over(word), F.lead("ln").over(word)).isNotNull()).where("met").drop("met")
        posts = self.work.bucketed(posts, "posts", self.n, ["w"], None, ["w", "ln"])
        pos = F.col("place").bitwiseAND(F.lit((1 << self.n_bits) - 1)).cast("int").alias("pos")
        return posts.select("w", "ln", F.shiftright("place", self.n_bits).cast("int").alias("n"), *_SIGNED[1:], pos)

    def first_pairs(self, posts: DataFrame) -> DataFrame:
        """Pairs (ln, e): of the first lines of a line's words the likeliest one."""
        word = Window.partitionBy("w").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        heads = posts.withColumn("b", F.first(F.struct("ln", *_SIGNED, "pos")).over(word)).alias("a")
        pairs = heads.where(F.expr(f"b.ln < a.ln and {_filters('a', 'b')}"))
        return pairs.select("a.ln", F.col("b.ln").alias("e"), F.expr(_differ("a", "b")).alias("d")).groupBy("ln").agg(F.min_by("e", "d").alias("e"))

    def other_pairs(self, posts: DataFrame, near: DataFrame) -> list[DataFrame]:
        """Pairs (ln, e) of a line that isn't of ``near`` and any earlier line of one of
        its words. While ``near`` has at most MOST_SENT lines, they are broadcast and the
        postings stay in their buckets; beyond that the postings are shuffled, in SLICES
        passes over the words, so that the files of one pass at a time are held."""
        few, out = near.count() <= MOST_SENT, []
        near, slices = (F.broadcast(near), 1) if few else (near, SLICES)
        for i in range(slices):
            mine = posts.where(F.pmod("w", F.lit(slices)) == i)
            open_ = mine.join(near, "ln", "left_anti")
            pairs = open_.alias("a").join(mine.alias("b").hint("merge"), F.expr(f"a.w = b.w and b.ln < a.ln and {_filters('a', 'b')}"))
            out.append(self.work.staged(pairs.select("a.ln", F.col("b.ln").alias("e")).distinct(), f"far-{i}"))
        return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, others) as struct ``doc`` (the other columns), the
    text left, n_lines and n_removed."""
    with Workspace(docs.sparkSession, "line-dedup") as work, with_conf(docs.sparkSession, _CONF):
        lines = _Lines(work, docs)
        again = work.staged(lines.repeats(), "again")
        posts = lines.postings(again)
        near = lines.verified(work.staged(lines.first_pairs(posts), "near"), "near")
        slices = lines.other_pairs(posts, near)
        work.drop("posts")
        far = slices[0] if len(slices) == 1 else work.staged(reduce(DataFrame.union, slices).distinct(), "far")
        far = lines.verified(far, "far")
        work.drop("sets")
        gone = work.staged(lines.bits(near.union(far), "gone"), "gone")
        out = _keyed(docs).join(_small(again), _KEY, "left").join(_small(gone), _KEY, "left").withColumn("ls", F.split("text", "\n"))
        kept = F.expr(f"filter(ls, (x, no) -> not ({_SQL_HAS.format('again')}) and not ({_SQL_HAS.format('gone')}))")
        touched = F.col("again").isNotNull() | F.col("gone").isNotNull()
        out = out.withColumn("kept", F.when(touched, kept).otherwise(F.col("ls")))
        result = out.select("doc", F.when(touched, F.array_join("kept", "\n")).otherwise(F.col("text")).alias("text"),
                            F.when(F.col("text").isNull(), 0).otherwise(F.size("ls")).alias("n_lines"),
                            F.when(F.col("text").isNull(), 0).otherwise(F.size("ls") - F.size("kept")).alias("n_removed"))
        return staged(result, "lines-left")


_SQL_HAS = "coalesce((shiftright(get({0}, shiftright(no, 6)), no & 63) & 1) = 1, false)"


def op10_line_dedup(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc.doc_id", "text", "n_lines", "n_removed")


def without_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without lines that repeat an earlier one; a
    document that has lost all its words goes; n_chars follows the text."""
    out = dedup_lines(docs)
    out = out.where((F.col("n_removed") == 0) | (F.regexp_replace("text", _SPACES[:-1] + r"\n ]", "") != ""))
    columns = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
               else F.col(f"doc.`{c}`") for c in docs.columns]
    return out.select(*columns)
