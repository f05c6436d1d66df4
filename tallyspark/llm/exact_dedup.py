"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, the SHA-256 of a text in
which every run of ASCII white space is one space. It holds one row a digest: the
document that stays. ``load`` digests a batch of new documents, reduces it to the first
document of each digest, removes what the index has by a sort-merge anti-join that
shuffles the batch alone (the index is read in its buckets), and appends the rest.
Every batch is one append: what is committed stays, and a batch that was lost on the
way, or comes again, adds only what the index lacks.

``resolve`` gives each document the one that stays. Counts are partial sums before the
shuffle. A digest that holds more than one of HOT_SHARE documents would send its copies
to one task; there are fewer than HOT_SHARE of these, whatever the corpus, so they
are broadcast and their copies stay where they are. All others are joined.

The table is registered under a name of its own while an index is open; ``close``
forgets the name and keeps the files, from which ``DigestIndex`` opens it again.

Rows: a null text is an empty one; among equal texts the smallest doc_id stays, null
ids last, and of rows that repeat it one (the first read); a document of an earlier
batch stays before those of later ones; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shared_folder, shuffles_dropped, staged

HOT_SHARE = 1000
_COLUMNS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, digest) of every document; ``row`` tells rows apart once written."""
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text, 256)).alias("digest"))


class DigestIndex:
    """The index in folder ``path`` (new, or of an earlier session)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE TABLE {self.name} ({_COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                  f"INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def load(self, batch: DataFrame) -> str:
        """Appends the first document of each digest that the index lacks. ``batch``
        is of :func:`digests`, written before. Returns the batch's name."""
        name = uuid.uuid4().hex
        order = F.coalesce("doc_id", F.lit((1 << 63) - 1))  # null ids last
        first = batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.min_by("row", order).alias("keep_row"), F.count(F.lit(1)).alias("n"))
        # Asking for n keeps the join above the aggregate: below it, every copy would be shuffled.
        index = self.rows().hint("merge").alias("i")
        new = first.alias("f").join(index, (F.col("f.digest") == F.col("i.digest")) & (F.col("f.n") > 0), "left_anti")
        new = new.drop("n").withColumn("batch", F.lit(name))
        with shuffles_dropped(self.spark):
            (new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
             .option("path", self.path).saveAsTable(self.name))
        return name

    def resolve(self, rows: DataFrame) -> DataFrame:
        """Documents that were loaded, with ``batch``, the name of their load: doc_id,
        keep_id, group_size (among these rows), kept, text_sha256."""
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        entries = staged(self.rows().withColumnRenamed("batch", "keep_batch").join(sizes, "digest"), "digest-groups")
        total = entries.agg(F.sum("group_size").alias("n")).first()["n"] or 0
        hot = F.col("group_size") * HOT_SHARE > total
        often = rows.join(F.broadcast(entries.where(hot)), "digest", "left")  # fewer than HOT_SHARE entries
        rare = often.where("group_size is null").select(*rows.columns).join(entries.where(~hot), "digest")
        out = often.where("group_size is not null").unionByName(rare)
        kept = (F.col("batch") == F.col("keep_batch")) & (F.col("row") == F.col("keep_row"))
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # external: the files stay


def dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """All of ``docs``, loaded into a new index in ``batches`` of ascending doc_id, so
    that the smallest doc_id stays: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = staged(digests(docs), "digests")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] or []
    part = F.lit(0)
    for cut in cuts:  # any cuts give the same rows
        part = part + (F.coalesce(F.col("doc_id") > cut, F.lit(True))).cast("int")
    rows = rows.withColumn("part", part)
    path = shared_folder(spark, "digest-index")
    index = DigestIndex(spark, path)
    try:
        names = [index.load(rows.where(F.col("part") == i)) for i in range(len(cuts) + 1)]
        rows = rows.withColumn("batch", F.element_at(F.array(*map(F.lit, names)), F.col("part") + 1))
        return staged(index.resolve(rows), "exact-dedup")
    finally:
        index.close()


def op12_exact_dedup(spark, sf_dir) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
