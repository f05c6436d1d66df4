"""Tables written to the shared folder, and small helpers of all operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def with_conf(spark: SparkSession, settings: dict[str, str]):
    """Session settings that hold meanwhile."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is written meanwhile go once it is written: its
    result is in files, and nothing reads them again."""
    return with_conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts
    the lineage, survives the loss of executors, and is not computed twice."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables of one operator's run in one folder below ``spark.checkpoint.dir``. Each
    goes when no step reads it any more, all when the run ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tables = spark, shared_folder(spark, name), {}

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*list(self.tables))
        self._delete(self.root)

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """Like :func:`staged`."""
        with shuffles_dropped(self.spark):
            df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def bucketed(self, df: DataFrame, name: str, n: int, keys: list[str], options: dict[str, str] | None = None,
                 order: list[str] | None = None) -> DataFrame:
        """``df``, dealt by ``keys`` over n partitions, as a table of n buckets, each sorted by ``order``."""
        table = f"{name}_{uuid.uuid4().hex[:12]}"
        self.tables[name] = table
        out = df.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "1", **(options or {})}).bucketBy(n, *keys)
        with shuffles_dropped(self.spark):
            (out.sortBy(*order) if order else out).format("parquet").option("path", f"{self.root}/{name}").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def held_out(id_col: str = "doc_id"):
    """True for the evaluation fold: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slabs(texts: list[str], max_chars: int):
    """Index ranges (lo, hi) of consecutive texts of at most ``max_chars``
    characters together (a longer text is a range of its own)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_chars:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
