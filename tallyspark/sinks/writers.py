"""Sinks: replaced tables, per-company partitioned outputs with a manifest, merged
exports and the reconciliation log."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its Path class."""
    jvm = spark.sparkContext._jvm
    cls = jvm.org.apache.hadoop.fs.Path
    return cls(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), cls


def replace_table(df: DataFrame, target: str, fmt: str = "parquet") -> None:
    """Replace a table (B1). The new rows are written beside the old ones and take
    their place only once they are whole, so a write that fails leaves the old table.

    A bare name is a view on the current rows, so that a reader sees the old or the
    new table, never neither; earlier rows stay in the warehouse until
    :func:`drop_versions`. A path is a plain folder, swapped by two renames; where
    readers must not meet the moment between these, use a name or :func:`publish`."""
    spark = df.sparkSession
    if "/" in target or ":" in target:
        target = target.rstrip("/")
        mark = uuid.uuid4().hex[:12]
        new, old = f"{target}__new_{mark}", f"{target}__old_{mark}"
        fs, path = _file_system(spark, target)
        _whole(df, new, fmt)
        had = fs.exists(path(target)) and fs.rename(path(target), path(old))
        if not fs.rename(path(new), path(target)):
            if had:
                fs.rename(path(old), path(target))
            raise OSError(f"{target} could not be replaced")
        if had:
            fs.delete(path(old), True)
        return
    data = f"{_versions_of(spark, target)}/{uuid.uuid4().hex}"
    _whole(df, data, fmt)
    if spark.catalog.tableExists(target) and not spark.catalog.getTable(target).tableType.endswith("VIEW"):
        spark.sql(f"DROP TABLE {target}")  # a table of this name from before it was a view
    spark.sql(f"CREATE OR REPLACE VIEW {target} AS SELECT * FROM {fmt}.`{data}`")


def _whole(df: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """``df`` written to a new folder; of a write that fails nothing is left."""
    try:
        df.write.format(fmt).save(folder)
    except BaseException:
        fs, path = _file_system(df.sparkSession, folder)
        fs.delete(path(folder), True)
        raise


def _versions_of(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}_versions"


def drop_versions(spark: SparkSession, name: str) -> None:
    """Delete the rows of a replaced table that its view no longer shows."""
    current = {f.split("/")[-2] for f in spark.table(name).inputFiles()}
    fs, path = _file_system(spark, _versions_of(spark, name))
    for status in fs.listStatus(path(_versions_of(spark, name))):
        if status.getPath().getName() not in current:
            fs.delete(status.getPath(), True)


COMMITS = "version long, folder string, at timestamp"


def publish(df: DataFrame, target: str) -> int:
    """The rows of ``df`` as the next version of the table in folder ``target``: written
    under a name of their own, then named by one more committed row. Readers
    (:func:`published`) follow the last commit: they see the old or the new version
    whole, and a write that fails changes nothing. Returns the version."""
    spark = df.sparkSession
    last = _last_commit(spark, target)
    version, folder = (last["version"] if last else 0) + 1, uuid.uuid4().hex
    _whole(df, f"{target}/data/{folder}")
    commit = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), F.current_timestamp().alias("at"))
    commit.coalesce(1).write.mode("append").parquet(f"{target}/commits")
    return version


def _last_commit(spark: SparkSession, target: str):
    try:
        commits = spark.read.schema(COMMITS).parquet(f"{target}/commits")
    except AnalysisException:  # nothing published yet
        return None
    return commits.orderBy(F.desc("version"), F.desc("at"), F.desc("folder")).first()


def published(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The last (or the given) version of a published table."""
    if version is None:
        commit = _last_commit(spark, target)
    else:
        commits = spark.read.schema(COMMITS).parquet(f"{target}/commits").where(F.col("version") == version)
        commit = commits.orderBy(F.desc("at"), F.desc("folder")).first()
    if commit is None:
        raise ValueError(f"{target} holds no such version")
    return spark.read.parquet(f"{target}/data/{commit['folder']}")


# ---------------------------------------------------------------------------
# One output per company
# ---------------------------------------------------------------------------

def write_per_company(df: DataFrame, path: str, by: str = "company", fmt: str = "parquet",
                      mode: str = "overwrite", max_records_per_file: int = 5_000_000) -> None:
    """One output per company (B2, B3, B4): a partitioned write. The rebalance
    hint groups a company's rows, and AQE splits a large company over as many
    tasks as its size asks for. The folder is named ``<by>_part=...``; the
    column itself stays in the rows, so that codes such as ``007`` keep their text."""
    out = df.withColumn(f"{by}_part", F.col(by)).hint("rebalance", by)
    (out.write.mode(mode).format(fmt).option("header", "true").option("maxRecordsPerFile", max_records_per_file)
     .partitionBy(f"{by}_part").save(path))


MAX_RECORDS_PER_FILE = 5_000_000
_NO_PART = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = {c: f"%{c:02X}" for c in (*range(1, 32), *map(ord, "\"#%'*/:=?\\{[]^"), 127)}  # as Spark names the folders of its own partitions


def write_parts(df: DataFrame, path: str, by: str = "company", expected: DataFrame | None = None) -> DataFrame:
    """:func:`write_per_company` with a manifest: (part, n_rows, n_files) of every part
    that was written (B2-B4). ``expected`` names parts (column ``by``) that must be
    listed though they have no rows (B3). The manifest is written to
    ``<path>_manifest`` once the parts are whole. On a local or mounted file system the
    tasks write the files (:func:`_write_files`) and count their rows meanwhile."""
    from tallyspark.sources.xlsx import _local
    spark = df.sparkSession
    if _local(path) is None:
        write_per_company(df, path, by)
        found = _parts(spark, path, by, df.schema).groupBy(F.col(f"{by}_part").alias("part")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct("_metadata.file_path").alias("n_files"))
        return _write_manifest(found, path, by, expected)
    path = path.rstrip("/")
    new, listed = (f"{path}__{what}_{uuid.uuid4().hex[:12]}" for what in ("new", "files"))
    fs, hadoop = _file_system(spark, path)
    try:
        _write_files(df, new, by).write.parquet(listed)
        fs.mkdirs(hadoop(new))
        if fs.exists(hadoop(path)):
            fs.delete(hadoop(path), True)
        if not fs.rename(hadoop(new), hadoop(path)):
            raise OSError(f"{path} could not be written")
        files = spark.read.schema("part string, n_rows long").parquet(listed)
        found = files.groupBy("part").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_files"))
        return _write_manifest(found, path, by, expected)
    finally:
        fs.delete(hadoop(new), True)
        fs.delete(hadoop(listed), True)


def _write_manifest(found: DataFrame, path: str, by: str, expected: DataFrame | None) -> DataFrame:
    if expected is not None:
        names = expected.select(F.col(by).alias("part")).where("part is not null").distinct()
        found = found.join(names, "part", "full_outer").select(
            "part", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_files", F.lit(0)).alias("n_files"))
    found.write.mode("overwrite").parquet(path.rstrip("/") + "_manifest")
    return read_manifest(found.sparkSession, path)


def _write_files(df: DataFrame, folder: str, by: str) -> DataFrame:
    """Writes ``df`` as ``<folder>/<by>_part=<name>/part-<task>-<number>.parquet`` and gives
    (part, n_rows) of each file. A large company is split over tasks as in
    :func:`write_per_company`; a task holds one Arrow batch and one open file. A file
    appears whole, and under the same name if a lost task runs again."""
    most = MAX_RECORDS_PER_FILE

    def run(batches):
        from itertools import groupby

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        from tallyspark.sinks.workbooks import _drafted
        task = TaskContext.get().partitionId()

        def slices():
            for batch in batches:
                names, rows, lo = batch.column("_part").to_pylist(), batch.drop_columns(["_part"]), 0
                for name, same in groupby(names):
                    n = sum(1 for _ in same)
                    for at in range(lo, lo + n, most):
                        yield name, rows.slice(at, min(most, lo + n - at))
                    lo += n

        number, size = 0, 0

        def file_of(piece):  # a company's rows, and within them those of one file
            nonlocal number, size, last
            name, rows = piece
            if name != last or size + len(rows) > most:
                number, size, last = number + 1, 0, name
            size += len(rows)
            return number

        last = object()
        for no, pieces in groupby(slices(), key=file_of):
            name, rows = next(pieces)
            where = f"{folder}/{by}_part={name.translate(_ESCAPED) if name else _NO_PART}"
            with _drafted(where, f"part-{task:05d}-{no}.parquet") as (fh, _), pq.ParquetWriter(fh, rows.schema) as out:
                out.write_batch(rows)
                n = len(rows)
                for _, rows in pieces:
                    out.write_batch(rows)
                    n += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([None if name in ("", _NO_PART) else name], pa.string()), pa.array([n], pa.int64())], ["part", "n_rows"])

    rows = df.withColumn("_part", F.col(by).cast("string")).hint("rebalance", by).sortWithinPartitions("_part")
    return rows.mapInArrow(run, "part string, n_rows long")


def _parts(spark: SparkSession, path: str, by: str, schema) -> DataFrame:
    """All parts; part names stay text (``007``, ``8``)."""
    from pyspark.sql.types import StringType, StructType
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"  # else a task for each folder that is listed
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.schema(StructType(schema.fields).add(f"{by}_part", StringType())).parquet(path)
    finally:
        spark.conf.set(key, before)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part string, n_rows long, n_files long").parquet(path.rstrip("/") + "_manifest")


def read_parts(spark: SparkSession, path: str, schema, by: str = "company", parts=None) -> DataFrame:
    """The rows of the given parts (all if None): only their folders are read. A part
    that the manifest lists with no rows gives none."""
    rows = _parts(spark, path, by, schema)
    if parts is not None:
        rows = rows.where(F.col(f"{by}_part").isin(list(parts)))
    return rows.drop(f"{by}_part")


def export_merged(df: DataFrame, path: str, file_col: str = "文件名", fmt: str = "parquet") -> None:
    """One merged output with the file-name column first."""
    cols = [file_col] + [c for c in df.columns if c != file_col]
    df.select(*[F.col(f"`{c}`") for c in cols]).write.mode("overwrite").format(fmt) \
        .option("header", "true").save(path)


# ---------------------------------------------------------------------------
# Reconciliation log
# ---------------------------------------------------------------------------

def write_recon_log(recon: DataFrame, path: str, by: str = "company", run: int | None = None,
                    companies: DataFrame | None = None) -> None:
    """Per-paper reconciliation log (B6): the log of every company of this run is
    replaced, the others stay (dynamic partition overwrite). ``run`` numbers the rows'
    run. ``companies`` (column ``by``) are all companies of the run: one that agrees
    has no rows, and an empty log replaces its earlier one. It is held by one row of
    nulls, which :func:`read_recon_log` leaves out."""
    out = recon
    if run is not None:
        out = out.withColumn("run", F.lit(run).cast("long"))
    out = out.withColumn("_agrees", F.lit(False))
    if companies is not None:
        clean = companies.select(by).distinct().join(recon.select(by).distinct(), by, "left_anti")
        if run is not None:
            clean = clean.withColumn("run", F.lit(run).cast("long"))
        out = out.unionByName(clean.withColumn("_agrees", F.lit(True)), allowMissingColumns=True)
    (out.withColumn(f"{by}_part", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(f"{by}_part").parquet(path))


def read_recon_log(spark: SparkSession, path: str, by: str = "company") -> DataFrame:
    """The rows of the last run of each company."""
    return spark.read.option("mergeSchema", "true").parquet(path).where("not coalesce(_agrees, false)").drop("_agrees", f"{by}_part")
