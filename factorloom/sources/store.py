"""Writing results: snapshots, sealed partitions, factor values and reports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a snapshot file at most: a file is hashed as a whole by one executor.
FILE_ROWS = 2_000_000


def with_lineage(df: DataFrame, **values: str) -> DataFrame:
    """Literal lineage columns (schema_version, snapshot_id, data_version, source, fetched_at)."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def write_snapshot(tables: Mapping[str, DataFrame], path: str, partition_by: Mapping[str, str] | None = None) -> DataFrame:
    """Write every table as Parquet; return the manifest (table, path, rows, digest)."""
    manifest = None
    for name, df in tables.items():
        target = f"{path}/{name}"
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(target)
        row = fingerprint(df.sparkSession.read.parquet(target)).select(
            F.lit(name).alias("table"), F.lit(target).alias("path"), "n_rows", "digest"
        )
        manifest = row if manifest is None else manifest.unionByName(row)
    return manifest


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, md5) of the Parquet files below ``folder``, paths relative to it; executors read and hash them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/"), -1)
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.md5("content").alias("md5"))


def publish_snapshot(tables: Mapping[str, DataFrame], path: str, partition_by: Mapping[str, str] | None = None, file_rows: int = FILE_ROWS) -> str:
    """Write a new version of all tables below ``path`` and return its folder.

    Two phases, without renames (object stores have none): the tables go to a folder that nobody reads yet, executors
    hash its files, and the manifest (table, file, bytes, md5) is written last.  A version without a manifest does
    not exist for ``open_snapshot``, so a job that fails half-way leaves the versions before it untouched.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"
    manifest = None
    for name, df in tables.items():
        writer = df.write.option("maxRecordsPerFile", file_rows)
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{version}/data/{name}")
        rows = file_hashes(spark, f"{version}/data/{name}").withColumn("table", F.lit(name))
        manifest = rows if manifest is None else manifest.unionByName(rows)
    manifest.coalesce(1).write.parquet(f"{version}/manifest")
    return version


def snapshot_manifest(spark: SparkSession, version: str) -> DataFrame:
    """The manifest of a published version; an error if it was never published."""
    return spark.read.schema("file string, bytes bigint, md5 string, table string").parquet(f"{version}/manifest")


def verify_snapshot(spark: SparkSession, version: str) -> DataFrame:
    """(table, file, problem) of every file that is missing, changed or unknown to the manifest."""
    said = snapshot_manifest(spark, version).select("table", "file", "bytes", "md5")
    found = None
    for name in [r[0] for r in said.select("table").distinct().collect()]:  # the tables of a snapshot
        part = file_hashes(spark, f"{version}/data/{name}").select(F.lit(name).alias("table"), "file", F.col("bytes").alias("_b"), F.col("md5").alias("_m"))
        found = part if found is None else found.unionByName(part)
    both = said.join(found, ["table", "file"], "full_outer")
    problem = F.when(F.col("_m").isNull(), "missing").when(F.col("md5").isNull(), "unknown").when((F.col("_m") != F.col("md5")) | (F.col("_b") != F.col("bytes")), "changed")
    return both.select("table", "file", problem.alias("problem")).where("problem IS NOT NULL")


def open_snapshot(spark: SparkSession, version: str, table: str) -> DataFrame:
    """A table of a published version."""
    if snapshot_manifest(spark, version).where(F.col("table") == table).isEmpty():
        raise ValueError(f"no table {table!r} in {version}")
    return spark.read.parquet(f"{version}/data/{table}")


def text_fingerprint(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """V34 in a form that other engines reproduce: row count and sum of the first 32 bits of the rows' MD5.

    ``columns`` are the texts of a row; they are joined by ``|``.  The sum does not depend on the order of rows.
    """
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(head), F.lit(0)).alias("digest"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: row count and XOR of row hashes (duplicates are kept apart by the count)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("digest"),
    )


def seal_split(df: DataFrame, cutoff: Column, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """(development, holdout) by date; the filters reach the scan when ``date`` is stored."""
    return df.where(F.col(date) < cutoff), df.where(F.col(date) >= cutoff)


def write_sealed(df: DataFrame, cutoff: Column, path: str, sealed_path: str, date: str = "date") -> None:
    development, holdout = seal_split(df, cutoff, date)
    development.write.mode("overwrite").parquet(path)
    holdout.write.mode("overwrite").parquet(sealed_path)


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "factor_id", version: str = "updated_at") -> DataFrame:
    """The newest row per key of both tables, as one map-side combined aggregation."""
    both = stored.unionByName(incoming)
    rest = [c for c in both.columns if c != key]
    newest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_n"))
    return newest.select(key, *[F.col(f"_n.{c}").alias(c) for c in rest])


def trade_report(trades: DataFrame, key: str = "code") -> DataFrame:
    """One JSON text per trade.  The report is the sorted set of these rows per code: nothing
    is collected into one array, so a code with very many trades stays distributed."""
    fields = [c for c in trades.columns if c != key]
    return trades.select(key, F.to_json(F.struct(*fields)).alias("trade"))
