"""Exact deduplication as a stateful stream with disk-backed keyed state.

Arrivals (digest, stable id, size) stream through a keyed aggregation whose state sits in RocksDB
and never expires: per digest it retains the id of the row that stays, its size as the content
locator's rank, and the number of rows seen.  A restarted stream carries on from its checkpoint, and a
later run over new arrivals continues the same state.  Rows that share a digest are hits: their
full normalised bytes are compared with those of the row that stays, and rows that differ
(colliding digests) are grouped by the bytes themselves.

Everything is DataFrame and SQL functions; no Python runs on executors.

Defined results.  NULL text counts as empty; all empty texts (or texts of white space only) form one
group.  NULL doc_id sorts after every id.  Repeated rows (same id, same text) are members like any
other and each is reported; the pipeline keeps one of them.  An empty table gives no rows.  Extra
columns are ignored.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import keep_rows, pick
from factorloom.session import shared_folder, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What counts as white space: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    for blank in BLANKS:  # measured: translate takes twice the time
        body = F.replace(body, F.lit(blank), F.lit(""))
    return body


@contextlib.contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """RocksDB state, closed after each commit: a store preallocates megabytes of local disk while it is open."""
    wanted = {"providerClass": ROCKSDB, "unloadOnCommit": "true"}
    keys = {f"spark.sql.streaming.stateStore.{k}": v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rank() -> Column:
    """Orders candidates: most code points first, then the smallest id (NULL last)."""
    return F.struct((-F.col("points")).alias("minus"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))


def stream_groups(arrivals_path: str, arrivals: DataFrame, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Run the stream over all arrivals; one row per digest with the row that stays.

    ``folder`` (shared) holds the checkpoint and the update log; running again with the same folder
    processes only arrivals that are new.
    """
    spark = arrivals.sparkSession
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(arrivals_path)
    state = stream.groupBy("digest").agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    log = f"{folder}/updates"

    def write(batch: DataFrame, epoch: int) -> None:  # a repeated epoch replaces its own folder
        batch.write.mode("overwrite").parquet(f"{log}/epoch={epoch}")

    with _state_on_disk(spark):
        query = (
            state.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).start()
        )
        query.awaitTermination()
    schema = state.schema.add("epoch", "long")
    updates = spark.read.schema(schema).option("basePath", log).parquet(log)
    return updates.groupBy("digest").agg(
        F.max_by("best", "epoch").alias("best"), F.max("group_size").alias("group_size")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest_bits`` shortens the key of the state (tests force collisions with it); the reported
    hash is always the whole SHA-256.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/exact-{uuid.uuid4().hex}"
    rows = pick(docs, doc_id=id_col, text=text_col)
    arrivals_path = f"{folder}/arrivals"
    hashed = rows.select(
        "doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points"),
    ).withColumn("digest", F.substring("text_sha256", 1, digest_bits // 4))
    hashed.write.parquet(arrivals_path)
    arrivals = spark.read.schema(hashed.schema).parquet(arrivals_path)
    if arrivals.isEmpty():
        return arrivals.select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.col("points").alias("group_size"),
            F.lit(True).alias("kept"), "text_sha256",
        )
    winners = stored(stream_groups(arrivals_path, arrivals, folder), "winners")
    joined = arrivals.join(winners, "digest").select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size", "text_sha256", "digest", "points"
    )
    odd = stored(_unequal(rows, joined, digest_bits), "unequal")
    if odd.isEmpty():
        grouped = joined
    else:
        again = _by_bytes(rows, odd, digest_bits)
        rest = joined.join(odd, "digest", "left_anti")
        grouped = rest.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(again)
    return grouped.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _unequal(rows: DataFrame, joined: DataFrame, digest_bits: int) -> DataFrame:
    """The full-byte check of all hits: digests whose rows are not all equal byte by byte.

    Texts are found by the ids of the hits and only these are hashed again; the least and the greatest text of a group
    are combined before the shuffle, so a hot group arrives as one pair per task.
    """
    # other texts of such an id come along, each to the group of its own digest
    hits = joined.where("group_size > 1").select(F.col("doc_id").alias("id")).distinct()
    bodies = keep_rows(rows, hits, "left_semi").select(normalised(F.col("text")).alias("body"))
    texts = bodies.withColumn("digest", F.substring(F.sha2("body", 256), 1, digest_bits // 4))
    return texts.groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a != b").select("digest")


def _by_bytes(rows: DataFrame, odd: DataFrame, digest_bits: int) -> DataFrame:
    """Groups of the rows behind colliding digests, by their bytes."""
    bodies = rows.select(
        "doc_id", normalised(F.col("text")).alias("body"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points")
    ).withColumn("text_sha256", F.sha2("body", 256))
    keyed = bodies.withColumn("digest", F.substring("text_sha256", 1, digest_bits // 4)).join(odd, "digest", "left_semi")
    best = keyed.groupBy("body").agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return keyed.join(best, "body").select("doc_id", F.col("best.id").alias("keep_id"), "group_size", "text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without exact duplicates, columns unchanged.

    Of repeated rows (equal id, equal normalised text) the one with the most code points stays.  An id of one row is judged by the
    id alone; only texts of ids that come more than once are hashed again.
    """
    groups = exact_duplicates(docs)
    of_id = groups.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("stay"))
    verdict = stored(of_id.where("n > 1 or stay = 0"), "verdict")
    repeated = verdict.where("stay > 0").select("id")
    stays = keep_rows(docs, verdict.select("id"), "left_anti")
    if repeated.isEmpty():
        return stays
    some = keep_rows(docs, repeated, "left_semi")
    kept = keep_rows(groups.where("kept").select("doc_id", "text_sha256"), repeated, "left_semi")
    verdicts = kept.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).distinct()
    lower = [c.lower() for c in docs.columns]
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, text = (F.col(names[docs.columns.index(n) if n in docs.columns else lower.index(n)]) for n in ("doc_id", "text"))
    keyed = some.toDF(*names).withColumn("own", F.sha2(normalised(text), 256))
    same = at.eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha"))
    order = Window.partitionBy(at, "own").orderBy(F.char_length(text).desc_nulls_last())
    again = keyed.join(verdicts, same, "left_semi").withColumn("place", F.row_number().over(order))
    return stays.toDF(*names).unionByName(again.where("place = 1").drop("own", "place")).toDF(*docs.columns)
