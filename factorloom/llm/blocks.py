"""Members of a key in blocks: a key with too many members is dealt out by pairs of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of a large key are dealt while they look up its size.
SALTS = 64


def dealt(rows: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """``rows`` with (i, j, side), once per task in which they meet others of their key.

    A key with up to ``block`` members is one task (0, 0).  A larger one is cut by the hash of ``member`` into
    blocks of about that many; task (i, i) holds one block, task (i, j) block i as side 0 and block j as side 1,
    so every pair of members meets in exactly one task.  Sizes are counted before the shuffle, and the rows
    of a large key look theirs up in SALTS parts: no key is one task's work at any step.
    """
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    sizes = large.select(*keys, F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(member), F.lit(SALTS)).cast("int"))
    known = salted.join(sizes, [*keys, "salt"], "left").drop("salt").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = known.withColumn("mine", F.pmod(F.xxhash64(F.lit(1), F.col(member)), F.col("blocks")).cast("int"))
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = met.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    return tasks.withColumn("side", (F.col("mine") != F.col("i")).cast("int")).drop("mine", "other", "blocks")
