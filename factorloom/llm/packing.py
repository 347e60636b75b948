"""Bounded-space online packing of documents into fixed windows of tokens.

Each partition keeps a fixed number of open windows.  A document is cut where it fills whole windows; its
rest goes to the open window that it fits best.  When none fits and all are open, the fullest is emitted.
Windows still open at the end of a partition are merged best-fit, MERGE_PARTS partitions at a time, so no
task sees more than MERGE_PARTS x OPEN windows.

One pass over the scan's own partitions: no shuffle of texts or ids.  The packed pieces are written
once to the shared folder; merging only renumbers windows.

Defined results.  NULL and empty texts are a document of the end token alone.  Repeated rows and repeated ids are
packed as often as they come.  NULL doc_id is carried along.  An empty table gives no rows; extra columns
are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factorloom.llm.common import as_batch, pick, release, slices
from factorloom.llm.words import word_ids
from factorloom.session import stored

WINDOW = 4096
OPEN = 48
END_ID = 2
MERGE_PARTS = 64
#: Bytes of ids per output batch.
OUT_BYTES = 4 << 20


class OpenWindows:
    """At most ``limit`` windows with room left, ordered by their room."""

    def __init__(self, size: int, limit: int) -> None:
        self.size, self.limit = size, limit
        self.rooms: list[tuple[int, int]] = []  # (room, number), ascending
        self.next = 0

    def place(self, length: int) -> tuple[int, int]:
        """(window number, offset) for a piece of ``length`` tokens (at most one window)."""
        at = bisect.bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.limit:
                self.rooms.pop(0)  # the fullest leaves
            room, number = self.size, self.next
            self.next += 1
        if room > length:
            bisect.insort(self.rooms, (room - length, number))
        return number, self.size - room


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN, end_id: int = END_ID, of_ids: Callable[[Column], Column] = lambda ids: ids
) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, ids (little-endian uint32 bytes), sequence_id, offset.

    ``of_ids``: what is written of the ids and stands in their column.
    """
    rows = pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    struct = T.StructType.fromDDL(f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary, seq bigint, offset bigint, room bigint")
    arrow = to_arrow_schema(struct)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer).encode
        base = TaskContext.get().partitionId() << 32
        windows = OpenWindows(window, open_windows)
        out: list[tuple] = []
        size = 0
        for columns in slices(batches):
            for doc_id, text in zip(*columns):
                ids = (encode(text) if text else b"") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    number, offset = windows.place(length)
                    out.append((doc_id, start, length, total, ids[4 * start : 4 * (start + length)], base + number, offset, None))
                size += len(ids)
                if size >= OUT_BYTES or len(out) >= 10_000:
                    yield as_batch(out, arrow)
                    out, size = [], 0
        out += [(None, None, None, None, None, base + number, None, room) for room, number in windows.rooms]
        if out:
            yield as_batch(out, arrow)
        release()

    packed = stored(rows.mapInArrow(run, struct).withColumn("ids", of_ids(F.col("ids"))), "packed")
    moved = stored(merged(packed.where("room is not null").select("seq", "room"), window), "moved")
    pieces = packed.where("room is null").drop("room").join(moved.withColumnRenamed("seq", "old"), F.col("seq") == F.col("old"), "left")
    return pieces.select(
        "doc_id", "start", "length", "doc_tokens", "ids", F.coalesce("target", "seq").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def merged(left: DataFrame, window: int) -> DataFrame:
    """Where the windows (seq, room) that were left open go: (seq, target, shift)."""
    struct = T.StructType.fromDDL("seq bigint, target bigint, shift bigint")
    arrow = to_arrow_schema(struct)

    def merge(table: pa.Table) -> pa.Table:
        items = sorted(((window - r, s) for s, r in zip(table["seq"].to_pylist(), table["room"].to_pylist())), key=lambda x: (-x[0], x[1]))
        spaces, first, rows = OpenWindows(window, len(items) + 1), {}, []
        for used, seq in items:
            number, shift = spaces.place(used)
            first.setdefault(number, seq)
            rows.append((seq, first[number], shift))
        return pa.Table.from_batches([as_batch(rows, arrow)])

    group = F.shiftright("seq", 32).cast("long") / MERGE_PARTS
    return left.withColumn("part", F.floor(group)).groupBy("part").applyInArrow(merge, struct)
