"""Shared small helpers: column picking, Arrow mapping over whole rows, table readers."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows per output batch: keeps the Python side of a task small whatever the partition holds.
OUT_ROWS = 20_000
#: Bytes of an incoming batch that are Python objects at one time (a single longer row is one slice).
SLICE_BYTES = 4 << 20
#: By whether digits belong to words: what becomes a blank beyond ASCII, and ASCII as it is kept (bytes of other characters stay).
_BLANKED = {False: re.compile(r"[^\x00-\x7f\w]|(?![0-9])\d"), True: re.compile(r"[^\x00-\x7f\w]")}
_KEPT = {digits: bytes(c if c > 127 or chr(c).isalpha() or (digits and chr(c).isdigit()) else 32 for c in range(256)) for digits in (False, True)}


def pick(df: DataFrame, **named: str) -> DataFrame:
    """The columns ``new=old`` of ``df``, found by position.

    Other columns never matter, not even if they equal a wanted name but for the case or collide
    with a name that an operator uses inside.  An exact match of the name wins.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def at(name: str) -> Column:
        exact = [i for i, c in enumerate(df.columns) if c == name]
        loose = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not (exact or loose):
            raise ValueError(f"no column {name!r} in {df.columns}")
        return F.col(f"c{(exact or loose)[0]}")

    return plain.select(*[at(old).alias(new) for new, old in named.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, function: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Arrow map: ``function`` gets one list per column of a slice and yields output tuples.

    Runs on the partitions of ``df`` without a shuffle; output leaves in batches of OUT_ROWS rows.
    """
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in slices(batches):
            rows: list[tuple] = []
            for row in function(*columns):
                rows.append(row)
                if len(rows) >= OUT_ROWS:
                    yield as_batch(rows, arrow)
                    rows = []
            if rows:
                yield as_batch(rows, arrow)
        release()

    return df.mapInArrow(run, struct)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of batches as lists, as many rows at a time as hold about SLICE_BYTES on average."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield [column.to_pylist() for column in batch.slice(at, rows).columns]


def spaced(text: str | None, digits: bool) -> bytes | None:
    """The lower-case words of a text with blanks between them, None if it has none."""
    low = (text or "").lower()
    if not low.isascii():
        low = _BLANKED[digits].sub(" ", low)
    return low.encode().translate(_KEPT[digits]).strip() or None


def word_numbers(texts: list[str | None], digits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-case words of a slice of texts: their numbers in order, how many each text has, and the words by number.

    The words that findall of [^\\W\\d_]+ (with ``digits`` of [^\\W_]+) gives; Arrow splits and numbers them, so
    only distinct words become Python objects.
    """
    lists = pc.ascii_split_whitespace(pa.array([spaced(text, digits) for text in texts], pa.string()))
    coded = lists.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return coded.indices.to_numpy(), sizes, coded.dictionary.to_numpy(zero_copy_only=False)


def release() -> None:
    """Give back what a finished task freed: a reused worker otherwise keeps its peak for the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def keep_rows(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` semi- or anti-joined with ``ids`` (one column ``id``) on doc_id, NULL equal to NULL."""
    position = [i for i, c in enumerate(docs.columns) if c == "doc_id"] or [
        i for i, c in enumerate(docs.columns) if c.lower() == "doc_id"
    ]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = plain.join(ids, F.col(f"c{position[0]}").eqNullSafe(ids["id"]), how)
    return kept.toDF(*docs.columns)


_HELD: dict = {}


def one_per_worker(key: str, build: Callable):
    """What ``build`` makes, kept by a worker process for its next tasks; only the latest one is kept."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]
