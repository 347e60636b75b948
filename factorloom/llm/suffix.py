"""Repeated passages by a sparse suffix array.

Suffixes are retained where a minimiser stands: the smallest hash of SEED_WORDS words among PICK places in a row, so the choice
depends on content alone and two copies of a passage retain the same places.  Retained suffixes are sorted by their
first KEY words (as two hashes) and the words around these, neighbours are compared, and neighbours with equal keys are matches.
Matches of two documents on one diagonal that touch become one run, and both ends of a run are extended left and
right word by word with the documents' own words.  Runs of MIN_WORDS words or more are reported.

The sort is a range partition over (key, document, place): copies of one hot passage spread over many
partitions, and the rows at partition borders are compared in a second, tiny step.  Every suffix links to one
predecessor, so a passage in n documents gives n - 1 runs and never all pairs.

Reach: every stretch of MIN_WORDS words that stands at two places lies in a reported passage at both.  Its first PICK seeds hold
one minimiser, retained at both places with the same KEY words.  Suffixes that also agree on the PICK - 1 words before
and the PICK words behind the key form a class: inside it neighbours share all stretches.  A key with two classes has
them side by side.  With three or more, a text that shares little more than the key can stand between two that
share a stretch; one suffix of every class then lists the hashes of its stretches (those whose minimiser it is), and equal
ones are sorted and linked in the same way.

Defined results.  Words are white-space separated, ASCII letters folded.  NULL and empty texts have no suffix.  Rows of
one doc_id are one document: repeated rows say nothing about themselves.  NULL doc_id is a document of its own.  Passages
repeated inside one document are reported with other_id equal to doc_id.  Ties keep the smallest place.  Empty table: no
rows.  Extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factorloom.llm.common import map_rows, pick
from factorloom.session import stored

MIN_WORDS = 50
SEED_WORDS = 8
PICK = 18
KEY = 32
#: Words that travel for each end of a run; the first minimiser of a passage is nearer than PICK words to its start.
REACH = 2 * PICK


def words_of(text: str | None) -> np.ndarray:
    digest = xxhash.xxh32_intdigest
    return np.array([digest(w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], np.uint32)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` words from each place on (places with fewer are left out)."""
    n = len(words) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for i in range(size if n > 0 else 0):
        out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def minimisers(words: np.ndarray) -> np.ndarray:
    """Places of the leftmost smallest seed in every window of PICK places."""
    seeds = rolling(words, SEED_WORDS)
    if len(seeds) < PICK:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(seeds, PICK)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def around(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of the PICK - 1 words before each place and the PICK words behind its key; 0 stands outside the text."""
    before = rolling(np.concatenate((np.zeros(PICK - 1, np.uint32), words)), PICK - 1)[places]
    behind = rolling(np.concatenate((words, np.zeros(PICK, np.uint32))), PICK)[places + KEY]
    return before * np.uint64(0xD6E8FEB86659FD93) ^ behind


def suffixes(docs: DataFrame) -> DataFrame:
    """(a, b, c, doc_id, pos): retained suffixes with the hashes of words 1-16, 17-32 and of those around."""
    rows = pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(ids: list, texts: list) -> Iterable[tuple]:
        for doc_id, text in zip(ids, texts):
            words = words_of(text)
            places = minimisers(words)
            places = places[places + KEY <= len(words)]
            if len(places):
                half = rolling(words, KEY // 2).view(np.int64)
                outer = around(words, places).view(np.int64)
                yield from zip(half[places].tolist(), half[places + KEY // 2].tolist(), outer.tolist(), [doc_id] * len(places), places.tolist())

    return map_rows(rows, run, f"a bigint, b bigint, c bigint, doc_id {kind}, pos int")


def stretches(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(a, b, c, doc_id, pos): the stretches of MIN_WORDS words whose minimiser stands at a given (doc_id, pos), c being 0."""
    # a document is asked at most once for each suffix it retains
    per_doc = places.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("pos").alias("asks"))
    texts = pick(docs, doc_id="doc_id", text="text").join(per_doc, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "asks")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(ids: list, bodies: list, asks: list) -> Iterable[tuple]:
        for doc_id, text, wanted in zip(ids, bodies, asks):
            words = words_of(text)
            whole = rolling(words, MIN_WORDS).view(np.int64)
            if len(whole):
                view = np.lib.stride_tricks.sliding_window_view(rolling(words, SEED_WORDS), PICK)[: len(whole)]
                at = np.flatnonzero(np.isin(view.argmin(axis=1) + np.arange(len(view)), wanted))
                half = rolling(words, MIN_WORDS // 2).view(np.int64)
                yield from zip(whole[at].tolist(), half[at].tolist(), [0] * len(at), [doc_id] * len(at), at.tolist())

    return map_rows(texts, run, f"a bigint, b bigint, c bigint, doc_id {kind}, pos int")


def contested(links: DataFrame) -> DataFrame:
    """(doc_id, pos): one suffix of every class, for keys with three classes or more."""
    step = links.where("c != other_c")
    sides = step.select("a", "b", "c", "doc_id", "pos").union(step.select("a", "b", "other_c", "other_id", "other_pos"))
    classes = sides.groupBy("a", "b", "c").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    # two steps or more; one row per key, so a hot key's classes are split by the skew join
    keys = step.groupBy("a", "b").count().where("count > 1").select("a", "b")
    return classes.join(keys, ["a", "b"]).select("at.*")


def neighbour_links(suffixes: DataFrame) -> DataFrame:
    """(a, b, c, doc_id, pos, other_c, other_id, other_pos) of neighbours with equal keys, borders between partitions included."""
    order = ["a", "b", "c", "doc_id", "pos"]
    sorted_suffixes = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = suffixes.schema["doc_id"].dataType.simpleString()
    struct = T.StructType.fromDDL(
        f"part int, last boolean, a bigint, b bigint, c bigint, doc_id {kind}, pos int, other_c bigint, other_id {kind}, other_pos int"
    )
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).select(order)
            if held is None:
                yield border(table.slice(0, 1), part, False)
            else:
                table = pa.concat_tables([held, table])
            a, b = table["a"].to_numpy(), table["b"].to_numpy()
            at = np.flatnonzero((a[1:] == a[:-1]) & (b[1:] == b[:-1]))
            if len(at):
                now, before = table.take(at + 1), table.take(at)
                none = pa.nulls(len(at))
                yield pa.RecordBatch.from_arrays(
                    [none.cast(pa.int32()), none.cast(pa.bool_())]
                    + [c.combine_chunks() for c in (*now.columns, *before.select(order[2:]).columns)], schema=arrow,
                )
            held = table.slice(table.num_rows - 1, 1)
        if held is not None:
            yield border(held, part, True)

    def border(row: pa.Table, part: int, last: bool) -> pa.RecordBatch:
        values = [row[c][0].as_py() for c in order]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([part, last, *values, None, None, None], arrow)], schema=arrow)

    found = stored(sorted_suffixes.mapInArrow(run, struct), "links")
    columns = [*order, "other_c", "other_id", "other_pos"]
    inside = found.where("part is null").select(columns)
    # two rows per partition: the last row of one meets the first row of the next
    after = Window.orderBy("part", "last")
    edge = found.where("part is not null").select(
        "last", *order, *[F.lag(c).over(after).alias(f"other_{c}") for c in order]
    ).where("not last and a = other_a and b = other_b").withColumnRenamed("other_doc_id", "other_id").select(columns)
    return inside.unionByName(edge).where(~(F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("pos") == F.col("other_pos"))))


def runs(links: DataFrame) -> DataFrame:
    """(run, doc_id, start, stop, other_id, shift): matches on one diagonal that touch, as one run."""
    on = Window.partitionBy("doc_id", "other_id", "shift").orderBy("pos")
    reached = F.max(F.col("pos") + F.col("width")).over(on.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("pos") > reached) | reached.isNull()
    numbered = links.withColumn("shift", F.col("pos") - F.col("other_pos")).withColumn("fresh", fresh.cast("int"))
    numbered = numbered.withColumn("block", F.sum("fresh").over(on))
    joined = numbered.groupBy("doc_id", "other_id", "shift", "block").agg(
        F.min("pos").alias("start"), F.max(F.col("pos") + F.col("width")).alias("stop")
    )
    return joined.select(F.xxhash64("doc_id", "other_id", "shift", "start").alias("run"), "doc_id", "start", "stop", "other_id", "shift")


def extensions(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(run, left, right): by how many equal words each run grows at its ends."""
    ask = F.explode(
        F.array(
            F.struct(F.col("doc_id").alias("id"), F.col("start").alias("at"), F.col("stop").alias("upto"), F.lit(0).alias("who")),
            F.struct(F.col("other_id").alias("id"), (F.col("start") - F.col("shift")).alias("at"), (F.col("stop") - F.col("shift")).alias("upto"), F.lit(1).alias("who")),
        )
    )
    asked = ends.select("run", ask.alias("x")).select("run", "x.id", "x.at", "x.upto", "x.who")
    # a document is asked at most twice for each suffix it retains
    per_doc = asked.groupBy("id").agg(F.collect_list(F.struct("run", "at", "upto", "who")).alias("asks"))
    texts = pick(docs, doc_id="doc_id", text="text").join(per_doc, F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "asks")

    def run(bodies: list, asks: list) -> Iterable[tuple]:
        for text, wanted in zip(bodies, asks):
            words = words_of(text)
            for x in wanted:
                if x["upto"] <= len(words):
                    before = words[max(0, x["at"] - REACH) : x["at"]][::-1]
                    yield x["run"], x["who"], before.tobytes(), words[x["upto"] : x["upto"] + REACH].tobytes()

    sides = map_rows(texts, run, "run bigint, who int, before binary, after binary")
    pick_one = lambda who, c: F.max(F.when(F.col("who") == who, F.col(c)))
    pairs = sides.groupBy("run").agg(*[pick_one(w, c).alias(f"{c}{w}") for w in (0, 1) for c in ("before", "after")])

    def grow(ids: list, b0: list, a0: list, b1: list, a1: list) -> Iterable[tuple]:
        for i, left, right, other_left, other_right in zip(ids, b0, a0, b1, a1):
            yield i, common(left, other_left), common(right, other_right)

    return map_rows(pairs, grow, "run bigint, left_words int, right_words int")


def common(a: bytes | None, b: bytes | None) -> int:
    """Equal words at the beginning of two packed lists."""
    x, y = np.frombuffer(a or b"", np.uint32), np.frombuffer(b or b"", np.uint32)
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, n_words, other_id, other_start: passages (in words) that another place has too."""
    by_key = neighbour_links(stored(suffixes(docs), "suffixes"))
    by_stretch = neighbour_links(stored(stretches(docs, contested(by_key)), "stretches"))
    pair = ["doc_id", "pos", "other_id", "other_pos"]
    links = by_key.select(*pair, F.lit(KEY).alias("width")).union(by_stretch.select(*pair, F.lit(MIN_WORDS).alias("width")))
    ends = stored(runs(links), "runs")
    grown = ends.join(extensions(docs, ends), "run", "left")
    left, right = F.coalesce("left_words", F.lit(0)), F.coalesce("right_words", F.lit(0))
    spans = grown.select(
        "doc_id", (F.col("start") - left).cast("long").alias("start"), (F.col("stop") + right).cast("long").alias("end"),
        "other_id", (F.col("start") - left - F.col("shift")).cast("long").alias("other_start"),
    )
    return spans.withColumn("n_words", F.col("end") - F.col("start")).where(F.col("n_words") >= min_words).select(
        "doc_id", "start", "end", "n_words", "other_id", "other_start"
    ).distinct()
