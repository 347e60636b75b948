"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words: the hash covers the words where the mask is set and ignores the
others, so a substituted word at an ignored place does no harm.  The two masks together hit every
aligned window of WINDOW words with at most two substitutions (the tests prove it by enumeration).  Hits
are verified word by word: an item is found in a document if some aligned window that contains the hit agrees in at
least NEED of WINDOW words.

Test hashes go into a bitmap of fixed size (BITMAP bits, whatever the size of the benchmark), which tasks use
to drop nearly all training hashes where they arise; what is left joins the test hashes by equality, and
Spark picks the join by size.  Hits carry the words around them, so verification needs no second look at a text.

Words are lower-case runs of letters and digits.  Items of MIN_WORDS to WINDOW - 1 words must occur whole; shorter
items match nothing.

Defined results.  NULL and empty texts or items have no words and no hits.  Repeated items and documents are reported
once per (doc_id, item_id), NULL ids included.  Ties in the number of agreeing words report the first place.  Empty
tables give no rows.  Extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import keep_rows, map_rows, pick, word_numbers
from factorloom.session import stored

WINDOW, NEED, MIN_WORDS = 13, 11, 5
#: The set places of each mask (fixed values).
MASKS = ((0, 1, 2, 6, 9, 10), (0, 1, 4, 5, 6, 7))
BITMAP = 1 << 23
#: What stands beyond the ends of a document and of an item: never equal to each other or to a word.
NO_WORD, NO_ITEM = 0, 1


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes (2 and above) of the words of texts, one text after the other, and how many each text has."""
    numbers, sizes, words = word_numbers(texts, digits=True)
    hashes = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))
    hashes[hashes < 2] += 2
    return hashes[numbers], sizes


def seed_keys(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """One 64-bit hash per place where the mask fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.full(n, sum(1 << at for at in mask), np.uint64)  # masks don't share hashes
    for at in mask:
        key = (key ^ words[at : at + n].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key


def context(words: np.ndarray, at: int, beyond: int) -> bytes:
    """The words of all windows of WINDOW words that contain place ``at``: 2 * WINDOW - 1 of them."""
    lo, hi = at - WINDOW + 1, at + WINDOW
    part = words[max(lo, 0) : min(hi, len(words))]
    return np.pad(part, (max(0, -lo), max(0, hi - len(words))), constant_values=beyond).astype("<u4").tobytes()


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """(key, mask, item_id, whole, at, near): every seed of every item; whole > 0 for items that must occur whole."""
    rows = pick(benchmark, item_id="item_id", text="text")
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(ids: list, texts: list) -> Iterable[tuple]:
        for item, text in zip(ids, texts):
            words, _ = words_of([text])
            short = MIN_WORDS <= len(words) < WINDOW
            masks = [tuple(range(len(words)))] if short else MASKS if len(words) >= WINDOW else []
            for mask in masks:
                keys = seed_keys(words, mask).view(np.int64).tolist()
                for at, key in enumerate(keys):
                    yield key, len(words) if short else 0, item, at, context(words, at, NO_ITEM)

    return map_rows(rows, run, f"key bigint, whole int, item_id {kind}, at int, near binary")


def bitmap_of(seeds: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of fixed size with two bits per test hash, and the lengths of the items that must occur whole."""
    slots = F.explode(F.array(_slot(F.col("key"), 0), _slot(F.col("key"), 23)))
    packed = seeds.select(slots.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    found = packed.toArrow()  # at most BITMAP / 64 rows
    bits = np.zeros(BITMAP // 64, np.int64)
    bits[found["w"].to_numpy()] = found["bits"].to_numpy()
    lengths = [r[0] for r in seeds.where("whole > 0").select("whole").distinct().collect()]  # at most WINDOW - MIN_WORDS
    return np.unpackbits(bits.view(np.uint8), bitorder="little"), sorted(lengths)


def _slot(key, shift: int):
    return F.shiftrightunsigned(key, shift).bitwiseAND(BITMAP - 1)


def hits(docs: DataFrame, bitmap: np.ndarray, lengths: list[int]) -> DataFrame:
    """(key, whole, doc_id, pos, around): places of documents whose seed hash passes the bitmap."""
    rows = pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap, bitorder="little").tobytes())
    masks = [(m, 0) for m in MASKS] + [(tuple(range(n)), n) for n in lengths]
    opened: list[np.ndarray] = []

    def run(ids: list, texts: list) -> Iterable[tuple]:
        if not opened:
            opened.append(np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little"))
        bits = opened[0]
        low = np.uint64(BITMAP - 1)
        words, sizes = words_of(texts)
        ends = np.cumsum(sizes)
        for mask, whole in masks:
            keys = seed_keys(words, mask)
            places = np.flatnonzero(bits[keys & low])
            places = places[bits[(keys[places] >> np.uint64(23)) & low] == 1]
            doc = np.searchsorted(ends, places, side="right")
            for place, d in zip(places.tolist(), doc.tolist()):
                if place + mask[-1] >= ends[d]:  # the mask reaches into the next document
                    continue
                first = int(ends[d] - sizes[d])
                own = words[first : int(ends[d])]
                yield int(keys[place].view(np.int64)), whole, ids[d], place - first, context(own, place - first, NO_WORD)

    return map_rows(rows, run, f"key bigint, whole int, doc_id {kind}, pos bigint, around binary")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched (most agreeing words of a window), start and end (words of the document)."""
    seeds = stored(item_seeds(benchmark), "seeds")
    bitmap, lengths = bitmap_of(seeds)
    found = hits(docs, bitmap, lengths)
    joined = found.join(seeds, ["key", "whole"])
    kinds = [joined.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")]

    def verify(whole: list, ids: list, pos: list, around: list, items: list, near: list) -> Iterable[tuple]:
        same = np.frombuffer(b"".join(around), "<u4") == np.frombuffer(b"".join(near), "<u4")
        same = same.reshape(-1, 2 * WINDOW - 1)
        run_sums = np.lib.stride_tricks.sliding_window_view(same, WINDOW, axis=1).sum(axis=2)
        best, first = run_sums.max(axis=1), run_sums.argmax(axis=1)
        for i, need in enumerate(whole):
            if need:
                if same[i, WINDOW - 1 : WINDOW - 1 + need].all():
                    yield ids[i], items[i], need, pos[i], pos[i] + need
            elif best[i] >= NEED:
                start = pos[i] - WINDOW + 1 + int(first[i])
                yield ids[i], items[i], int(best[i]), max(start, 0), start + WINDOW

    fits = map_rows(
        joined.select("whole", "doc_id", "pos", "around", "item_id", "near"), verify,
        f"doc_id {kinds[0]}, item_id {kinds[1]}, matched int, start bigint, stop bigint",
    )
    # the best place, of equal ones the first
    best = F.max(F.struct("matched", (-F.col("start")).alias("back"), "stop")).alias("best")
    return fits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.matched", (-F.col("best.back")).alias("start"), F.col("best.stop").alias("end"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a passage of the benchmark."""
    return keep_rows(docs, overlaps(docs, benchmark).select(F.col("doc_id").alias("id")).distinct(), "left_anti")
