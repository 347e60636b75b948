"""Periodic runs of words by online dyadic square catching.

Words are appended in order.  A block of 2^k consecutive words that starts at a multiple of 2^k becomes a catcher
as soon as it is complete.  With every further word the suffix of 2^k words is compared with the catchers whose distance q lies
in 2*2^k - 1 ... 4*2^k - 2: at any word these are two catchers a level.  The first half of every square of period q holds a
whole block of that level, so an equal suffix is met for every square.  Windows of 2^k words are named by the names
of their halves, so comparing two of them is comparing two numbers and is exact.

A caught pair grows left and right by the longest equal stretches, which turns squares into maximal stretches of a period;
stretches that reach the last word stay open and grow with the next words.  Stretches with the same ends are one
run, with the smallest period.  Words arrive in chunks (any size, the result is the same) and NumPy takes the steps of a chunk
together: per word about two comparisons on each level at which some window still occurs twice.

Defined results.  NULL, empty and blank texts have no words: no runs, four NULLs, digests of the empty string.  NULL doc_id:
no words are replaced.  Repeated rows are reported as often as they come; an empty table gives no rows; extra columns are
ignored; a text of any length is read whole (memory: some bytes per word and level).  Every document is
work of its own, so the query has no shuffle and no key that could be hot.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from factorloom.llm.common import map_rows, pick

#: A run counts from so many words and so many periods on.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words appended at a time.
CHUNK = 1 << 16


class Names:
    """Numbers for the windows of 2^k words, equal exactly if the windows are; grows with the text."""

    def __init__(self) -> None:
        self.ids = np.empty(0, np.int64)
        self.keys = np.empty(0, np.int64)  # sorted, with the id of each
        self.of_key = np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        fresh, place = np.unique(keys, return_inverse=True)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, fresh), len(self.keys) - 1)
            known = self.keys[at] == fresh
            ids = np.where(known, self.of_key[at], len(self.keys) + np.cumsum(~known) - 1)
            merged = np.concatenate([self.keys, fresh[~known]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.of_key = merged[order], np.concatenate([self.of_key, ids[~known]])[order]
        else:
            ids = np.arange(len(fresh))
            self.keys, self.of_key = fresh, ids
        self.ids = np.concatenate([self.ids, ids[place]])

    @property
    def repeats(self) -> bool:
        return len(self.keys) < len(self.ids)


class SquareCatcher:
    """Catches the maximal stretches of at least two periods in words (numbers) appended in order."""

    def __init__(self) -> None:
        self.levels = [Names()]
        self.open = np.empty((0, 2), np.int64)  # start, period of stretches that reach the last word
        self.found: set[tuple[int, int, int]] = set()

    def __len__(self) -> int:
        return len(self.levels[0].ids)

    def append(self, words: np.ndarray) -> None:
        before = len(self)
        self.levels[0].add(np.asarray(words, np.int64))
        caught = [self.open]
        level = 0
        while self.levels[level].repeats:
            caught.append(self._catch(level, before))
            if 2 << level > len(self):
                break
            level += 1
            self._name(level)
        self._grow(np.concatenate(caught))

    def _name(self, level: int) -> None:
        """Name the windows of 2^level words that have no name yet."""
        if level == len(self.levels):
            self.levels.append(Names())
        half, below = 1 << level - 1, self.levels[level - 1].ids
        have, all_of_them = len(self.levels[level].ids), len(self) - 2 * half + 1
        self.levels[level].add((below[have:all_of_them] << 32) | below[have + half : all_of_them + half])

    def _catch(self, level: int, before: int) -> np.ndarray:
        """(start, period) of the catchers that meet an equal suffix at one of the new words, one per stretch."""
        size, ids = 1 << level, self.levels[level].ids
        suffix = np.arange(max(0, before - size + 1), len(ids))
        out = []
        for back in (0, size):
            block = (suffix - 2 * size + 1) // size * size - back
            live = block >= 0
            block, at = block[live], suffix[live]
            equal = ids[block] == ids[at]
            out.append(np.stack([block[equal], at[equal] - block[equal]], axis=1))
        pairs = np.concatenate(out)
        if len(pairs) > 1:  # neighbouring catchers of one distance lie on the same stretch
            pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))]
            same = (np.diff(pairs[:, 1]) == 0) & (np.diff(pairs[:, 0]) == size)
            pairs = pairs[np.concatenate(([True], ~same))]
        return pairs

    def _equal(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How many words are equal from x and y on (step 1), or before x and y (step -1); x < y."""
        total = np.zeros(len(x), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            size, ids = 1 << level, self.levels[level].ids
            a, b = (x, y) if step > 0 else (x - size, y - size)
            inside = np.flatnonzero((a >= 0) & (b + size <= len(self)) & (b < len(ids)))
            grown = np.zeros(len(x), np.int64)
            grown[inside[ids[a[inside]] == ids[b[inside]]]] = size
            x, y, total = x + step * grown, y + step * grown, total + grown
        return total

    def _grow(self, pairs: np.ndarray) -> None:
        if not len(pairs):
            self.open = pairs
            return
        start, period = pairs[:, 0], pairs[:, 1]
        start = start - self._equal(start, start + period, -1)
        # one per stretch
        key = np.unique(np.stack([start, period], axis=1), axis=0)
        start, period = key[:, 0], key[:, 1]
        end = start + period + self._equal(start, start + period, 1)
        length = end - start
        # a stretch within one of the same start whose period divides its own is that run for ever
        first = np.concatenate(([True], np.diff(start) != 0))
        least, reach = period[first][np.cumsum(first) - 1], end[first][np.cumsum(first) - 1]
        keep = (period == least) | (period % least != 0) | (end != reach) | (length < period + least)
        start, period, end, length = start[keep], period[keep], end[keep], length[keep]
        for s, p, e in zip(start[length >= 2 * period].tolist(), period[length >= 2 * period].tolist(), end[length >= 2 * period].tolist()):
            if e < len(self):
                self.found.add((s, e - s, p))
        going = end == len(self)
        self.open = np.stack([start[going], period[going]], axis=1)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, smallest period) of all maximal stretches of at least two periods so far, by start."""
        here = len(self)
        least: dict[tuple[int, int], int] = {}
        for s, length, p in self.found | {(s, here - s, p) for s, p in self.open.tolist() if here - s >= 2 * p}:
            least[s, length] = min(p, least.get((s, length), p))
        return sorted((s, length, p) for (s, length), p in least.items())


def word_runs(words: list, chunk: int = CHUNK) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of LEAST_PERIODS periods and LEAST_WORDS words, by start, then period."""
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(ids):
        return []
    catcher = SquareCatcher()
    for at in range(0, len(ids), chunk):
        catcher.append(ids[at : at + chunk])
    runs = [(s, n, p) for s, n, p in catcher.runs() if n >= max(LEAST_WORDS, LEAST_PERIODS * p)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words left when every run keeps its first period only."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    keep = np.cumsum(drop)[:-1] == 0
    return [w for w, k in zip(words, keep) if k]


def planted(words: list, doc_id: int | None) -> list:
    """A tenth of the documents repeat a part of themselves, by a rule on the id."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    body = words[a : a + p]
    return words[:a] + (body * ((n - a) // p + 1))[: n - a]


def _row(doc_id: int | None, text: str | None) -> tuple:
    words = planted((text or "").encode("utf-8", "surrogatepass").split(), doc_id)
    runs = word_runs(words)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = collapsed(words, runs) if runs else words
    best = (None,) * 4
    if runs:
        top = runs[0]
        for run in runs[1:]:  # exact fractions; runs come by start, then period
            if run[1] * top[2] > top[1] * run[2]:
                top = run
        best = (*top, 1000 * top[1] // top[2])
    return doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    rows = pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(ids: list, texts: list) -> Iterable[tuple]:
        return map(_row, ids, texts)

    numbers = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint"
    return map_rows(rows, run, f"doc_id {kind}, {numbers}, runs_sha256 string, collapsed_sha256 string")
