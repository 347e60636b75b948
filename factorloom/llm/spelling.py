"""Spelling variants of the corpus's words by blocked Gram matrices.

An inserted, deleted or replaced letter changes the letter counts of a word by a squared distance of at most two.  Words are
vectors of letter counts (a-z, and BINS bins for the other letters), a block of words is a matrix, and one NumPy product of
two blocks gives all their squared distances |x|^2 + |y|^2 - 2 xy.  Pairs at most two apart are verified on their letters.

Blocks hold words of one length (replacements) or of two adjacent lengths (insertions, deletions).  Within a length they are
drawn by exact letter counts: the letters are dealt into PARTS = 3 parts, an edit touches two letters at most, so two near
words agree in all counts of some part.  Every word enters one block per part and length pair, pairs count in the first part
in which they agree, and no pair is lost.  A block with more than BLOCK words is dealt out by pairs of blocks (``blocks.dealt``).

Words are counted per slice of texts before the shuffle, so frequent words are no hot key.

Defined results.  NULL and empty texts have no words.  NULL doc_id counts as an empty id in the rule on ids.  Repeated rows count
as often as they come; an empty table gives no rows; extra columns are ignored; texts are read whole.  Ties of a
form go to the smaller word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.blocks import dealt
from factorloom.llm.common import map_rows, pick
from factorloom.session import stored

#: Words have so many code points and occurrences.
LEAST_POINTS, LEAST_COUNT = 5, 3
#: A form is at least so many times as frequent as its variant.
RATIO = 2
#: Runs whose checksum this number divides lose one code point.
DIVISOR = 97
RUN = re.compile("[a-zÀ-ÿ]+")
#: Letters by frequency (fixed values), so that dealing them in turn makes even parts.
LETTERS = "etaoinshrdlucmfwypvbgkjqxz"
BINS = 6
PARTS = 3
#: Words of a block; two blocks of so many are multiplied at a time.
BLOCK = 1024
_COLUMN = {letter: i for i, letter in enumerate(LETTERS)} | {chr(c): len(LETTERS) + c % BINS for c in range(0xC0, 0x100)}
DIMS = len(LETTERS) + BINS


def text_words(doc_id: object, text: str | None) -> Iterable[tuple[str, int]]:
    """The words of one text with their counts."""
    mark = b"" if doc_id is None else str(doc_id).encode()
    for run, n in Counter(RUN.findall((text or "").encode("utf-8", "replace").lower().decode())).items():
        h = zlib.crc32(mark + b":" + run.encode())
        if h % DIVISOR == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_POINTS:
            yield run, n


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with LEAST_COUNT occurrences."""

    def run(ids: list, texts: list) -> Iterable[tuple]:
        total: Counter = Counter()
        for doc_id, text in zip(ids, texts):
            for word, n in text_words(doc_id, text):
                total[word] += n
        return total.items()

    slim = map_rows(pick(docs, doc_id="doc_id", text="text"), run, "word string, n bigint")
    return slim.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts per word."""
    out = np.zeros((len(words), DIMS), np.float32)
    for i, word in enumerate(words):
        for letter in word:
            out[i, _COLUMN[letter]] += 1
    return out


def block_keys(words: DataFrame) -> DataFrame:
    """(part, pair, counts, word): the blocks of a word; pair is the greater length of a pair of adjacent lengths."""

    def run(words: list) -> Iterable[tuple]:
        counts = letter_counts(words).astype(np.uint8)
        for word, row in zip(words, counts):
            for part in range(PARTS):
                own = row[part::PARTS].tobytes()
                yield part, len(word), own, word
                yield part, len(word) + 1, own, word

    return map_rows(words.select("word"), run, "part int, pair int, counts binary, word string")


def points(words: list[str], width: int) -> np.ndarray:
    return np.array([w.ljust(width, "\0") for w in words], f"<U{width}").view("<u4").reshape(len(words), width)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows (code points of equal length) differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of ``long`` are those of ``short`` with one code point more."""
    width = long.shape[1] - 1
    ahead = np.cumprod(short[:, :width] == long[:, :width], axis=1).sum(axis=1)
    behind = np.cumprod((short[:, :width] == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= width


def near_pairs(part: int, pair: int, left: list[str], right: list[str] | None) -> Iterable[tuple[str, str]]:
    """Near pairs among words of lengths pair-1 and pair: within ``left``, or between ``left`` and ``right``."""
    both = left if right is None else left + right
    # whole numbers stay exact below 2^24 in single precision
    counts, letters = letter_counts(both).astype(np.float32 if pair < 2000 else np.float64), points(both, pair)
    length = np.array([len(w) for w in both])
    first, second = (np.arange(len(left)), np.arange(len(left))) if right is None else (np.arange(len(left)), np.arange(len(left), len(both)))
    x, y = counts[first], counts[second]
    distance = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    near = distance <= 2
    if right is None:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = first[a], second[b]
    # two of the shorter length belong to the pair of lengths below, pairs that agree in an earlier part to that part
    keep = (length[a] == pair) | (length[b] == pair)
    for earlier in range(part):
        keep &= (counts[a][:, earlier::PARTS] != counts[b][:, earlier::PARTS]).any(axis=1)
    a, b = a[keep], b[keep]
    equal = length[a] == length[b]
    ok = np.zeros(len(a), bool)
    ok[equal] = one_replaced(letters[a[equal]], letters[b[equal]])
    s, t = np.where(length[a] < length[b], a, b)[~equal], np.where(length[a] < length[b], b, a)[~equal]
    ok[~equal] = one_inserted(letters[s], letters[t])
    return ((both[i], both[k]) for i, k in zip(a[ok].tolist(), b[ok].tolist()))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): every pair of near words once."""
    tasks = dealt(block_keys(words), ["part", "pair", "counts"], "word", block)
    own = ["part", "pair", "counts", "i", "j"]
    groups = tasks.groupBy(*own).agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("word"))).alias("zero"), F.collect_list(F.when(F.col("side") == 1, F.col("word"))).alias("one")
    ).where(F.size("zero") + F.size("one") > 1)

    def run(parts: list, pairs: list, i: list, j: list, zeros: list, ones: list) -> Iterable[tuple]:
        for part, pair, a, b, zero, one in zip(parts, pairs, i, j, zeros, ones):
            if a == b or one:
                yield from near_pairs(part, pair, zero, None if a == b else one)

    return map_rows(groups.select("part", "pair", "i", "j", "zero", "one"), run, "a string, b string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form, by pointer doubling: counts at least double with every step."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(64):
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = stored(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return now


def spelling_variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = stored(count_words(docs), "words")
    pairs = stored(near_words(words, block), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("other_n"))
    best = both.join(other, "b").groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("least"), F.col("b").alias("form"))).alias("best")
    )
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("top"), (-F.col("best.least")).alias("top_n"))
    fits = F.col("top_n") >= RATIO * F.col("n")
    formed = stored(known.select("word", "n", "n_near", F.when(fits, F.col("top")).alias("form"), F.when(fits, F.col("top_n")).alias("form_n")), "forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
