"""Runs of words against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from factorloom.llm import squares


def plain_runs(words, words_least=6, periods=4):
    """Every period of every stretch by its definition."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q - i), q)  # smaller periods come first
            i = j
    return sorted(((s, n_, q) for (s, n_), q in found.items() if n_ >= max(words_least, periods * q)), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic_words(rng, n, letters):
    out = []
    while len(out) < n:
        unit = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 20]))]
        out += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)]
        if rng.random() < 0.4:
            out += [rng.choice(letters) for _ in range(rng.randrange(4))]
    return out[:n]


def test_all_squares_at_every_chunk_size():
    rng = random.Random(1)
    for round_ in range(300):
        words = periodic_words(rng, rng.randrange(1, 120), "ab" if round_ % 3 == 0 else "abcde")
        ids = np.array([ord(w) for w in words])
        want = plain_runs(words, 2, 2)
        for chunk in (1, 2, 7, 50, 1000):
            catcher = squares.SquareCatcher()
            for at in range(0, len(ids), chunk):
                catcher.append(ids[at : at + chunk])
            assert sorted(catcher.runs(), key=lambda r: (r[0], r[2])) == want, (words, chunk)


def test_long_texts():
    rng = random.Random(2)
    words = periodic_words(rng, 3000, [f"w{i}" for i in range(50)])
    assert squares.word_runs(words) == plain_runs(words) == squares.word_runs(words, 701)
    assert squares.word_runs(["a"] * 300_000) == [(0, 300_000, 1)]
    unit = [str(i) for i in range(40_000)]
    assert squares.word_runs(unit * 5) == [(0, 200_000, 40_000)]


def rows_for_test():
    rng = random.Random(3)
    rows = [(i, " ".join(periodic_words(rng, rng.randrange(1, 200), [f"w{k}" for k in range(30)]))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n\x0b "), (None, "a b " * 9), (203, "é é " * 7), (5, rows[5][1]), (204, "x " * 20_000), (205, "one")]
    rows += [(i, "the quick brown fox jumps over a lazy dog " * 3) for i in range(300, 330)]  # some of them are replaced
    return rows


def test_rows_equal_brute_force(spark):
    rows = rows_for_test()
    docs = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, period int, TEXT string").repartition(3)
    got = sorted((tuple(r) for r in squares.periodic_runs(docs).collect()), key=str)
    short = [r for r in rows if len(r[1] or "") < 10_000]
    assert [r for r in got if r[0] != 204] == sorted((plain_row(*r) for r in short), key=str)
    assert [r[1:6] for r in got if r[0] == 204] == [(1, 0, 20_000, 1, 20_000_000)]
    assert sum(r[1] > 0 for r in got if r[0] is not None and r[0] >= 300) > 0
    assert squares.periodic_runs(docs.limit(0)).collect() == []
