"""Near words and their forms against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from factorloom.llm import spelling


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            if len(run) >= 5:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= 3}
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if plain_near(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def rows_for_test():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeé" if k % 2 else "etaoinshrdluàÿ") for _ in range(rng.randrange(5, 9))) for k in range(60)]
    words = []
    for w in base:
        words += [w] * rng.randrange(3, 40)
        for _ in range(4):
            at, c = rng.randrange(len(w)), rng.choice("abcdeétÀx")
            v = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + c + w[at:]])
            words += [v] * rng.randrange(1, 8)
    words += ["aaaaa"] * 3 + ["aaaaaa"] * 6 + ["aaaaaaa"] * 12 + ["aaaaaaaa"] * 24 + ["Straße", "STRAßE", "straße", "stra×e", "ab’cde"] * 3
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", ", ", "-"]).join(words[i::80])) for i in range(80)]
    return rows + [(90, None), (91, ""), (92, "12 34"), (None, "hello hello hello"), (3, rows[3][1]), (93, "verylongword" * 2000 + " tail")]


@pytest.mark.parametrize("block", [spelling.BLOCK, 3])
def test_forms_equal_brute_force(spark, block):
    rows = rows_for_test()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, WORD string").repartition(3)
    want = plain(rows)
    assert sorted(tuple(r) for r in spelling.spelling_variants(docs, block).collect()) == want
    assert sum(r[1] is not None for r in want) > 40 and sum(r[2] != (r[1] or r[0]) for r in want) >= 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(docs).collect() == []
