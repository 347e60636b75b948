"""Repeated passages, spaced seeds, license scans and the pipeline against brute force."""

import itertools
import random
import re
from collections import defaultdict

import pyarrow as pa

from factorloom.llm import decontaminate, license, suffix
from factorloom.llm.common import slices
import corpus_pipeline
from tests.conftest import SF

RNG = random.Random(11)
VOCABULARY = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def prose(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def test_repeats_equal_brute_force(spark):
    passage, shorter = prose(70), prose(49)
    rows = []
    for i in range(40):
        words = prose(RNG.randrange(20, 200))
        at = RNG.randrange(len(words))
        insert = passage if i % 3 == 0 else shorter if i % 3 == 1 else []
        rows.append((i, " ".join(words[:at] + insert + words[at:])))
    copy = " ".join(prose(120))
    rows += [(100 + i, copy.upper() if i % 2 else copy) for i in range(30)]
    inside = prose(60)
    rows += [(200, " ".join(inside + prose(30) + inside)), (201, None), (202, ""), (None, copy), (203, "same " * 2000), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).selectExpr("*", "1 AS a", "2 AS pos")
    got = suffix.repeated_passages(docs).collect()
    text = {d: (t or "").lower().split() for d, t in rows}
    grams = defaultdict(set)
    for d, w in text.items():
        for i in range(len(w) - 49):
            grams[tuple(w[i : i + 50])].add((d, i))
    want = {d for places in grams.values() if len(places) > 1 for d, _ in places}
    for r in got:
        assert text[r["doc_id"]][r["start"] : r["end"]] == text[r["other_id"]][r["other_start"] : r["other_start"] + r["n_words"]]
        assert r["n_words"] >= 50 and (r["doc_id"], r["start"]) != (r["other_id"], r["other_start"])
    assert {r["doc_id"] for r in got} | {r["other_id"] for r in got} == want
    assert len([r for r in got if (r["doc_id"] or 0) in range(100, 130)]) <= 31  # a chain, not all pairs
    assert suffix.repeated_passages(docs.limit(0)).collect() == []


def test_repeats_behind_nested_texts(spark):
    """Two copies of 50 to 67 words among many texts that share only a part of them: every repeated stretch is covered."""
    rows = []
    for case in range(24):
        passage = prose(50 + RNG.randrange(18))
        for _ in range(2):
            rows.append((len(rows), " ".join(prose(RNG.randrange(40)) + passage + prose(RNG.randrange(40)))))
        for _ in range(40):
            size = RNG.randrange(33, 50)
            at = RNG.randrange(len(passage) - size + 1)
            rows.append((len(rows), " ".join(prose(RNG.randrange(30)) + passage[at : at + size] + prose(RNG.randrange(30)))))
    # near copies with a word changed every 50 to 67 words
    for case in range(4):
        base = prose(600)
        for _ in range(20):
            words, at = list(base), RNG.randrange(50)
            while at < len(words):
                words[at] = f"edit{len(rows)}x{at}"
                at += RNG.randrange(50, 68)
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    text = {d: t.split() for d, t in rows}
    places = defaultdict(set)
    for d, w in text.items():
        for i in range(len(w) - 49):
            places[tuple(w[i : i + 50])].add((d, i))
    want = {place for same in places.values() if len(same) > 1 for place in same}
    covered = set()
    for r in suffix.repeated_passages(docs).collect():
        assert text[r["doc_id"]][r["start"] : r["end"]] == text[r["other_id"]][r["other_start"] : r["other_start"] + r["n_words"]]
        covered |= {(d, at + i) for d, at in ((r["doc_id"], r["start"]), (r["other_id"], r["other_start"])) for i in range(r["n_words"] - 49)}
    assert covered == want


def test_masks_tolerate_two_substitutions():
    for a, b in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(
            not {a - at, b - at} & set(mask) for mask in decontaminate.MASKS for at in range(decontaminate.WINDOW - mask[-1])
        ), (a, b)


def plain_overlaps(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for (d, t), (i, b) in itertools.product(docs, items):
        x, y = words(t), words(b)
        if 5 <= len(y) < 13:
            hit = any(x[s : s + len(y)] == y for s in range(len(x) - len(y) + 1))
        else:
            hit = len(y) >= 13 and any(
                sum(p == q for p, q in zip(x[s : s + 13], y[o : o + 13])) >= 11 for s in range(len(x) - 12) for o in range(len(y) - 12)
            )
        if hit:
            out.add((d, i))
    return out


def test_overlaps_equal_brute_force(spark):
    items = [(i, " ".join(prose(RNG.randrange(13, 40)))) for i in range(12)] + [(50, " ".join(prose(7))), (51, "too short"), (52, None), (None, " ".join(prose(20))), (4, None)]
    rows = []
    for n in range(80):
        words = prose(RNG.randrange(0, 80))
        item = (items[n % 14][1] or "").split()
        for _ in range(n % 4):  # up to three substitutions
            item[RNG.randrange(len(item))] = "zzz"
        at = RNG.randrange(len(words) + 1)
        rows.append((n, " ".join(words[:at] + item + words[at:]).title()))
    rows += [(100, None), (101, ""), (None, items[1][1]), (102, "word " * 20_000 + items[0][1]), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS doc_id")
    got = decontaminate.overlaps(docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == plain_overlaps([r for r in rows if r[0] != 102], items) | {(102, 0)}
    clean = decontaminate.decontaminate(docs, bench)
    hit = {r["doc_id"] for r in got.collect()}
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _ in rows if d not in hit)
    assert decontaminate.overlaps(docs.limit(0), bench).collect() == [] == decontaminate.overlaps(docs, bench.limit(0)).collect()


def test_license_scan(spark):
    mit = "Released under the MIT License."
    files = [
        (1, "a/b/LICENSE", "Apache License Version 2.0, January 2004\nhttp://www.apache.org/licenses/\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
        (2, "a/b/c/x.py", "code and words"), (3, "a/b/c/y.py", "more\n" + mit + "\nlines " * 50_000), (4, "a/z.py", "nothing"), (5, "q/COPYING", mit), (6, "q/r/s/t.c", None),
        (7, "top.c", ""), (8, None, mit), (9, None, None), (None, "q/u.c", "words"), (6, "q/r/s/t.c", None),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").selectExpr("*", "'x' AS own", "'y' AS dir")
    got = {(r["doc_id"], r["path"]): (r["license"], r["origin"], r["license_path"]) for r in license.scan_licenses(df).collect()}
    assert got[1, "a/b/LICENSE"][:2] == ("Apache-2.0", "own")
    assert got[2, "a/b/c/x.py"] == ("Apache-2.0", "inherited", "a/b/LICENSE") and got[3, "a/b/c/y.py"][:2] == ("MIT", "own")
    assert got[4, "a/z.py"][:2] == (None, "none") and got[6, "q/r/s/t.c"] == ("MIT", "inherited", "q/COPYING")
    assert got[7, "top.c"][1] == "none" and got[8, None][:2] == ("MIT", "own") and got[9, None][1] == "none" and got[None, "q/u.c"][0] == "MIT"
    assert license.scan_licenses(df).count() == len(files) and license.scan_licenses(df.limit(0)).collect() == []
    matcher = license.Matcher(100, {"the": 90, "this": 50, "of": 80, "a": 70})
    for _ in range(300):  # no unit at or above the threshold lacks the telling words
        words = [w for _, t in license.TEMPLATES for w in license.words_of(t)]
        unit = " ".join(w for w in RNG.sample(words, 6) if not matcher.tells(w))
        assert matcher.best(unit)[0] < license.MIN_COSINE


def test_pipeline_small(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, frames = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).toArrow())
        assert kept.columns == docs.columns, name
        frames.append({r["doc_id"]: r["text"] for r in kept.collect()})
    all_docs = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(frames[0]) == len(all_docs)  # every text is in a learned language
    bodies = {re.sub(r"[\x20\x09-\x0D]", "", t) for t in frames[0].values()}
    assert len(frames[1]) == len(bodies)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, t in frames[2].items() for _, b in items if b in t}
    assert not dirty & set(frames[3]) and set(frames[2]) - set(frames[3]) == dirty
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    assert packed == set(frames[3])
    empty = corpus_pipeline.STAGES
    nothing = docs.limit(0)
    for name, stage in empty:
        assert stage(spark, nothing, SF).count() == 0, name


def test_slices_keep_every_row_of_a_batch():
    texts = ["a" * 10, "b" * (5 << 20), "", None, "c" * (3 << 20), "d"]
    parts = [part for [part] in slices([pa.record_batch({"text": texts}), pa.record_batch({"text": pa.array([], pa.string())})])]
    assert [t for part in parts for t in part] == texts and len(parts) > 1


def test_span_is_that_of_the_best_place(spark):
    """A whole item early on and a part of it later: the span is one place, the best one, and of equal ones the first."""
    item = [f"q{i}" for i in range(13)]
    fill = [f"f{i}" for i in range(200)]
    near = [*item[:12], "other"]
    rows = [(1, " ".join(item + fill + near)), (2, " ".join(near + fill + item)), (3, " ".join(fill + item + fill + item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["matched"], r["start"], r["end"]) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {1: (13, 0, 13), 2: (13, 213, 226), 3: (13, 200, 213)}
