"""Language trees, toxicity, packing and token attribution against plain versions and held-out rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from factorloom.llm import attribution, language, packing, toxicity
from factorloom.llm.words import WordIds

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "Don't I'LL x_y² a½", "Σς ΑΣ naïve café ß İ", "<|endoftext|> and <|startoftext|>", "tab\tx\r\n\n  two", "日本語 テキスト", "é combining", "1234 5 6,7.",
    "'s 't ''ll __a__ -- …€“”", "x" * 5000, "Ünï cødé " * 300, "\x00\x1f\x85 z", "🙂👩‍👩‍👧 emoji",
]


def plain_bits(text, entries, lang):
    """Exact code length under one tree, byte by byte."""
    n = {(o, k): c for g, o, k, c in entries if g == lang}
    known = {k & 255 for _, o, k, _ in entries if o == 0} | {10}
    by = defaultdict(dict)
    for (o, k), c in n.items():
        by[o, k >> 8][k & 255] = c
    data = b"\n\n\n" + text.lower().encode()
    total = 0.0
    for i in range(3, len(data)):
        cost = 0.0
        for order in (3, 2, 1, 0):
            context = data[i - order : i]
            seen = by.get((order, int.from_bytes(context, "big"))) if all(b in known for b in context) else None
            if not seen:
                continue
            whole, kinds = sum(seen.values()), len(seen)
            if data[i] in seen:
                cost += math.log2((whole + kinds) / seen[data[i]])
                break
            cost += math.log2((whole + kinds) / kinds)
        else:
            cost += 8.0
        total += cost
    return total


def test_code_lengths_are_exact(spark):
    rows = [("en", "the cat sat on the mat and the dog ate"), ("en", "then there was the other thing"), ("de", "der hund und die katze über das dach"), ("de", "das ist die größte")]
    entries = language.train(spark.createDataFrame(rows, "lang string, text string"), share=0.0)
    trees = language.Trees(entries)
    texts = ["the dog", "über die katze!", "x", "the퟿", "zzz the zzz"]
    got = trees.bits([t.lower().encode() for t in texts])
    for i, text in enumerate(texts):
        for j, lang in enumerate(trees.langs):
            assert got[i, j] == pytest.approx(plain_bits(text, entries, lang), rel=1e-4), (text, lang)
    long = ("the cat " * 40_000).encode()
    before, language.CHUNK = language.CHUNK, 1 << 62
    whole = trees.bits([long])
    language.CHUNK = before
    assert np.allclose(trees.bits([b"a", long, b"b"])[1], whole[0], rtol=1e-6)


def test_language_awkward_rows(spark):
    rows = [(i, "the cat and the dog are here", "en") for i in range(20)] + [(i, "der hund und die katze sind hier", "de") for i in range(20, 40)]
    rows += [(90, None, "en"), (91, "", None), (92, "123 --", "de"), (None, "the dog and the cat", None), (94, "die katze " * 30_000, None), (3, rows[3][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS score")
    got = {r["doc_id"]: r for r in language.identify_language(docs).collect()}
    assert [got[i]["lang_pred"] for i in (90, 91, 92, None, 94, 25)] == ["und", "und", "und", "en", "de", "de"]
    assert got[90]["score"] == 0 and 0.5 < got[94]["score"] <= 1 and not got[None]["held_out"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(40))
    assert len(language.identify_language(docs).collect()) == len(rows)
    assert language.identify_language(docs.limit(0)).collect() == []
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r["lang_pred"] for r in language.identify_language(unlabelled).collect()} == {"und"}
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_language_filter_rejects_by_code_length(spark):
    """Foreign and random texts go; clean ones stay, short ones and such with a key as well; few rows reject nothing."""
    rng = random.Random(6)
    vocabulary = {"en": "the cat and dog are here with some other things that we know about".split(), "de": "der hund und die katze sind hier mit anderen dingen über das dach".split()}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    clean = [(i, say(lang, rng.choice([2, 5, 20, 60, 300])), lang) for i, lang in enumerate(["en", "de"] * 500)]
    clean += [(2000, "the cat", None), (2001, "the dog password=b8a6bab61dc0d4e3d1 is here", None), (2002, "ab", None), (2003, "hund " * 50_000, None), (None, "the other dog", None)]
    letters = "bfgjklmpqvwxyz0123456789"
    junk = ["日本語のテキストです。これは長い文章で、学習された言語ではありません。", "Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί και φεύγει", "".join(rng.choice(letters) for _ in range(300)), "ж" * 3 + " съешь ещё этих мягких французских булок" * 4000]
    rows = clean + [(3000 + i, text, None) for i, text in enumerate(junk)] + [(3100, "12 34", "en"), (3101, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS size", "2 AS n")
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r[0] or -1 for r in clean)
    few = docs.where("doc_id < 40 or doc_id >= 3000")
    assert language.keep_known(few).count() == few.count() - 2


def test_word_ids_equal_the_tokenizer():
    words, whole = WordIds(WORDS), Tokenizer.from_file(WORDS)
    for text in ODD + [" ".join(ODD)]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_packing_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "naïve", "x9"]) for _ in range(rng.randrange(1, 900)))) for i in range(300)]
    rows += [(400 + i, t) for i, t in enumerate(ODD)] + [(500, None), (None, "no id"), (501, "long text " * 9000), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS seq", "2 AS ids", "3 AS `offset`")
    pieces = packing.pack(docs, WORDS, open_windows=4).collect()
    whole = Tokenizer.from_file(WORDS)
    want = Counter((d, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in rows)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for doc_id, own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        ids = [np.frombuffer(bytes(p["ids"]), "<u4").tolist() for p in own]
        if doc_id != 7:  # the repeated row is packed twice
            assert want[doc_id, tuple(sum(ids, []))] == 1
        assert all(len(i) == p["length"] for i, p in zip(ids, own))
    assert sum(p["length"] for p in pieces) == sum(len(k[1]) * n for k, n in want.items())
    for own in by_seq.values():
        own.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in own])
        assert [p["offset"] for p in own] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(by_seq) <= 1.2 * sum(p["length"] for p in pieces) / 4096 + 2
    assert packing.pack(docs.limit(0), WORDS).collect() == []


def test_attribution_equals_offsets(spark):
    rows = [(i, t, None if i % 3 else "title " + t[:20]) for i, t in enumerate(ODD)] + [(None, None, None), (50, "a\n\n\nb\n", "x\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string").selectExpr("*", "1 AS section", "'f' AS field")
    whole = Tokenizer.from_file(BYTES)
    whole.encode_special_tokens = True
    for rule in ("first", "last"):
        got = defaultdict(list)
        for r in attribution.attribute_tokens(docs, BYTES, ("title", "text"), rule).collect():
            got[r["doc_id"]].append(r)
        for doc_id, text, title in rows:
            joined = (title or "") + "\n" + (text or "")
            offsets = [o if rule == "first" else (e - 1) for o, e in whole.encode(joined, add_special_tokens=False).offsets]
            sections = sorted(got[doc_id], key=lambda r: (r["field"] == "text", r["section"]))
            starts = [s["char_start"] for s in sections]
            want = [0] * len(sections)
            for o in offsets:
                want[max(i for i, s in enumerate(starts) if s <= o)] += 1
            assert [s["n_tokens"] for s in sections] == want, (doc_id, rule)
    assert attribution.attribute_tokens(docs.limit(0), BYTES).collect() == []


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(common) for _ in range(rng.randrange(5, 120))]
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "rotten"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(9000, None), (9001, ""), (9002, "123 !"), (None, "vile vile nasty"), (9003, "calm " * 100_000), (5, rows[5][1])]
    labels += [(5, None), (None, 1), (77777, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS score")
    known = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'t' AS text")
    got = toxicity.score_toxicity(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1500]
    assert len(held) > 200 and sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) / len(held) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert by[9000]["predicted"] == by[9001]["predicted"] == by[9003]["predicted"] == 0 and by[None]["predicted"] == 1
    assert all(r["score"] == 0 for r in toxicity.score_toxicity(docs, known.where("toxic = 0")).collect())
    assert toxicity.score_toxicity(docs.limit(0), known).collect() == []


def plain_kneser_ney(rows, text, d=0.75):
    """Log-likelihood difference of a text under the two models, word by word."""
    grams = {c: Counter() for c in (True, False)}
    for t, toxic in rows:
        words = toxicity.words_of(t)
        grams[toxic].update(zip(["^", *words], words))
    every = set(grams[True]) | set(grams[False])
    kinds = Counter(w for _, w in every)
    back = d * len(kinds) / len(every)
    total = 0.0
    words = toxicity.words_of(text)
    for v, w in zip(["^", *words], words):
        if w not in kinds and all(v != x for x, _ in every):
            continue
        p = {}
        for c, n in grams.items():
            own = Counter(b for _, b in n)
            low = (1 - back) * max(own[w] - d, 0) / sum(max(k - d, 0) for k in own.values()) + back * kinds[w] / len(every)
            context = sum(k for (a, _), k in n.items() if a == v)
            out = d * sum(a == v for a, _ in n) / context if context else 1.0
            p[c] = (max(n[v, w] - d, 0) / max(context, 1), out, low)
        if w in kinds:
            total += math.log(p[True][0] + p[True][1] * p[True][2]) - math.log(p[False][0] + p[False][1] * p[False][2])
        else:  # the shared backoff of a word that no class knows is the same under both
            total += math.log(p[True][1]) - math.log(p[False][1])
    return total


def test_toxicity_keeps_rare_words_and_escape_weights(spark):
    rows = [("the vile dog bit the cat", True), ("a vile rare slur", True), ("the dog and the cat sat", False), ("the cat sat on a mat", False), ("a dog sat", False)]
    texts = ["the rare slur", "vile cat sat", "the mat", "slur unheard dog", "unheard of", "", "the the the"]
    learn = spark.createDataFrame(rows, "text string, toxic boolean")
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for share in (0.0, 0.15, 2.0):  # all, some and none of the counts travel to the tasks
        got = {r["doc_id"]: r["total"] for r in toxicity.measured(asked, *toxicity.train(learn, share)).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx([plain_kneser_ney(rows, t) for t in texts]), share
    assert plain_kneser_ney(rows, "rare slur") > 1


def test_toxicity_of_a_rare_class_is_reported(spark):
    """Toxic rows outside fold 4, and a single toxic row, still give scores."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 not in (0, 4)]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    toxic = set(ids[::12])
    text = lambda i, bad: ("calm words here " * 3) + ("vile slur here " * 2 if bad else "kind talk here ")
    rows = [(i, text(i, i in toxic or (i in held and i % 2))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bad in (toxic, {min(toxic)}):
        known = spark.createDataFrame([(i, int(i in bad)) for i in range(400) if i not in toxic or i in bad], "doc_id long, toxic int")
        got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, known).collect()}
        assert min(got[i] for i in held if i % 2) > max(got[i] for i in held if not i % 2)


def test_toxicity_ranks_held_out_rows(spark):
    """Held-out rows of the 10 000 documents: AUC of 0.95, as the labels have noise."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").select("score", "predicted", "toxic").toPandas()
    y, rank = got.toxic.to_numpy(), got.score.rank().to_numpy()
    n = y.sum()
    assert n > 50 and (rank[y == 1].sum() - n * (n + 1) / 2) / n / (len(y) - n) >= 0.95
    assert ((got.predicted == 1) & (y == 1)).sum() >= 0.8 * n and ((got.predicted == 1) & (y == 0)).sum() <= 0.02 * (len(y) - n)
