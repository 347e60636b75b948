"""Shared helpers of the pipeline: texts hashed once, words of a slice, remembered chunks, min-hashes."""

import random
import re
from itertools import chain

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from factorloom.llm import common, exact, simhash, toxicity, words

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_stage_hashes_a_text_once(spark):
    """The rows that stay are told by their ids; only ids that come more than once are hashed again."""
    once = [(i, f"t {i % 30}") for i in range(60)]
    assert "sha2" not in plan_of(exact.drop_exact(spark.createDataFrame(once, "doc_id long, text string")))
    # ids that come with equal, with longer and with other texts, one of which goes and one stays
    rows = once + [(70, "a b"), (70, "ab"), (70, "other"), (71, "ab"), (71, "alone"), (0, "t  0"), (None, "none"), (None, "no ne"), (None, "t 1"), (72, "none")]
    got = exact.drop_exact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, f"t {i}") for i in range(1, 30)] + [(0, "t  0"), (70, "a b"), (70, "other"), (71, "alone"), (72, "none")]
    # "no ne" has a point more than "none", so the row without an id stays for both
    want = [w for w in want if w != (72, "none")] + [(None, "no ne")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_word_numbers_equal_findall():
    rng = random.Random(3)
    ranges = ((1, 0x80), (0x80, 0x500), (0x500, 0xD800), (0xE000, 0x20000))
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(200)) for _ in range(300)]
    texts = [None, "", " 1_2 ", "²٣a b_c—ß İx ΑΣ x9y", *texts, "\n"]
    for digits, pattern in ((False, r"[^\W\d_]+"), (True, r"[^\W_]+")):
        found = [re.findall(pattern, (t or "").lower()) for t in texts]
        numbers, sizes, own = common.word_numbers(texts, digits)
        assert own[numbers].tolist() == list(chain.from_iterable(found)) and sizes.tolist() == list(map(len, found))
        assert len(set(own)) == len(own)
        assert [len(x) for x in common.word_numbers([None, ""], digits)] == [0, 2, 0]


def test_remembered_chunks_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(words, "REMEMBERED", 5)
    path = public_tokenizers.path("word_bpe_49k.json")
    own, whole = words.WordIds(path), Tokenizer.from_file(path)
    rng = random.Random(9)
    parts = ["naïve", "naïve,", "(naïve)", "don't", "x9", "...", "a.b", "''s", "über", "WE'LL", "$$$"]
    for _ in range(50):
        text = " ".join(rng.choices(parts, k=12))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(own) <= 8 and len(own.older) <= 8  # a chunk and its pieces may come at once


def test_band_keys_of_sets_together():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (5, 0, 1, 700, 0, 3000)]
    for own, keys in zip(sets, simhash.band_keys(sets)):
        least = [((own ^ flip) * mix).min() for flip, mix in zip(simhash.FLIP, simhash.MIX)] if len(own) else []
        assert keys == [simhash._digest(np.array(least[i : i + 6])) for i in range(0, len(least), 6)]
    assert simhash.band_keys([]) == [] and simhash.band_keys([sets[1]]) == [[]]


def test_toxicity_numbers_words_by_slices():
    """Numbers and hashes of a slice give each text's words and their hashes, whatever stands beside it."""
    texts = ["The dog, the CAT", None, "x9y ²٣ über", "", "dog_dog"]
    own, hashes = toxicity.numbered(texts)
    plain = lambda w: xxhash.xxh64_intdigest(w.encode(), 42) >> (64 - toxicity.HASH_BITS)
    assert [hashes[ids].tolist() for ids in own] == [[plain(w) for w in toxicity.words_of(t)] for t in texts]
    assert hashes[0] == plain(toxicity.START) and all(0 not in ids for ids in own)
    assert [ids.tolist() for ids in toxicity.numbered([None])[0]] == [[]]
