"""SimHash links against brute force."""

import random

import numpy as np
import xxhash

from factorloom.llm import simhash

HOT = 60


def plain_fingerprint(text, size=4):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits=4):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in prints), key=str)


def rows_for_test():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    base = [rng.choice(words) for _ in range(400)]
    for i in range(HOT):  # one large group of near copies
        own = list(base)
        own[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(own)))
    for i in range(HOT, 120):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))))
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "one"), (204, "One"), (205, "one two THREE\x0bfour five"), (None, "one"), (3, rows[3][1])]
    rows += [(300, "long " * 50_000), (301, "Ünïcode ÉÉ text here and there"), (302, "ünïcode ÉÉ text here and there")]
    return rows


def test_components_equal_brute_force(spark):
    rows = rows_for_test()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (simhash.BLOCK, 7):
        got = sorted((tuple(r) for r in simhash.near_duplicates(docs, block=block).collect()), key=str)
        assert got == plain_components(rows)


def test_clashing_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 9, 8, "x"), (2, "a b c d e", 7, 7, "y")], "doc_id long, text string, fp int, component_id int, TEXT string")
    assert {tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "component_id").collect()} == {(1, 1), (2, 1)}
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns and [r[0] for r in kept.collect()] == [1]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_forest_links_exactly():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in rng.choice(64, k)]) for k in rng.integers(1, 7, 80)]
    members = np.array([centre ^ f for f in flips], np.uint64)
    links = simhash.forest(members, 4)
    distinct = np.unique(members)
    assert len(links) < len(distinct)
    assert all((a ^ b).bit_count() <= 4 for a, b in links)


def test_stage_removes_copies_from_similarity_08_on(spark):
    rng = random.Random(11)
    pairs = []
    while len(pairs) < 400:
        size = rng.randrange(100, 800)
        one = [f"w{rng.randrange(50_000)}" for _ in range(size)]
        two = list(one)
        for at in rng.sample(range(size), max(1, int(size * rng.uniform(0.005, 0.035)))):
            two[at] = f"x{rng.randrange(50_000)}"
        pairs.append((one, two))
    grams = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    jaccard = [len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a, b in pairs]
    assert sum(0.8 <= j < 0.9 for j in jaccard) > 100 and sum(j < 0.8 for j in jaccard) > 50
    rows = [(2 * i + k, " ".join(words)) for i, pair in enumerate(pairs) for k, words in enumerate(pair)]
    want = [d for d, _ in rows if d % 2 == 0 or jaccard[d // 2] < 0.8]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r[0] for r in simhash.drop_near(docs).collect()) == want
    # a hot group in blocks of 7: copies with one edit each are one document
    base = [f"b{i}" for i in range(300)]
    hot = [(i, " ".join(base[:i] + [f"y{i}"] + base[i + 1 :])) for i in range(60)]
    got = simhash.similar_documents(spark.createDataFrame(hot, "doc_id long, text string"), block=7).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 60


def test_stage_takes_candidates_from_its_simhash(spark):
    """Pairs within MAX_BITS of the stage's fingerprints become links even if no band of min-hashes is shared; each is verified."""
    rng = random.Random(5)
    texts, kept = {}, 0
    while kept < 30:
        words = [f"w{rng.randrange(9_000)}" for _ in range(400)]
        other = list(words)
        other[rng.randrange(400)] = "changed"
        a, b = (simhash.print_of(simhash.shingle_set(" ".join(x))) for x in (words, other))
        if (a ^ b).bit_count() <= simhash.MAX_BITS:
            texts |= {2 * kept: " ".join(words), 2 * kept + 1: " ".join(other)}
            kept += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    profiles = simhash.profiles(docs).toPandas().set_index("doc_id")
    nodes = spark.createDataFrame([(int(p.node), int(p.body), int(p.fp), []) for p in profiles.itertuples()], "node long, body long, fp long, bands array<long>")
    ends = {frozenset((r["a"], r["b"])) for r in simhash.verified_links(docs, nodes).collect()}
    assert ends == {frozenset((int(profiles.node[2 * i]), int(profiles.node[2 * i + 1]))) for i in range(30)}
    # within the bits but not similar: a candidate, no link
    lone = spark.createDataFrame([(int(profiles.node[0]), int(profiles.body[0]), 7, []), (int(profiles.node[2]), int(profiles.body[2]), 6, [])], nodes.schema)
    assert simhash.near_prints(lone).count() == 1 and simhash.verified_links(docs, lone).count() == 0
