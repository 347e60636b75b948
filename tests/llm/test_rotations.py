"""Links of vectors against brute force; recall of the index and of the confidence bounds."""

import math

import numpy as np
import pytest

from factorloom.llm import rotations


def plain(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) from all pairs in double precision."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    unit = {i: np.array(rows[i][1]) / max(abs(x) for x in rows[i][1]) for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    for i in good:
        for j in good:
            if i < j and len(unit[i]) == len(unit[j]) and (unit[i] @ unit[j] >= cosine or rows[i][1] == rows[j][1]):
                links[i].add(j)
                links[j].add(i)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            group, queue = {i}, [i]
            while queue:
                for j in links[queue.pop()] - group:
                    group.add(j)
                    queue.append(j)
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            seen |= dict.fromkeys(group, min(ids, default=None))
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=str)


def at_cosine(rng, v, cosine):
    other = rng.standard_normal(len(v))
    other -= (other @ v) / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def rows_for_test():
    rng = np.random.default_rng(7)
    rows = []

    def add(v):
        rows.append((len(rows), [float(x) for x in v]))

    for _ in range(60):
        v = rng.standard_normal(24)
        add(v)
        add(at_cosine(rng, v, rng.choice([0.85, 0.93, 0.97, 0.995])) * rng.choice([1e-3, 1, 50]))
    hot = rng.standard_normal(24)
    for _ in range(70):  # a hot group of near vectors
        add(at_cosine(rng, hot, 0.98))
    for _ in range(40):  # and of equal ones
        add(hot)
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [1.0, None] * 12), (504, [math.nan] * 24), (505, [math.inf] * 24)]
    rows += [(506, [1.0, 0.0]), (507, [2.0, 0.1]), (508, [-1.0, 0.0]), (509, [3.0]), (510, [0.5]), (511, [-0.5]), (512, [1e-200, 1e-201]), (513, [1e200, 1e199])]
    rows += [(None, rows[3][1]), (None, list(map(float, rng.standard_normal(24)))), rows[5], (-4, rows[200][1])]
    return rows


@pytest.mark.parametrize("block", [rotations.BLOCK, 20])
def test_links_equal_brute_force(spark, block):
    rows = rows_for_test()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string").repartition(3)
    got = sorted((tuple(r) for r in rotations.near_vectors(table, block=block).collect()), key=str)
    assert got == plain(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        v = rng.standard_normal(64)
        rows += [(2 * i, v.tolist()), (2 * i + 1, at_cosine(rng, v, 0.9001).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = sum(r["n_links"] for r in rotations.near_vectors(table).collect())
    assert 0.99 * 3000 <= found <= 3000


def test_bounds_hold_and_dismiss():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((400, 64))
    b = np.array([at_cosine(rng, v, c) for v, c in zip(a, rng.uniform(-0.5, 1, 400))])
    _, bodies, unit = rotations.encode(np.concatenate([a, b]), 1, 3)
    code = rotations.decode([r.tobytes() for r in bodies], 64, 3)
    inner, upper = unit @ unit.T, rotations.upper_bounds(code, code)
    assert (upper >= inner).mean() > 0.9999
    root = math.sqrt(code[0].shape[1])
    estimate = code[0] @ code[2].T / root / code[1][:, None]
    assert abs((estimate - inner)[~np.eye(800, dtype=bool)].mean()) < 0.002  # no bias
    far = inner < 0.3
    assert (upper[far] < 0.9).mean() > 0.99


def test_empty_table(spark):
    assert rotations.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
