"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector is padded to DIMS or more coordinates, rotated at random and kept as its signs: the code, a unit vector c of +-1/sqrt(D).
Beside it lies the correction factor f = <c, x>.  For a rotated unit vector y the quotient <c, y> / f estimates <x, y>
without bias, and its error is below BOUND * sqrt((1 - f^2) / f^2 / (D - 1)) with all but negligible chance.  Pairs whose upper
confidence bound lies below the threshold are dismissed by the codes; only members of the others are
fetched and their cosines recomputed in double precision.  y is shipped in bytes, with its rounding added to the bound.

Pairs meet in buckets of further random rotations: the signed place of the greatest coordinate, of as many rotations together
as it takes for FILL vectors a bucket.  The number of tables follows from the simulated chance that two vectors at
the threshold share a bucket, so that all tables miss one in 1 / MISS such pairs at every size of the table (nearer pairs are
missed far more rarely).  A bucket with more than BLOCK vectors is dealt out by pairs of blocks (``blocks.dealt``).

Equal vectors are one class with a size, so copies cost nothing.  Links are counted where they are verified, in the first
table that the pair shares; blocks return counts and a spanning forest, never all pairs.

Defined results.  Vectors that are NULL, empty or zero, or hold NULL or non-finite components, link with nothing (component_id = vec_id), as
do vectors of different length.  NULL vec_id: the row links like any other, component_id is the smallest id that is not NULL, kept is
false unless the component has none.  Repeated rows are vectors of their own and link with each other; all rows with the smallest id are kept.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factorloom.llm.blocks import SALTS, dealt
from factorloom.llm.common import map_rows, one_per_worker, pick, release
from factorloom.llm.components import components
from factorloom.session import stored

COSINE = 0.9
#: Coordinates of a code at least; a multiple of 64.
DIMS = 128
#: Standard deviations of the confidence bound.
BOUND = 4.5
#: Share of the pairs exactly at the threshold that no table may bring together.
MISS = 1e-3
#: Vectors of a bucket, on average, and of a block.
FILL, BLOCK = 512, 1024
#: Coordinates of a bucket's rotation at most; a vector falls into one of twice as many places.
PLACES = 64
#: Vectors rotated at a time.
SLICE = 2048
SEED = 42
#: Copies from which on a class is looked up in parts.
HOT = 4096


def code_dims(dim: int) -> int:
    return max(DIMS, -(-dim // 64) * 64)


def rotation(dim: int) -> np.ndarray:
    """dim x D matrix with orthonormal rows: padding and random rotation in one."""
    d = code_dims(dim)
    q, _ = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((d, dim)))
    return q.T.astype(np.float32)


def bucket_rotations(dim: int, number: int, stream: int = 1) -> np.ndarray:
    """Random matrices (number x dim x coordinates) whose greatest coordinates place a vector."""
    return np.random.default_rng([SEED, dim, stream]).standard_normal((number, dim, min(dim, PLACES))).astype(np.float32)


def places(unit: np.ndarray, turns: Sequence[np.ndarray]) -> np.ndarray:
    """The signed place of the greatest coordinate under each turn: rows x turns."""
    out = np.empty((len(unit), len(turns)), np.int64)
    for t, turn in enumerate(turns):
        y = unit @ turn
        top = np.abs(y).argmax(axis=1)
        out[:, t] = 2 * top + (y[np.arange(len(y)), top] > 0)
    return out


def shared_chance(dim: int, cosine: float = COSINE) -> float:
    """Chance that two vectors at ``cosine`` have the same place under a random rotation, simulated."""
    rng = np.random.default_rng([SEED, dim, 2])
    hits = trials = 0
    for turn in bucket_rotations(dim, 40, 3):
        a, b = rng.standard_normal((2, 500, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        hits += int((places(a, [turn]) == places(cosine * a + math.sqrt(1 - cosine**2) * b, [turn])).sum())
        trials += 500
    return hits / trials


def plan(rows: int, dim: int, cosine: float = COSINE) -> tuple[int, int]:
    """(rotations of a bucket, tables) for so many vectors."""
    width = max(1, math.ceil(math.log(max(1, rows / FILL)) / math.log(2 * min(dim, PLACES))))
    return width, max(1, math.ceil(math.log(MISS) / math.log1p(-min(shared_chance(dim, cosine), 0.999) ** width)))


def usable(vector: str) -> Column:
    """Whether a vector can link at all."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; huge and tiny vectors included."""
    scaled = values / np.ldexp(1.0, np.frexp(np.abs(values).max(axis=1))[1])[:, None]
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(values: np.ndarray, width: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, bodies, vectors) of equally long vectors: bucket keys, packed code with factor and bytes, unit vectors."""
    dim = values.shape[1]
    turn, turns = one_per_worker(f"rotations {dim} {width * tables}", lambda: (rotation(dim), bucket_rotations(dim, width * tables)))
    unit = _unit(values)
    single = unit.astype(np.float32)
    keys = np.zeros((len(unit), tables), np.int64)
    for t in range(width):
        keys = keys * (2 * PLACES) + places(single, turns[t::width])
    y = single @ turn
    factor = np.abs(y).sum(axis=1) / np.float32(math.sqrt(y.shape[1]))
    scale = np.abs(y).max(axis=1) / np.float32(127)
    whole = np.rint(y / scale[:, None]).astype(np.int8)
    parts = [np.packbits(y > 0, axis=1), factor[:, None].view(np.uint8), scale[:, None].view(np.uint8), whole.view(np.uint8), keys.view(np.uint8).reshape(len(keys), -1)]
    return keys, np.concatenate(parts, axis=1), unit


def decode(bodies: list[bytes], dim: int, tables: int) -> tuple[np.ndarray, ...]:
    """(signs as +-1, factor, rotated vector, rounding, keys) of packed bodies."""
    d = code_dims(dim)
    raw = np.frombuffer(b"".join(bodies), np.uint8).reshape(len(bodies), d // 8 + 8 + d + 8 * tables)
    at = d // 8
    signs = np.unpackbits(raw[:, :at], axis=1).astype(np.float32) * 2 - 1
    factor, scale = np.ascontiguousarray(raw[:, at : at + 8]).view(np.float32).T
    rotated = np.ascontiguousarray(raw[:, at + 8 : at + 8 + d]).view(np.int8).astype(np.float32) * scale[:, None]
    keys = np.ascontiguousarray(raw[:, at + 8 + d :]).view(np.int64)
    return signs, factor, rotated, scale, keys


def upper_bounds(code: tuple, other: tuple) -> np.ndarray:
    """Upper confidence bounds of the inner products of all rows of ``code`` with all rows of ``other``."""
    signs, factor = code[0], code[1][:, None]
    rotated, scale = other[2], other[3][None, :]
    root = math.sqrt(signs.shape[1])
    estimate = (signs @ rotated.T) / root
    spread = BOUND * np.sqrt(np.maximum(1 - factor**2, 0) / (signs.shape[1] - 1))
    return (estimate + spread + scale / 2 * root) / factor


def first_table(mine: np.ndarray, others: np.ndarray, table: int) -> np.ndarray:
    """Which pairs of key rows share no table before ``table``."""
    fresh = np.ones((len(mine), len(others)), bool)
    for t in range(table):
        fresh &= mine[:, t][:, None] != others[:, t][None, :]
    return fresh


def suspects(bodies: list[bytes], sides: list[int], dim: int, table: int, tables: int, cosine: float) -> np.ndarray:
    """Places of the members of a task that have a pair the codes cannot dismiss."""
    side = np.array(sides)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    crossed = len(two) > 0
    a = decode([bodies[i] for i in one], dim, tables)
    b = decode([bodies[i] for i in two], dim, tables) if crossed else a
    near = upper_bounds(a, b) >= cosine
    if not crossed:
        near = np.triu(near, 1)
    rows, cols = np.nonzero(near.any(axis=1))[0], np.nonzero(near.any(axis=0))[0]
    if not len(rows):
        return rows
    near = near[np.ix_(rows, cols)] & first_table(a[4][rows], b[4][cols], table)
    return np.unique(np.concatenate([one[rows[near.any(axis=1)]], (two if crossed else one)[cols[near.any(axis=0)]]]))


def exact_links(vectors: np.ndarray, keys: np.ndarray, sides: list[int], table: int, cosine: float) -> np.ndarray:
    """Symmetric truth table of the links of a task, by cosines in double precision."""
    side = np.array(sides)
    linked = (vectors @ vectors.T >= cosine) & first_table(keys, keys, table)
    linked &= linked.T
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    return linked


def forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of a symmetric truth table."""
    left = linked.any(axis=1)
    for seed in np.flatnonzero(left):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            one = queue.pop()
            found = np.flatnonzero(linked[one] & left)
            left[found] = False
            yield from ((int(one), int(x)) for x in found)
            queue += found.tolist()


def coded(classes: DataFrame, dim: int, width: int, tables: int) -> DataFrame:
    """(node, size, keys, body, vector) of the classes with vectors of this length; vector: unit, packed doubles."""
    struct = T.StructType.fromDDL("node bigint, size bigint, keys array<bigint>, body binary, vector binary")
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                values = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim)
                keys, bodies, unit = encode(values, width, tables)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.ravel())).cast(arrow.field(2).type)
                packed = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (bodies, unit)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, *packed], schema=arrow)
        release()

    return classes.where(F.size("vector") == dim).select("node", "size", "vector").mapInArrow(run, struct)


def verified(codes: DataFrame, dim: int, tables: int, cosine: float, block: int) -> DataFrame:
    """(kind, a, b): kind 0 gives node a and its number b of linked rows of other classes, kind 1 a link of the forest."""
    keyed = codes.select("node", "body", F.posexplode("keys").alias("slot", "value"))
    own = ["slot", "value", "i", "j"]
    tasks = dealt(keyed, ["slot", "value"], "node", block).groupBy(*own).agg(
        F.collect_list("node").alias("nodes"), F.collect_list("body").alias("bodies"), F.collect_list("side").alias("sides")
    ).where(F.size("nodes") > 1)

    def dismiss(slots: list, values: list, i: list, j: list, nodes: list, bodies: list, sides: list) -> Iterable[tuple]:
        for slot, value, a, b, own, packed, side in zip(slots, values, i, j, nodes, bodies, sides):
            if a == b or len(set(side)) == 2:
                for place in suspects(packed, side, dim, slot, tables, cosine).tolist():
                    yield slot, value, a, b, own[place], side[place]

    asked = stored(map_rows(tasks.select(*own, "nodes", "bodies", "sides"), dismiss, "slot int, value bigint, i int, j int, node bigint, side int"), "asked")
    fetched = asked.join(codes.select("node", "size", "keys", "vector"), "node")
    exact = fetched.groupBy(*own).agg(F.collect_list(F.struct("node", "size", "side")).alias("members"), F.collect_list("vector").alias("vectors"), F.collect_list("keys").alias("keys"))

    def recompute(slots: list, members: list, vectors: list, keys: list) -> Iterable[tuple]:
        for slot, member, packed, key in zip(slots, members, vectors, keys):
            unit = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dim)
            linked = exact_links(unit, np.array(key, np.int64), [m["side"] for m in member], slot, cosine)
            rows = linked.astype(np.float64) @ np.array([m["size"] for m in member], np.float64)
            yield from ((0, member[k]["node"], int(rows[k])) for k in np.flatnonzero(rows))
            yield from ((1, member[a]["node"], member[b]["node"]) for a, b in forest(linked))

    return map_rows(exact.select("slot", "members", "vectors", "keys"), recompute, "kind int, a bigint, b bigint")


def labelled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (vec_id, vector) joined with their class; the copies of a large class find it in SALTS parts."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")
    large = classes.where(F.col("size") > HOT).select("vector", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("node").alias("hot"))
    marked = rows.withColumn("salt", salt).join(large, ["vector", "salt"], "left")
    few = marked.where("hot IS NULL").join(classes.select("vector", "node"), "vector").select("vec_id", "node")
    return marked.where("hot IS NOT NULL").select("vec_id", F.col("hot").alias("node")).unionByName(few)


def near_vectors(table: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = table.sparkSession
    rows = pick(table, vec_id="vec_id", vector="embedding")
    good = rows.where(usable("vector"))
    grouped = good.groupBy("vector").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    lengths = classes.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    links = spark.createDataFrame([], "kind int, a bigint, b bigint")
    for dim, n in ((r["dim"], r["n"]) for r in lengths.collect()):  # one row per length of vectors
        width, tables = plan(n, dim, cosine)
        codes = stored(coded(classes, dim, width, tables), "codes")
        links = links.unionByName(stored(verified(codes, dim, tables, cosine, block), "links"))
    found = links.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    roots = components(links.where("kind = 1").select("a", "b"))
    placed = classes.select("node", "size", "least").join(found, "node", "left").join(roots, "node", "left").select(
        "node", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"), "least"
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = stored(placed.join(least, "root").select("node", "n_links", "component_id"), "placed")
    inside = labelled(good, classes.select("vector", "size", "node")).join(of_node, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable("vector")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
