"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into fewer segments than it takes to keep one equal: with at most 4 differing bits and
3 segments, one segment differs by at most one bit.  Every segment is indexed once per position with
that bit as a wildcard (64 keys in all); two fingerprints that may link share a key.  Keys meet by equality, and
members are verified on all 64 bits.

Rows with one fingerprint are one node, so copies cost nothing.  Members of a key are handled in blocks of
BLOCK nodes; a key with more members is dealt out by pairs of blocks, so a task never holds
more than two blocks.  A block returns a spanning forest of its links, never all pairs.

The pipeline's stage (``drop_near``) has another rule: Jaccard similarity of at least SIMILAR on the distinct shingles of
STAGE_SHINGLE words.  Its SimHash of those shingles goes through the same variant keys and links; fingerprints within
MAX_BITS are candidates.  Pairs at SIMILAR differ in about 10 of 64 bits, and a bound of 16 bits leaves segments of 7 bits,
whose keys gather 1/64 of all documents each: the pairs that SimHash keys cannot reach are candidates by bands of
min-hashes of the same shingles.  Every candidate of either kind is verified on the whole sets of shingles before the components.

Defined results.  NULL, empty and blank texts have fingerprint zero and are linked like any other.  Repeated rows
are reported as often as they come.  NULL doc_id: the component_id is the smallest id that is not NULL.  An
empty table gives no rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import keep_rows, map_rows, pick
from factorloom.llm.components import components
from factorloom.session import stored

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BLOCK = 2048
#: Shingles whose bits are unpacked at a time.
CHUNK = 1 << 16
#: The pipeline's rule: Jaccard similarity of the distinct shingles of so many words.
STAGE_SHINGLE, SIMILAR = 5, 0.8
#: A pair at 0.8 misses all bands with chance (1 - 0.8 ** 6) ** 32 = 6e-5.
BANDS, BAND_ROWS = 32, 6
#: Sets whose min-hashes are computed together.
TOGETHER = 32
#: Documents of a task are at most two blocks of so many.
MEMBERS = 128
_draw = np.random.default_rng(SEED)
MIX = _draw.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1)
FLIP = _draw.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles of one text, in order and with repeats; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    size = min(shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles (repeats count) of one text."""
    return print_of(shingle_hashes(text, shingle))


def print_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.ones(len(part), np.float32) @ bits.astype(np.float32)  # exact: a chunk's sums fit into the 24 bits of a float
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per input row."""
    rows = pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(ids: list, texts: list) -> Iterable[tuple]:
        return ((i, _signed(fingerprint(t, shingle))) for i, t in zip(ids, texts))

    return map_rows(rows, run, f"doc_id {kind}, fp bigint")


def segments(bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Fewest segments (start, length) of 64 bits such that ``bits`` flips leave one with at most one."""
    n = bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variant_keys(fp, bits: int = MAX_BITS):
    """The one-wildcard variants of every segment as an array of (slot, value) columns."""
    keys = []
    for start, length in segments(bits):
        mask = ((1 << length) - 1) << start
        keys += [F.struct(F.lit(start + i).alias("slot"), fp.bitwiseAND(F.lit(_signed(mask & ~(1 << (start + i))))).alias("value")) for i in range(length)]
    return F.array(*keys)


def forest(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``members``: each step compares one with those not yet reached."""
    links = []
    pool = np.unique(members)
    while len(pool):
        queue, pool = [pool[0]], pool[1:]
        while queue and len(pool):
            one = queue.pop()
            near = np.bitwise_count(pool ^ one) <= bits
            if near.any():
                found, pool = pool[near], pool[~near]
                links += [(int(one), int(x)) for x in found]
                queue += list(found)
    return links


def near_links(nodes: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b) links that connect exactly the fingerprints (column fp, distinct) within ``bits`` bits."""
    keyed = nodes.select("fp", F.explode(variant_keys(F.col("fp"), bits)).alias("k")).select("k.slot", "k.value", "fp")
    key = Window.partitionBy("value", "slot")  # the sort compares by the first column, and slots are few
    shared = (
        keyed.withColumn("n", F.count(F.lit(1)).over(key)).where("n > 1")
        .withColumn("mine", F.floor((F.row_number().over(key.orderBy("fp")) - 1) / block).cast("int"))
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    )
    # a member of block i meets every other block j in the task of (min(i, j), max(i, j))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = shared.withColumn("other", others).where("blocks = 1 or mine != other").select("slot", "value", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    groups = dealt.repartition("slot", "value", "i", "j").groupBy("slot", "value", "i", "j").agg(F.collect_list("fp").alias("fps"))

    def run(lists: list) -> Iterable[tuple]:
        for fps in lists:
            if len(fps) == 2:
                if ((fps[0] ^ fps[1]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= bits:
                    yield fps[0], fps[1]
            else:
                for a, b in forest(np.array(fps, np.int64).view(np.uint64), bits):
                    yield _signed(a), _signed(b)

    return map_rows(groups.select("fps"), run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = stored(fingerprints(docs, shingle), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_links(nodes.select("fp"), bits, block))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = placed.join(least, "root").select("fp", "component_id")
    return prints.join(of_node, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of STAGE_SHINGLE words as sorted hashes."""
    return np.unique(shingle_hashes(text, STAGE_SHINGLE))


def _digest(values: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(values.tobytes(), SEED)) if len(values) else 0


def band_keys(sets: list[np.ndarray]) -> list[list[int]]:
    """For each set BANDS keys of BAND_ROWS smallest hashes each: sets of Jaccard s share a given key with chance s ** BAND_ROWS.

    An empty set has no keys.
    """
    full = [own for own in sets if len(own)]
    if not full:
        return [[] for _ in sets]
    values, starts = np.concatenate(full), np.cumsum([0, *map(len, full)])[:-1]
    least, mixed = np.empty((len(MIX), len(full)), np.uint64), np.empty_like(values)
    for row, flip, mix in zip(least, FLIP, MIX):
        np.bitwise_xor(values, flip, out=mixed)
        np.multiply(mixed, mix, out=mixed)
        np.minimum.reduceat(mixed, starts, out=row)
    keys = ([_digest(part) for part in own.reshape(BANDS, BAND_ROWS)] for own in least.T)
    return [next(keys) if len(own) else [] for own in sets]


def similar_links(sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest (places in ``sets``) of the pairs with at least this exact Jaccard similarity."""
    sizes = np.array([len(x) for x in sets])
    links, pool = [], np.arange(len(sets))
    while len(pool):
        queue, pool = [pool[0]], pool[1:]
        while queue and len(pool):
            one = queue.pop()
            a = sets[one]
            other = sizes[pool]
            near = np.flatnonzero(np.minimum(other, len(a)) >= similar * np.maximum(other, len(a)) - 1e-9)
            if len(near):
                b = np.concatenate([sets[i] for i in pool[near]])
                same = a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b
                both = np.add.reduceat(same, np.concatenate(([0], np.cumsum(other[near])[:-1])), dtype=np.int64)
                near = near[both >= similar * (other[near] + len(a) - both) - 1e-9]
                links += [(int(one), int(x)) for x in pool[near]]
                queue += list(pool[near])
                pool = np.delete(pool, near)
    return links


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, body, node, fp, bands): hash of the text, digest of its shingle set, SimHash, band keys; one row per input row."""
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("body", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(ids: list, texts: list, bodies: list) -> Iterable[tuple]:
        for at in range(0, len(ids), TOGETHER):
            sets = [shingle_set(text) for text in texts[at : at + TOGETHER]]
            for doc_id, body, own, keys in zip(ids[at : at + TOGETHER], bodies[at : at + TOGETHER], sets, band_keys(sets)):
                # of the distinct shingles: one fingerprint a node
                yield doc_id, body, _digest(own), _signed(print_of(own)), keys

    return map_rows(rows, run, f"doc_id {kind}, body bigint, node bigint, fp bigint, bands array<bigint>")


def near_prints(nodes: DataFrame) -> DataFrame:
    """(members): pairs of nodes (node, fp) whose fingerprints link within MAX_BITS, as sorted lists of two.

    Nodes of one fingerprint all meet the smallest of them, which stands for the fingerprint in its links.
    """
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    equal = nodes.select("fp", "node").join(heads, "fp").where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = near_links(heads.select("fp"))
    ends = links.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    pairs = equal.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return pairs.select(F.array_sort(F.array("a", "b")).alias("members"))


def verified_links(docs: DataFrame, nodes: DataFrame, block: int = MEMBERS) -> DataFrame:
    """(a, b) links that connect the nodes (node, body, fp, bands) which link by SimHash or share a band and are similar by their shingles."""
    keyed = nodes.select("node", F.posexplode("bands").alias("slot", "value"))
    key = Window.partitionBy("value", "slot")
    shared = (
        keyed.withColumn("n", F.count(F.lit(1)).over(key)).where("n > 1")
        .withColumn("mine", F.floor((F.row_number().over(key.orderBy("node")) - 1) / block).cast("int"))
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    )
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = shared.withColumn("other", others).where("blocks = 1 or mine != other").select("slot", "value", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node")
    # bands mostly gather the same nodes: one comparison for equal lists
    lists = dealt.groupBy("slot", "value", "i", "j").agg(F.array_sort(F.collect_list("node")).alias("members")).select("members")
    lists = near_prints(nodes).unionByName(lists).distinct()
    members = stored(lists.select(F.xxhash64("members").alias("task"), F.explode("members").alias("node")), "members")
    bodies = members.select("node").distinct().join(nodes.select("node", "body"), "node").select(F.col("body").alias("wanted")).distinct()
    texts = pick(docs, text="text").withColumn("body", F.xxhash64("text"))

    def read(bodies: list) -> Iterable[tuple]:
        for text in bodies:
            own = shingle_set(text)
            yield _digest(own), own.tobytes()

    found = map_rows(texts.join(bodies, F.col("body") == F.col("wanted"), "left_semi").select("text"), read, "node bigint, shingles binary")
    sets = stored(found.groupBy("node").agg(F.max("shingles").alias("shingles")), "sets")
    tasks = members.join(sets, "node").groupBy("task").agg(F.collect_list("node").alias("ids"), F.collect_list("shingles").alias("sets"))

    def run(ids: list, packed: list) -> Iterable[tuple]:
        for own, sets in zip(ids, packed):
            for a, b in similar_links([np.frombuffer(x, np.uint64) for x in sets]):
                yield own[a], own[b]

    return map_rows(tasks.select("ids", "sets"), run, "a bigint, b bigint").distinct()


def similar_documents(docs: DataFrame, block: int = MEMBERS) -> DataFrame:
    """One row per document: doc_id, component_id (smallest id reachable by links of similarity SIMILAR)."""
    prints = stored(profiles(docs), "profiles")
    nodes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("body").alias("body"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    roots = components(verified_links(docs, nodes, block))
    placed = nodes.select(F.col("node").alias("own"), "least").join(roots, F.col("own") == F.col("node"), "left").select("own", F.coalesce("root", "own").alias("root"), "least")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = placed.join(least, "root").select("own", "component_id")
    return prints.select("doc_id", "node").join(of_node, F.col("node") == F.col("own")).select("doc_id", "component_id")


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of similar documents (its smallest id); columns unchanged."""
    stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")
    ids = similar_documents(docs).groupBy(F.col("doc_id").alias("id")).agg(stays)
    return keep_rows(docs, ids.where("not stays").select("id"), "left_anti")  # those that go are fewer
