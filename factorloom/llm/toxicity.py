"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, one for toxic and one for ordinary text, back off to continuation counts (in how
many different contexts a word occurs, so copies of a text count once) and share the last backoff, the
continuation counts of both classes together, with one weight: a word that no class knows is smoothed alike under both.  A bigram
without a count of its own has the escape weight of its context in each class.

Evidence of a text: the mean difference of the two log-likelihoods over its words, the greatest mean over SPAN words, and the two
greatest differences of single words under the lower order, each less CAUTION standard errors of its toxic
contexts, so that a word met by chance in one toxic text weighs less than an expression of many.  A logistic curve
turns them into a probability.

Learning.  Of the rows that may be learned from (fold 0 of FOLDS is held out), at most a quarter and about SAMPLE / 2 of each class
(chosen by a hash of the id, weighted back to the true rate) fit the curve; all others are counted, so the curve sees texts the counts have
not seen.  If the sample lacks a class, the score is the uncalibrated log-likelihood difference of the whole text as a probability.

All words and bigrams of the counted rows enter the contexts and the continuation counts; words and contexts that occur LEAST times and
bigrams that occur LEAST_PAIRS times have counts of their own.  Words are hashes of HASH_BITS bits from the first count on (of a
billion words about one in a thousand shares its hash).  Bigrams are shuffled in packed blocks, dealt by hash into as many buckets as
keep BUCKET characters of text each.  The HELD most frequent counts travel to the tasks as sorted arrays, a bound that holds at every
size; texts ask for the others by equality of keys, after a filter of FILTER bits has told what cannot be known.  Labels
meet their texts by the hashes of id and text: up to HELD labelled documents travel to the scan, more are joined.

Defined results.  NULL and empty texts, and texts without a word, score the curve's value at the evidence of an unknown word.  Rows with
NULL or missing labels are not learned from but are scored; NULL doc_id is not held out and not learned from.  Repeated rows are scored as
often as they come; repeated or contradicting labels of one document all count.  If a class has no row, every score is 0.  An empty
table gives no rows.  Extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factorloom.llm.common import map_rows, pick, release, slices, word_numbers
from factorloom.llm.language import fold
from factorloom.session import stored

FOLDS, HELD_OUT = 5, 0
SPAN = 4
DISCOUNT = 0.75
SAMPLE = 20_000
#: Occurrences from which on words and contexts, and bigrams, have counts of their own.
LEAST, LEAST_PAIRS = 2, 3
#: Counts, and labelled documents, that travel to the tasks at most (28 bytes each).
HELD = 3_000_000
#: Bits of a word's hash; a bigram is packed into twice as many.
HASH_BITS = 40
#: Characters of text whose bigrams make a bucket.
BUCKET = 8_000_000
#: Bits of the filters of keys and of learned ids; full filters let everything pass.
FILTER = 1 << 26
#: Words whose bigrams are looked up at one time (a single longer text is one part).
POSITIONS = 1 << 18
CAUTION = 2.0
#: Evidence of a word that no class knows.
UNKNOWN = -CAUTION
WORD = re.compile(r"[^\W\d_]+")
#: The context of the first word; no word looks like it.
START = "^"
#: Marks that keep the keys of contexts, words and bigrams apart.
CONTEXT, SINGLE, PAIR = (np.uint64(x << 60) for x in (1, 2, 3))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def numbered(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of each text of a slice as numbers, and the hash of every word by number; START is 0."""
    numbers, sizes, words = word_numbers(texts, digits=False)
    digests = map(xxhash.xxh64_intdigest, [START, *words], repeat(42))
    hashes = np.fromiter(digests, np.uint64, len(words) + 1) >> np.uint64(64 - HASH_BITS)
    return np.split(numbers + 1, np.cumsum(sizes)[:-1]), hashes


def bit_filter(keys: DataFrame) -> np.ndarray:
    """FILTER bits as longs, those of the column ``key`` set: at most 8 MB reach the driver."""
    bit = f"pmod(key, {FILTER}L)"
    words = keys.select(F.expr(f"cast(shiftright({bit}, 6) as int)").alias("at"), F.expr(f"shiftleft(1L, cast({bit} % 64 as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER // 64, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def bits_of(keys: np.ndarray) -> np.ndarray:
    """The filter of keys that one process holds."""
    at = keys.view(np.uint64) & np.uint64(FILTER - 1)
    marks = np.zeros(FILTER, bool)
    marks[at.astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").view("<u8").astype(np.uint64)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) & np.uint64(FILTER - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 60-bit key of two hashes: multiplied and folded, so that no pair of words is favoured."""
    x = v * np.uint64(0x9E3779B97F4A7C15) ^ w * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(4)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, key, chars, t, o) of the rows that may be learned from: hash of id and text, and how many labels of either class."""
    known = pick(labels, id="doc_id", toxic="toxic").where("id is not null and toxic is not null").groupBy("id").agg(
        F.count(F.when(F.col("toxic") > 0, 1)).alias("t"), F.count(F.when(F.col("toxic") > 0, None).otherwise(1)).alias("o")
    )
    rows = pick(docs, doc_id="doc_id", text="text")
    learn = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    slim = learn.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.length("text").alias("chars"))
    return slim.join(known, F.col("doc_id") == F.col("id")).select("doc_id", "key", "chars", "t", "o")


def texts_of(docs: DataFrame, learn: DataFrame, held: int = HELD) -> DataFrame:
    """(toxic, text), as often as labels say so, of the documents of ``learn``.

    Up to ``held`` of them travel to the scan as hashes of id and text.  More are joined; a filter of
    bits then drops most other texts before the shuffle.
    """
    spark, struct = docs.sparkSession, T.StructType.fromDDL("toxic boolean, text string")
    arrow = to_arrow_schema(struct)
    rows = pick(docs, doc_id="doc_id", text="text").where("text is not null").select(F.xxhash64("doc_id", "text").alias("key"), "text")
    wanted = learn.groupBy("key").agg(F.max("t").alias("t"), F.max("o").alias("o"))
    few = wanted.count() <= held
    if few:
        found = wanted.toArrow()
        order = np.argsort(found["key"].to_numpy())
        sent = spark.sparkContext.broadcast(tuple(found[c].to_numpy()[order] for c in ("key", "t", "o")))
    else:
        sent = spark.sparkContext.broadcast(bit_filter(wanted))

    def repeated(texts: pa.Array, t: np.ndarray, o: np.ndarray) -> Iterator[pa.RecordBatch]:
        for toxic, times in ((True, t), (False, o)):
            at = np.repeat(np.arange(len(times)), times)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), toxic)), texts.take(pa.array(at))], schema=arrow)

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, t, o = sent.value
        for batch in batches:
            own = batch.column(0).to_numpy()
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            hit = np.flatnonzero(keys[at] == own) if len(keys) else np.empty(0, int)
            yield from repeated(batch.column(1).take(pa.array(hit)), t[at[hit]], o[at[hit]])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(may_hold(sent.value, batch.column(0).to_numpy())))
            if kept.num_rows:
                yield kept

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from repeated(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy())

    if few:
        return rows.mapInArrow(here, struct)
    return rows.mapInArrow(sift, rows.schema).join(wanted.hint("merge"), "key").select("text", "t", "o").mapInArrow(there, struct)


def bigrams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first and the second words of all bigrams of texts, one after the other."""
    w = np.concatenate(texts)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    v[starts[starts < len(v)]] = 0
    return v, w


def packed(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Bigrams as 2 x 5 bytes each, then the places and counts of those that occur more than once."""
    more = np.flatnonzero(n > 1).astype("<u4")
    halves = [x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for x in (v, w)]
    return b"".join([np.array([len(v), len(more)], "<u4").tobytes(), *halves, more.tobytes(), n[more].astype("<u8").tobytes()])


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, more = np.frombuffer(block, "<u4", 2)
    full = np.zeros((2, size, 8), np.uint8)
    full[:, :, :5] = np.frombuffer(block, np.uint8, 10 * size, 8).reshape(2, size, 5)
    v, w = full.reshape(2, -1).view("<u8")
    n = np.ones(size, np.int64)
    n[np.frombuffer(block, "<u4", more, 8 + 10 * size)] = np.frombuffer(block, "<u8", more, 8 + 10 * size + 4 * more)
    return v, w, n


def blocks(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, toxic, block): the distinct bigrams of a slice of texts, packed per bucket and class."""
    struct = T.StructType.fromDDL("bucket int, toxic boolean, block binary")
    arrow = to_arrow_schema(struct)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, texts in slices(batches):
            own, h = numbered(texts)
            sides = {True: [], False: []}
            for kind, words in zip(toxic, own):
                sides[kind].append(words)
            for kind, parts in sides.items():
                if not any(map(len, parts)):
                    continue
                v, w = (h[x] for x in bigrams(parts))
                keys, first, n = np.unique(pair_key(v, w), return_index=True, return_counts=True)
                own = keys % np.uint64(buckets)
                order = np.argsort(own, kind="stable")
                ends = np.searchsorted(own[order], np.arange(buckets + 1).astype(np.uint64))
                used = np.flatnonzero(np.diff(ends))
                made = []
                for b in used:
                    at = order[ends[b] : ends[b + 1]]
                    made.append(packed(v[first[at]], w[first[at]], n[at]))
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([kind] * len(used)), pa.array(made, pa.binary())], schema=arrow)
        release()

    return rows.select("toxic", "text").mapInArrow(count, struct)


#: Columns of a context: occurrences of either class and the discounted mass of its bigrams with counts of their own.  Of a word: occurrences,
#: continuation counts of either class and of both.  Of a bigram: occurrences.
COUNTS = ("t", "o", "a", "b", "k")


def sums(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    keys, place = np.unique(key, return_inverse=True)
    return keys, *[np.bincount(place, c, len(keys)) for c in columns]


def counted(rows: DataFrame, buckets: int, least: int) -> DataFrame:
    """(key, t, o, a, b, k) of all contexts and words, and of the bigrams that occur ``least`` times."""
    struct = T.StructType.fromDDL("key bigint, t double, o double, a double, b double, k double")
    arrow = to_arrow_schema(struct)

    def merge(table: pa.Table) -> pa.Table:
        # a bucket: BUCKET characters of text, packed
        parts = [(kind, *unpacked(block)) for kind, block in zip(table["toxic"].to_pylist(), table["block"].to_pylist())]
        v, w, n = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        toxic = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        keys, first, place = np.unique(pair_key(v, w), return_index=True, return_inverse=True)
        t, o = (np.bincount(place, np.where(toxic == kind, n, 0), len(keys)) for kind in (True, False))
        v, w, own = v[first], w[first], t + o >= least
        mass = [np.where(own, np.maximum(c - DISCOUNT, 0), 0) for c in (t, o)]
        zero = np.zeros(own.sum())
        sides = [
            sums(CONTEXT | v, t, o, *mass, np.zeros(len(v))),
            sums(SINGLE | w, t, o, t > 0, o > 0, np.ones(len(w))),
            (PAIR ^ keys[own], t[own], o[own], zero, zero, zero),
        ]
        columns = [np.concatenate([side[i] for side in sides]) for i in range(6)]
        return pa.table([pa.array(columns[0].view(np.int64)), *map(pa.array, columns[1:])], schema=arrow)

    partial = blocks(rows, buckets).groupBy("bucket").applyInArrow(merge, struct)
    return partial.groupBy("key").agg(*[F.sum(c).cast("float").alias(c) for c in COUNTS])


def kind_of(key: str) -> str:
    return f"shiftrightunsigned({key}, 60)"


def train(rows: DataFrame, share: float | None = None, least: int = 1, least_pairs: int | None = None, buckets: int = 1) -> tuple[dict, DataFrame] | None:
    """The counts that occur ``least`` times: held arrays with the totals, and the other rows (key and COUNTS).

    ``share`` holds what makes up that share of a class's words instead of the HELD most frequent counts.
    """
    counts = stored(counted(rows, buckets, least if least_pairs is None else least_pairs), "counts")
    above = [F.sum(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))).alias(f"above_{c}") for c in "ab"]
    words = counts.where(f"{kind_of('key')} = 2")
    totals = words.agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("types"), *above).first()
    if not totals["t"] or not totals["o"]:
        return None
    known = counts.where(F.col("t") + F.col("o") >= least)
    if share is None:
        top = 10_000
        steps = sorted((int(r["n"]), r["count"]) for r in known.groupBy(F.least(F.col("t") + F.col("o"), F.lit(float(top))).alias("n")).count().collect())
        room, bar = HELD, top + 1
        for n, count in reversed(steps):
            if count > room:
                break
            room, bar = room - count, n
        often = F.col("t") + F.col("o") >= bar
    else:
        often = (F.col("t") >= share * totals["t"]) | (F.col("o") >= share * totals["o"])
    held = known.where(often).toArrow()
    keys = held["key"].to_numpy()
    order = np.argsort(keys)
    rest = known.where(~often)
    model = {
        "keys": keys[order], "counts": np.column_stack([held[c].to_numpy() for c in COUNTS])[order].astype(np.float32),
        "back": DISCOUNT * totals["types"] / totals["k"], "kinds": totals["k"], "above": (totals["above_a"] or 1.0, totals["above_b"] or 1.0),
        "bits": bits_of(keys), "filter": None if rest.isEmpty() else bit_filter(rest),
    }
    return model, rest


def look_up(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Rows of counts of the asked keys, NaN where ``keys`` (sorted) lacks them."""
    if not len(keys):
        return np.full((len(asked), len(COUNTS)), np.nan)
    order, at = np.argsort(asked), np.empty(len(asked), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, asked[order]), len(keys) - 1)  # near keys in turn: fewer cache misses
    return np.where((keys[at] == asked)[:, None], counts[at], np.nan)


def pair_keys(h: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (PAIR ^ pair_key(h[v], h[w])).view(np.int64)


def unknown_keys(texts: list[str | None], model: dict) -> Iterator[np.ndarray]:
    """For each text the keys that the held counts lack and the other rows may have."""
    own, h = numbered(texts)

    def lacking(keys: np.ndarray) -> np.ndarray:
        out = may_hold(model["filter"], keys)
        out[out] = np.isnan(look_up(model["keys"], model["counts"], keys[out])[:, 0])
        return out

    sides = [(keys, lacking(keys)) for keys in ((CONTEXT | h).view(np.int64), (SINGLE | h).view(np.int64))]
    for ids in own:
        used = np.unique(np.append(ids, np.int32(0)))
        pairs = np.unique(pair_keys(h, *bigrams([ids])))
        yield np.unique(np.concatenate([*[keys[used[asks[used]]] for keys, asks in sides], pairs[lacking(pairs)]]))


def evidence(texts: list[str | None], model: dict, told: list[list]) -> Iterator[tuple[float, float, float, float, float]]:
    """(best word, second word, best SPAN words, mean, total) in nats for each text of a slice.

    ``told`` holds the rows (key, counts) that the texts asked for.  What concerns one word is computed once for the slice.
    """
    own, h = numbered(texts)
    tables = [(model["keys"], model["counts"], model["bits"])]
    answers = {r["key"]: [r[c] for c in COUNTS] for rows in told for r in rows}
    if answers:
        keys = np.array(sorted(answers), np.int64)
        tables.append((keys, np.array([answers[k] for k in keys.tolist()], float), None))

    def counts(asked: np.ndarray) -> np.ndarray:
        out = look_up(*tables[0][:2], asked).astype(float)
        return np.where(np.isnan(out), look_up(*tables[1][:2], asked), out) if answers else out

    some, word = np.nan_to_num(counts((CONTEXT | h).view(np.int64))), counts((SINGLE | h).view(np.int64))
    known = ~np.isnan(word[:, 0])
    escape = [np.where(some[:, c] > 0, 1 - some[:, 2 + c] / np.maximum(some[:, c], 1), 1.0) for c in (0, 1)]
    # a word that no class knows has the same lower order under both
    back, kinds = model["back"], np.where(known, word[:, 4], model["kinds"])
    lower = [(1 - back) * np.maximum(np.nan_to_num(word[:, 2 + c]) - DISCOUNT, 0) / model["above"][c] + back * kinds / model["kinds"] for c in (0, 1)]
    out, tail = np.log(escape[0]) - np.log(escape[1]), np.log(lower[0]) - np.log(lower[1])
    gain = np.where(known, tail - CAUTION / np.sqrt(np.maximum(np.nan_to_num(word[:, 2]), 1)), UNKNOWN)

    def ratios(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        ratio, asked = out[v] + tail[w], pair_keys(h, v, w)
        for keys, values, bits in tables:  # bigrams with counts of their own
            if not len(keys):
                continue
            may = np.arange(len(asked)) if bits is None else np.flatnonzero(may_hold(bits, asked))
            may = may[np.argsort(asked[may])]  # near keys in turn: fewer cache misses
            at = np.minimum(np.searchsorted(keys, asked[may]), len(keys) - 1)
            hit = keys[at] == asked[may]
            n, may = values[at[hit], :2].astype(float), may[hit]
            x, y = v[may], w[may]
            p = [np.maximum(n[:, c] - DISCOUNT, 0) / np.maximum(some[x, c], 1) + escape[c][x] * lower[c][y] for c in (0, 1)]
            ratio[may] = np.log(p[0]) - np.log(p[1])
        return ratio

    at = 0
    while at < len(own):
        upto, size = at, 0
        while upto < len(own) and (upto == at or size + len(own[upto]) <= POSITIONS):
            size += len(own[upto])
            upto += 1
        ratio, ends = ratios(*bigrams(own[at:upto])), np.cumsum([0, *map(len, own[at:upto])])
        for ids, start, end in zip(own[at:upto], ends[:-1], ends[1:]):
            if start == end:
                yield UNKNOWN, UNKNOWN, 0.0, 0.0, 0.0
                continue
            sums_ = np.concatenate(([0.0], np.cumsum(ratio[start:end])))
            span, total = min(SPAN, end - start), float(sums_[-1])
            gains = gain[ids]
            best = gains.argmax()
            others = gains[ids != ids[best]]
            second = float(others.max()) if len(others) else UNKNOWN
            yield float(gains[best]), second, float((sums_[span:] - sums_[:-span]).max() / SPAN), total / (end - start), total
        at = upto


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge; x without the constant column."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


EVIDENCE = ("first", "second", "most", "mean")


def measured(rows: DataFrame, model: dict, rest: DataFrame) -> DataFrame:
    """doc_id, body (hash of the text) and the evidence for every row."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, body bigint, first double, second double, most double, mean double, total double"
    texts = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("body"))
    if model["filter"] is None:  # every value is held

        def alone(ids: list, own: list, bodies: list) -> Iterator[tuple]:
            return ((doc_id, body, *found) for doc_id, body, found in zip(ids, bodies, evidence(own, sent.value, [])))

        return map_rows(texts, alone, out)

    def ask(bodies: list, own: list) -> Iterable[tuple]:
        once = dict(zip(bodies, own))  # copies ask once
        for body, keys in zip(once, unknown_keys(list(once.values()), sent.value)):
            yield from ((body, key) for key in keys.tolist())

    # copies in other slices ask again: distinct before the lists are made, so a list has the size of one text
    asked = map_rows(texts.select("body", "text"), ask, "asker bigint, key bigint").distinct()
    answers = asked.join(rest, "key").groupBy("asker").agg(F.collect_list(F.struct("key", *COUNTS)).alias("said"))

    def run(ids: list, own: list, bodies: list, told: list) -> Iterator[tuple]:
        found = evidence(own, sent.value, [said for said in told if said])
        return ((doc_id, body, *values) for doc_id, body, values in zip(ids, bodies, found))

    told = texts.join(answers, F.col("body") == F.col("asker"), "left").select("doc_id", "text", "body", "said")
    return map_rows(told, run, out)


def score_toxicity(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = pick(docs, doc_id="doc_id", text="text")
    learn = stored(labelled(docs, labels), "learn")
    totals = learn.agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.sum("chars").alias("chars")).first()
    n = {True: totals["t"] or 0, False: totals["o"] or 0}
    buckets = 1 + (totals["chars"] or 0) // BUCKET
    # of each class its own bound, and never more than a quarter
    bound = {kind: min(SAMPLE // 2, n[kind] // 4) for kind in (True, False)}
    chosen = {kind: F.pmod(F.xxhash64("doc_id"), F.lit(max(n[kind], 1))) < bound[kind] for kind in n}
    learn = learn.withColumn("fits", F.when(F.col("t") > 0, chosen[True]).otherwise(chosen[False]))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    trained, calibrate = None, True
    if n[True] and n[False]:
        trained = train(texts_of(docs, learn.where("not fits")), share, LEAST, LEAST_PAIRS, buckets)
        if not trained:
            trained, calibrate = train(texts_of(docs, learn), share, LEAST, LEAST_PAIRS, buckets), False
    if not trained:
        return rows.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    found = stored(measured(rows, *trained), "evidence")
    power = F.col("total")
    if calibrate:
        sides = F.explode(F.array_compact(F.array(F.when(F.col("t") > 0, F.lit(True)), F.when(F.col("o") > 0, F.lit(False)))))
        wanted = learn.where("fits").select(F.col("key").alias("own"), sides.alias("toxic"))
        of_text = found.groupBy("body").agg(*[F.max(e).alias(e) for e in EVIDENCE])
        sample = wanted.join(of_text, F.col("own") == F.col("body")).select("toxic", *EVIDENCE).toArrow()
        y = np.array(sample["toxic"].to_pylist(), float)
        if 0 < y.sum() < len(y):
            rate = n[True] / (n[True] + n[False])
            weight = np.where(y > 0, rate * len(y) / y.sum(), (1 - rate) * len(y) / (len(y) - y.sum()))
            beta = [float(b) for b in fit_curve(np.column_stack([sample[e].to_numpy() for e in EVIDENCE]), y, weight)]
            power = F.lit(beta[0])
            for b, e in zip(beta[1:], EVIDENCE):
                power = power + b * F.col(e)
    score = 1 / (1 + F.exp(-power))
    return found.select("doc_id", held, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
