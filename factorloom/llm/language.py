"""Language identification by prediction by partial matching (PPM).

For every language a variable-order context tree over lower-case UTF-8 bytes is counted on all training
rows: contexts of up to ORDER bytes, with an escape probability (method C) to the next shorter
context and a uniform byte at the end.  With the statistics frozen, the code length of a text under each
tree is exact; the shortest wins and the score is its posterior against the others.

Training is one distributed count of byte 4-grams (grouped on the map side as well); shorter contexts are sums
of it.  The trees that tasks receive hold only nodes with at least SHARE of a language's bytes, hence
at most 1 / SHARE entries per order and language, however large the corpus.  Workers compile them to one cost table.

Defined results.  NULL texts and texts without a letter are ``und`` with score 0.  If nothing can be learned (no
labelled row) every text is ``und``.  Ties go to the language that sorts first.  Rows with NULL lang are not learned
from but are predicted; NULL doc_id is not held out and not learned from.  Repeated rows count and are predicted as
often as they come.  Empty table: no rows.  Extra columns are ignored; texts are read whole.

As a filter (``keep_known``) the code length itself decides: a text goes if its tree needs more bits than no tree at all (8 bits
a byte) by over MARGIN, and more bits a byte than the mean of held-out rows of its language and like length (the
same power of two of bytes) by over SPREADS standard deviations.  With fewer than LIKE such rows those of all lengths of the language
stand for them; if these are fewer too, the text stays.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import keep_rows, map_rows, one_per_worker, pick
from factorloom.session import stored

ORDER = 3
SHARE = 1e-6
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
START = b"\n" * ORDER
CHUNK = 1 << 20
#: Bits: a key or an address of 40 characters in a short text costs up to about 10 bits a byte more than no tree.
MARGIN = 400.0
SPREADS, LIKE = 6.0, 30


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds


def merged_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``grams`` of many texts, a few megabytes at a time."""
    parts, at = [], 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= CHUNK):
            size += len(texts[upto])
            upto += 1
        parts.append(grams(texts[at:upto]))
        at = upto
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed 4-grams (three context bytes, one symbol) of texts, with counts."""
    data = np.frombuffer(b"".join(START + t for t in texts), np.uint8).astype(np.uint32)
    packed = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    keep = np.ones(len(packed), bool)
    ends = np.cumsum([len(t) + ORDER for t in texts])[:-1]
    for back in range(ORDER):  # no gram reaches from one text into the next start
        keep[ends - 1 - back] = False
    return np.unique(packed[keep], return_counts=True)


@dataclass
class Entries:
    """Nodes of the trees as columns, which travel and rest in little memory; iterates over tuples."""

    langs: list[str]
    lang: np.ndarray
    order: np.ndarray
    key: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Entries:
        langs = sorted(set(table["lang"].to_pylist()))
        number = {name: i for i, name in enumerate(langs)}
        lang = np.array([number[x] for x in table["lang"].to_pylist()], np.int32)
        return cls(langs, lang, *[table[c].to_numpy() for c in ("order", "key", "n")])

    def __iter__(self) -> Iterator[tuple[str, int, int, int]]:
        for i in range(len(self.n)):
            yield self.langs[self.lang[i]], int(self.order[i]), int(self.key[i]), int(self.n[i])


def train(labelled: DataFrame, share: float = SHARE) -> Entries:
    """(lang, order, packed context and symbol, count) of the frozen trees; bounded by ``share``."""

    def count(langs: list, texts: list) -> Iterable[tuple]:
        by = defaultdict(list)
        for lang, text in zip(langs, texts):
            if text:
                by[lang].append(text.lower().encode("utf-8", "surrogatepass"))
        for lang, own in by.items():
            keys, n = merged_grams(own)
            yield from ((lang, k, c) for k, c in zip(keys.tolist(), n.tolist()))

    raw = map_rows(labelled.select("lang", "text"), count, "lang string, gram bigint, n bigint")
    whole = raw.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("order"), F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")) for k in range(ORDER + 1)]))
    nodes = whole.select("lang", "n", levels.alias("x")).groupBy("lang", "x.order", "x.key").agg(F.sum("n").alias("n"))
    totals = whole.groupBy("lang").agg(F.sum("n").alias("total"))
    frozen = nodes.join(totals, "lang").where(F.col("n") >= share * F.col("total")).select("lang", "order", "key", "n")
    return Entries.of(frozen.toArrow())


class Trees:
    """The cost table: bits of every symbol after every known context, for all languages at once."""

    def __init__(self, entries: Entries) -> None:
        self.langs = entries.langs
        column = {lang: i for i, lang in enumerate(self.langs)}
        used = sorted({key & 255 for _, order, key, _ in entries if order == 0} | set(START))
        self.map = np.zeros(256, np.int64)  # 0: any other byte
        for i, b in enumerate(used):
            self.map[b] = i + 1
        width = self.width = len(used) + 1
        counts = defaultdict(lambda: defaultdict(list))  # order -> context -> (lang, symbol, n)
        for lang, order, key, n in entries:
            counts[order][key >> 8].append((column[lang], self.map[key & 255], n))
        size = 1 + sum(len(counts[order]) for order in range(1, ORDER + 1))
        table = np.empty((size, width, len(self.langs)), np.float32)
        table[0] = self._row(np.full(table.shape[1:], 8.0, np.float32), counts[0].get(0, []))
        known, filled = {(): 0}, 1
        for order in range(1, ORDER + 1):
            for context, found in sorted(counts.pop(order, {}).items()):
                symbols = tuple(self.map[(context >> 8 * i) & 255] for i in reversed(range(order)))
                if all(symbols):
                    parent = next(known[symbols[i:]] for i in range(1, order + 1) if symbols[i:] in known)
                    table[filled] = self._row(table[parent], found)
                    known[symbols] = filled
                    filled += 1
        self.table = table[:filled].reshape(filled * width, len(self.langs))
        self.row_of = np.zeros((width, width, width), np.int32)
        for symbols, row in sorted(known.items(), key=lambda x: len(x[0])):
            if len(symbols) == 1:
                self.row_of[:, :, symbols[0]] = row
            elif len(symbols) == 2:
                self.row_of[:, symbols[0], symbols[1]] = row
            elif len(symbols) == 3:
                self.row_of[symbols] = row
        self.row_of = self.row_of.reshape(-1)

    @staticmethod
    def _row(shorter: np.ndarray, found: list[tuple[int, int, int]]) -> np.ndarray:
        """Costs in a context: a known symbol's own, else the escape plus the cost in the shorter context."""
        row = shorter.copy()
        total, distinct = np.zeros(shorter.shape[1]), np.zeros(shorter.shape[1])
        for lang, _, n in found:
            total[lang] += n
            distinct[lang] += 1
        has = total > 0
        row[:, has] += np.log2((total[has] + distinct[has]) / distinct[has]).astype(np.float32)
        for lang, symbol, n in found:
            row[symbol, lang] = np.log2((total[lang] + distinct[lang]) / n)
        return row

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths (texts x languages)."""
        out = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= CHUNK):
                size += len(texts[upto]) + ORDER
                upto += 1
            part = texts[at:upto]
            if len(part) == 1 and size > CHUNK:
                out[at] = sum(self._sums([part[0][max(0, i - ORDER) : i + CHUNK]], i == 0)[0] for i in range(0, len(part[0]), CHUNK))
            else:
                out[at:upto] = self._sums(part, True)
            at = upto
        return out

    def _sums(self, texts: list[bytes], fresh: bool) -> np.ndarray:
        """Sums over texts; if not ``fresh``, the first bytes of the text are context only."""
        lead = START if fresh else b""
        s = self.map[np.frombuffer(b"".join(lead + t for t in texts), np.uint8)]
        lengths = np.array([len(t) + len(lead) for t in texts])
        sums = np.zeros((len(texts), len(self.langs)))
        if len(s) <= ORDER:
            return sums
        w = self.width
        cell = self.row_of[(s[:-3] * w + s[1:-2]) * w + s[2:-1]].astype(np.int64) * w + s[3:]
        costs = self.table[cell]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        for back in range(ORDER):  # positions of the next text's start bytes cost nothing
            costs[starts[1:] - ORDER + back] = 0
        has = lengths > ORDER
        sums[has] = np.add.reduceat(costs, starts[has], axis=0, dtype=np.float64)
        return sums


def identify(docs: DataFrame, entries: Entries) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte for every row of ``docs`` under frozen trees."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(entries)
    tag = f"trees {uuid.uuid4().hex}"

    def run(ids: list, texts: list) -> Iterator[tuple]:
        trees = one_per_worker(tag, lambda: Trees(sent.value))
        good = [i for i, t in enumerate(texts) if trees.langs and t and any(map(str.isalpha, t))]
        raw = [texts[i].lower().encode("utf-8", "surrogatepass") for i in good]
        bits = trees.bits(raw) if good else np.zeros((0, 0))
        best = {}
        if good:
            at = bits.argmin(axis=1)
            low = bits[np.arange(len(good)), at]
            score = 1.0 / np.exp2(np.maximum(low[:, None] - bits, -1000.0)).sum(axis=1)
            best = {i: (trees.langs[a], s, b / len(r)) for i, a, s, b, r in zip(good, at.tolist(), score.tolist(), low.tolist(), raw)}
        for i, doc_id in enumerate(ids):
            yield (doc_id, *best.get(i, (UNKNOWN, 0.0, None)))

    rows = pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def learnable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))


def identify_language(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte: trees learned on the rows that are not held out."""
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang")
    entries = train(learnable(rows), share)
    return identify(rows, entries).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte"
    )


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without those that are ``und`` and those whose code is too long for every learned language."""
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang")
    size = F.octet_length(F.lower("text")).alias("size")
    # identify hands on the id as it is: here a struct, so that rows of one id stay apart
    marked = rows.select(F.struct("doc_id", "lang", size).alias("doc_id"), "text")
    found = identify(marked, train(learnable(rows))).select("doc_id.*", "lang_pred", "bits_per_byte")
    found = stored(found.withColumn("length", F.floor(F.log2("size")).cast("int")), "languages")
    held = found.where((F.col("lang") == F.col("lang_pred")) & (fold(F.col("doc_id"), FOLDS) == HELD_OUT))
    levels = F.explode(F.array(F.col("length"), F.lit(-1)))
    most = (F.avg("bits_per_byte") + SPREADS * F.stddev_pop("bits_per_byte")).alias("most")
    limits = held.select("lang_pred", "bits_per_byte", levels.alias("level")).groupBy("lang_pred", "level").agg(most, F.count(F.lit(1)).alias("n")).where(F.col("n") >= LIKE)
    like, every = (limits.where(c).select(F.col("lang_pred").alias(f"l{i}"), F.col("level").alias(f"v{i}"), F.col("most").alias(f"m{i}")) for i, c in enumerate(("level >= 0", "level < 0")))
    # a row per language and power of two: small at every size
    judged = found.join(F.broadcast(like), F.expr("lang_pred = l0 and length = v0"), "left").join(F.broadcast(every), F.expr("lang_pred = l1"), "left")
    bits = F.col("bits_per_byte")
    too_long = ((bits - 8) * F.col("size") > MARGIN) & (bits > F.coalesce("m0", "m1"))
    return keep_rows(docs, judged.where((F.col("lang_pred") == UNKNOWN) | too_long).select(F.col("doc_id").alias("id")).distinct(), "left_anti")
