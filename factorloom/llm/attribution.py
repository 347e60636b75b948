"""Token counts by field and section from one encoding of the whole document.

A document (its fields joined by a line break) is encoded once; each token has a character span.  Token spans and
section spans of a document are joined as intervals: both are sorted, so a binary search per token finds its
section.  A token that crosses a boundary belongs, by rule, to the section of its first character (``first``) or of its
last (``last``); every token counts exactly once, so the sections' counts add up to the document's.

The word-like pieces that the byte-level tokenizer splits a text into are encoded once per worker and
remembered, which leaves ids and spans the same; control strings in a text are text.  No shuffle: sections never leave the task of their document.

Sections are the lines of each field; a line's break belongs to it.  Defined results: NULL fields are empty; an empty
field is one section without characters.  NULL and repeated doc_ids are reported row by row.  Empty table: no rows.
Extra columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from factorloom.llm.common import map_rows, one_per_worker, pick
from factorloom.llm.words import PLAIN, REMEMBERED, byte_letters

#: How the byte-level vocabulary splits a text before merging (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts of PLAIN characters, for the faster matcher.
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: New pieces that are turned into spans in one step.
TOGETHER = 20_000


class PieceSpans:
    """Token spans by piece.  The new pieces of a text meet the model and are turned into spans together."""

    def __init__(self, path: str) -> None:
        self.model = Tokenizer.from_file(path).model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        """Remember (first character, one past the last) of every token of new pieces, as uint32 bytes."""
        values: list[list[int]] = []
        for piece in pieces:
            shown = piece.encode().decode("latin-1").translate(self.letters)
            values.append([len(t.value) for t in self.model.tokenize(shown)])  # one letter stands for one byte
        counts = np.fromiter(map(len, values), np.int64, len(values))
        sizes = np.fromiter(chain.from_iterable(values), np.int64)
        stops = np.cumsum(sizes)
        starts = stops - sizes
        joined = "".join(pieces)
        if not joined.isascii():  # bytes to characters
            of = np.cumsum((np.frombuffer(joined.encode(), np.uint8) & 0xC0) != 0x80) - 1
            starts, stops = of[starts], of[stops - 1] + 1
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        before = np.repeat(np.cumsum(lengths) - lengths, counts)
        packed = np.column_stack([starts - before, stops - before]).astype(np.uint32).tobytes()
        edges = [0, *(np.cumsum(counts) * 8).tolist()]
        self.known.update((piece, packed[s:e]) for piece, s, e in zip(pieces, edges, edges[1:]))

    def spans(self, text: str) -> np.ndarray:
        """(tokens x 2): first character and one past the last of every token of a text."""
        pieces = (PLAIN_PIECES if PLAIN.fullmatch(text) else PIECES).findall(text)
        if not pieces:
            return np.zeros((0, 2), np.int64)
        distinct = set(pieces)
        new = list(distinct.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(distinct)
        for at in range(0, len(new), TOGETHER):
            self.learn(new[at : at + TOGETHER])
        packed = list(map(self.known.__getitem__, pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
        offsets = np.repeat(np.cumsum(sizes) - sizes, counts)
        return np.frombuffer(b"".join(packed), np.uint32).reshape(-1, 2).astype(np.int64) + offsets[:, None]


def piece_spans(path: str) -> PieceSpans:
    return one_per_worker(f"pieces {path}", lambda: PieceSpans(path))


def lines(text: str) -> list[tuple[int, int]]:
    """Spans of the lines of a text; a break belongs to the line that it ends."""
    out, at = [], 0
    while True:
        found = text.find("\n", at)
        if found < 0:
            return out + [(at, len(text))] if at < len(text) or not out else out
        out.append((at, found + 1))
        at = found + 1


def attribute_tokens(docs: DataFrame, tokenizer: str, fields: Sequence[str] = ("text",), rule: str = "first") -> DataFrame:
    """doc_id, field, section, char_start, char_end (within the joined document), n_tokens."""
    if rule not in ("first", "last"):
        raise ValueError("rule is 'first' or 'last'")
    rows = pick(docs, doc_id="doc_id", **{f"f{i}": f for i, f in enumerate(fields)})
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(ids: list, *columns: list) -> Iterable[tuple]:
        encoder = piece_spans(tokenizer)
        for doc_id, *parts in zip(ids, *columns):
            sections, at = [], 0
            parts = [p or "" for p in parts]
            for name, part in zip(fields, parts):
                sections += [(name, i, at + s, at + e) for i, (s, e) in enumerate(lines(part))]
                at += len(part) + 1
            spans = encoder.spans("\n".join(parts))
            where = spans[:, 0] if rule == "first" else spans[:, 1] - 1
            # empty sections share their start with the next: the last of them holds the characters
            owner = np.searchsorted([s[2] for s in sections], where, side="right") - 1
            counts = np.bincount(owner, minlength=len(sections)).tolist()
            for (name, i, s, e), n in zip(sections, counts):
                yield doc_id, name, i, s, e, n

    return map_rows(rows, run, f"doc_id {kind}, field string, section int, char_start bigint, char_end bigint, n_tokens bigint")
