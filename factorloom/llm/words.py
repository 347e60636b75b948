"""Token ids by white-space chunk: each distinct chunk meets the tokenizer's model once per worker."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from factorloom.llm.common import one_per_worker

#: Chunks a worker remembers before they become the older ones, which stay until there are as many new ones (about 40 MB in all).
REMEMBERED = 75_000
#: Texts of these characters alone may be cut at white space; any other text goes through the tokenizer as a whole.
PLAIN = re.compile("[\\t\\n\\r -~¡-©«-±´¶-¸»¿-įı-ſ–—‘-”…€]*")
#: Pieces of a lower-case chunk, as the word tokenizer splits them (fixed values).
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free letter from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """chunk -> its ids as little-endian uint32 bytes, for the lower-casing word tokenizer."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if (out := self.older.get(chunk)) is not None:
            self[chunk] = out
            return out
        pieces = PIECES.findall(chunk)
        if pieces == [chunk]:
            shown = chunk if chunk.isascii() else "".join(map(self.letters.__getitem__, chunk.encode()))
            out = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        else:  # a word is met with many signs around it
            out = b"".join(map(self.__getitem__, pieces))
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as bytes; equal to the tokenizer's own encoding without special tokens."""
        if "<|" in text or not PLAIN.fullmatch(text) or not unicodedata.is_normalized("NFC", text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


def word_ids(path: str) -> WordIds:
    """One per worker process and tokenizer file."""
    return one_per_worker(f"words {path}", lambda: WordIds(path))
