"""Words of UTF-8 texts as numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Byte tables: ASCII white space to spaces; and, with A-Z in lower case, all that isn't 0-9, a-z or beyond ASCII to spaces.
SPACED = bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256))
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
CHUNK = 1 << 22


def chunks(raw: bytes, table: bytes, size: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``size`` bytes, so that a long text's words never stand in one list."""
    start = 0
    while start < len(raw):
        part = raw[start : start + size].translate(table)
        if (end := start + size) < len(raw) and raw[end : end + 1].translate(table) != b" ":
            rest = bytearray()
            while end < len(raw):  # to the end of the word that the cut falls into
                more = raw[end : end + 4096].translate(table)
                at = more.find(b" ")
                rest += more if at < 0 else more[:at]
                end += len(more) if at < 0 else at
                if at >= 0:
                    break
            part += bytes(rest)
        yield part.split()
        start = end


class Vocabulary:
    """Numbers from 1 for words, in the order of their first use."""

    def __init__(self) -> None:
        self.words, self._ids = [b""], {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        known = self._ids
        for w in set(words).difference(known):
            known[w] = len(self.words)
            self.words.append(w)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
