"""Tokenizing by pieces: texts are cut where no token can cross, equal pieces are encoded once."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

# A space between two other characters always starts a byte-level token.
_TWO_SPACES = re.compile(r"\s\s")
NO_SPACE = " "
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def byte_level_pieces(text: str) -> list[str]:
    """Names of pieces that a byte-level tokenizer encodes as it does the whole text.

    A piece that begins with its only space is named by what follows; any other name is its
    piece behind a ``NO_SPACE`` mark.
    """
    if _TWO_SPACES.search(text):
        return [NO_SPACE + p for p in _BEFORE_SPACE.split(text)]
    pieces = text.split(" ")
    pieces[0] = NO_SPACE + pieces[0]
    return pieces


def byte_level_text(name: str) -> str:
    return name[1:] if name[:1] == NO_SPACE else " " + name


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: bytes that print stand for themselves, the others for 256 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def byte_level_word(name: str) -> str | None:
    """A space and a word of Latin letters in the byte-level alphabet; None for other pieces.

    Such a piece is one word to the model, so it needs no search for word ends.
    """
    if name.isascii():
        return "\u0120" + name if name.isalpha() else None
    if name.isalpha() and max(name) < "\u0250":
        return (" " + name).encode().decode("latin-1").translate(_BYTE_LETTERS)
    return None


def word_pieces(text: str) -> list[bytes]:
    """Words between ASCII white space, for tokenizers that drop white space."""
    return text.encode().split()


def stretches(text: str, most: int = 1 << 20) -> Iterator[str]:
    """Cuts a long text before single spaces, every ``most`` characters or at the next such place."""
    start = 0
    while len(text) - start > most:
        cut = _BEFORE_SPACE.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


class _Index(dict):
    """Numbers names in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, name) -> int:
        self[name] = n = len(self)
        self.new.append(name)
        return n


class PieceEncoder:
    """Token ids of texts by way of their distinct pieces.

    Pieces seen before are looked up, the others go to the library in batches of about
    ``batch_bytes``. Beyond ``limit`` pieces only those used again are remembered, or none if
    they are too many, so memory stays bounded.
    """

    def __init__(self, path: str, split: Callable, text: Callable, limit: int = 1_200_000, batch_bytes: int = 1 << 18, ids: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model) if split is byte_level_pieces else None
        self.split, self.text, self.limit, self.batch_bytes, self.with_ids = split, text, limit, batch_bytes, ids
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.lengths = np.zeros(1 << 14, np.int64)
        self.starts = np.zeros(1 << 14, np.int64)
        self.used = np.zeros(1 << 14, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.n = self.n_ids = 0

    def _shrink(self) -> None:
        """Forgets the pieces that were used once."""
        again = np.flatnonzero(self.used[: self.n] > 1)
        if len(again) > self.limit // 2:
            return self._clear()
        names = list(self.index)
        lengths = self.lengths[again]
        if self.with_ids:
            self.ids = self.ids[_ranges(self.starts[again], lengths)]
            self.n_ids = len(self.ids)
        self.index = _Index()
        self.index.update(zip([names[i] for i in again.tolist()], range(len(again))))
        self.lengths, self.starts, self.used = lengths, np.cumsum(lengths) - lengths, np.ones(len(again), np.int64)
        self.n = len(again)

    def _encode(self, names: list) -> None:
        run = lambda coder, texts: [e.ids for e in coder.encode_batch_fast(texts, add_special_tokens=False)]
        words = [byte_level_word(x) for x in names] if self.model else [None]
        if any(words):
            plain = iter(run(self.model, [w for w in words if w is not None]))
            other = iter(run(self.tokenizer, [self.text(x) for x, w in zip(names, words) if w is None]))
            found = [next(other) if w is None else next(plain) for w in words]
        else:
            found = run(self.tokenizer, [self.text(x) for x in names])
        n, more = self.n, len(found)
        lengths = np.fromiter(map(len, found), np.int64, more)
        if n + more > len(self.lengths):
            grow = max(len(self.lengths), more)
            self.lengths, self.starts, self.used = (np.concatenate([x, np.zeros(grow, np.int64)]) for x in (self.lengths, self.starts, self.used))
        self.lengths[n : n + more] = lengths
        if self.with_ids:
            total = int(lengths.sum())
            if self.n_ids + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
            self.starts[n : n + more] = self.n_ids + np.cumsum(lengths) - lengths
            self.ids[self.n_ids : self.n_ids + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
            self.n_ids += total
        self.n += more

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts' pieces in the memory, and each text's number of pieces."""
        if self.n > self.limit:
            self._shrink()
        pieces: list = []
        counts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = self.split(text)
            pieces += found
            counts[i] = len(found)
        rows = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        batch, size = [], 0
        for name in self.index.new:
            batch.append(name)
            size += len(name)
            if size >= self.batch_bytes:
                self._encode(batch)
                batch, size = [], 0
        if batch:
            self._encode(batch)
        self.index.new = []
        self.used[: self.n] += np.bincount(rows, minlength=self.n)
        return rows, counts

    def _sums(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(values)])[np.cumsum(counts)]
        return np.diff(ends, prepend=0)

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        parts = [list(stretches(t)) for t in texts]
        rows, counts = self._rows([s for p in parts for s in p])
        each = self._sums(self.lengths[rows], counts)
        return self._sums(each, np.fromiter(map(len, parts), np.int64, len(parts)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and each text's number of ids."""
        parts = [list(stretches(t)) for t in texts]
        rows, counts = self._rows([s for p in parts for s in p])
        lengths = self.lengths[rows]
        each = self._sums(self._sums(lengths, counts), np.fromiter(map(len, parts), np.int64, len(parts)))
        return self.ids[_ranges(self.starts[rows], lengths)], each


@functools.lru_cache(maxsize=2)
def encoder(path: str, kind: str, ids: bool = True) -> PieceEncoder:
    """One encoder for each Python worker; it outlives a task."""
    ways = {"bytes": (byte_level_pieces, byte_level_text), "words": (word_pieces, bytes.decode)}
    return PieceEncoder(path, *ways[kind], ids=ids)
