"""Words between ASCII white space, taken from whole texts in bounded blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

_SPACE = re.compile(rb"[ \t-\r]")


def word_blocks(data: bytes, carry: int = 0, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words (runs of bytes other than \\x20 and \\x09-\\x0D) of about ``most`` bytes at a time.

    Every block after the first begins with the last ``carry`` words before it, so windows of
    ``carry + 1`` words are seen once each.
    """
    start, before = 0, []
    while len(data) - start > most and (cut := _SPACE.search(data, start + most)):
        words = before + data[start : cut.start()].split()
        yield words
        before = words[-carry:] if carry else []
        start = cut.start()
    yield before + (data[start:] if start else data).split()


def text_pieces(data: bytes, most: int = 4 << 20) -> Iterator[bytes]:
    """The text cut at white space into pieces of about ``most`` bytes; no word is split."""
    start = 0
    while len(data) - start > most and (cut := _SPACE.search(data, start + most)):
        yield data[start : cut.start()]
        start = cut.start()
    yield data[start:] if start else data
