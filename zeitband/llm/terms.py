"""Words of whole texts as UTF-8 bytes, a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

PIECE = 4_000_000
_UPPER = range(0x41, 0x5B)
_LOWER = range(0x61, 0x7B)
_DIGITS = range(0x30, 0x3A)
#: A-Z become a-z, other ASCII characters but a-z and 0-9 become blanks, all else stays.
LETTERS_AND_DIGITS = bytes(b + 32 if b in _UPPER else b if b >= 0x80 or b in _LOWER or b in _DIGITS else 0x20 for b in range(256))
#: A-Z become a-z, the six ASCII blanks become one kind, all else stays.
NO_BLANKS = bytes(b + 32 if b in _UPPER else 0x20 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))


def words(text: str | None, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in order, in lists of a few megabytes; none of a null text."""
    raw = (text or "").encode().translate(table)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end + 1
