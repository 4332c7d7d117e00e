"""Terms of texts as bytes: one translation to lower case with spaces between, then a split."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are split at once.
STRETCH = 1 << 20


def table(digits: bool) -> bytes:
    """Lower-cases A-Z, leaves letters, bytes of other characters and, if asked, digits, and makes all else a space."""
    kept = {*range(97, 123), *range(128, 256), *(range(48, 58) if digits else ())}
    return bytes(x + 32 if 65 <= x <= 90 else x if x in kept else 32 for x in range(256))


def stretches(text: bytes, own: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in lists of bounded size, never cutting one."""
    plain, at = text.translate(own), 0
    while at < len(plain):
        end = at + STRETCH
        if end < len(plain):
            end = plain.find(b" ", end)
            end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end
