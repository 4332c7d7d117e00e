"""Encoding with a public tokenizer through a cache of pieces.

The byte-level tokenizer starts a new piece at every single space or line end that stands between other characters,
after such a line end, and before a full stop or comma that stands between a letter or digit and white space. A text
whose white space is all of that kind is encoded piece by piece, and pieces repeat; any other text is encoded whole.
A piece of letters alone goes to the tokenizer's model at once, without the steps that would find it to be one piece."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

TOKENIZER = "byte_bpe_50k.json"
#: Pieces that a worker remembers, the first it meets; the others are encoded each time, so its memory stays bounded.
CACHED = 400_000
#: Bytes of text that are split at once: few, so that the pieces stay in the processor's cache.
ENCODE_BYTES = 256 << 10
_ODD = ["  ", " \n", "\n ", "\n\n", "\0", *(chr(x) for x in range(0x110000) if chr(x).isspace() and chr(x) not in " \n")]
_loaded: dict[str, object] = {}


def load(name: str):
    """The tokenizer of a file of the public vocabularies, or of a path."""
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        _loaded[name] = Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))
    return _loaded[name]


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others in turn
    from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class TokenCache:
    """encode(): a text's ids as little-endian uint32 bytes."""

    _pieces: dict[str, dict[str, bytes]] = {}

    def __init__(self, name: str = TOKENIZER):
        self.tokenizer = load(name)
        self.pieces = self._pieces.setdefault(name, {})
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.direct = type(self.model).__name__ == "BPE" and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None

    def _ids(self, texts: list[str]) -> list[bytes]:
        plain = [self.direct and (x[1:] if x[:1] == " " else x).isalpha() for x in texts]
        rest = iter(self.tokenizer.encode_batch_fast([x for x, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        words = self._words([x for x, p in zip(texts, plain, strict=True) if p])
        return [array("I", next(words) if p else next(rest).ids).tobytes() for x, p in zip(texts, plain, strict=True)]

    def _words(self, pieces: list[str]) -> Iterator[list[int]]:
        """The ids of pieces without line ends, whose bytes are turned into letters in one go."""
        letters, tokenize = "\n".join(pieces).encode().decode("latin-1").translate(self.letters), self.model.tokenize
        return ([t.id for t in tokenize(x)] for x in letters.split(self.letters[10]))

    def _new(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't known; a closing full stop or comma after a letter or digit is cut off first."""
        stems = {p: p[:-1] if p[-1:] in (".", ",") and p[-2:-1].isalnum() else p for p in pieces}
        todo = list({x for x in stems.values() if x not in self.pieces} | {".", ","})
        own = dict(zip(todo, self._ids(todo), strict=True))
        known = {x: self.pieces[x] for x in stems.values() if x in self.pieces} | own
        return own | {p: known[x] if p == x else known[x] + own[p[-1]] for p, x in stems.items()}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; what isn't known is encoded in one call."""
        known, split = self.pieces, []
        for x in texts:
            whole = x[-1:] in (" ", "\n") or any(odd in x for odd in _ODD)
            split.append([x] if whole else x.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0"))
        found = [list(map(known.get, parts)) for parts in split]
        new = self._new({p for parts, ids in zip(split, found, strict=True) if None in ids for p, own in zip(parts, ids, strict=True) if own is None})
        if len(known) + len(new) <= CACHED:
            known.update(new)
        return [b"".join([new[p] if own is None else own for p, own in zip(parts, ids, strict=True)] if None in ids else ids) for parts, ids in zip(split, found, strict=True)]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text.decode("utf-8")])[0]
