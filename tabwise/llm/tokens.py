"""Token ids of whole texts by a public tokenizer, encoding each distinct word once.

The tokenizers library splits a text by a fixed pattern and encodes piece by piece, so
equal pieces have equal ids wherever they stand.  A task therefore splits texts itself,
keeps the ids of the pieces it has met, and asks the library's model only for new ones.
Texts with characters for which two pattern engines might differ are given to the
library whole; the ids are the same either way.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

# The vocabularies' split patterns, for ASCII and Latin letters, which all
# pattern engines class alike.  The dotted capital I, which lower-cases to two
# characters, is left out.
_PLAIN = "\t\n\r -~\u00a1-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e"
_L = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_N = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_ODD = re.compile(f"[^{_PLAIN}]")
PIECES = {
    "byte_bpe_50k.json": rf" ?[{_L}]+|{_SHORT}| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+",
    "word_bpe_49k.json": rf"[{_L}]+|{_SHORT}|[{_N}]|[^\s{_L}{_N}]+",
}
LOWERED = {"word_bpe_49k.json"}
#: Known pieces a task keeps before it starts anew.
MAX_PIECES = 1_000_000


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Ids by piece, asked for when first met."""

    LETTERS = _byte_letters()

    def __init__(self, model) -> None:
        super().__init__()
        self.tokenize = model.tokenize

    def __missing__(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.LETTERS)
        ids = np.array([t.id for t in self.tokenize(letters)], "<u4").tobytes()
        self[piece] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        name = os.path.basename(path)
        self.lower = name in LOWERED
        self.pieces = re.compile(PIECES[name]).findall if name in PIECES else None
        self.known = _Known(self.tokenizer.model)

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        """By the library alone."""
        return [
            np.asarray(e.ids, "<u4").tobytes()
            for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)
        ]

    def one(self, text: str) -> bytes:
        if self.pieces is None or _ODD.search(text):
            return self.whole([text])[0]
        if len(self.known) > MAX_PIECES:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.pieces(text.lower() if self.lower else text)))

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        return [self.one(t) if t else b"" for t in texts]
