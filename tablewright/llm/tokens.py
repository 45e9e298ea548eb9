"""Token ids of whole texts by the ``tokenizers`` library, remembered per chunk.

Byte-level and word BPE cut a text at white space before any merge, so a text's ids are
those of its chunks in a row. Chunks repeat, so each task asks the library once per
chunk it has not seen lately. A chunk of letters with trailing punctuation goes straight
to the library's merge model; anything else through its full encoder. A text that may hold the string
of a special token goes whole through the library, which gives that string its id.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

# Chunks remembered by one task before it starts afresh: bounds memory, not results.
CHUNK_MEMORY = 400_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"([{_LETTERS}]*)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]*)")
# White space other than blank and newline, as Python or the tokenizers' patterns see it.
_OTHER_SPACE = [chr(c) for c in (
    9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000, 0xFEFF)]
_ODD_BLANKS = ("  ", " \n", "\n ", "\n\n")
_BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")


def has_other_space(text: str) -> bool:
    """Whether white space other than blanks and newlines occurs."""
    return any(c in text for c in _OTHER_SPACE)


def has_odd_space(text: str) -> bool:
    """Whether anything but single blanks and newlines between other characters occurs."""
    return text[0] in " \n" or text[-1] in " \n" or any(c in text for c in _ODD_BLANKS) or has_other_space(text)


def _byte_letters() -> dict[int, str]:
    """The byte-to-character map of byte-level vocabularies: printable bytes stand for
    themselves, the others take the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class _Memory(dict):
    """Chunk -> packed ids, filled on demand."""

    def __init__(self, fill):
        self.fill = fill

    def __missing__(self, chunk):
        if len(self) >= CHUNK_MEMORY:
            self.clear()
        self[chunk] = packed = self.fill(chunk)
        return packed


class ChunkEncoder:
    """Encodes whole texts with a vocabulary file of the ``tokenizers`` library.

    ``keeps_space``: white space is part of the tokens (byte-level vocabularies); if
    false the tokenizer lower-cases and drops it. Strings of special tokens become those tokens, as
    the library has it with ``add_special_tokens=False``, which only adds none of its own.
    """

    def __init__(self, path: str, keeps_space: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.marks = [t.content.casefold() for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        self.keeps_space = keeps_space
        self.code = "H" if self.whole.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(np.uint16 if self.code == "H" else np.uint32)
        self.letters = str.maketrans({b: c for b, c in _byte_letters().items()})
        self.blank = " ".translate(self.letters)
        self.first = _Memory(lambda chunk: self._ids("", chunk, self.first))
        self.after_blank = _Memory(lambda chunk: self._ids(" " if keeps_space else "", chunk, self.after_blank))
        self.odd = _Memory(self._odd)
        self.pieces = _Memory(self._merge)

    def _merge(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)] if mapped else []).tobytes()

    def _ids(self, blank: str, chunk: str, memory: _Memory) -> bytes:
        """A word may be known without its marks, which have ids of their own."""
        if chunk.isascii() and chunk.isalpha():
            mapped = self.blank + chunk if blank else chunk if self.keeps_space else chunk.lower()
            return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()
        plain = PLAIN.fullmatch(chunk)
        if plain is None or not chunk:
            return self._odd(blank + chunk)
        word, marks = plain.groups()
        if not word:
            return self.pieces[blank + marks]
        if marks:
            return memory[word] + self.pieces[marks]
        return self._merge(blank + (word if self.keeps_space else word.lower()))

    def _odd(self, chunk: str) -> bytes:
        return array(self.code, self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text``, as the library gives them for the whole text."""
        if not text:
            return np.empty(0, self.dtype)
        if any(mark[0] in text for mark in self.marks):
            folded = text.casefold()
            if any(mark in folded for mark in self.marks):
                return np.frombuffer(self._odd(text), self.dtype)
        if not self.keeps_space:
            packed = self._odd(text) if has_other_space(text) else b"".join(
                map(self.after_blank.__getitem__, text.split()))
        elif has_odd_space(text):
            packed = b"".join(map(self.odd.__getitem__, _BEFORE_WORD.split(text)))
        else:
            parts = []
            for line in text.split("\n"):
                head, _, rest = line.partition(" ")
                parts.append(self.first[head])
                if rest:
                    parts.extend(map(self.after_blank.__getitem__, rest.split(" ")))
                parts.append(self.first["\n"])
            packed = b"".join(parts[:-1])
        return np.frombuffer(packed, self.dtype)
