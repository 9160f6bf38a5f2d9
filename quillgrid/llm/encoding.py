"""Ids of whole texts by the tokenizers library, computed once per distinct piece of text a worker meets.

A text is cut at places where the tokenizer's own pattern cuts it too, whatever stands around them; the ids of the
pieces in sequence are then the ids of the text. Pieces of a plain word with marks behind it go straight to the
library's merges, any other piece through all of its steps, added tokens included. A worker remembers the ids of short
pieces as bytes, at most ``REMEMBERED`` of at most ``SHORT`` characters (some 250 MB); then it starts anew.

Ids are little-endian unsigned 32-bit integers. Long texts are worked through in windows of some ``WINDOW`` characters
that begin at a cut. By default the strings of added tokens inside texts are the ids of those tokens, as the library
has it; ``plain=True`` reads them as ordinary text.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
from collections.abc import Iterator

import numpy as np

REMEMBERED = 3 << 18
SHORT = 64
WINDOW = 1 << 20
#: Letters beyond ASCII that composing leaves alone.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks that may follow a word in a piece; not the apostrophe, which may begin a clitic.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def worker_memory() -> dict:
    """What this process keeps from task to task. Functions and classes that travel by value are new in every task."""
    return sys.modules.setdefault("_quillgrid_worker", types.ModuleType("_quillgrid_worker")).__dict__.setdefault("kept", {})


class _Pieces(dict):
    """Ids of pieces, made when first asked for. ``words`` has the ids of words and of runs of marks by themselves."""

    def __init__(self, encoder: _Encoder, keep: int, space: str = ""):
        self.encoder, self.keep, self.space = encoder, keep, space
        self.words: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.keep:
            self.clear()
            self.words.clear()
        encoder, words = self.encoder, self.words
        word = piece.rstrip(_MARKS)
        if word.isalpha() and (word.isascii() or _LATIN.fullmatch(word)) and not encoder.added.search(piece):
            spelt = self.space + encoder.cased(word)
            ids = words.get(spelt)
            if ids is None:
                ids = words[spelt] = encoder.merged(spelt)
            if word != piece:
                marks = piece[len(word) :]
                if marks not in words:
                    words[marks] = encoder.merged(marks)
                ids += words[marks]
        else:
            ids = encoder.whole(piece, self.space)
        if len(piece) <= SHORT:
            self[piece] = ids
        return ids


#: The format of a list of so many ids.
_PACK = [f"<{n}I" for n in range(SHORT)]


class _Encoder:
    @classmethod
    def kept(cls, path: str, vocabulary, plain: bool = False) -> _Encoder:
        """This worker's encoder for a broadcast vocabulary; it serves the worker's next tasks too."""
        made = worker_memory()
        if (cls.__name__, path, plain) not in made:
            made[cls.__name__, path, plain] = cls(vocabulary.value, plain)
        return made[cls.__name__, path, plain]

    def __init__(self, vocabulary: str, plain: bool):
        # A worker is one of many on its machine; threads of its own would only add memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = plain
        self.size = self.tokenizer.get_vocab_size()
        spelt = self.tokenizer.pre_tokenizer.pre_tokenize_str
        #: How the pre-tokenizer spells a character of a word or mark.
        self.spelling = {c: "".join(x for x, _ in spelt(chr(c))) for c in [*range(32, 127), *range(0xC0, 0x100)]}
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Added tokens are looked for before anything else.
        self.added = re.compile("|".join(added) or "(?!)")
        self.tokenize = self.tokenizer.model.tokenize

    def cased(self, word: str) -> str:
        return word

    def merged(self, word: str) -> bytes:
        """Through the library's merges only."""
        ids = [t.id for t in self.tokenize(word.translate(self.spelling))]
        return struct.pack(_PACK[len(ids)] if len(ids) < SHORT else f"<{len(ids)}I", *ids)

    def whole(self, piece: str, space: str = "") -> bytes:
        """Through all steps of the library."""
        if not piece:
            return b""
        return np.array(self.tokenizer.encode_batch_fast([space + piece], add_special_tokens=False)[0].ids, "<u4").tobytes()


class WordEncoder(_Encoder):
    """For vocabularies of lower-cased words with word ends that drop white space."""

    def __init__(self, vocabulary: str, plain: bool = False, remembered: int = REMEMBERED):
        super().__init__(vocabulary, plain)
        self.pieces = _Pieces(self, remembered)

    def cased(self, word: str) -> str:
        return word.lower()

    def __call__(self, text: str) -> bytes:
        get = self.pieces.__getitem__
        return b"".join(b"".join(map(get, part.replace("\n", " ").split(" "))) for part in windows(text, _BLANK))


class _Odd(Exception):
    """White space stands where the quick way expects none."""


class ByteLevelEncoder(_Encoder):
    """For byte-level vocabularies whose words may begin with one space.

    A space before anything but white space begins a word, whatever stands before it. A line break before anything but
    white space is a word of its own.
    """

    def __init__(self, vocabulary: str, plain: bool = False, remembered: int = REMEMBERED):
        super().__init__(vocabulary, plain)
        self.line_break = super().whole("\n")
        self.first, self.later = _Pieces(self, remembered // 8), _Pieces(self, remembered, " ")

    def whole(self, piece: str, space: str = "") -> bytes:
        if not piece or piece[0].isspace():
            raise _Odd
        return super().whole(piece, space)

    def _lines(self, text: str, spaced: bool) -> Iterator[bytes]:
        later = self.later.__getitem__
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            yield b"".join([later(head) if spaced else self.first[head], *map(later, rest)])
            spaced = False

    def _words(self, text: str, spaced: bool) -> Iterator[bytes]:
        head, *rest = _SPACE.split(text)
        yield self.later[head] if spaced else super().whole(head)
        yield from map(self.later.__getitem__, rest)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        out = []
        for part in windows(text, _SPACE):
            spaced = bool(out)
            try:
                out.append(self.line_break.join(self._lines(part, spaced)))
            except _Odd:
                out.append(b"".join(self._words(part, spaced)))
        return b"".join(out)


_BLANK, _SPACE = re.compile("[ \n]"), re.compile(r" (?=\S)")


def windows(text: str, cut: re.Pattern) -> Iterator[str]:
    """The text between some of its cuts, each one character that no part holds."""
    at = 0
    while len(text) - at > WINDOW and (found := cut.search(text, at + WINDOW)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text
