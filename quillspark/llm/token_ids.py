"""Token ids by a public vocabulary, packed as little-endian unsigned 32-bit numbers.

White space always ends a token of the vocabularies that this is used with, so the ids of a text are
those of its words one after the other; a bounded table keeps the ids of words seen lately. Texts that
may hold a special token's string go to the tokenizer whole.

Where a vocabulary marks the ends of words and has lower case only, upper case of ASCII is lowered first, a
run of punctuation after a last letter is a piece of its own, and a word of Latin letters alone is one piece, which
goes to the vocabulary's model without the tokenizer's passes over the text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Words whose ids are kept in a worker: those of the current generation and of the one before it.
KEPT_WORDS = 300_000
_encoders: dict[str, PackedEncoder] = {}
#: A word that ends in a letter of ASCII or Latin-1 and then punctuation of ASCII.
_STOPPED = re.compile(rb"(.*(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-/:-@\[-`{-~]+)", re.DOTALL).fullmatch
#: Words that are one piece to the tokenizer: letters of ASCII and Latin-1 alone.
_SIMPLE = re.compile("[a-zÀ-ÖØ-öø-ÿ]+").fullmatch


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PackedEncoder(dict):
    """Packed ids by word; a word that is missing is worked out and kept for two generations at most."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.generation, self.before = max(1, kept_words // 2), {}
        spec = json.loads(self.tokenizer.to_str())
        lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self.marked = bool(spec["model"].get("end_of_word_suffix")) and lowers
        self.letters = byte_letters()
        self.model = self.tokenizer.model

    def _worked_out(self, word: bytes) -> bytes:
        if self.marked:
            if word.isalpha():
                return array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
            if stopped := _STOPPED(word):
                return self[stopped[1]] + self[stopped[2]]
            text = word.decode()
            if _SIMPLE(text):
                text = text.lower().encode().decode("latin-1").translate(self.letters)
                return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self._worked_out(word)
        if len(self) >= self.generation:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def packed(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The packed ids of each text."""
        for text in texts:
            if b"<|" in text:
                yield np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join(map(self.__getitem__, (text.lower() if self.marked else text).split()))

    def forget(self) -> None:
        """Give the memory of the table back; the next task begins with an empty one."""
        self.before = {}
        self.clear()


def encoder(path: str) -> PackedEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PackedEncoder(path)
    return _encoders[path]
