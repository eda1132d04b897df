"""Whole-text encoding by a public tokenizer file, with a bounded cache of words.

The file's rules never join characters across ASCII white space, so a text's ids are those of its words. A word's
letters and the ASCII punctuation after them are pieces of their own as well, which lets most spellings share the
ids of one lower-case stem. Everything else goes to the library whole.
"""

from __future__ import annotations

import string

import numpy as np
from tokenizers import Tokenizer

from .common import release

MARKS = string.punctuation.encode()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Maps a word's UTF-8 bytes to its ids as little-endian unsigned 16-bit integers.

    It remembers up to 2 * limit words: when there are limit new ones, those before them go, but for what was used
    since."""

    def __init__(self, path: str, limit: int = 200_000):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        self.model, self.limit, self.letters, self.before = self.tokenizer.model, limit, _byte_letters(), {}

    def __missing__(self, word: bytes) -> bytes:
        low = word.lower()
        if (ids := self.before.get(word)) is not None:
            pass
        elif low != word:
            ids = self[low]
        elif (head := word.rstrip(MARKS)) and (text := head.decode("utf-8", "replace").lower()).isalpha() and max(text) < "ɐ":
            ids = self._letters(text) if head == word else self[head] + self[word[len(head) :]]
        else:
            ids = self._any(word.decode("utf-8", "replace"))
        self[word] = ids
        return ids

    def _letters(self, text: str) -> bytes:
        """Lower-case letters that are one piece; the library's rules for other text are not needed."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(text)], "<u2").tobytes()

    def _any(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def rest(self) -> None:
        """At the end of a task: an idle worker keeps half of the words at most."""
        self.before = {}
        release()

    def encode(self, text: str | None) -> bytes:
        """The whole text's ids; null is the empty text."""
        if len(self) > self.limit:
            self.before = self.copy()
            self.clear()
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
