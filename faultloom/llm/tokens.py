"""Exact token ids by a word-level BPE whose pre-tokens never cross white space.

Texts are cut at white space and each piece's ids are remembered, since natural text repeats its words.
The memory is bounded and lives as long as the Python worker.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: Characters that str.split takes for white space although the tokenizer doesn't, or may not.
ODD_SPACE = re.compile("[\x1c-\x1f\u0085᠎]")
PLAIN_SPACE = re.compile("[ \n\t\r]+")
#: A word of Latin-1 letters (these are composed already), with punctuation after it or not. An
#: apostrophe could start a contraction, so such pieces take the tokenizer's own way.
WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,*%&$#!?|;:\"()-]*)").fullmatch
#: Words remembered by a worker (about 200 bytes each); later ones are worked out each time.
MAX_WORDS = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = _byte_letters()
        self.table = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x80, 0x250)}
        self.known: dict[str, bytes] = {}

    def _model_ids(self, letters: str) -> bytes:
        tokens = self.model.tokenize(letters.lower().translate(self.table))
        return array("I", [t.id for t in tokens]).tobytes()

    def _part(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            found = self._model_ids(part)
            if len(self.known) < MAX_WORDS:
                self.known[part] = found
        return found

    def _learn(self, word: str) -> bytes:
        m = WORD(word)
        if m and "<|" not in word:
            letters, rest = m.groups()
            if not rest:
                return self._part(letters)
            ids = self._part(letters) + self._part(rest)
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self.known) < MAX_WORDS:
            self.known[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = PLAIN_SPACE.split(text) if ODD_SPACE.search(text) else text.split()
        found = list(map(self.known.get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    found[i] = self.known.get(w) or self._learn(w)
        return b"".join(found)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
