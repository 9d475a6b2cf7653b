"""Encoding of many texts with the tokenizers library, each distinct word only once.

A byte-pair vocabulary merges inside the pieces that its splitting pattern finds, never across them.  So a text is
split by that pattern first, each distinct word's pieces go to the library's model once for as long as the memo keeps
it, and the ids are joined.  Texts with characters for which Python's classes could differ from the library's (controls,
rare blanks, letters above Latin Extended-A), or with the content of an added token, are given to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np

from tandem.llm._common import release

_UNUSUAL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0İŉƀ-\U0010ffff]")
_USUAL = [chr(c) for c in range(33, 0x180)]
_L = "".join(c for c in _USUAL if unicodedata.category(c)[0] == "L")
_N = "".join(c for c in _USUAL if unicodedata.category(c)[0] == "N")
#: The published splitting patterns of the two kinds of vocabulary, for the characters above.
BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: Byte-level models name printable bytes by themselves and the others by the characters from U+0100.
_plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
_other = [b for b in range(256) if b not in _plain]
_NAMES = {b: chr(256 + i) for i, b in enumerate(_other)}
#: Entries of a memo's generation, the longest key that it keeps, and the entries that are left when a task ends.
MEMO, LONGEST, KEPT = 400_000, 60, 50_000


class _Memo(dict):
    """A function's results in two generations: what the younger one has not used when it is full is forgotten.

    What came first, mostly frequent words, is kept from task to task; the rest would fill a worker that goes on to
    other work.
    """

    def __init__(self, function):
        self.function = function
        self.older: dict = {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.function(key)
        if len(key) <= LONGEST:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out


    def trim(self) -> None:
        first = dict(islice(self.items(), KEPT))
        self.older = {}
        self.clear()
        self.update(first)


class Encoder:
    """Texts to little-endian uint32 ids. byte_level: blanks are kept in the pieces; else lower case, blanks dropped.

    An added token's content, like an end-of-text mark, gets that token's id wherever a text holds it, as the library
    does; with special_as_text it is ordinary text.
    """

    def __init__(self, path: str, byte_level: bool, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        added = [] if special_as_text else self.tok.get_added_tokens_decoder().values()
        self.added, self.as_lower = [t.content for t in added if not t.normalized], [t.content.lower() for t in added if t.normalized]
        self.byte_level = byte_level
        self.pattern = BYTE_LEVEL if byte_level else WORD_LEVEL
        self.words, self.marks = _Memo(self._word), _Memo(self._piece)
        self.model = self.tok.model.tokenize

    def trim(self) -> None:
        """To be called when a task ends."""
        self.words.trim()
        self.marks.trim()
        release()

    @property
    def vocabulary(self) -> int:
        return self.tok.get_vocab_size(with_added_tokens=True)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha() and piece[0] == " ":
            named = _NAMES[32] + piece[1:]
        else:
            named = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(_NAMES)
        return array("I", [t.id for t in self.model(named)]).tobytes()

    def _pieces(self, text: str) -> bytes:
        return b"".join([self._known(x) for x in self.pattern.findall(text)])

    def _known(self, piece: str) -> bytes:
        """A piece's ids by way of the memos: a word of letters stands in one of them with and without its blank."""
        word = piece[1:] if self.byte_level and piece[0] == " " else "" if self.byte_level else piece
        return self.words[word] if word.isalpha() else self.marks[piece]

    def _word(self, word: str) -> bytes:
        """Ids of a word (after a blank where these count); those of letters, and a mark after them, come from the memo."""
        low = word if self.byte_level else word.lower()
        if low != word:
            return self.words[low]
        blank = " " if self.byte_level else ""
        if word.isalpha():
            return self._piece(blank + word)
        if word[:-1].isalpha() and not word[-1].isalnum():
            return self.words[word[:-1]] + self.marks[word[-1]]
        return self._pieces(blank + word)

    def _is_whole(self, text: str) -> bool:
        """Whether the text has to go to the library as it is."""
        if _UNUSUAL.search(text) or self.byte_level and "  " in text:
            return True
        return any([x in text for x in self.added]) or bool(self.as_lower) and any([x in text.lower() for x in self.as_lower])

    def encode(self, texts: list[str]) -> list[bytes]:
        out, whole, words = [], [], self.words
        for i, t in enumerate(texts):
            if self._is_whole(t):
                whole.append(i)
                out.append(b"")
            elif self.byte_level:  # a single blank always begins a piece
                first, *rest = t.split(" ")
                out.append(b"".join([self._pieces(first), *[words[x] for x in rest]]))
            else:
                out.append(b"".join([words[x] for x in t.split()]))
        for i, x in zip(whole, self.whole([texts[i] for i in whole]) if whole else (), strict=True):
            out[i] = x
        return out


@lru_cache(4)
def encoder(path: str, byte_level: bool, special_as_text: bool = False) -> Encoder:
    """One per worker process."""
    return Encoder(path, byte_level, special_as_text)
