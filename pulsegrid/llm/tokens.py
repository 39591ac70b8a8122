"""Token ids by the tokenizers library, word by word.

Both public vocabularies cut a text at white space before any merge, so the ids
of a text are the ids of its words in turn.  Each worker keeps the ids of words
it has met (bounded) and asks the library only for new ones: in corpora, where
words recur, that is several times cheaper than encoding whole texts, with the
same ids (tested on whole texts).
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Callable

#: Bytes of a generation of words; a worker keeps two, so that frequent words are never lost.
CACHE_BYTES = 44 << 20
#: Bytes of an entry besides the word's characters and its ids.
_ENTRY = 120
#: A longer word is not kept.
_LONGEST = 256

#: Bytes as the byte-level pre-tokenizer writes them: printable ones as they are,
#: the rest in order from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))
}
#: Letters as the byte-level pre-tokenizer writes their UTF-8 bytes.
_MAPPED = {chr(i): "".join(_BYTE_CHARS[b] for b in chr(i).encode()) for i in range(256)}

#: A word of Latin letters with closing marks (no apostrophe: it starts contractions).
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary; ``name`` may also be a path of one's own."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def library(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(name))
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


_LAYOUTS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _packed(ids: list[int]) -> bytes:
    return _LAYOUTS[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers; fills itself.

    ``before`` is what the vocabulary writes for a space before the word.  A plain
    word is one piece of letters and one of marks, which need the merges alone.
    ``room`` is what a generation may hold, in bytes about, however long the words are.
    """

    def __init__(self, tokenizer, before: str, lower: bool, room: int):
        super().__init__()
        self.room, self.held = room, 0
        self.before, self.lower, self.merge = before, lower, tokenizer.model.tokenize
        self.whole = lambda text: _packed(tokenizer.encode(text, add_special_tokens=False).ids)
        self.marks: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if (ids := self.earlier.get(word)) is None:
            if word.isalpha() and word.isascii():
                ids, kept = _packed([t.id for t in self.merge(self.before + (word.lower() if self.lower else word))]), True
            else:
                ids, kept = self._found(word)
            if not kept or len(word) > _LONGEST:
                return ids
        if self.held >= self.room:
            self.earlier, self.held = dict(self), 0
            self.clear()
        self.held += len(word) + len(ids) + _ENTRY
        self[word] = ids
        return ids

    def _found(self, word: str) -> tuple[bytes, bool]:
        """Ids of a word that isn't all ASCII letters, and whether to keep them: those
        with marks only if their letters were met before, since most come once."""
        if not (plain := _PLAIN.fullmatch(word)):
            return self.whole(" " + word if self.before else word), True
        letters, marks = plain.groups()
        if marks:
            if (end := self.marks.get(marks)) is None:
                end = self.whole(marks)
                if len(self.marks) < 10_000:
                    self.marks[marks] = end
            met = letters in self or letters in self.earlier
            return self[letters] + end, met
        letters = letters.lower() if self.lower else letters
        return _packed([t.id for t in self.merge(self.before + "".join(map(_MAPPED.__getitem__, letters)))]), True


#: A space between two characters that aren't white: no id crosses it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=4)
def encoder(name: str) -> Callable[[str], bytes]:
    """Text -> ids as little-endian unsigned 32-bit integers, by this worker's words."""
    tokenizer = library(name)
    if "word_bpe" in os.path.basename(name):
        words = WordIds(tokenizer, "", True, CACHE_BYTES)
        return lambda text: b"".join(map(words.__getitem__, text.replace("\n", " ").split(" ")))

    # Words that begin a line are few.
    first, spaced = WordIds(tokenizer, "", False, CACHE_BYTES // 8), WordIds(tokenizer, "Ġ", False, CACHE_BYTES)
    whole, line_end = first.whole, first.whole("\n")

    def encode(text: str) -> bytes:
        words, lines = text.split(), text.split("\n")
        if len(words) != text.count(" ") + len(lines) or len(" ".join(words)) != len(text):
            # White space other than single spaces and newlines inside the text.
            head, *rest = _CUT.split(text)
            return whole(head) + b"".join(map(spaced.__getitem__, rest))
        found, at = [], 0
        for line in lines:
            end = at + line.count(" ") + 1
            found.append(first[words[at]] + b"".join(map(spaced.__getitem__, words[at + 1 : end])))
            at = end
        return line_end.join(found)

    return encode
