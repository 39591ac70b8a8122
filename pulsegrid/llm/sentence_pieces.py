"""SentencePiece encoding and decoding in numpy batches (operator 10).

A text is cut into words, each with the space mark before it; no piece of the
model reaches from one word into the next (checked when the model is read).  New
words of a batch are grouped by length, and words of one length advance together:
every substring a step asks for is hashed from the words' prefix hashes and looked
up in the sorted hashes of the pieces.

* ``viterbi``: the segmentation with the best sum of piece scores; the maxima over
  the pieces that end at a place are taken for all words at once, and the chosen
  length is the backpointer.  This is what the library does for unigram models.
* ``merges``: for BPE models the library does not maximise a sum but merges the
  neighbours with the best piece, leftmost first; here, too, all words of a length
  take their next merge at once.

``encode`` uses the one that gives the library's ids for the model at hand.
"""

from __future__ import annotations

import functools
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Top bits of a hash that lead to its place among the sorted keys.
_TOP = 17
#: Words times length that advance at once, length beyond which a word is merged
#: by a heap, and words that a worker keeps.
_CELLS, _LONG, _KEPT = 100_000, 512, 450_000
#: Characters of texts whose new words are encoded together.
_TOGETHER = 2_000_000
#: Below the worst score of a piece: a character that is no piece.
_UNKNOWN = 10.0

_ENCODED = pa.schema(
    [("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("n_viterbi", pa.int64()), ("viterbi_crc32", pa.int64()), ("round_trip", pa.bool_()), ("ids", pa.binary()), ("viterbi_ids", pa.binary())]
)



def model_path(name: str) -> str:
    """Place of a public model; ``name`` may also be a path of one's own."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


class Pieces:
    """Pieces by id, their scores, and their hashes in order."""

    def __init__(self, pieces: list[str], scores: list[float], ordinary: list[bool], byte_of: dict[int, int], bpe: bool, unknown: int):
        self.pieces, self.bpe, self.unknown = pieces, bpe, unknown
        self.bytes = {b: i for i, b in byte_of.items()}
        self.scores = np.array(scores, np.float64)
        own = [i for i, ok in enumerate(ordinary) if ok]
        self.ids = {pieces[i]: i for i in own}
        self.longest = max((len(pieces[i]) for i in own), default=1)
        self.apart = not any(MARK in pieces[i].lstrip(MARK) for i in own)
        self.lines = not any("\n" in pieces[i] for i in own)  # then no piece reaches over a newline
        keys = np.array([self._hash(pieces[i]) for i in own], np.uint64) * _MIX
        order = np.argsort(keys)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        # One key beyond the last ends every run.
        self.keys, self.key_ids = np.append(keys[order], ~np.uint64(0)), np.append(np.array(own, np.int32)[order], np.int32(-1))
        tops, starts, held = np.unique(self.keys[:-1] >> np.uint64(64 - _TOP), return_index=True, return_counts=True)
        self.first = np.full(1 << _TOP, -1, np.int64)
        self.first[tops], self.deepest = starts, int(held.max(initial=0))
        self.raw = [bytes([byte_of[i]]) if i in byte_of else (p.replace(MARK, " ").encode() if ordinary[i] else b"") for i, p in enumerate(pieces)]
        if not bytes_covered(self.bytes):
            self.raw[unknown] = " ⁇ ".encode()  # as the library writes it
        sizes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.raw_sizes, self.raw_starts = sizes, np.cumsum(sizes) - sizes
        self.raw_data = np.frombuffer(b"".join(self.raw), np.uint8)
        self.worst = (self.scores[own].min() if own else 0.0) - _UNKNOWN
        self.score_of = np.append(self.scores, -np.inf)  # of -1, which is no piece
        self.rank_of = np.unique(-self.scores, return_inverse=True)[1].astype(np.int64)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * _BASE + np.uint64(ord(c) + 1)
        return h

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; -1 where there is none.  The keys are
        sorted; the top bits of a hash say where its run of keys begins."""
        asked = (hashes * _MIX).ravel()
        at = self.first[asked >> np.uint64(64 - _TOP)]
        ids = np.full(len(asked), -1, np.int32)
        some = np.flatnonzero(at >= 0)
        asked, at = asked[some], at[some]
        for _ in range(self.deepest):
            met = self.keys[at] == asked
            ids[some[met]] = self.key_ids[at[met]]
            more = self.keys[at] < asked
            some, asked, at = some[more], asked[more], at[more] + 1
        return ids.reshape(hashes.shape)

    # -- equal-length words ------------------------------------------------

    def _substrings(self, words: list[str]) -> np.ndarray:
        """(end - 1, length - 1, word): the piece that is that substring, or -1."""
        points = np.ascontiguousarray(_points(words).T).astype(np.uint64)
        n, count = points.shape
        hashes = np.zeros((n + 1, count), np.uint64)
        for i in range(n):
            hashes[i + 1] = hashes[i] * _BASE + points[i] + np.uint64(1)
        ids = np.full((n, min(n, self.longest), count), -1, np.int32)
        power = np.uint64(1)
        for size in range(1, ids.shape[1] + 1):
            with np.errstate(over="ignore"):
                power = power * _BASE
            ids[size - 1 :, size - 1] = self.look_up(hashes[size:] - hashes[:-size] * power)
        return ids

    def viterbi(self, words: list[str], ids: np.ndarray | None = None) -> list[bytes]:
        """Best-scoring pieces of words of one length (ties: the longer last piece)."""
        ids = self._substrings(words) if ids is None else ids
        n, longest, count = ids.shape
        best, size = np.zeros((n + 1, count)), np.zeros((n + 1, count), np.int64)
        columns = np.arange(count)
        for end in range(1, n + 1):
            k = min(end, longest)
            score = self.score_of[ids[end - 1, :k][::-1]]
            np.maximum(score[-1], self.worst, out=score[-1])  # no worse than an unknown character
            total = best[end - k : end] + score
            chosen = np.argmax(total, axis=0)  # the first of equals: the longest
            best[end], size[end] = total[chosen, columns], k - chosen
        found, begins = np.full((n, count), -1, np.int32), np.zeros((n, count), bool)
        at = np.full(count, n)
        while len(columns):  # all words walk their backpointers together
            step = size[at, columns]
            begins[at - step, columns] = True
            found[at - step, columns] = ids[at - 1, step - 1, columns]
            at = at - step
            columns, at = columns[at > 0], at[at > 0]
        return self._gathered(words, begins, found)

    def merges(self, words: list[str], ids: np.ndarray | None = None) -> list[bytes]:
        """Pieces of words of one length by best merge first, leftmost of equals.
        Each step gives every word its next merge; pairs carry one key, rank and place."""
        ids = self._substrings(words) if ids is None else ids
        n, longest, count = ids.shape
        never, wide = np.iinfo(np.int64).max, n + 1

        def key(start, end, column):
            ok = (end <= n) & (end - start <= longest)
            piece = np.where(ok, ids[np.minimum(end, n) - 1, np.minimum(end - start, longest) - 1, column], -1)
            return np.where(piece >= 0, self.rank_of[piece] * wide + start, never)

        after = np.tile(np.arange(1, n + 2)[:, None], (1, count))  # symbol: start to after[start]
        after[n] = n + 1
        before = after - 2
        begins = np.ones((n, count), bool)
        columns = np.arange(count)
        keys = np.stack([key(np.full(count, j), np.full(count, j + 2), columns) for j in range(n)])
        while len(columns):
            least = keys.min(axis=0)
            held = np.flatnonzero(least < never)
            if not len(held):
                break
            if 2 * len(held) < len(columns):
                keys, columns, least = np.ascontiguousarray(keys[:, held]), columns[held], least[held]
                held = np.arange(len(columns))
            a, column = least[held] % wide, columns[held]
            b = after[a, column]
            e = after[b, column]
            after[a, column], before[e, column], begins[b, column] = e, a, False
            keys[b, held] = never
            keys[a, held] = key(a, after[e, column], column)
            left = np.flatnonzero(before[a, column] >= 0)
            p = before[a[left], column[left]]
            keys[p, held[left]] = key(p, e[left], column[left])
        ends = np.minimum(after[:n], n)
        sizes = ends - np.arange(n)[:, None]
        found = ids[ends - 1, np.minimum(sizes, longest) - 1, np.arange(count)]
        return self._gathered(words, begins, np.where(sizes <= longest, found, -1))

    def _gathered(self, words: list[str], begins: np.ndarray, found: np.ndarray) -> list[bytes]:
        """Ids of each word (packed 32-bit) from where its pieces begin."""
        chosen = begins.T
        flat = found.T[chosen]
        ends = np.cumsum(chosen.sum(1))
        starts = ends - chosen.sum(1)
        data = flat.astype("<u4").tobytes()
        out = [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), "right")).tolist():
            at = np.flatnonzero(chosen[i]).tolist()
            out[i] = self._with_bytes(words[i], list(zip(flat[starts[i] : ends[i]].tolist(), at)))
        return out

    def merge_long(self, word: str) -> bytes:
        """As ``merges`` for one long word, in n log n."""
        n = len(word)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        live, heap = [True] * n, []

        def offer(a):
            b = after[a]
            if b < n and end[b] - a <= self.longest and (i := self.ids.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, end[a], end[b]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, middle, e = heapq.heappop(heap)
            if not live[a] or end[a] != middle or after[a] >= n or end[after[a]] != e:
                continue
            b = after[a]
            live[b], end[a], after[a] = False, e, after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return self._spelled(word, [a for a in range(n) if live[a]] + [n])

    def _spelled(self, word: str, edges: list[int]) -> bytes:
        return self._with_bytes(word, [(self.ids.get(word[a:b], -1), a) for a, b in zip(edges, edges[1:])])

    def _with_bytes(self, word: str, found: list[tuple[int, int]]) -> bytes:
        """Ids, with the bytes of a character that is no piece (or the unknown id)."""
        out: list[int] = []
        for piece, start in found:
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in word[start].encode()]
            else:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def segment(self, words: list[str], methods: tuple[str, ...]) -> dict[str, tuple[bytes, ...]]:
        """Word -> ids (packed 32-bit) by each method, words of one length together.
        The pieces that their substrings are serve all methods."""
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        out = {}
        for n, group in by_length.items():
            step = max(1, _CELLS // n)
            for i in range(0, len(group), step):
                some = group[i : i + step]
                ids = self._substrings(some)
                said = {m: self.viterbi(some, ids) if m == "viterbi" else self.merges(some, ids) if n <= _LONG else [self.merge_long(w) for w in some] for m in set(methods)}
                out.update(zip(some, zip(*(said[m] for m in methods))))
        return out

    def restored(self, words: list[str], ids: list[bytes]) -> np.ndarray:
        """Which words their ids decode to, byte for byte (the space mark: a space)."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = self.raw_sizes[flat]
        got = np.add.reduceat(np.append(sizes, 0), np.cumsum([0, *map(len, ids)])[:-1] // 4) if words else np.zeros(0, np.int64)
        want = [w.replace(MARK, " ").encode() for w in words]
        lengths = np.fromiter(map(len, want), np.int64, len(want))
        if (got == lengths).all() and self._raw(flat) == b"".join(want):
            return np.ones(len(words), bool)
        return np.array([self._raw(np.frombuffer(x, "<u4")) == w for x, w in zip(ids, want)], bool)

    def _raw(self, ids: np.ndarray) -> bytes:
        """Pieces' and bytes' raw bytes, gathered at once."""
        sizes, starts = self.raw_sizes[ids], self.raw_starts[ids]
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.raw_data[np.repeat(starts, sizes) + within].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids."""
        text = self._raw(ids).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def bytes_covered(by_byte: dict[int, int]) -> bool:
    return len(by_byte) == 256


@functools.lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path(model))
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    kinds = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
    scores = [sp.get_score(i) for i in range(n)]
    # A BPE model's scores are the ranks of its merges: whole numbers, 0 and below.
    ordinary = [s for s, k in zip(scores, kinds) if not k]
    bpe = all(s == int(s) for s in ordinary)
    return Pieces(names, scores, [not k for k in kinds], {i: int(names[i][3:5], 16) for i in range(n) if sp.is_byte(i)}, bpe, sp.unk_id())


def _line_words(line: str) -> list[str]:
    """Words of a line whose spaces are marks; a run of marks starts one word."""
    head, *rest = line.split(MARK)
    out = [head] if head else []
    if MARK + MARK not in line and line[-1:] != MARK:
        return out + [MARK + w for w in rest]
    held = ""
    for part in rest:
        held += MARK
        if part:
            out.append(held + part)
            held = ""
    return [*out, held] if held else out


def words_of(text: str, apart: bool = True, lines: bool = False) -> list[str]:
    """Words with the space mark before them, or whole texts where pieces may reach
    over a space; with ``lines``, newlines are words of their own."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    if not apart:
        return [marked]
    if not lines or "\n" not in marked:
        return _line_words(marked)
    first, *rest = marked.split("\n")
    out = _line_words(first)
    for line in rest:
        out.append("\n")
        out += _line_words(line)
    return out


class Encoder:
    """Texts -> ids by one or more methods; keeps the words that it has met lately, in
    two generations of a bounded size, so that frequent words are never lost.  A word
    is decoded once, when it is met: a text is its words, and no byte of a character
    crosses a word's end, so a text decodes to itself where all its words do."""

    def __init__(self, model: str, methods: tuple[str | None, ...] = (None,)):
        self.pieces = pieces(model)
        own = "merges" if self.pieces.bpe else "viterbi"  # what the library does
        self.methods = tuple(m or own for m in methods)
        self.empty = (*[b""] * len(self.methods), True)
        self.known: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}

    def _words(self, text: str) -> list[str]:
        p = self.pieces
        if text[:1] in ("", " ") or not (p.apart and p.lines) or "  " in text or MARK in text:
            return words_of(text, p.apart, p.lines)
        # No runs of spaces: marks and newlines cut the text as ``words_of`` does (and leave empty words).
        return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")

    def _learn(self, words: list[list[str]]) -> None:
        if len(self.known) > _KEPT:
            self.before, self.known = self.known, {}
        self.known[""] = self.empty
        new = set().union(*words) - self.known.keys()
        again = {w: self.before[w] for w in new if w in self.before}
        self.known.update(again)
        fresh = [w for w in new if w not in again]
        ids = self.pieces.segment(fresh, self.methods)
        columns = [[ids[w][i] for w in fresh] for i in range(len(self.methods))]
        good = np.logical_and.reduce([self.pieces.restored(fresh, x) for x in columns]).tolist()
        self.known.update(zip(fresh, zip(*columns, good)))

    def batch(self, texts: list[str]) -> list[tuple]:
        """Ids of each text by each method, as little-endian unsigned 32-bit integers,
        and whether all of them decode to the text."""
        out: list[tuple] = []
        ends = np.cumsum([len(t) for t in texts]) // _TOGETHER if texts else np.zeros(0)
        edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        for low, high in zip(edges, edges[1:]):
            words = [self._words(t) for t in texts[low:high]]
            self._learn(words)
            for own in words:
                found = list(zip(*map(self.known.__getitem__, own))) or [(x,) for x in self.empty]
                out.append((*map(b"".join, found[:-1]), all(found[-1])))
        return out


@functools.lru_cache(maxsize=2)
def _encoder(model: str, methods: tuple[str | None, ...]) -> Encoder:
    return Encoder(model, methods)


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_ids and ids_crc32 (the library's ids),
    n_viterbi and viterbi_crc32 (the best-scoring segmentation), round_trip (both
    decode to the text), and both lists of ids (packed 32-bit) where ``keep_ids``.

    A null or empty text has no ids.  The space mark in a text is read as a space.
    Rows that repeat are encoded alike; an empty table gives no rows; other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, (None, "viterbi"))
        for batch in batches:
            rows = []
            for doc_id, (a, b, same) in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1).to_pylist())):
                rows.append((doc_id, len(a) // 4, zlib.crc32(a), len(b) // 4, zlib.crc32(b), same, *((a, b) if keep_ids else (None, None))))
            yield common.to_batch(_ENCODED, list(zip(*rows)) or [[]] * len(_ENCODED))

    schema = "doc_id long, n_ids long, ids_crc32 long, n_viterbi long, viterbi_crc32 long, round_trip boolean, ids binary, viterbi_ids binary"
    found = common.texts(docs).mapInArrow(run, schema)
    return found if keep_ids else found.drop("ids", "viterbi_ids")


def decode_documents(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and text from doc_id and ids (packed 32-bit; null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(model)
        for batch in batches:
            said = [known.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded again."""
    return encode_documents(common.documents(spark, sf_dir))
