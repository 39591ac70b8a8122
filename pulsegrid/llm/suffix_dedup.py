"""Repeated byte strings by the common-prefix interval tree of a suffix array (operator 1).

Suffixes of every byte would be many times the text, so the array is sparse.  Of
the strings of ``k`` bytes within each window of ``length`` bytes, the one with
the least hash is the window's anchor: equal windows have equal anchors at equal
places, so a repeat of ``length`` bytes always shows as equal anchors.  Only
anchors that occur twice get their suffixes sorted:

1. every text -> its anchors (hash, hash of the windows that choose it, place);
2. anchors that occur once are dropped; windows that are equal throughout are
   collapsed to one row, known to be repeated;
3. the rest go to the owner of their anchor with the bytes around them.  There
   the suffixes from the anchor on are sorted, the stack scan over their common
   prefixes yields the interval tree, and each interval is split into classes
   whose members agree far enough to the left: maximal repeats, with all their
   occurrences.  Occurrences that can all be extended to the left alike, or that
   do not reach ``length``, are not output;
4. spans are joined back to the documents.

The same tree finds repeated passages of ``words`` words: a text is then the string
of its words' 64-bit hashes, and a unit is eight bytes instead of one.  Both kinds go
through the joins together.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 400
#: Bytes of an anchor.
K = 64
#: Words of a passage, and of its anchors.
PASSAGE, PASSAGE_K = 50, 10
#: Bytes of a word's hash.
_WORD = 8
#: Occurrences of an anchor that may meet in one task.  Larger groups are dealt out
#: by what all windows of a segment share, and those that are still larger by the
#: window itself, where no suffixes are left to compare.
GROUP = 1_000
#: Windows of a segment, for the groups beyond GROUP.
SEGMENT = 64
#: Window starts hashed at once (fits the cache).
_SEGMENT = 1 << 18
#: Bytes of texts whose words are hashed at once.
_TOGETHER = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = np.uint64
#: Which bytes belong to words.
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False

_ANCHORS = pa.schema(
    [("anchor", pa.int64()), ("ctx", pa.int64()), ("did", pa.int64()), ("tk", pa.int64()), ("pos", pa.int32()), ("lft", pa.int32()), ("rgt", pa.int32()), ("n", pa.int32()), ("cover", pa.binary()), ("words", pa.bool_())]
)
ANCHORS = "anchor long, ctx long, did long, tk long, pos int, lft int, rgt int, n int, cover binary, words boolean"
_CONTEXTS = pa.schema(
    [("anchor", pa.int64()), ("did", pa.int64()), ("tk", pa.int64()), ("pos", pa.int32()), ("lft", pa.int32()), ("solo", pa.bool_()), ("words", pa.bool_()), ("window", pa.binary())]
)
CONTEXTS = "anchor long, did long, tk long, pos int, lft int, solo boolean, words boolean, window binary"
_SPANS = pa.schema([("did", pa.int64()), ("tk", pa.int64()), ("words", pa.bool_()), ("cover", pa.binary())])
SPANS = "did long, tk long, words boolean, cover binary"
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("n_passage_words", pa.int64()), ("spans", pa.binary()), ("passages", pa.binary())]
)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    up, down = np.full(n, _BASE, _U64), np.full(n, pow(_BASE, -1, 1 << 64), _U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U64), np.cumprod(down, dtype=_U64)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of texts laid end to end, and where each text's
    words begin among them."""
    found, counts = [np.zeros(0, _U64)], np.zeros(len(offsets), np.int64)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _TOGETHER, "right")) - 1)
        low, high = int(offsets[i]), int(offsets[j])
        own = data[low:high]
        inside = _INSIDE[own]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        edges = offsets[i:j] - low
        edges = edges[edges < high - low]
        starts[edges] = inside[edges]
        places = np.flatnonzero(inside)
        first = np.flatnonzero(starts[places])
        if len(first):
            sizes = np.diff(np.append(first, len(places)))
            powers = _powers(_SEGMENT + 4096)[0] if sizes.max() <= _SEGMENT else np.cumprod(np.append(_U64(1), np.full(int(sizes.max()), _BASE, _U64)))
            within = np.arange(len(places)) - np.repeat(first, sizes)
            h = np.add.reduceat((own[places].astype(_U64) + _U64(1)) * powers[within], first)
            h ^= h >> _U64(32)
            h *= _U64(0x94D049BB133111EB)
            h ^= h >> _U64(29)
            found.append(h)
            counts[i + 1 : j + 1] = np.bincount(np.searchsorted(offsets[i : j + 1], places[first] + low, "right") - 1, minlength=j - i)
        i = j
    return np.concatenate(found), np.cumsum(counts)


def _units(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts, or of the strings of their words' hashes."""
    offsets, data = common.string_bytes(column)
    if not words:
        return offsets, data
    hashes, starts = _word_hashes(data, offsets)
    return starts * _WORD, hashes.view(np.uint8)


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each place on (equal bytes, equal hash)."""
    up, down = _powers(_SEGMENT + 4096)
    sums = np.empty(len(data) + 1, _U64)
    sums[0] = 0
    np.cumsum((data.astype(_U64) + _U64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(data) - k + 1]
    h ^= h >> _U64(29)
    h *= _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(32)
    return h


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in turn."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    if done < width:
        values = np.minimum(values[: len(values) - (width - done)], values[width - done :])
    return values


def _runs(data: np.ndarray, valid_until: np.ndarray, length: int, k: int):
    """(anchor place, first window, last window, anchor hash) for runs of windows
    with one anchor; ``valid_until``: windows that lie within one text."""
    h = _gram_hashes(data, k)
    bits = _U64(20)
    places = np.arange(len(h), dtype=_U64)
    chosen = (_window_minima((h >> bits << bits) | places, length - k + 1) & _U64((1 << 20) - 1)).astype(np.int64)
    new = np.empty(len(chosen), bool)
    new[0] = True
    np.not_equal(chosen[1:], chosen[:-1], out=new[1:])
    new[1:] |= valid_until[1:] != valid_until[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(chosen)) - 1
    ok = valid_until[first]
    first, last = first[ok], last[ok]
    return chosen[first], first, last, h[chosen[first]]


def _text_runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """As ``_runs`` for texts laid end to end, with places in ``data`` and the text's
    number; texts are taken together in segments, and long ones in several."""
    found = []
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + _SEGMENT, "right")) - 1
        if j > i:  # whole texts
            low, high = int(offsets[i]), int(offsets[j])
            if high - low >= length:
                starts = high - low - length + 1
                edge = np.zeros(starts + 1, np.int32)
                first = offsets[i:j] - low
                after = offsets[i + 1 : j + 1] - low - length + 1
                long = after > first
                np.add.at(edge, first[long], 1)
                np.add.at(edge, after[long], -1)
                pos, a, b, h = _runs(data[low:high], np.cumsum(edge[:-1]) > 0, length, k)
                text = np.searchsorted(offsets, pos + low, "right") - 1
                found.append((text, pos + low, a + low, b + low, h))
            i = j
        else:  # one text beyond a segment
            low, high = int(offsets[i]), int(offsets[i + 1])
            parts = []
            for s in range(low, high - length + 1, _SEGMENT):
                e = min(s + _SEGMENT + length - 1, high)
                pos, a, b, h = _runs(data[s:e], np.ones(e - s - length + 1, bool), length, k)
                parts.append((pos + s, a + s, b + s, h))
            pos, a, b, h = (np.concatenate(x) for x in zip(*parts))
            keep = np.append(True, pos[1:] != pos[:-1])  # a run that a segment's end cut
            last = np.append(np.flatnonzero(keep)[1:], len(pos)) - 1
            found.append((np.full(keep.sum(), i), pos[keep], a[keep], b[last], h[keep]))
            i += 1
    if not found:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, _U64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans, touching ones joined, of an (n, 2) array."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    tops = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > tops[:-1])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], tops[np.append(first[1:], len(spans)) - 1]], axis=1)


def _anchors(sizes: tuple[tuple[bool, int, int], ...]):
    """``sizes``: (words, length, k) of each kind of repeat, both in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (words, length, k) in itertools.product(batches, sizes):
            offsets, data = _units(batch.column(2), words)
            unit = _WORD if words else 1
            text, pos, first, last, h = _text_runs(data.view(_U64) if words else data, offsets // unit, length // unit, k // unit)
            pos, first, last = pos * unit, first * unit, last * unit
            if not len(pos):
                continue
            view, digest = memoryview(data), xxhash.xxh3_64_intdigest
            windows = zip(first.tolist(), (last + length).tolist(), (pos - first).tolist())
            ctx = np.fromiter((digest(view[a:b], left) for a, b, left in windows), _U64, len(pos))
            # Equal windows within a text are one row that carries all their places.
            order = np.lexsort((pos, ctx, h, text))
            text, pos, first, last, h, ctx = (x[order] for x in (text, pos, first, last, h, ctx))
            new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]))
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(pos)))
            start = offsets[text]
            covers: list[bytes | None] = [None] * len(at)
            for i in np.flatnonzero(n > 1).tolist():
                own = slice(at[i], at[i] + n[i])
                spans = np.stack([first[own] - start[own], last[own] + length - start[own]], axis=1)
                covers[i] = _merged(spans).astype("<i4").tobytes()
            ids = batch.column(0).to_numpy()[text[at]], batch.column(1).to_numpy()[text[at]]
            place = pos[at] - start[at]
            yield common.to_batch(
                _ANCHORS,
                [h[at].view(np.int64), ctx[at].view(np.int64), *ids, place.astype(np.int32), (pos - first)[at].astype(np.int32), (last + length - pos)[at].astype(np.int32), n.astype(np.int32), covers, [words] * len(at)],
            )

    return run


def _cut(length_of: dict[bool, int], segments: bool):
    """The bytes around each anchor asked for.  With ``segments`` the windows of an
    anchor are cut into runs of SEGMENT bytes, each under a hash of what they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {words: _units(batch.column(2), words) for words in length_of}
            rows: list[tuple] = []
            for i, asked in enumerate(batch.column(3).to_pylist()):
                did, tk = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for x in asked:
                    words, left = x["words"], x["lft"]
                    offsets, view = held[words][0], memoryview(held[words][1])
                    length, unit, pos = length_of[words], _WORD if words else 1, int(offsets[i]) + x["pos"]
                    if not segments:
                        rows.append((x["anchor"], did, tk, x["pos"], left, x["solo"], words, bytes(view[pos - left : pos + x["rgt"]])))
                        continue
                    least = length - x["rgt"]
                    for s in range(least // SEGMENT, left // SEGMENT + 1):
                        a, b = max(least, s * SEGMENT), min(left, (s + 1) * SEGMENT - unit)
                        shared = view[pos - s * SEGMENT : pos - (s + 1) * SEGMENT + unit + length]
                        key = xxhash.xxh3_64_intdigest(shared, 2 * s + words) - (1 << 63)
                        rows.append((key, did, tk, x["pos"], b, x["solo"], words, bytes(view[pos - b : pos - a + length])))
                if len(rows) > 8192:
                    yield common.to_batch(_CONTEXTS, list(zip(*rows)))
                    rows = []
            if rows:
                yield common.to_batch(_CONTEXTS, list(zip(*rows)))

    return run


def _each_window(length_of: dict[bool, int]):
    """A row, with a hash, for every window of the contexts of very large groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                w, words, length = x["window"], x["words"], length_of[x["words"]]
                rows = [
                    (x["anchor"], x["did"], x["tk"], x["pos"] - x["lft"] + p, x["lft"] - p, x["solo"], words, xxhash.xxh3_128_digest(w[p : p + length]))
                    for p in range(0, len(w) - length + 1, _WORD if words else 1)
                ]
                yield common.to_batch(_CONTEXTS, list(zip(*rows)))

    return run


def _prefix_lengths(rows: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    out = np.empty(len(left), np.int64)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    width = int(sizes.max(initial=0))
    for low in range(0, len(left), 4096):
        a, b = left[low : low + 4096], right[low : low + 4096]
        used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        table = np.frombuffer(b"".join(rows[i].ljust(width, b"\0") for i in used.tolist()), np.uint8).reshape(len(used), width)
        differ = table[where[: len(a)]] != table[where[len(a) :]]
        first = np.where(differ.any(1), differ.argmax(1), width) if width else np.zeros(len(a), np.int64)
        out[low : low + 4096] = np.minimum(first, np.minimum(sizes[a], sizes[b]))
    return out


def prefix_intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of the tree, from the common
    prefixes of neighbours in a suffix array (``lcp[i]``: of suffixes i-1 and i)."""
    found, stack = [], []  # (prefix, first)
    for i in range(1, len(lcp) + 1):
        now, first = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack and stack[-1][0] > now:
            prefix, first = stack.pop()
            found.append((prefix, first, i - 1))
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, first))
    return found


def maximal_repeats(anchors: np.ndarray, suffixes: list[bytes], lefts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, bytes to the left, bytes to the right) of all occurrences of the
    maximal repeats of ``length`` bytes or more that hold an anchor.

    ``suffixes`` start at the anchors; ``lefts`` are the bytes before, reversed.
    """
    n = len(suffixes)
    order = np.array(sorted(range(n), key=lambda i: (anchors[i], suffixes[i])))
    lcp = np.zeros(n, np.int64)
    lcp[1:] = _prefix_lengths(suffixes, order[:-1], order[1:])
    lcp[1:][anchors[order[1:]] != anchors[order[:-1]]] = 0
    by_left = sorted(range(n), key=lambda i: lefts[i])
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    out = []
    intervals = prefix_intervals(lcp.tolist())
    sizes = np.array([b - a + 1 for _, a, b in intervals], np.int64)
    groups = np.cumsum(sizes) // 50_000 if len(sizes) else sizes
    for g in np.unique(groups).tolist():
        own = [intervals[i] for i in np.flatnonzero(groups == g).tolist()]
        prefix, first, last = (np.array(x, np.int64) for x in zip(*own))
        size = last - first + 1
        node = np.repeat(np.arange(len(own)), size)
        within = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)
        member = order[first[node] + within]
        sort = np.lexsort((rank[member], node))
        member = member[sort]
        # Left-extension diversity: neighbours by what stands to the left, and how
        # far they agree.  Classes that agree for the bytes still needed are repeats.
        same = node[1:] == node[:-1]
        agree = np.zeros(len(member) + 1, np.int64)
        pairs = np.flatnonzero(same)
        agree[1:-1][pairs] = _prefix_lengths(lefts, member[pairs], member[pairs + 1])
        linked = np.zeros(len(member) + 1, bool)
        linked[1:-1] = same
        enough = linked & (agree + prefix[np.append(node, 0)[: len(agree)]] >= length)
        to_left = np.maximum(np.where(enough[:-1], agree[:-1], -1), np.where(enough[1:], agree[1:], -1))
        hit = to_left >= 0
        out.append((member[hit], to_left[hit], prefix[node][hit]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _repeats(length_of: dict[bool, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(table: pa.Table):
            of_words = table.column("words").to_numpy()
            for words, length in length_of.items():
                own = table.filter(pa.array(of_words == words))
                if own.num_rows:
                    yield repeats(own, words, length)

        def repeats(table: pa.Table, words: bool, length: int):
            windows, left = table.column("window").to_pylist(), table.column("lft").to_pylist()
            member, to_left, to_right = maximal_repeats(
                table.column("anchor").to_numpy(), [w[n:] for w, n in zip(windows, left)], [w[:n][::-1] for w, n in zip(windows, left)], length
            )
            solo = table.column("solo").to_numpy()[member]
            member, to_left, to_right = member[solo], to_left[solo], to_right[solo]
            pos = table.column("pos").to_numpy()[member]
            spans = np.stack([pos - to_left, pos + to_right], axis=1).astype("<i4")
            return common.to_batch(_SPANS, [table.column("did").to_numpy()[member], table.column("tk").to_numpy()[member], [words] * len(member), [s.tobytes() for s in spans]])

        held, size = [], 0
        for table in common.in_runs(batches, "anchor"):  # groups are taken together
            held.append(table)
            size += table.num_rows
            if size >= 8192:
                yield from answer(pa.concat_tables(held))
                held, size = [], 0
        if held:
            yield from answer(pa.concat_tables(held))

    return run


def _passages(covers: list[bytes] | None) -> np.ndarray:
    """Sorted disjoint passages (pairs of word offsets) of spans over words' hashes."""
    if not covers:
        return np.zeros((0, 2), np.int64)
    spans = np.frombuffer(b"".join(covers), "<i4").reshape(-1, 2).astype(np.int64)
    # Neighbouring hashes may agree in some of their bytes: whole words count.
    return _merged(np.stack([-(-spans[:, 0] // _WORD), spans[:, 1] // _WORD], axis=1))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for did, text, covers, passages in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            raw = text.as_py().encode()
            n, spans = len(raw), np.zeros((0, 2), np.int64)
            if covers:
                spans = _merged(np.frombuffer(b"".join(covers), "<i4").reshape(-1, 2).astype(np.int64))
                ends = [0, *spans.ravel().tolist(), n]
                raw = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
            said = _passages(passages)
            counts = len(said), int((said[:, 1] - said[:, 0]).sum())
            rows.append(
                (None if did == common.NO_ID else did, n, n - len(raw), len(spans), hashlib.sha256(raw).hexdigest(), *counts, spans.astype("<i8").tobytes(), said.astype("<i8").tobytes())
            )
        yield common.to_batch(_RESULT, list(zip(*rows)) or [[]] * len(_RESULT))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP, passage: int = PASSAGE, passage_k: int = PASSAGE_K) -> DataFrame:
    """did, tk, words, cover: spans (pairs of 32-bit offsets) whose bytes are covered
    by a string of ``length`` bytes that starts elsewhere too, or (``words``) whose
    words are, by ``passage`` of them; ``keyed`` has did, tk, text."""
    sizes = ((False, length, k), (True, passage * _WORD, passage_k * _WORD))
    length_of = {words: n for words, n, _ in sizes}
    anchors = common.stored(keyed.mapInArrow(_anchors(sizes), ANCHORS), "anchors")
    twice = anchors.groupBy("anchor").agg(F.sum("n").alias("c"), F.min("ctx") != F.max("ctx"), F.count("*")).toDF("anchor", "c", "mixed", "size")
    twice = common.stored(twice.where("c > 1").select("anchor", "mixed", (F.col("c") > group).alias("hot"), "size"), "twice")
    place = F.struct("did", "tk", "pos")
    found = common.stored(common.joined(anchors, twice, ["anchor"], "size", place), "repeated")
    columns = ["did", "tk", "words", "pos", "lft", "rgt", "cover"]
    whole = found.where("not mixed").select(*columns)
    mixed = found.where("mixed")
    windows = mixed.groupBy("anchor", "ctx").agg(
        F.sum("n").alias("n_same"), F.max("hot").alias("hot"), F.min(F.struct("did", "tk", "pos", "lft", "rgt", "words")).alias("rep")
    )
    windows = common.stored(windows, "windows")
    same = common.joined(mixed, windows.where("n_same > 1").select("anchor", "ctx", "n_same"), ["anchor", "ctx"], "n_same", place)
    whole = whole.unionByName(same.select(*columns))
    # An int pair in the layout of ``cover``, by hex digits: the low byte first.
    def little(c):
        digits = F.lpad(F.hex(c.cast("long")), 8, "0")
        return F.concat(F.substring(digits, 7, 2), F.substring(digits, 5, 2), F.substring(digits, 3, 2), F.substring(digits, 1, 2))

    pair = F.unhex(F.concat(little(F.col("pos") - F.col("lft")), little(F.col("pos") + F.col("rgt"))))
    spans = whole.select("did", "tk", "words", F.coalesce("cover", pair).alias("cover"))

    def asked(rows: DataFrame) -> DataFrame:
        x = F.struct("anchor", "rep.pos", "rep.lft", "rep.rgt", "rep.words", (F.col("n_same") == 1).alias("solo"))
        by_text = rows.select("rep.did", "rep.tk", x.alias("x")).groupBy("did", "tk").agg(F.collect_set("x").alias("asked"))
        return keyed.join(by_text, ["did", "tk"]).select("did", "tk", "text", "asked")

    def scanned(contexts: DataFrame) -> DataFrame:
        return contexts.select(*_CONTEXTS.names).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeats(length_of), SPANS)

    spans = spans.unionByName(scanned(asked(windows.where("not hot")).mapInArrow(_cut(length_of, False), CONTEXTS)))
    if not windows.where("hot").isEmpty():
        cut = common.stored(asked(windows.where("hot")).mapInArrow(_cut(length_of, True), CONTEXTS), "segments")
        sizes = cut.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1")
        spans = spans.unionByName(scanned(cut.join(sizes.where(F.col("c") <= group), "anchor")))
        large = sizes.where(F.col("c") > group)
        if not large.isEmpty():
            large = common.joined(cut, common.stored(large, "large"), ["anchor"], "c", place)
            each = common.stored(large.select(*_CONTEXTS.names).mapInArrow(_each_window(length_of), CONTEXTS), "by-window")
            window = ["anchor", "lft", "words", "window"]
            shared = common.stored(each.groupBy(*window).agg(F.count("*").alias("c")).where("c > 1"), "shared")
            again = common.joined(each.where("solo"), shared, window, "c", place)
            start = F.col("pos").cast("long")
            end = start + F.when(F.col("words"), length_of[True]).otherwise(length_of[False])
            spans = spans.unionByName(again.select("did", "tk", "words", F.unhex(F.concat(little(start), little(end))).alias("cover")))
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP, passage: int = PASSAGE, passage_k: int = PASSAGE_K) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    n_passages and n_passage_words, the removed spans (pairs of little-endian 64-bit
    byte offsets) and the passages (pairs of word offsets, likewise).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else in
    the corpus, the same text included.  A word is of a passage if a string of
    ``passage`` words over it also starts anywhere else; passages are told, not
    removed, and n_passages counts their maximal runs.  Words are runs without white
    space; what stands between them does not matter.  Null or empty texts have no
    bytes; texts under ``length`` bytes lose none; rows that repeat an id and text are
    documents of their own and so repeat each other.  An empty table gives no rows;
    other columns are not read.
    """
    if not (0 < k < length and 0 < passage_k < passage):
        raise ValueError("an anchor must be shorter than what it is an anchor of")
    keyed = common.with_row_key(docs)
    of = lambda words: F.collect_set(F.when(F.col("words") == words, F.col("cover")))
    # Sets: rows that repeat an id and text have the same spans.
    covers = repeated_spans(keyed, length, k, group, passage, passage_k).groupBy("did", "tk").agg(of(False).alias("covers"), of(True).alias("passages"))
    return keyed.join(covers, ["did", "tk"], "left").select("did", "text", "covers", "passages").mapInArrow(
        _removed,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long, spans binary, passages binary",
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents without the bytes of 400-byte repeats."""
    return remove_repeats(common.documents(spark, sf_dir)).drop("spans", "passages")
