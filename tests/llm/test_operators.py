"""The ten operators against plain Python on small tables with every odd case."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import sys
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import (
    common,
    components,
    exact_dedup,
    language_id,
    packing,
    quality_rules,
    secret_scan,
    sentence_pieces,
    simhash_dedup,
    suffix_dedup,
    token_counts,
    token_files,
    tokens,
)

from . import data

ROWS = data.rows()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return data.table(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return data.table(spark, [])


# -- 1 -----------------------------------------------------------------------


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                covered[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        left = bytes(np.frombuffer(b, np.uint8)[~covered]) if len(b) else b""
        out.append((len(b), int(covered.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("length,k,group", [(60, 16, 1000), (60, 16, 2), (150, 64, 3)])
def test_suffix_dedup(docs, length, k, group):
    got = pairs(suffix_dedup.remove_repeats(docs, length, k, group), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    same(got, [(r[0], *x) for r, x in zip(ROWS, brute_repeats([r[1] for r in ROWS], length))])


def brute_passages(texts, size):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    counts = collections.Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        covered = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - size + 1):
            if counts[tuple(w[i : i + size])] > 1:
                covered[i : i + size] = True
        out.append((int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum()), int(covered.sum())))
    return out


@pytest.mark.parametrize("passage,k,group", [(50, 10, 1000), (12, 3, 1000), (12, 3, 2), (30, 8, 3)])
def test_repeated_passages(docs, passage, k, group):
    got = pairs(suffix_dedup.remove_repeats(docs, 150, 64, group, passage, k), "doc_id", "n_passages", "n_passage_words")
    same(got, [(r[0], *x) for r, x in zip(ROWS, brute_passages([r[1] for r in ROWS], passage))])


def test_passages_of_short_words_and_other_white_space(spark):
    """Passages under 400 bytes, set with other white space, among long texts."""
    rng = random.Random(12)
    shared = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(61)]
    rows = [
        (1, data.prose(rng, 70) + " " + " ".join(shared[:50]) + " end", None, None, 0),
        (2, "\n".join(shared) + "\t\t" + data.prose(rng, 30), None, None, 0),
        (3, " ".join(shared[11:60]), None, None, 0),  # one word short
        (4, "w" * 300_000 + " " + "  ".join(shared[5:55]), None, None, 0),
        (5, None, None, None, 0),
    ]
    got = pairs(suffix_dedup.remove_repeats(data.table(spark, rows)), "doc_id", "n_removed", "n_passages", "n_passage_words")
    # The long word repeats itself: every 400 bytes of it start elsewhere in it, too.
    same(got, [(1, 0, 1, 50), (2, 0, 1, 55), (3, 0, 0, 0), (4, 300_000, 1, 50), (5, 0, 0, 0)])


def test_suffix_dedup_long_text(spark):
    """A text beyond a segment, cut where an anchor's run crosses the edge."""
    unit = data.prose(__import__("random").Random(3), 60_000)
    rows = [(1, unit, None, None, 0), (2, "x" + unit[100_000:100_700] + "y", None, None, 0)]
    got = pairs(suffix_dedup.remove_repeats(data.table(spark, rows)), "doc_id", "n_removed")
    want = brute_repeats([unit, rows[1][1]], 400)
    assert got == [(1, want[0][1]), (2, want[1][1])]


def test_prefix_intervals():
    assert sorted(suffix_dedup.prefix_intervals([0, 2, 2, 1, 0, 3])) == [(1, 0, 3), (2, 0, 2), (3, 4, 5)]
    assert suffix_dedup.prefix_intervals([0]) == []


# -- 2 -----------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(windows)
    hit = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def brute_weights(rows, chosen, buckets):
    """Weights from words and pairs hashed as Spark's xxhash64 does: seed 42, chained."""

    def h(*words):
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w.encode(), seed)
        return (seed - (1 << 64) if seed >> 63 else seed) % buckets

    raw, good = collections.Counter(), collections.Counter()
    grams = {}
    for i, r in enumerate(rows):
        words = WORD.findall(r[1] or "")
        own = [h(w) for w in words] + [h(a, b) for a, b in zip(words, words[1:])]
        grams[i] = own
        raw.update(own)
        if chosen.get(r[0]) is False:
            good.update(own)
    n_raw, n_good = sum(raw.values()), sum(good.values())
    weight = [round(math.log(((good[b] + 1) / (n_good + buckets)) / ((raw[b] + 1) / (n_raw + buckets))) * quality_rules.SCALE) for b in range(buckets)]
    return weight, grams


def test_quality_rules(spark, docs):
    labels = spark.createDataFrame([(100 + i, i % 4 != 0) for i in range(60)] + [(None, True)], "doc_id long, quality boolean").selectExpr("doc_id", "cast(quality as int) quality", "0 toxic")
    buckets = 64
    sample, rest = ({r.good_id for r in ids.collect()} for ids in quality_rules.trusted_ids(labels))
    assert sample and rest and not sample & rest and sample | rest == {100 + i for i in range(60) if i % 4}
    few, others = quality_rules.trusted_ids(labels, 7)
    assert few.count() == 7 and others.count() == len(sample | rest) - 7
    chosen = dict.fromkeys(sample, False) | dict.fromkeys(rest, True)
    got = quality_rules.quality_rules(docs, labels, buckets, miss=0.2)
    weight, grams = brute_weights(ROWS, chosen, buckets)
    score = [math.floor(sum(weight[b] for b in g) / len(g)) if g else None for g in grams.values()]
    base = [brute_quality(r[1]) for r in ROWS]
    held = sorted(s for s, r, b in zip(score, ROWS, base) if chosen.get(r[0]) and not b[-1])
    at = 0.2 * (len(held) - 1)
    low = held[math.floor(at)]
    limit = low + (held[math.ceil(at)] - low) * (at - math.floor(at))
    want = [(r[0], *b, not b[-1] and s >= limit) for r, b, s in zip(ROWS, base, score)]
    same(pairs(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), want)
    # The row can be carried, and a filter on the result keeps the schema.
    kept = quality_rules.quality_rules(docs, labels, buckets, miss=0.2, carry=True).where("kept").select("row.*")
    assert kept.columns == docs.columns and kept.count() == sum(w[-1] for w in want)


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = pairs(quality_rules.quality_rules(docs, none, 64), "doc_id", "kept")
    same(got, [(r[0], not brute_quality(r[1])[-1]) for r in ROWS])
    assert quality_rules.quality_rules(empty, none, 64).count() == 0


def test_repeats_when_hashes_clash(spark, docs, monkeypatch):
    """Windows that share a hash are compared themselves."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    got = pairs(quality_rules._with_repeats(quality_rules._measured(docs.where("doc_id < 112"))), "doc_id", "n_repeat_words")
    same(got, [(r[0], brute_quality(r[1])[4]) for r in ROWS if r[0] and r[0] < 112])
    rng = random.Random(4)
    long = " ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(300_000))
    began = time.monotonic()
    table = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert pairs(quality_rules._with_repeats(quality_rules._measured(table)), "n_repeat_words") == [(brute_quality(long)[4],)]
    assert time.monotonic() - began < 60
    # More words than places fit: likewise.
    monkeypatch.undo()
    monkeypatch.setattr(quality_rules, "_PLACE", 6)
    got = pairs(quality_rules._with_repeats(quality_rules._measured(docs)), "doc_id", "n_repeat_words")
    same(got, [(r[0], brute_quality(r[1])[4]) for r in ROWS])


# -- 3 and 6 -----------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_by_word_ids(name):
    odd = ["don't we'll 'tis", "a  b\n\nc ", " x\ty", "12ab34 x_y ½ ²", "<|endoftext|> hi", "É́e ΣΑΣ İx ﬁ ſtop", "日本 👍🏽", "a\x1cb \x85c", "x.\nY", "!!!\n???"]
    encode, library = tokens.encoder(name), tokens.library(name)
    for text in [*odd, *[r[1] or "" for r in ROWS]]:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_where_other_white_space_makes_up_for_runs_of_it(name):
    encode, library = tokens.encoder(name), tokens.library(name)
    for text in ("x\ty\tw\n\n\nz", "a\tb\tc   d", "a\u2003b\u2003c\n\n\nd", "\n\n\na\tb\tc\td", "a\x0bb\x0bc\n\n\n"):
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_kept_words_are_bounded_in_bytes():
    library, room = tokens.library("byte_bpe_50k.json"), 1 << 20
    words = tokens.WordIds(library, "Ġ", False, room)
    for i in range(8_000):
        word = chr(97 + i % 26) * 150 + "".join(chr(97 + int(d)) for d in str(i))
        ids = words[word]
        assert i % 500 or np.frombuffer(ids, "<u4").tolist() == library.encode(" " + word, add_special_tokens=False).ids
    for kept in (words, words.earlier):
        assert 0 < sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in kept.items()) < 1.2 * room


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(1).integers(0, 2**width, 1001, dtype=np.uint64).astype("<u4")
    packed = token_files.pack_ids(ids, width)
    assert len(packed) == -(-1001 * width // 8)
    for start, count in ((0, 1001), (7, 13), (999, 2), (5, 0)):
        assert (token_files.unpack_ids(packed, width, start, count) == ids[start : start + count]).all()


def test_token_files(spark, docs, empty):
    path = common.scratch(spark, "t")
    token_files.write_token_files(docs, path, block_ids=500)
    library = tokens.library("byte_bpe_50k.json")
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    want = collections.Counter()
    for r in ROWS:
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want[(r[0], len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    some = next(r for r in got if r.doc_id == 112)
    range_ = token_files.read_id_range(spark, path, some.start, some.n_tokens)
    assert zlib.crc32(range_.tobytes()) == some.ids_crc32
    path = common.scratch(spark, "t")
    token_files.write_token_files(empty, path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_packing(docs, empty):
    size = 256
    pieces = packing.pack_documents(docs, size=size, keep_ids=True)
    rows = pieces.collect()
    library = tokens.library("word_bpe_49k.json")
    want = collections.Counter()
    for r in ROWS:
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), size):
            want[(r[0], s, zlib.crc32(ids[s : s + size].tobytes()), len(ids))] += 1
    assert collections.Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // size) * 1.1 + 1
    sequences = packing.packed_sequences(pieces).collect()
    assert sum(len(s.ids) // 4 for s in sequences) == total
    assert packing.pack_documents(empty).count() == 0


def spf_packs(histogram, size):
    """Lengths of all packs, placing one piece after the other, longest first; what of
    a length finds no room opens packs of its own."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for left in range(histogram[length], 0, -1):
            at = min(range(len(packs)), key=packs.__getitem__, default=None)
            if at is None or packs[at] + length > size:
                packs += [length] * left
                break
            packs[at] += length
    return sorted(packs)


def test_shortest_pack_first():
    rng = random.Random(3)
    for _ in range(30):
        histogram = collections.Counter(rng.choices(range(1, 51), k=rng.randint(0, 300)))
        patterns = packing.shortest_pack_first(histogram, 50)
        assert sorted(sum(p) for c, p in patterns for _ in range(c)) == spf_packs(histogram, 50)
        assert sum((collections.Counter({n: c * k for n, k in collections.Counter(p).items()}) for c, p in patterns), collections.Counter()) == histogram
    patterns = packing.shortest_pack_first({5: 3, 3: 2, 2: 4, 10: 1}, 10)
    assert sum(c * len(p) for c, p in patterns) == 10 and all(sum(p) <= 10 for _, p in patterns)
    assert packing.shortest_pack_first({}, 10) == []
    # 6 opens packs of room 4; both 3s go onto them rather than together.
    assert packing.shortest_pack_first({6: 2, 3: 2}, 10) == [(2, (6, 3))]


# -- 4 -----------------------------------------------------------------------


def test_token_counts(spark, docs, empty):
    got = pairs(token_counts.maintained_counts(docs), "source", "lang", "version", "n_docs", "n_tokens")
    n = lambda name, t: len(tokens.library(name).encode(t or "", add_special_tokens=False).ids)
    old, new = "byte_bpe_50k.json", "word_bpe_49k.json"
    largest = {}
    for r in ROWS:
        t = r[1] or ""
        if largest.get(t) is None or (r[0] is not None and r[0] > largest[t]):
            largest[t] = r[0]
    totals = collections.defaultdict(lambda: [0, 0])
    for r in ROWS:
        t = r[1] or ""
        if r[0] != largest[t]:
            continue
        version = new if n(new, t) < n(old, t) else old
        totals[(r[3], r[2], version)][0] += 1
        totals[(r[3], r[2], version)][1] += n(version, t)
    same(got, [(*k, *v) for k, v in totals.items()])
    assert token_counts.maintained_counts(empty).count() == 0


def test_rollup_commits_once(spark):
    rollup = token_counts.Rollup(spark, common.scratch(spark, "r"))
    change = lambda n, d: spark.createDataFrame([("s", None, "v", d, n)], token_counts.DELTAS)
    assert rollup.commit("a", change(10, 1)) and not rollup.commit("a", change(99, 1))
    assert rollup.commit("b", change(-4, 0)) and rollup.commit("c", change(5, 1))
    # A batch whose folder has no _SUCCESS was cut short: it does not count until sent again.
    change(1000, 9).write.parquet(f"{rollup.path}/batch=d")
    (fs := spark._jvm.org.apache.hadoop.fs.Path(f"{rollup.path}/batch=d/_SUCCESS")).getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs, False)
    assert pairs(rollup.totals(), "n_docs", "n_tokens") == [(2, 11)]
    assert rollup.compact() and not rollup.compact()
    assert pairs(rollup.totals(), "n_docs", "n_tokens") == [(2, 11)]
    # Totals without their list of batches were cut short, too.
    change(7, 7).write.parquet(f"{rollup.path}/totals=2")
    assert not rollup.commit("a", change(1, 1)) and pairs(rollup.totals(), "n_docs", "n_tokens") == [(2, 11)]
    assert rollup.commit("d", change(-11, -2))
    assert rollup.totals().count() == 0 and rollup.compact() and rollup.totals().count() == 0
    assert not rollup.commit("d", change(1, 1)) and rollup.commit("e", change(3, 1))
    assert pairs(rollup.totals(), "n_docs", "n_tokens") == [(1, 3)]
    with pytest.raises(ValueError):
        rollup.commit("x/y", change(1, 1))


# -- 5 -----------------------------------------------------------------------

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secret_scan(spark, docs, empty):
    extra = [
        (900, "token: short token = longenough1 Api_Key='abcdefgh' TOKEN=x ſecret=abcdefghij", None, None, 0),
        (901, "é secret:" + "a" * 8 + " apikey=" + "0" * 40, None, None, 0),
    ]
    rows = ROWS + extra
    got = secret_scan.scan_secrets(docs.unionByName(data.table(spark, extra))).collect()
    want = []
    for r in rows:
        base = brute_base(r[1] or "")
        said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((r[0], *[sum(k == i for _, k, _ in base) for i in range(3)], hashlib.sha256(said.encode()).hexdigest()))
    same([tuple(r)[:5] for r in got], want)
    by = {r.doc_id: r.spans for r in got}
    assert by[116] == "random:4:44"  # the method's own find
    assert "random" not in by[111] and by[115].count(":") == 6
    assert secret_scan.scan_secrets(empty).count() == 0


def test_battery_and_redaction(docs):
    assert secret_scan.infer_encoding("12345678901234567890") is None
    assert secret_scan.infer_encoding("deadbeef00") == "hex" and secret_scan.infer_encoding("ABCDEFG234567") == "base32"
    even, runs, serial = secret_scan.battery("abcdefghijklmnopqrstuvwxyz", "base64")
    assert serial < secret_scan.ORDER  # in order: not random
    assert secret_scan.battery("thereisnothinginthehousethatthemothereatsinthemorning", "base64")[0] > 0.01
    assert secret_scan.battery("Zq8vN2xLw0RtYp4sKd7GhJ3mBc6FeUaX9TiVnO1Q", "base64")[0] < 1e-4
    out = {r.doc_id: r for r in secret_scan.redact_secrets(docs).collect()}
    assert out[116].text == "key [SECRET] end" and out[116].n_chars == len(out[116].text)
    assert out[115].text == "[SECRET] and [SECRET] then [SECRET] ok".replace("[SECRET] and", '[SECRET]" and')
    plain = {r[0]: r[1] for r in ROWS if r[0] not in (111, 115, 116, None)}  # 111 is hex throughout
    assert all(out[i].text == t for i, t in plain.items())


# -- 7 -----------------------------------------------------------------------


def test_golomb_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 3000):
        values = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        coded = exact_dedup.golomb_encode(values, 1 << 40)
        assert (exact_dedup.golomb_decode(coded, len(values), 1 << 40) == values).all()
    edge = np.array([0, 1, (1 << 40) - 1], np.uint64)
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(edge, 1 << 40), 3, 1 << 40) == edge).all()


@pytest.mark.parametrize("bits,most", [(56, 1 << 14), (5, 1)])
def test_exact_groups(spark, docs, empty, bits, most):
    """Few bits make many false suspects, which the bytes then clear; few bitmaps at
    once make groups of files."""
    if most == 1:
        path = common.scratch(spark, "several-files")
        docs.repartition(3).write.parquet(path)
        docs = spark.read.parquet(path)
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    want = []
    for r in ROWS:
        own = groups[r[1] or ""]
        keep = max((i for i in own if i is not None), default=None)
        want.append((r[0], keep, len(own), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    same(pairs(exact_dedup.exact_groups(docs, bits, most), "doc_id", "keep_id", "group_size", "kept", "text_sha256"), want)
    assert exact_dedup.exact_groups(empty).count() == 0


# -- 8 -----------------------------------------------------------------------


def test_codewords():
    for n in (1, 2, 3, 4, 7, 9):
        code = language_id.codewords(n)
        assert len(code) == n and len({tuple(c) for c in code.tolist()}) == n
    assert min(int((a != b).sum()) for i, a in enumerate(language_id.codewords(4)) for b in language_id.codewords(4)[:i]) == 4


def test_language_id(spark, sf, docs, empty):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(table)
    said = language_id.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(said) > 20 and sum(r.lang == r.lang_pred for r in said) / len(said) >= 0.95
    for r in said:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    odd = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert odd[101].lang_pred == odd[102].lang_pred == odd[103].lang_pred == "und"
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    untaught = language_id.identify(docs, language_id.fit(empty)).select("lang_pred").distinct().collect()
    assert [r[0] for r in untaught] == ["und"]


def brute_language(rows, chosen, text):
    """The prediction in plain Python: log-odds per bit, loss-weighted decoding."""

    def grams(t):
        b = (" " + t.lower() + " ").encode()
        out = collections.Counter()
        for order in (1, 2, 3):
            for i in range(len(b) - order + 1):
                h = b[i]
                for x in b[i + 1 : i + order]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ x
                out[(order - 1) * 8192 + ((h * 0x9E3779B1 & 0xFFFFFFFF) >> 19)] += 1
        return out

    size, counts = 3 * 8192, {}
    for r in rows:
        if (r[0], r[2]) in chosen:
            counts.setdefault(r[2], collections.Counter()).update(grams(r[1] or ""))
    languages = sorted(counts)
    share = {x: (lambda c, n: lambda f: (c[f] + 0.5) / (n + 0.5 * size))(counts[x], sum(counts[x].values())) for x in languages}
    code = language_id.codewords(len(languages)).tolist()
    own = grams(text)
    margins = []
    for bit in range(len(code[0])):
        on, off = ([x for x, c in zip(languages, code) if c[bit] == v] for v in (1, 0))
        odds = sum(n * (math.log(sum(share[x](f) for x in on) / len(on)) - math.log(sum(share[x](f) for x in off) / len(off))) for f, n in own.items())
        margins.append(odds / math.sqrt(sum(own.values())))
    loss = [sum((1 - math.exp(-abs(m))) * math.log1p(math.exp(-(2 * c[b] - 1) * m)) for b, m in enumerate(margins)) for c in code]
    chance = [math.exp(min(loss) - x) for x in loss]
    best = loss.index(min(loss))
    return languages[best], chance[best] / sum(chance)


@pytest.mark.parametrize("per_language", [3000, 4])
def test_language_by_brute_force(spark, sf, per_language):
    table = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 AS own_id", "2 AS own_lang", "3 AS h", "4 AS size")
    rows = [(r.doc_id, r.text, r.lang) for r in table.collect()]
    ranked = collections.defaultdict(list)
    for i, _, lang in rows:
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            ranked[lang].append((xxhash.xxh64_intdigest(str(i).encode(), 42) >> 2, i))
    chosen = {(i, lang) for lang, own in ranked.items() for _, i in sorted(own)[:per_language]}
    assert chosen == {tuple(r) for r in language_id._sample(table, per_language).collect()}
    said = {r.doc_id: r for r in language_id.identify(table, language_id.fit(table, per_language)).collect()}
    texts = [r for r in rows if r[1] and any(map(str.isalpha, r[1])) and len(r[1]) < 4000][:25]
    for i, text, _ in texts:
        lang, score = brute_language(rows, chosen, text)
        assert said[i].score == pytest.approx(score, abs=1e-3)
        assert said[i].lang_pred == lang or score < 0.51


def test_sample_where_ids_repeat(spark):
    rows = [(1, "en", "x")] * 500 + [(i, "en", "y") for i in range(2, 400)] + [(3, "de", "z")]
    got = language_id._sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"), 20).collect()
    assert {r.own_lang for r in got} == {"en", "de"} and 1 <= sum(r.own_lang == "en" for r in got) <= 20


# -- 9 -----------------------------------------------------------------------


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups(docs, empty):
    fps = [brute_fingerprint(r[1]) for r in ROWS]
    root = list(range(len(ROWS)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ROWS)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(ROWS):
        least[find(i)].append(r[0])
    want = [(r[0], f"{fps[i]:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, r in enumerate(ROWS)]
    same(pairs(simhash_dedup.near_groups(docs), "doc_id", "fingerprint", "component_id"), want)
    assert simhash_dedup.near_groups(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_are_all_pairs(spark, radius):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    values = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(12):
            v = b & (2**64 - 1)
            for bit in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                v ^= 1 << bit
            values.add(v - 2**64 if v >> 63 else v)
    got = {frozenset((r.u, r.v)) for r in simhash_dedup.links(spark.createDataFrame([(v,) for v in values], "fp long"), radius).collect()}
    ordered = sorted(values)
    want = {frozenset((a, b)) for i, a in enumerate(ordered) for b in ordered[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    assert got == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 100), (7, 7)]
    got = dict(pairs(components.components(spark.createDataFrame(chain, "u long, v long")), "node", "root"))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- 10 ----------------------------------------------------------------------


def test_sentence_pieces(docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path("piece_bpe_32k.model"))
    encoded = sentence_pieces.encode_documents(docs, keep_ids=True)
    want = []
    for r in ROWS:
        ids = np.array(library.encode(r[1] or ""), "<u4")
        want.append((r[0], len(ids), zlib.crc32(ids.tobytes()), True))
    same(pairs(encoded, "doc_id", "n_ids", "ids_crc32", "round_trip"), want)
    same(pairs(sentence_pieces.decode_documents(encoded), "doc_id", "text"), [(r[0], r[1] or "") for r in ROWS])
    same(pairs(sentence_pieces.decode_documents(encoded.selectExpr("doc_id", "viterbi_ids ids")), "doc_id", "text"), [(r[0], r[1] or "") for r in ROWS])
    assert sentence_pieces.encode_documents(empty).count() == 0


def test_long_words_merge_alike():
    p = sentence_pieces.pieces("piece_bpe_32k.model")
    for word in ("▁" + "ab" * 100, "▁" * 40, "▁" + "thequickbrownfox" * 12, "▁é日👍"):
        assert p.merges([word])[0] == p.merge_long(word)


def test_words_decode_as_whole_texts_do():
    """Word by word, with words kept from text to text, against the whole text's ids."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path("piece_bpe_32k.model"))
    rng = random.Random(4)
    texts = [" a", "a ", "a\n b", " \n", "\n\na  b\n", "a▁b", "▁", "  ", "x\n\n\ny ", "é日👍\nü ñ", "word " * 3000 + "z" * 700]
    texts += ["".join(rng.choice(["a", "th", "é", "👍", " ", " ", "\n", "▁", "q7", "..", "\t"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    encoder = sentence_pieces.Encoder("piece_bpe_32k.model", (None, "viterbi"))
    for text, (a, b, good) in zip(texts, encoder.batch(texts)):
        assert np.frombuffer(a, "<u4").tolist() == library.encode(text)
        whole = [encoder.pieces.decode(np.frombuffer(x, "<u4")) == text.replace("▁", " ") for x in (a, b)]
        assert good == all(whole) and good
    p = encoder.pieces
    assert p.restored(["▁a", "b"], [np.array([p.ids["▁a"]], "<u4").tobytes(), np.array([p.ids["c"]], "<u4").tobytes()]).tolist() == [True, False]


def brute_viterbi(word, pieces, worst):
    best = [(0.0, [])] + [(-math.inf, [])] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            part = word[s:e]
            score = pieces.get(part, worst if e - s == 1 else -math.inf)
            if best[s][0] + score > best[e][0] + 1e-12:
                best[e] = (best[s][0] + score, [*best[s][1], part])
    return best[-1]


def test_viterbi_is_the_best_segmentation():
    names = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca", "aab", "▁ab"]
    scores = [0, -2.5, -3.1, -3.3, -3.7, -4.0, -4.2, -5.9, -3.9, -5.1, -6.3, -4.7]
    model = sentence_pieces.Pieces(names, scores, [False] + [True] * 11, {}, False, 0)
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 9):
        words = ["".join(rng.choice(list("▁abcx"), n)) for _ in range(60)]
        for word, ids in zip(words, model.viterbi(words)):
            got = sum(scores[i] if i else model.worst for i in np.frombuffer(ids, "<u4"))
            assert got == pytest.approx(brute_viterbi(word, dict(zip(names[1:], scores[1:])), model.worst)[0])


def test_prefix_lengths_of_nothing():
    none = np.zeros(0, np.int64)
    assert suffix_dedup._prefix_lengths([b"", b""], np.array([0]), np.array([1])).tolist() == [0]
    assert suffix_dedup._prefix_lengths([], none, none).tolist() == []


def test_heavy_keys_join_alike(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN 7 ELSE id % 50 + 100 END AS k", "id")
    values = rows.where("k != 101").groupBy("k").agg(F.min("id").alias("v"), F.count("*").alias("n"))
    plain = sorted(map(tuple, rows.join(values.drop("n"), "k", "left").collect()), key=repr)
    for light in (1000, 10):
        monkeypatch.setattr(common, "LIGHT", light)
        got = common.joined(rows, values, ["k"], "n", F.col("id"), "left").select("k", "id", "v")
        assert sorted(map(tuple, got.collect()), key=repr) == plain


def test_pieces_are_handed_on_before_a_batch_ends(monkeypatch):
    import types

    from pulsegrid.llm import packing

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": ["a b c d " * 9, "", "e f " * 40]})
    monkeypatch.setattr(packing, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    run = packing._pieces("word_bpe_49k.json", 1, 16, True)
    whole = [r for b in run(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(packing, "HELD_IDS", 20)
    parts = list(run(iter([batch])))
    assert sum(b.num_rows > 0 for b in parts) == 2 and [r for b in parts for r in b.to_pylist()] == whole
