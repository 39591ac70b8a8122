"""Secrets within longer runs: after a name and '=', and at the end of a path."""

from __future__ import annotations

import math
import random
import time

import pytest

from pulsegrid.llm import secret_scan

from . import data

KEY = "Zq8vN2xLw0RtYp4sKd7GhJ3mBc6FeUaX9TiVnO1Q"
SHORT = "b7Kq2XzR9mVt4LcW8nYp3HsD6fGj1QaE"
SLASHED = "wJ4rXUt/FEMI8K7MDq+G5bPxRf1CYzQh/Lk3Bn9v"
RUNS = [
    (f"AWS_SECRET_ACCESS_KEY={SLASHED}", SLASHED),
    (f"SIGNING_KEY={SHORT}", SHORT),
    (f"see https://host.example/get?sig={SHORT}&x=1", SHORT),
    (f"at https://host.example/services/T01-A_b/{SHORT} now", SHORT),
    (f"at /some-long_name/words+more/prefix_{KEY}/end", KEY),
    (f"=={KEY}== closes", f"{KEY}=="),
]


@pytest.mark.parametrize("text,secret", RUNS)
def test_parts_are_candidates(text, secret):
    spans, found = secret_scan.scan(text)
    assert not spans and secret in {text[a:b] for a, b, *_ in found}


def test_whole_runs_stay_whole():
    for text in (f"key {KEY} end", f"key {SLASHED}== end", "12345678901234567890123"):
        whole = [w for w in text.split() if len(w) > 20 and not w.isdigit()]
        assert [text[a:b] for a, b, *_ in secret_scan.scan(text)[1]] == whole


def test_runs_are_redacted(spark):
    rows = [(i, text, "en", "s", len(text)) for i, (text, _) in enumerate(RUNS)]
    docs = spark.createDataFrame(rows, data.SCHEMA)
    out = {r.doc_id: r for r in secret_scan.redact_secrets(docs).collect()}
    for i, (text, secret) in enumerate(RUNS):
        assert secret not in out[i].text and "[SECRET]" in out[i].text and out[i].n_chars == len(out[i].text)
    assert out[1].text == "SIGNING_KEY=[SECRET]" and out[0].text == "AWS_SECRET_ACCESS_KEY=[SECRET]"
    assert all("random:" in r.spans for r in secret_scan.scan_secrets(docs).collect())


def encoded(rng, n):
    return "".join(rng.choice(secret_scan.ALPHABETS["base64"]) for _ in range(n))


def test_random_spans_by_brute_force(spark):
    """The battery and the step-up rule as a whole, over planted random strings, words
    and strings in order."""
    rng = random.Random(5)
    texts = [f"key {encoded(rng, n)} end" for n in (20, 24, 32, 40, 64) for _ in range(8)]
    texts += ["".join(rng.choice(data.WORDS) for _ in range(rng.randint(5, 12))) for _ in range(60)]
    texts += ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "aZ" * 20, "a" * 30, "x_y-z_" * 6, "", None]
    every = []
    for i, text in enumerate(texts):
        for start, end, p, weight in secret_scan.scan(text or "")[1]:
            s = text[start:end]
            encoding = secret_scan.infer_encoding(s)
            even, runs, serial = secret_scan.battery(s, encoding)
            assert p == even and weight == pytest.approx(len(s) * min(1, 2 * min(runs, serial) / 0.01) if 2 * min(runs, serial) >= 0.001 else 0)
            every.append((i, start, end, p, weight))
    mean = sum(x[4] for x in every) / len(every)
    bin_of = lambda p, w: max(0, min(1023, math.floor(-math.log10(max(p * mean / w if w else 1, 1e-300)) * 16)))
    bins = sorted((bin_of(p, w) for *_, p, w in every), reverse=True)
    least = min((b for k, b in enumerate(bins, 1) if 10 ** (-b / 16) * len(bins) <= 0.01 * sum(x >= b for x in bins)), default=1024)
    want = {i: [] for i in range(len(texts))}
    for i, start, end, p, w in every:
        if bin_of(p, w) >= least:
            want[i].append(f"random:{start}:{end}")
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], data.SCHEMA)
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(docs).collect()}
    assert got == {i: ",".join(sorted(s, key=lambda x: int(x.split(":")[1]))) for i, s in want.items()}
    caught = [bool(got[i]) for i in range(40)]
    assert sum(caught[16:]) >= 23 and sum(caught) >= 30  # 32 characters and more; all
    assert not any(got[i] for i in range(40, len(texts)))
    # Strings that an order test rejects are hypotheses all the same.
    assert any(w < 1 for *_, w in every) and any(i >= 40 for i, *_ in every)


def test_redaction_keeps_columns(spark):
    docs = data.table(spark)
    out = secret_scan.redact_secrets(docs)
    assert out.schema.names == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert out.count() == docs.count() and out.where("text IS NULL").count() == docs.where("text IS NULL").count()


def test_many_secrets_in_one_text():
    """200,000 secrets of two kinds and as many random strings, some within base spans."""
    rng = random.Random(9)
    words = [f"token={rng.getrandbits(64):016x} {rng.getrandbits(128):032x} {encoded(rng, 24)}" for _ in range(100_000)]
    began = time.process_time()
    spans, found = secret_scan.scan("\n".join(words))
    assert time.process_time() - began < 120
    few = "\n".join(words[:300])
    slow, candidates = secret_scan.scan(few)
    inside = [any(a <= c[0] and c[1] <= b for a, _, b in slow) for c in candidates]
    assert len(spans) >= 200_000 and not any(inside) and candidates == [c for c in found if c[1] <= len(few)]
