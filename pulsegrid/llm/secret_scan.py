"""Secrets: base patterns and a randomness test battery (operator 5).

A candidate is a run of 20 or more characters of an encoding's alphabet; '=' only
closes it.  Its encoding is the smallest alphabet that holds it.  Where none does (a
path with a key, say), the candidates are the longest parts that base64 or base64url
holds, and the parts between separators.  Three tests look at the symbols:

* chi-squared against a uniform alphabet.  Ordinary words have uneven letters, so
  their statistic is large; the p-value is the chance that ``n`` letters of
  ordinary text come out as even as this (non-central, hence length-aware);
* runs of symbols above and below the alphabet's middle, and
* serial correlation of neighbours, both two-sided p-values of a random string.

False discoveries are held to a share of ``q`` of what is flagged over the whole
corpus by a weighted step-up rule.  The hypothesis is ordinary text, whose p-value is
the chi-squared test's.  Its weight is the length, as the tests have more power over
longer strings, times the order tests' say: the smaller of their p-values, doubled
for being two, over ORDER; at most 1, and 0 below VETO.  A string that an order test
doubts thus needs more evidence, and one that it rejects (the alphabet in order, say)
is never flagged.  Every candidate counts as a hypothesis, weights are taken over
their mean, and the rule works on a histogram of fixed size.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("passw", "secret", "token", "api")
_ACCESS, _HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{32,}")

#: Least characters of a candidate, p-values of the order tests from which on they have
#: no objection and below which they reject, share of false discoveries.
LEAST, ORDER, VETO, FALSE_SHARE = 20, 0.01, 0.001, 0.01
_CANDIDATE = re.compile("[A-Za-z0-9+/_-]{%d,}(?:=+(?![A-Za-z0-9+/_=-]))?" % LEAST)
#: Parts of a run that no alphabet holds: of base64, of base64url, and between separators.
_PARTS = tuple(re.compile("[A-Za-z0-9%s]{%d,}=*" % (more, LEAST)) for more in ("+/", "_-", "+"))
#: Alphabets from small to large; decimal runs are ordinary numbers and no secrets.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Share of each letter a to z in English text, in percent.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.07)

#: Steps of a p-value to a factor of ten, and the last bin of the histogram.
STEPS, LAST = 16, 1023


def _text_unevenness(alphabet: str) -> float:
    """Chi-squared that each letter of ordinary text adds over a uniform alphabet."""
    share = {c: x for c, x in zip("abcdefghijklmnopqrstuvwxyz", LETTERS)}
    own = [share[c.lower()] for c in alphabet if c.lower() in share and (c.islower() or alphabet.upper() == alphabet)]
    return len(alphabet) * sum(x * x for x in own) / sum(own) ** 2 - 1


_UNEVEN = {name: _text_unevenness(a) for name, a in ALPHABETS.items()}
_PLACES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}


def infer_encoding(s: str) -> str | None:
    """Smallest alphabet that holds ``s`` (closing '=' aside); none for numbers."""
    s = s.rstrip("=")
    if not s or s.isdigit():
        return None
    return next((name for name, places in _PLACES.items() if all(c in places for c in s)), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(s: str, encoding: str) -> tuple[float, float, float]:
    """p-values: as even as this though ordinary text; runs; serial correlation
    (both of a random string)."""
    places, k = _PLACES[encoding], len(ALPHABETS[encoding])
    v = [places[c] for c in s.rstrip("=")]
    n = len(v)
    counts = [0] * k
    for x in v:
        counts[x] += 1
    chi = k * sum(c * c for c in counts) / n - n
    mean, var = k - 1 + n * _UNEVEN[encoding], 2 * (k - 1) + 4 * n * _UNEVEN[encoding]
    even = 0.5 * math.erfc((mean - chi) / math.sqrt(2 * var))
    up = [x >= k // 2 for x in v]
    n1 = sum(up)
    n0 = n - n1
    runs = 1 + sum(a != b for a, b in zip(up, up[1:]))
    if n0 and n1 and n > 2:
        expect = 2 * n0 * n1 / n + 1
        spread = (expect - 1) * (expect - 2) / (n - 1)
        p_runs = _two_sided((runs - expect) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        p_runs = 0.0
    m = sum(v) / n
    s2 = sum((x - m) ** 2 for x in v)
    p_serial = _two_sided((sum((a - m) * (b - m) for a, b in zip(v, v[1:])) / s2) * math.sqrt(n)) if s2 else 0.0
    return even, p_runs, p_serial


def _parts(m: re.Match) -> list[tuple[int, int]]:
    """Where the candidates of a run lie: the run itself, if an alphabet holds it."""
    if infer_encoding(m[0]) or m[0].rstrip("=").isdigit():
        return [m.span()]
    return sorted({(m.start() + x.start(), m.start() + x.end()) for part in _PARTS for x in part.finditer(m[0])})


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float, float]]]:
    """Base spans (start, kind's number, end) and candidates (start, end, p, weight)."""
    spans: list[tuple[int, int, int]] = []
    low = text.lower() if text.isascii() else text.casefold()
    if any(k in low for k in _KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if max(map(len, text.split()), default=0) < LEAST:
        return sorted(spans), []
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    spans.sort()
    starts, reach = [a for a, _, _ in spans], list(itertools.accumulate((b for _, _, b in spans), max))
    covered = lambda start, end: (i := bisect.bisect_right(starts, start)) > 0 and reach[i - 1] >= end  # noqa: E731  by one span that begins no later
    found = []
    for m in _CANDIDATE.finditer(text):
        for start, end in _parts(m):
            if covered(start, end) or not (encoding := infer_encoding(text[start:end])):
                continue
            even, runs, serial = battery(text[start:end], encoding)
            order = min(1.0, 2 * min(runs, serial))
            found.append((start, end, even, (end - start) * min(1.0, order / ORDER) * (order >= VETO)))
    return spans, found


_FOUND = "spans array<struct<start:int,kind:int,end:int>>, candidates array<struct<start:int,end:int,p:double,weight:double>>"
_FOUND_ARROW = [
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
    ("candidates", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64()), ("weight", pa.float64())]))),
]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds spans and candidates to a first column; the second is the text."""
    for batch in batches:
        found = [scan(t.as_py() or "") for t in batch.column(1)]
        spans = [[{"start": a, "kind": k, "end": b} for a, k, b in s] for s, _ in found]
        candidates = [[{"start": a, "end": b, "p": p, "weight": w} for a, b, p, w in c] for _, c in found]
        schema = pa.schema([batch.schema.field(0), *_FOUND_ARROW])
        yield common.to_batch(schema, [batch.column(0), spans, candidates])


def found_spans(rows: DataFrame) -> DataFrame:
    """The first column of ``rows`` (which it and the text are), with base spans and
    candidates, in the shared folder."""
    first = rows.schema[0]
    return common.stored(rows.mapInArrow(_scan, StructType([first, *StructType.fromDDL(_FOUND).fields])), "secrets")


def _bin(p, weight, mean: float):
    """Bin of a candidate's weighted p-value; without weight it is 1."""
    weighted = F.coalesce(F.try_divide(p * mean, weight), F.lit(1.0))
    return F.greatest(F.lit(0), F.least(F.lit(LAST), F.floor(-F.log10(F.greatest(weighted, F.lit(1e-300))) * STEPS)))


def cutoff(found: DataFrame, q: float = FALSE_SHARE) -> tuple[int, float]:
    """(least bin that counts as a discovery, mean weight) over the whole corpus."""
    each = found.select(F.explode("candidates").alias("c")).select("c.*")
    total = each.agg(F.count("*").alias("m"), F.avg("weight").alias("mean")).first()
    if not total.mean:
        return LAST + 1, 1.0
    bins = each.groupBy(_bin(F.col("p"), F.col("weight"), total.mean).alias("bin")).agg(F.count("*").alias("n")).collect()  # LAST + 1 rows at most
    above, best = 0, LAST + 1
    for row in sorted(bins, key=lambda r: -r.bin):
        above += row.n
        if 10 ** (-row.bin / STEPS) * total.m <= q * above:  # a bin counts with its largest p
            best = row.bin
    return best, total.mean


def discoveries(found: DataFrame, q: float = FALSE_SHARE):
    """Column of the candidates that the rule flags, as spans."""
    least, mean = cutoff(found, q)
    kept = F.filter("candidates", lambda c: _bin(c["p"], c["weight"], mean) >= least)
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))


def scan_secrets(docs: DataFrame, q: float = FALSE_SHARE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` is kind:start:end by start, then kind, in code points, end exclusive;
    the battery's have kind ``random``.  A null or empty text has none; rows that
    repeat are scanned alike, and count alike for false discoveries; an empty
    table gives no rows; other columns are not read.  Texts of any length are scanned
    whole, in time that follows their length and number of secrets.
    """
    found = found_spans(common.texts(docs))
    more = discoveries(found, q)
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(said(F.col("spans")), 256).alias("base_sha256"), said(F.array_sort(F.concat("spans", more))).alias("spans"),
    )


def redact_text(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, q: float = FALSE_SHARE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret's span replaced by ``mark``, and n_chars (if there)
    counted anew for the texts that change.  Null texts stay null; the schema stays.

    Texts are scanned once: rows wait with their spans in the shared folder until the
    rule is settled over all of them."""
    rows = docs.select(F.struct(*common.columns_of(docs)).alias("row"), F.col("text").cast("string").alias("text"))
    found = found_spans(rows)
    cut = found.select("row", F.concat("spans", discoveries(found, q)).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(0), batch.column(1).to_pylist()
            new = [t.as_py() if not s else redact_text(t.as_py(), [(x["start"], x["end"]) for x in s], mark) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), batch.column(2)], ["text", "row"])

    # Rows without secrets do not leave the JVM.
    clean = cut.where(F.size("spans") == 0).select("row.*")
    dirty = cut.where(F.size("spans") > 0).select("row.text", "spans", "row")
    changed = dirty.mapInArrow(run, StructType([StructField("text", StringType()), found.schema["row"]]))
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)
    columns = [new.get(c, F.col("row.`{}`".format(c.replace("`", "``")))).alias(c) for c in docs.columns]
    return clean.unionByName(changed.select(*columns))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return scan_secrets(common.documents(spark, sf_dir))
