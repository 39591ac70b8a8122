"""The pipeline's near stage on planted near copies, against plain Python."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from pulsegrid.llm import shingle_dedup

from . import data


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^ \t-\r]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def planted(seed=3):
    """Texts, and copies of them with some words changed: similarity from 0.6 to 0.99."""
    rng = random.Random(seed)
    word = lambda: f"{rng.choice(data.WORDS)}{rng.randrange(500)}"
    texts = []
    for n in (20, 60, 150, 400):
        for changes in (1, 2, 4, 8, 16):
            words = [word() for _ in range(n)]
            copy = words[:]
            at = rng.randrange(max(1, n - changes))
            copy[at : at + changes] = [word() for _ in range(changes)]
            texts += [" ".join(words), " ".join(copy).upper()]
    hub = [word() for _ in range(200)]  # copies near the hub, but not near each other
    texts.append(" ".join(hub))
    for i in range(12):
        copy = hub[:]
        for at in range(5 + i, 200, 50):
            copy[at] = word()
        texts.append("\n".join(copy))
    texts += ["", " \n", None, "one", "ONE ", "a b c d", "a b c e"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(1000 + order[i], t, "en", "s", 0) for i, t in enumerate(texts)]


def wanted(rows):
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and similarity(rows[i][1], rows[j][1]) >= 0.8:
                root = [root[j] if x == root[i] else x for x in root]
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return sorted(least.values())


def test_planted_near_copies_go(spark):
    rows = planted()
    high = [similarity(a[1], b[1]) for i, a in enumerate(rows) for b in rows[:i]]
    assert sum(0.8 <= s < 0.95 for s in high) >= 10 and any(0.7 < s < 0.8 for s in high)
    out = corpus_pipeline.near(spark, spark.createDataFrame(rows, data.SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == wanted(rows)


def test_shared_passages(spark):
    """Texts that share a passage and are not near, every second with a copy at 0.8 to
    0.9, and texts of one repeated shingle, which differ by their sets."""
    rng = random.Random(12)
    word = lambda: f"{rng.choice(data.WORDS)}{rng.randrange(500)}"
    passage = [word() for _ in range(150)]
    texts = []
    for _ in range(12):
        own = passage + [word() for _ in range(90)]
        texts += [" ".join(own), " ".join(own[:-12] + [word() for _ in range(12)])]
    texts += [("a b c d e " * 60) + " ".join(word() for _ in range(8)) for _ in range(3)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    near = shingle_dedup.near_rows(spark.createDataFrame(rows, data.SCHEMA))
    assert sorted(r.doc_id for r in near.where("kept").collect()) == wanted(rows)


def test_prefixes_miss_no_pair(spark):
    """Every pair at 0.8 or more of different components, whatever the components are."""
    rng = random.Random(5)
    pool = [[str(rng.randrange(60)) for _ in range(rng.randrange(20, 40))] for _ in range(6)]
    texts = set()
    for _ in range(200):
        words = rng.choice(pool)[:]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = str(rng.randrange(60))
        texts.add(" ".join(words[: len(words) - rng.randrange(4)]))
    texts = sorted(texts)
    size = [shingle_dedup.signature(t)[0] for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "text_hash long, text string")
    for roots in ([i for i in range(len(texts))], [rng.randrange(5) for _ in texts]):
        named = spark.createDataFrame(list(zip(range(len(texts)), size, roots)), "text_hash long, n long, root long")
        got = {(r.a, r.b) for r in shingle_dedup._prefix_pairs(named, rows).collect()}
        high = {(i, j) for j in range(len(texts)) for i in range(j) if roots[i] != roots[j] and similarity(texts[i], texts[j]) >= 0.8}
        assert len(high) > 50 and high <= got and all(roots[a] != roots[b] for a, b in got)


def test_templates_make_no_pairs(spark):
    """Texts of 220 words that share 180 of them: 0.69, so none is near."""
    rng = random.Random(6)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(180))
    rows = spark.createDataFrame([(i, passage + "".join(f" own{rng.randrange(10**9)}" for _ in range(40))) for i in range(300)], "text_hash long, text string")
    named = spark.createDataFrame([(i, 216, i) for i in range(300)], "text_hash long, n long, root long")
    assert shingle_dedup._prefix_pairs(named, rows).count() == 0


def test_near_of_nothing(spark):
    assert corpus_pipeline.near(spark, spark.createDataFrame([], data.SCHEMA), "").count() == 0


def test_bands_meet_at_the_limit():
    rng = random.Random(8)
    for n in (36, 90, 720):
        for _ in range(50):
            words = [str(rng.random()) for _ in range(n + 4)]
            copy = [str(rng.random()) for _ in range(n // 9)] + words[n // 9 :]
            assert similarity(" ".join(words), " ".join(copy)) >= 0.8
            a, b = (shingle_dedup.signature(" ".join(x)) for x in (words, copy))
            assert a[0] == b[0] == n and (a[2] == b[2]).any()
