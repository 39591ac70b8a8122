"""The dedup stages keep one row of each group, whatever its ids."""

from __future__ import annotations

import random

import corpus_pipeline

from . import data


def test_one_row_of_each_group(spark):
    rng = random.Random(6)
    one, two, three = (data.prose(rng, 80) for _ in range(3))
    near = two + " end"
    rows = [
        (1, one, "en", "a", 1), (1, one, "en", "a", 1), (1, one, "de", "b", 2),  # a table loaded twice
        (None, three, "en", "b", 1), (None, three, "en", "a", 2), (None, three, None, "a", 2),
        (5, two, "en", "a", 1), (5, near, "en", "a", 1),  # near texts under one id
        (7, None, "en", "a", 1), (7, "", "en", "a", 0), (7, "", "en", "a", 0),
    ]
    docs = spark.createDataFrame(rows, data.SCHEMA)
    exact = corpus_pipeline.exact(spark, docs, "")
    assert exact.columns == docs.columns
    want = [(1, one, "de", "b", 2), (None, three, None, "a", 2), (5, two, "en", "a", 1), (5, near, "en", "a", 1), (7, None, "en", "a", 1)]
    assert sorted(map(tuple, exact.collect()), key=repr) == sorted(want, key=repr)
    for source in (exact, docs):
        kept = [tuple(r) for r in corpus_pipeline.near(spark, source, "").collect()]
        assert len(kept) == 4 and {r[0] for r in kept} == {1, None, 5, 7}
        assert {want[0], want[1]} < set(kept) and sum(r[1] in (two, near) for r in kept) == 1
