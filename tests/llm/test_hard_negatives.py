"""Hard negatives against brute force: ties, copies, odd vectors, small blocks, and what is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, key string, size string"


def vectors(n=260, size=12, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (4, size))
    rows = [(i, i % 4, [float(x) for x in (centres[i % 4] + rng.normal(0, 0.2, size)).astype(np.float32)], "k", None) for i in range(n)]
    rows += [(1000 + i, i % 2, rows[50][2], "k", None) for i in range(40)]  # copies, of two labels
    rows += [(2000, 1, None, "k", None), (2050, None, rows[0][2], "k", None), (2100, 1, [float("nan")] * size, "k", None)]
    rows += [(2150, 1, [None] * size, "k", None), (2200, 3, [1.0, 2.0], "k", None), (2201, 3, [0.5, 2.0], "k", None)]
    rows += [(2202, 1, [0.4, 1.0], "k", None), (2250, 2, [0.0] * size, "k", None), (2300, 2, [], "k", None), (2301, 2, [], "k", None)]
    rows += [(2302, 1, [], "k", None), rows[3], (None, 1, rows[4][2], "k", None), (2350, 9, rows[5][2], "k", None)]
    return rows


def brute(rows, step, k, wanted):
    known = {
        (i, label): np.floor(np.array(v, np.float64) * 256).astype(int)
        for i, label, v, *_ in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    }
    out = []
    for (a, label), q in known.items():
        if a % step:
            continue
        scored = sorted((-int(q @ v), i, other) for (i, other), v in known.items() if i != a and len(v) == len(q))
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fits = [x for x in scored if x[2] != label and -50 * s <= -100 * x[0] <= -95 * s][:wanted]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("block", "anchor_block"), [(16_384, 2_048), (48, 3)])
def test_hard_negatives(spark, block, anchor_block):
    data = vectors()
    rows = hn.labelled_vectors(spark.createDataFrame(data, SCHEMA), 256)
    got = hn.hard_negatives(rows, F.col("id") % 50 == 0, block=block, anchor_block=anchor_block)
    want = brute(data, 50, 5, 3)
    assert sorted(map(tuple, got.collect())) == want
    assert len({r[0] for r in want}) > 8


def test_empty_and_without_anchors(spark):
    none = hn.labelled_vectors(spark.createDataFrame([], SCHEMA), 256)
    assert hn.hard_negatives(none, F.col("id") % 50 == 0).count() == 0
    some = hn.labelled_vectors(spark.createDataFrame(vectors(), SCHEMA), 256)
    assert hn.hard_negatives(some, F.col("id") < 0).count() == 0


def test_repeated_rows_and_ids(spark):
    """Equal rows count once; another vector of the same id is a row, but no partner of that id."""
    rows = [(50, 1, [1.0, 0.0], "", "")] * 3 + [(50, 1, [0.9, 0.0], "", ""), (1, 1, [1.0, 0.0], "", ""), (2, 0, [0.7, 0.0], "", "")]
    got = hn.hard_negatives(hn.labelled_vectors(spark.createDataFrame(rows, SCHEMA), 256), F.col("id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == [(50, 1, 1, 2, 58880, 41170), (50, 1, 1, 2, 65536, 45824)]


def test_bitmap_shrinks():
    """Far rows are dropped before all of their components are read, and none that matters."""
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 8, 4_000)
    data = np.floor((rng.normal(0, 1, (8, 64))[labels] + rng.normal(0, 0.2, (4_000, 64))) * 64)
    block = hn.Columns(np.arange(4_000), labels, data)
    for a in range(0, 4_000, 200):
        query = data[a]
        ids, scores = hn.nearest_of_label(block, a, labels[a], query, 5)
        exact = (data @ query).astype(int)
        same = [i for i in np.lexsort((np.arange(4_000), -exact)) if labels[i] == labels[a] and i != a][:5]
        assert ids.tolist() == same and scores.tolist() == exact[same].tolist()
        low, high = np.ceil(scores[:1] * 0.5), np.floor(scores[:1] * 0.95)
        ((found, _),) = hn.best_in_windows(block, a, labels[a], query, low, high, 3)
        fits = [i for i in np.lexsort((np.arange(4_000), -exact)) if labels[i] != labels[a] and low[0] <= exact[i] <= high[0]][:3]
        assert found.tolist() == fits
    assert block.read < 0.75 * block.all


def test_scores_that_are_not_exact_are_refused():
    import pandas as pd

    rows = pd.DataFrame({"id": [0, 1], "label": [0, 0], "vec": [np.array([2**30]), np.array([2**24])]})
    with pytest.raises(OverflowError):
        hn.stacked(rows, hn.block_of(rows))
