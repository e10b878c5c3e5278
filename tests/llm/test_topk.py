import math

import numpy as np
import pytest

from cubespark.llm import topk


def brute(rows, queries, k):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)

    q = lambda v: [math.floor(256 * float(x)) for x in v]
    good = [(i, q(v)) for i, v in rows if i is not None and ok(v)]
    out = []
    for i, v in [(i, q(v)) for i, v in queries if i is not None and ok(v)]:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(v) == len(w))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=5, every=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")
    got = topk.top_k(df, df.where(f"vec_id % {every} = 0"), k)
    plain = [(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]]) for r in rows]
    asked = [r for r in plain if r[0] is not None and r[0] % every == 0]
    assert sorted(map(tuple, got.collect())) == brute(plain, asked, k)


def test_against_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(0, 0.2, 12).astype(float).tolist(), None, "x") for i in range(400)]
    run(spark, rows)


def test_ties_nulls_lengths_and_odd_values(spark):
    rows = [(i, [0.25, -0.5, 0.0], 1, None) for i in range(30)]
    rows += [(40, None, 1, None), (41, [], 1, None), (42, [None, 1.0, 2.0], 1, None), (None, [1.0, 1.0, 1.0], 1, None)]
    rows += [(43, [float("nan"), 0.0, 0.0], 1, None), (45, [float("inf"), 0.0, 0.0], 1, None)]
    rows += [(48, [1.0, 2.0], 1, None), (49, [3.0, -2.0], 1, None), (51, [0.0, 0.0, 0.0], 1, None), (54, [900.0, -700.5, 3.0], 1, None)]
    run(spark, rows)


def test_few_rows_and_empty_table(spark):
    run(spark, [(0, [0.1, 0.2], 1, None), (1, [0.3, 0.4], 1, None)])
    run(spark, [(3, [0.1], 1, None)])
    run(spark, [])


def test_bitmaps(spark):
    draw = np.random.default_rng(2)
    values = draw.integers(-300, 300, (130, 7))
    index = topk.Index(np.arange(130), values)
    for q in draw.integers(-300, 300, (20, 7)):
        ids, scores = index.search(-1, q, 9)
        want = sorted(zip((-(values @ q)).tolist(), range(130)))[:9]
        assert sorted(zip((-scores).tolist(), ids.tolist())) == want


def test_components_beyond_exact_sums_are_refused():
    with pytest.raises(ValueError):
        topk.Index(np.array([1]), np.array([[1 << 30]]))
