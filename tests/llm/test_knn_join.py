import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm.knn_join import quantized, top_k_search


def brute(rows, asked, k):
    out = []
    for q, v in asked.items():
        scores = sorted((-int(np.dot(np.array(v, object), np.array(w, object))), i) for i, w in rows if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("big,options", [(1, {}), (1, {"group": 3, "block": 7, "most_pivots": 9}), (1, {"group": 1, "block": 50}), (2**22, {"group": 9}), (2**28, {"group": 9})])
def test_against_brute(spark, big, options):
    r = np.random.default_rng(1)
    centres = r.integers(-60, 60, (5, 8))
    rows = [(int(i), [int(x) * big for x in centres[i % 5] + r.integers(-9, 9, 8)]) for i in range(200)]
    rows += [(i, rows[50][1]) for i in range(300, 340)] + [(40, rows[41][1]), (41, rows[41][1])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    asked = {}
    for i, v in rows:
        if i % 10 == 0:
            asked[i] = min(v, asked.get(i, v))
    if big == 2**28:  # scores past 2**62 are refused by 64 bits, not wrapped
        rows = [(i, [x // 2**6 for x in v]) for i, v in rows]
        asked = {i: [x // 2**6 for x in v] for i, v in asked.items()}
        df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = top_k_search(df, df.filter("vec_id % 10 = 0"), 5, **options).collect()
    assert sorted(map(tuple, got)) == brute(rows, asked, 5)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (50, [0.5, -0.1]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, []), (6, [1.0, 2.0, 3.0]), (7, [-0.001, 3.0]), (7, [-0.001, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("g", "b", "cell", "score")})
    v = df.select("*", quantized("embedding").alias("vector"))
    some = [(i, [*x, *[0.0] * (3 - len(x))]) for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
    f = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int).tolist()) for i, x in some]
    want = brute(f, {0: f[0][1], 50: f[1][1]}, 5)
    assert len(f) == 6 and sorted(map(tuple, top_k_search(v, v.filter("vec_id % 50 = 0"), 5).collect())) == want
    assert top_k_search(v.limit(0), v, 5).count() == 0
    assert top_k_search(v, v.limit(0), 5).count() == 0
    assert top_k_search(v.limit(1), v.limit(1), 5).count() == 0
