import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelake.llm import topk


def plain(ids, rows, query_ids, queries, k):
    out = []
    for q, v in zip(query_ids, queries, strict=True):
        scores = sorted((-int(np.dot(v, r)), int(i)) for i, r in zip(ids, rows, strict=True) if i != q)
        out += [(int(q), rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return out


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10**6), st.integers(1, 120), st.integers(1, 8), st.integers(1, 6), st.sampled_from([1, 3, 1000]))
def test_threshold_algorithm_is_exact(seed, n, d, k, spread):
    rng = np.random.default_rng(seed)
    ids, rows = np.sort(rng.choice(500, n, replace=False)), rng.integers(-spread, spread + 1, (n, d))
    asked = rng.integers(0, n, 5)
    query, row, score = topk.threshold_top_k(ids, rows, ids[asked], rows[asked], k)
    for i, a in enumerate(asked):
        want = plain(ids, rows, [ids[a]], [rows[a]], k)
        got = [(int(ids[a]), rank, int(ids[r]), int(s)) for rank, (r, s) in enumerate(zip(row[query == i], score[query == i], strict=True), 1)]
        assert got == want


def test_skewed_lists_stop_early():
    rng = np.random.default_rng(1)
    rows = np.zeros((4000, 16), np.int64)
    rows[:, 0] = rng.integers(0, 10**6, 4000)
    query, row, _ = topk.threshold_top_k(np.arange(4000), rows, np.array([-1]), rows[:1] * 0 + 1, 5)
    assert row.tolist() == np.argsort(-rows[:, 0], kind="stable")[:5].tolist()


@pytest.mark.parametrize("blocks", [(8192, 512), (7, 3)])
def test_blocks_ties_and_odd_rows(spark, blocks):
    rng = np.random.default_rng(2)
    good = [(int(i), rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    bad = [(60, None), (80, [1.0, None]), (100, [float("nan")]), (None, [1.0]), (120, [float("inf"), 1.0]), (7, [1.0, 1.0, 1.0, 1.0]), (140, [])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], "vec_id long, embedding array<float>, score int, cell int")
    vectors = frame.select("vec_id", topk.whole_components(F.col("embedding"), 1).alias("vector"))
    got = [tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 5, *blocks).orderBy("query_id", "rank").collect()]
    sound = [(i, [int(x) for x in v] + [0] * (4 - len(v))) for i, v in [*good, bad[5], bad[6]]]
    ids, rows = [i for i, _ in sound], np.array([v for _, v in sound])
    asked = [j for j, i in enumerate(ids) if i % 20 == 0]
    assert got == plain(ids, rows, [ids[j] for j in asked], rows[asked], 5)


def test_fewer_rows_than_k_and_empty_tables(spark):
    frame = spark.createDataFrame([(0, [1]), (1, [2])], "vec_id long, vector array<long>")
    assert [tuple(r) for r in topk.top_k(frame, frame.where("vec_id = 0"), 20).collect()] == [(0, 1, 1, 2)]
    empty = frame.where("false")
    assert topk.top_k(empty, empty, 3).count() == 0 and topk.top_k(frame, empty, 3).count() == 0


def test_sums_beyond_doubles():
    rows = np.array([[2**30 + 1, 0], [2**30, 1], [5, 5]])
    query, row, score = topk.threshold_top_k(np.arange(3), rows, np.array([9]), np.array([[2**30 + 1, 2**29]]), 2)
    assert score.tolist() == [(2**30 + 1) ** 2, 2**30 * (2**30 + 1) + 2**29] and row.tolist() == [0, 1]
