import numpy as np
import pyarrow as pa
import pytest
from tests.llm.helpers import EDGES, documents
from tests.test_queries import DATA

from tidelake.llm import quality, queries
from tidelake.llm._common import table


def test_held_out_accuracy(spark):
    scored = queries.op6_quality_machine(spark, DATA)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = table(spark, DATA, "labels").select("doc_id", "quality")
    rows = scored.join(labels, "doc_id").where("held_out and quality is not null").collect()
    low, high = [r.score for r in rows if r.quality == 0], [r.score for r in rows if r.quality == 1]
    assert np.mean([a < b for a in low for b in high]) > 0.98
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_pairs_in_linear_time_equal_all_pairs():
    rng = np.random.default_rng(1)
    machine = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    for _, offsets, numbers, values in quality.features(pa.array(["Some words, some words!", None, "É 1"]), pa.array([20, None, -1])):
        got = quality.margins(machine, offsets, numbers, values)
        for i in range(3):
            n, x = numbers[offsets[i] : offsets[i + 1]], values[offsets[i] : offsets[i + 1]]
            assert len(set(n.tolist())) == len(n)
            pairs = sum(machine.factors[n[a]] @ machine.factors[n[b]] * x[a] * x[b] for a in range(len(n)) for b in range(a))
            assert got[i] == pytest.approx(0.3 + machine.linear[n] @ x + pairs, rel=1e-4)


def test_edges(spark):
    docs = documents(spark, EDGES)
    labels = spark.createDataFrame([(1, 0), (4, 1), (6, None), (None, 1), (7, 1), (7, 0)], "doc_id long, quality int")
    machine = quality.fit(docs, labels)
    rows = quality.score_documents(docs, machine).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.quality_score <= 1 for r in rows)
    assert len({r.quality_score for r in rows if r.doc_id == 7}) == 1
    none = documents(spark, [])
    empty = quality.fit(none, labels.where("false"))
    assert quality.score_documents(none, empty).count() == 0
    assert quality.score_documents(docs, empty).count() == len(EDGES)


def test_sample_is_bounded_and_leaves_the_held_out_alone(spark):
    from tidelake.llm._common import held_out, training_rows

    docs = documents(spark, [(i, f"text {i}") for i in range(200)])
    labels = docs.selectExpr("doc_id", "1 as quality")
    chosen = training_rows(docs, labels, "quality", 50)
    assert chosen.count() == 50 and chosen.where(held_out()).count() == 0


def test_training_rows_are_bounded_where_ids_repeat(spark):
    from tidelake.llm._common import held_out, training_rows

    docs = documents(spark, [(i, f"text {i}") for i in range(40)] + [(1, "copy")] * 500 + [(2, "pair")])
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    kept = lambda n: [r.doc_id for r in training_rows(docs, labels, "quality", n).collect()]
    free = {r.doc_id for r in labels.where(~held_out()).collect()}
    for bound in (2, 10, 100):
        assert len(kept(bound)) <= bound
    assert set(kept(100)) == free - {1} and set(kept(1000)) == free and len(kept(1000)) == len(free) + 500 * (1 in free) + (2 in free)


def test_a_column_named_like_the_score_is_replaced(spark):
    docs = documents(spark, [(i, f"some text of row {i}") for i in range(20)])
    machine = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"))
    scored = quality.score_documents(docs, machine, "score")
    assert scored.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in scored.select("score").collect())
