import random

import corpus_pipeline
import pytest
from tests.llm.helpers import WORD, documents, prose
from tests.test_queries import DATA

import __spark_entry__ as entry
from tidelake.llm._common import staged, table

SMALL = DATA.replace("sf0.01", "sf0.001")


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = staged(stage(spark, docs, SMALL), name)
        assert after.columns == docs.columns, name
        counts.append(after.count())
        docs = after
    assert counts[0] > counts[1] > counts[2] >= counts[3] >= counts[4] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.select("doc_id").distinct().count() == counts[4]


def test_planted_cases(spark):
    """Exact and near copies, repeated passages and toxic documents among clean ones, stage by stage."""
    rng = random.Random(10)
    clean = [(10**6 + i, prose(rng, 150), "s") for i in range(30)]
    body, passage = prose(rng, 200).split(), prose(rng, 80)
    near = body.copy()
    near[10] = "changed"
    planted = [
        (2 * 10**6, " ".join(body), "s"),
        (2 * 10**6 + 1, " ".join(body), "s"),
        (2 * 10**6 + 2, " ".join(near), "s"),
        (3 * 10**6, f"{prose(rng, 90)} {passage}", "s"),
        (3 * 10**6 + 1, f"{passage} {prose(rng, 90)}", "s"),
        (4 * 10**6, "you idiot of a moron, stupid and pathetic " + prose(rng, 50), "s"),
    ]
    docs = table(spark, DATA, "documents")  # the smallest tables have too few labels to learn from
    docs = docs.unionByName(documents(spark, clean + planted).select(*docs.columns))
    stages = dict(corpus_pipeline.STAGES)
    kept = staged(stages["toxicity"](spark, docs, DATA).where("doc_id >= 1000000"), "planted")
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 4 * 10**6 not in ids and ids >= {i for i, _, _ in clean}
    kept = staged(stages["near_dedup"](spark, kept, SMALL), "planted")
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids & {2 * 10**6, 2 * 10**6 + 1, 2 * 10**6 + 2} == {2 * 10**6} and ids >= {i for i, _, _ in clean}
    kept = {r.doc_id: r.text for r in stages["substring_dedup"](spark, kept, SMALL).collect()}
    assert passage in kept[3 * 10**6] and passage not in kept[3 * 10**6 + 1]
    assert len(WORD.findall(kept[3 * 10**6 + 1])) < 90 + 30
    assert all(kept[i] == t for i, t, _ in clean)


def test_run_is_registered():
    assert entry.queries()["pipeline"] and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    assert {f"op{i}_" for i in range(1, 11)} <= {name[: name.index("_") + 1] for name in entry.queries() if name.startswith("op")}


@pytest.mark.parametrize("name", ["pipeline"])
def test_run(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0
