import heapq
import random

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import EDGES, WORD, documents, prose
from tests.test_queries import DATA

from tidelake.llm import mixing
from tidelake.llm._common import table


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, targets = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return targets | {s: level * weight[s] for s in open_}
        for s in over:
            targets[s] = 2 * sizes[s]
            left -= targets[s]
        open_ -= over
    return targets


def sizes_of(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    return sizes


def check(spark, rows, plan, slack):
    sizes = sizes_of(rows)
    targets = plain_targets(sizes)
    of = {}
    for i, _, source in rows:
        of.setdefault(i, source)
    taken = dict.fromkeys(sizes, 0)
    for r in plan:
        source = of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source])
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= slack(target)


def test_all_documents(spark):
    docs = table(spark, DATA, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    plan = mixing.plan(docs).collect()
    assert sorted(r.doc_id for r in plan) == sorted(i for i, _, _ in rows)
    check(spark, rows, plan, lambda target: 0.01 * target + 2 * mixing.BLOCK_WORDS)
    again = mixing.plan(docs.repartition(7, F.rand(3))).collect()  # the same rows, spread in another way
    assert sorted(plan) == sorted(again)


def test_edges(spark):
    rng = random.Random(4)
    rows = [(i, t, "s") for i, t in EDGES] + [(100 + i, prose(rng, 400), rng.choice(["a", "B", "é", "", None])) for i in range(40)]
    docs = documents(spark, rows)
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(rows)
    check(spark, rows, plan, lambda target: 0.02 * target + 2 * mixing.BLOCK_WORDS)
    assert mixing.plan(documents(spark, [])).count() == 0


def test_only_empty_texts_take_nothing(spark):
    assert {r.taken for r in mixing.plan(documents(spark, [(1, None), (2, "")])).collect()} == {0}
    assert mixing.mix(documents(spark, [(1, None), (2, "")])).count() == 0


def test_mix_gives_the_taken_words(spark):
    docs = table(spark, DATA, "documents")
    plan = {r.doc_id: r for r in mixing.plan(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert {r.doc_id for r in rows} == {i for i, r in plan.items() if r.taken}
    for r in rows:
        words, own = WORD.findall(r.text), WORD.findall(texts[r.doc_id])
        assert len(words) == plan[r.doc_id].taken and r.n_chars == len(r.text)
        assert set(words) <= set(own)
        if plan[r.doc_id].taken == len(own):
            assert r.text == texts[r.doc_id]


def by_quotients(weights, seats):
    heap, won = [(-w, k) for k, w in enumerate(weights) if w], [0] * len(weights)
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, k = heapq.heappop(heap)
        won[k] += 1
        heapq.heappush(heap, (-weights[k] / (2 * won[k] + 1), k))
    return won


def test_apportion_is_by_highest_quotients(spark):
    rng = random.Random(5)
    cases = [([rng.choice([0, 1, 1, 2, 5, 13, 40]) for _ in range(12)], seats) for seats in (0, 1, 7, 100)]
    # One large and many small: shares below a half, above a half, and ties that only the keys decide.
    cases += [([9_600_000] + [20] * 1000, 300_625), ([100] + [0.4] * 1000, 500), ([3] * 300, 100), ([0, 0], 5), ([7], 3)]
    cases += [([rng.paretovariate(0.5) for _ in range(400)], seats) for seats in (3, 390, 20_000)]
    rows = [(g, k, float(w), seats) for g, (weights, seats) in enumerate(cases) for k, w in enumerate(weights)]
    frame = spark.createDataFrame(rows, "g int, k int, w double, seats long")
    got = {(r.g, r.k): r.won for r in mixing.apportion(frame, ["g"], "k", "w", "seats", "won").collect()}
    assert len(got) == len(rows)
    for g, (weights, seats) in enumerate(cases):
        assert [got[g, k] for k in range(len(weights))] == by_quotients(weights, seats), g
    whole = mixing.apportion(frame.where("g = 5"), [], "k", "w", "seats", "won")
    assert [r.won for r in whole.orderBy("k").collect()] == by_quotients(*cases[5])
