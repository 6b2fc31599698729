import math
import random
import re
from collections import Counter

import numpy as np
from tests.llm.helpers import EDGES, documents, lowered, prose

from tidelake.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_force(docs, items, k):
    counted = [(i, Counter(TERM.findall(lowered(t or "")))) for i, t, *_ in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(TERM.findall(lowered(text or "")))
    out = []
    for item, terms in asked.items():
        found = []
        for doc_id, own in counted:
            if doc_id is None or not own:
                continue
            m = 100 - 25 + 25 * sum(own.values()) * n_docs // total
            score = 0
            for t, times in terms.items():
                if t in own:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (1000000000 * own[t] // (1000 * own[t] + 12 * m))
            if score > 0:
                found.append((-score, doc_id))
        out += [(item, rank + 1, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(found)[:k])]
    return sorted(out)


def found(spark, docs, items, k=20):
    items = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, term string, block int")
    return sorted(tuple(r) for r in ranked_search.search(documents(spark, docs), items, k).collect())


def corpus(rng, n=300):
    docs = [(i, prose(rng, rng.randrange(1, 60), 200)) for i in range(n)]
    copies = [(n + i, docs[7][1]) for i in range(60)]
    return docs + copies + [(3, docs[3][1]), (None, docs[5][1])]


def test_against_brute_force(spark):
    rng = random.Random(12)
    docs = corpus(rng)
    items = [(i, prose(rng, rng.randrange(1, 25), 200).upper()) for i in range(12)] + [(50, docs[7][1]), (50, "w1 w1 w1"), (None, "w1"), (51, None), (52, "nothing-here")]
    for k in (1, 20):
        assert found(spark, docs, items, k) == brute_force(docs, items, k)


def test_many_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCUMENTS", 40)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 3)
    rng = random.Random(13)
    docs = corpus(rng)
    items = [(i, prose(rng, 20, 200)) for i in range(10)]
    assert found(spark, docs, items, 5) == brute_force(docs, items, 5)


def test_edges(spark):
    items = [(1, "Many words, told é"), (2, ""), (3, " !? "), (4, "ñ a")]
    assert found(spark, EDGES, items) == brute_force(EDGES, items, 20)
    assert found(spark, [], items) == [] and found(spark, EDGES, []) == []
    assert found(spark, [(1, None), (2, " - ")], items) == []


def test_what_cannot_reach_the_kth_gets_no_accumulator():
    rng = np.random.default_rng(1)
    pa = ranked_search.pa
    docs = 200
    right = pa.table({"block": [0] * docs, "place": list(range(docs)), "n": rng.integers(5, 50, docs), "terms": [[7] if i < 30 else [] for i in range(docs)], "counts": [[1] if i < 30 else [] for i in range(docs)]})
    left = pa.table({"block": [0], "part": [0], "item_id": [1], "terms": [[7, 9]], "weights": [[9000, 10]], "docs": pa.array([[]], pa.list_(pa.int32())), "scores": pa.array([[]], pa.list_(pa.int64())), "ends": pa.array([[1, 2]], pa.list_(pa.int32()))})
    out = ranked_search._Owner(docs, 5000, 5)(left, right)
    assert 5 <= len(out["docs"][0]) < 30 and out["terms"].to_pylist() == [[9]] and out["ends"].to_pylist() == [[1]]
