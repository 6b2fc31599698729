import hashlib
import random

import numpy as np
from tests.llm.helpers import EDGES, documents, prose
from tests.test_queries import DATA

from tidelake.llm import syncmers
from tidelake.llm._common import table


def as_bytes(text):
    return np.frombuffer(text.encode(), np.uint8)


def test_choice_depends_on_the_k_mer_alone():
    data = as_bytes(prose(random.Random(1), 300) + " é" * 20 + "aaaaaaaaaaaaaaaaaaaaaaaaaa")
    alone = [i for i in range(len(data) - syncmers.K + 1) if len(syncmers.closed_syncmers(data[i : i + syncmers.K]))]
    assert syncmers.closed_syncmers(data).tolist() == alone
    assert 0.1 < len(alone) / len(data) < 0.4


def test_anchors_are_the_smallest_with_their_first_place():
    data = as_bytes(prose(random.Random(2), 3000, 50))
    at = syncmers.closed_syncmers(data)
    first = {}
    for i in at.tolist():
        first.setdefault(data[i : i + syncmers.K].tobytes(), i)
    single = {int(syncmers.anchors(np.frombuffer(k, np.uint8))[0, 0]): i for k, i in first.items()}
    assert syncmers.anchors(data).tolist() == [[h, single[h]] for h in sorted(single)[: syncmers.ANCHORS]]


def test_likeness():
    rng = random.Random(3)
    a, b = prose(rng, 500), prose(rng, 500)
    f = lambda t: syncmers.from_text(syncmers.fingerprint(t))
    assert syncmers.likeness(f(a), f(a)) == 1 and syncmers.likeness(f(a), f(b)) < 0.1
    assert syncmers.likeness(f(a), f("put in front " + a)) > 0.9  # one offset
    assert syncmers.likeness(f(""), f(None)) == 1 and syncmers.likeness(f(""), f("a")) == 0
    assert syncmers.fingerprint("tiny") != syncmers.fingerprint("tine") and len(syncmers.fingerprint("tiny")) == 16


def plain(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, after = (syncmers.anchors(as_bytes(t)) for t in (text, edited, following))
        out.append(
            (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), syncmers.to_text(own), syncmers.to_text(changed),
             syncmers.likeness(own, changed), syncmers.likeness(own, after))
        )
    return sorted(out, key=repr)


def test_all_documents_and_their_next(spark):
    docs = table(spark, DATA, "documents")
    got = sorted((tuple(r) for r in syncmers.fingerprints(docs).collect()), key=repr)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert np.mean([r[5] for r in got]) > 0.35 > 0.05 > np.mean([r[6] for r in got])


def test_edges(spark):
    for rows in (EDGES, [(1, "alone")], [(1, None)], [(3, "same"), (3, "same"), (3, "other")], [(-5, "a"), (2**60, "b"), (2**60 + 1, "c")]):
        assert sorted((tuple(r) for r in syncmers.fingerprints(documents(spark, rows)).collect()), key=repr) == plain(rows)
    assert syncmers.fingerprints(documents(spark, [])).count() == 0
