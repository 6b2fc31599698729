import random

from tests.llm.helpers import EDGES, WORD, documents, lowered, prose
from tests.test_queries import DATA

from tidelake.llm import near_dedup, queries
from tidelake.llm._common import table
from tidelake.llm.components import components


def shingles(text, k):
    words = WORD.findall(lowered(text or ""))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def plain(rows, k, percent=80):
    """(n, component, kept) by id, with all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, own in sorted(sets.items()):
        for j in {j for s in own for j in holders.get(s, ())}:
            both = len(own & sets[j])
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in own:
            holders.setdefault(s, []).append(i)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def check(frame, rows, k):
    want = plain(rows, k)
    found = frame.collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]


def test_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    check(queries.op8_minhash_near_dedup(spark, DATA), rows, 2)


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_groups_chains_and_common_parts(spark):
    rng = random.Random(6)
    rows = []
    base = prose(rng, 300).split()
    for _ in range(40):  # near copies around the threshold
        rows.append(edited(rng, base, rng.choice([0.005, 0.02, 0.05])))
    step = prose(rng, 200).split()
    for _ in range(12):  # a chain: each is near to the one before
        step = edited(rng, step, 0.05)
        rows.append(step)
    common = prose(rng, 60).split()
    for _ in range(40):  # much in common, but not enough
        rows.append(common + prose(rng, rng.randrange(20, 60)).split())
    for n in (1, 2, 3, 4, 5, 6, 50, 51, 52, 63, 64, 65, 80):  # small sets, whole in the sketch or just not
        own = [f"x{n}_{i}" for i in range(n)]
        rows += [own, [*own, "more"], own[:-1]]
    rows += [rows[0], rows[5]]  # exact copies
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rng.shuffle(rows)
    docs = documents(spark, EDGES + [(100 + i, t) for i, t in rows])
    check(near_dedup.near_duplicates(docs, 2, 80), EDGES + [(100 + i, t) for i, t in rows], 2)


def test_two_that_meet_under_a_hub_that_is_like_neither(spark):
    rows = [(1, "a b z"), (2, "a b c d e"), (3, "a b c d e f")]
    rows += [(10 + i, f"{pair} u{i}") for i, pair in enumerate(p for p in ("b z", "b c", "c d", "d e") for _ in range(3))]
    found = near_dedup.near_duplicates(documents(spark, rows), 2, 80)
    check(found, rows, 2)
    assert {r.doc_id: r.component_id for r in found.collect()}[3] == 2


def test_five_words_by_default_and_all_columns_stay(spark):
    rows = [*EDGES, (50, "a b c d e f g"), (51, "A b c d e f g"), (52, "a b c d e f h")]
    docs = documents(spark, rows)
    check(near_dedup.near_duplicates(docs), rows, 5)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, _ in rows if i != 51)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
