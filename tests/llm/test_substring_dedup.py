import random

import numpy as np
import pyarrow as pa
from tests.llm.helpers import EDGES, WORD, documents, prose

from tidelake.llm import substring_dedup as sd


def removed(spark, rows):
    docs = documents(spark, rows)
    out = sd.remove_repeats(docs)
    assert out.columns == [*docs.columns, "n_removed"]
    found = out.collect()
    assert len(found) == len(rows)
    return found


def contains(text, passage):
    words, part = WORD.findall(text or ""), WORD.findall(passage)
    return any(words[i : i + len(part)] == part for i in range(len(words)))


def test_gear_hash_is_rolling():
    data = np.frombuffer(prose(random.Random(1), 50).encode(), np.uint8)
    window = 1 << sd.DOUBLINGS
    for i in (20, 77, len(data) - 1):
        h = 0
        for b in data[i - window + 1 : i + 1]:
            h = (h * 2 + int(sd._GEAR[b])) & 0xFFFFFFFF
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        assert int(sd.gear_hash(data)[i]) == h ^ (h >> 13)


def test_cuts_fall_in_the_same_places_after_an_insertion():
    text = prose(random.Random(2), 400)
    cut = lambda t: {t.encode()[s[a] : e[b - 1]] for _, s, e, at, _ in sd.chunks(pa.array([t])) for a, b in zip(at[:-1], at[1:], strict=True)}
    before = cut(text)
    for changed in ("one more " + text, text[:700] + " in between" + text[700:], text.replace("w1", "w", 1)):
        assert len(before - cut(changed)) <= 4


def test_chunks_cover_all_words_and_are_not_too_long():
    for text in (prose(random.Random(3), 500), "same " * 1000, "x" * 5000, "a"):
        ((_, starts, _, at, digests),) = sd.chunks(pa.array([text]))
        assert at[0] == 0 and at[-1] == len(starts) == len(WORD.findall(text)) and len(digests) == len(at) - 1
        assert np.diff(at).min() >= 1 and np.diff(at).max() <= sd.LONGEST


def test_repeated_passages_stay_once_and_clean_texts_are_left_alone(spark):
    rng = random.Random(4)
    passages = [prose(rng, n) for n in (51, 55, 60, 70, 90, 120) for _ in range(5)]
    rows, i = [], 0
    for passage in passages:
        for _ in range(rng.randrange(2, 5)):
            rows.append((i, f"{prose(rng, rng.randrange(0, 80))} {passage}\n{prose(rng, rng.randrange(0, 80))}"))
            i += 1
    clean = [(1000 + j, prose(rng, 200)) for j in range(50)]
    rng.shuffle(rows)
    found = {r.doc_id: r for r in removed(spark, rows + clean)}
    texts = dict(rows + clean)
    for passage in passages:
        holders = sorted(j for j, t in texts.items() if contains(t, passage))
        assert [j for j in holders if contains(found[j].text, passage)] == holders[:1]
        for j in holders[1:]:
            left = WORD.findall(found[j].text)
            assert len(left) == len(WORD.findall(texts[j])) - found[j].n_removed and found[j].n_chars == len(found[j].text)
            assert found[j].n_removed >= len(WORD.findall(passage)) - 30
    assert all(found[j].text == t and found[j].n_removed == 0 for j, t in clean)


def test_short_repeats_stay(spark):
    rng = random.Random(5)
    line = prose(rng, 15)
    rows = [(i, f"{prose(rng, 60)}\n{line}\n{prose(rng, 60)}") for i in range(20)]
    assert all(r.n_removed == 0 for r in removed(spark, rows))


def test_chunks_that_come_from_many_documents_stay(spark):
    rng = random.Random(7)
    text = prose(rng, 200)
    ((_, starts, ends, at, _),) = sd.chunks(pa.array([text]))
    parts = [text[starts[a] : ends[b - 1]] for a, b in zip(at[:-3], at[3:], strict=True)]  # each has three chunks, the middle one whole
    rows = [(i, f"{prose(rng, 40)} {part} {prose(rng, 40)}") for i, part in enumerate(parts) if len(part.split()) < sd.LEAST_WORDS]
    found = {r.doc_id: r for r in removed(spark, [*rows, (1000, text), (1001, text)])}
    assert found[1000].n_removed == 0 and found[1000].text == text and found[1001].n_removed > 170


def test_windows_are_alike_wherever_they_stand():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 1 << 60, 30)
    sizes = rng.integers(3, 9, 30)
    tell = lambda d, n: {tuple(d[x:y]): h for x, y, h in zip(*sd.windows(np.concatenate([[0], np.cumsum(n)]), d, 20), strict=True)}
    whole, part = tell(digests, sizes), tell(digests[7:], sizes[7:])
    assert part and all(whole[k] == h for k, h in part.items()) and len(set(whole.values())) == len(whole)


def test_within_one_document_and_whole_copies(spark):
    rng = random.Random(6)
    passage = prose(rng, 100)
    found = {r.doc_id: r for r in removed(spark, [(1, f"{passage}\n{passage}"), (2, passage), (3, prose(rng, 100))])}
    assert 60 < found[1].n_removed < 125 and found[2].n_removed > 80 and found[3].n_removed == 0


def test_edges(spark):
    found = removed(spark, EDGES)
    for r, (i, text) in zip(sorted(found, key=lambda r: (r.doc_id or 0, r.text or "")), sorted(EDGES, key=lambda r: (r[0] or 0, r[1] or "")), strict=True):
        if i != 6:
            assert (r.doc_id, r.text, r.n_removed) == (i, text, 0)
        else:
            assert 0 < r.n_removed < 60_000 and r.text  # long, and all alike
    assert removed(spark, []) == []
