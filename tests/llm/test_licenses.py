import re
from collections import Counter

from tests.llm.helpers import EDGES, documents, lowered
from tests.test_queries import DATA

from tidelake.llm import licenses
from tidelake.llm._common import table

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def plain(text):
    words = TOKEN.findall(lowered(text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def check(frame, texts):
    rows = frame.collect()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    return rows


def test_base_on_all_documents(spark):
    docs = table(spark, DATA, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = check(licenses.scan(docs), texts)
    assert len(rows) == len(texts) and sum(r.n_base for r in rows) > 10


def test_places_edges_and_repeated_rows(spark):
    extra = [
        (20, "MIT License mit license; the MIT\nLicense"),
        (21, "Apache-License general public license"),
        (22, "general public general public license"),
        (23, "mitlicense summit license mit licenses"),
        (24, "apache license " * 5000),
        (25, "Straße MİT license ümit license mit license"),
    ]
    rows = EDGES + extra
    found = check(licenses.scan(documents(spark, rows)), dict(rows))
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)  # rows that repeat an id each have their row


def test_method_labels_bridge_edits_and_need_enough_words(spark):
    bsd = "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met"
    rows = [(1, "x y " + bsd), (2, "Redistribution and use of words"), (3, "Licensed under CC BY-NC 4.0")]
    found = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert (found[1].labels, found[1].base_labels) == ("bsd", "") and found[1].score > 0.8
    assert found[2].labels == "" and found[3].labels == "cc"


def test_templates_of_any_length(spark):
    whole = max((t.text for t in licenses.TEXTS), key=len)
    words = whole.split()
    assert len(words) > 2 * licenses.BITS
    half = len(words) // 2
    broken = " ".join("x" if i % 20 == 5 else w for i, w in enumerate(words))
    rows = [(1, "a b " + whole), (2, broken), (3, " ".join(words[:40])), (4, " ".join(words[half:] + words[:half])), (5, "c " * 100 + whole + " d " + whole)]
    found = {r.doc_id: r for r in licenses.scan(documents(spark, rows), texts=[licenses.Template("long", whole)]).collect()}
    assert (found[1].labels, found[1].score) == ("long", 1.0) and found[5].score == 1.0
    grams = list(zip(words, words[1:], strict=False))
    kept = sum(1 for i in range(len(grams)) if i % 20 not in (4, 5))
    assert found[2].labels == "long" and found[2].score >= kept / len(grams)
    assert found[3].labels == found[4].labels == ""
    where = licenses.spans(documents(spark, rows), [licenses.Template("long", whole)]).where("template = 0").collect()
    assert sorted((r.doc_id, r.start) for r in where if r.votes == 1) == [(1, 2), (5, 100), (5, 101 + len(words))]


def test_empty_table(spark):
    assert licenses.scan(documents(spark, [])).count() == 0
