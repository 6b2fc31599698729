"""Small tables for the tests of the training-data operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside; as further input columns they must not matter.
CLASHING = ("label", "size", "score", "hashes", "n", "rep", "value", "key", "range", "tail", "place", "digest", "found", "ids", "component", "taken", "target")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def documents(spark, rows):
    """A documents table of (doc_id, text) or (doc_id, text, source), with columns of clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *["x"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


#: Null, empty, blank, tiny and long texts, a row twice, a null id.
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "é ñ"), (6, "many words " * 30_000), (7, "twice told tale of it"), (7, "twice told tale of it"), (None, "no id here at all")]
