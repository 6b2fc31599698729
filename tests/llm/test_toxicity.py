import numpy as np
import pyarrow as pa
import pytest
from tests.llm.helpers import EDGES, documents
from tests.test_queries import DATA

from tidelake.llm import toxicity
from tidelake.llm._common import held_out, table


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(table(spark, DATA, "documents"), table(spark, DATA, "labels"))


def test_held_out_accuracy(spark, model):
    scored = toxicity.score_documents(table(spark, DATA, "documents"), model)
    rows = scored.join(table(spark, DATA, "labels"), "doc_id").where(held_out()).select("toxic", "toxic_score").collect()
    clean = [r.toxic_score for r in rows if r.toxic == 0]
    assert np.mean([s < 0.3 for s in clean]) > 0.97
    # A third of the toxic rows here are junk whose text has lost its toxic words.
    assert np.mean([r.toxic_score >= 0.3 for r in rows if r.toxic == 1]) >= 0.6


@pytest.mark.parametrize("text", ["idiot", "1d10t", "i d i o t", "i.d.i.o.t", "IDIOOOT!!", "(idiot)", "id*ot,"])
def test_disguise_does_not_help(model, text):
    assert toxicity.restore(text, model.logp) == "idiot"
    around = "And the thing with of it is {} in there and for on to that"
    score = toxicity.score_text(around.format(text), model)
    assert score == pytest.approx(toxicity.score_text(around.format("idiot"), model), abs=0.05) and score >= 0.3
    assert toxicity.score_text(around.format("thing"), model) < 0.3


@pytest.mark.parametrize("text, word", [("1d107", "idiot"), ("1053r", "loser"), ("7r45h", "trash"), ("iiddiioott", "idiot")])
def test_more_signs_than_letters_and_doubled_letters(model, text, word):
    assert toxicity.restore(text, model.logp) == word
    around = "And the thing with of it is {} in there and for on to that"
    assert toxicity.score_text(around.format(text), model) == pytest.approx(toxicity.score_text(around.format(word), model))


MIXED = ["1 d 1 0 t", "i d 1 o t", "$ t u p i d", "i  d i\to t", "s\nc u m", "1 2 3 4", "| a | b |", "a € é 漢 b", "x. y z", "coffee 1d107 covid19, 1053r"]


@pytest.mark.parametrize("text", MIXED)
def test_features_are_those_of_the_restored_text(model, text):
    met = lambda t: sorted((rank, cell) for _, _, found in toxicity.features(pa.array([t]), toxicity._Restored(model.logp)) for rank, _, cells in found for cell in cells.tolist())
    plain = lambda t: sorted((rank, int(cell)) for data in [np.frombuffer(t.encode(), np.uint8)] for rank, _, cells in toxicity._cells(data, *spans(t)) for cell in cells)
    text = f"And the thing {text} in there"
    assert met(text) == plain(toxicity.restore(text, model.logp))


def spans(text):
    """(text, start, end) of words parted by single spaces, in bytes."""
    sizes = np.array([len(w.encode()) for w in text.split(" ")])
    ends = np.cumsum(sizes + 1) - 1
    return np.zeros(len(sizes), int), ends - sizes, ends


def test_plain_words_stay_as_they_are(model):
    assert toxicity.restore("The Words, (stay) 2024 10.5 l'été!", model.logp).startswith("the words stay")
    assert toxicity.restore(None, model.logp) == "" == toxicity.restore("12 34 $$", model.logp)


def test_decoding_is_the_best_path():
    """On short tokens the beam holds all readings: compare with trying them all."""
    rng = np.random.default_rng(3)
    logp = np.log(rng.dirichlet(np.ones(32), (32, 32, 32))).astype(np.float32)

    def cost(text):
        a = b = c = 0
        total = 0.0
        for x in [*text, " "]:
            s = 0 if x == " " else toxicity._symbol_of(x)
            total -= float(logp[a, b, c, s])
            a, b, c = (0, 0, 0) if s == 0 else (b if c else 0, c, s)
        return total

    readings = {"": 0.0}
    token = "a1b4"
    for char in token:
        step = {}
        for text, own in readings.items():
            options = [(text + char, own)] if char.isalpha() else [(text + x, own + toxicity.REPLACED) for x in toxicity.LEET[char]]
            if not char.isalpha():
                options += [(text, own + toxicity.DROPPED)]
                options += [(text + " ", own + toxicity.PARTED)] if text and text[-1] != " " else []
                options += [(text, own + toxicity.REPLACED + toxicity.REPEATED)] if text and text[-1] in toxicity.LEET[char] else []
            for t, c in options:
                step[t] = min(c, step.get(t, np.inf))
        readings = step
    best = min((own + cost(t.rstrip(" ")), t.strip()) for t, own in readings.items())
    assert toxicity.decode(token, logp) == best[1]


def test_language_model_counts_every_text(spark):
    docs = documents(spark, [(1, "ab ab"), (2, "Ab?"), (3, None), (4, "é")])
    logp = toxicity.language_model(docs)
    assert np.allclose(np.exp(logp).sum(axis=-1), 1, atol=1e-4)
    assert logp[0, 0, 1, 2] > np.log(0.5) and logp[0, 0, 1, 3] < np.log(0.1)


def test_edges(spark, model):
    docs = documents(spark, EDGES)
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == len(EDGES) and len({r.toxic_score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.keep_clean(docs, model).count() == len(EDGES)
    none = documents(spark, [])
    nothing = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.keep_clean(none, nothing).count() == 0 and not nothing.weights
    assert toxicity.score_documents(docs, nothing).count() == len(EDGES)


def test_scores_do_not_depend_on_the_batch(model):
    texts = ["idiot one", None, "i d i o t", "scum " * 3, "clean words here", "1d10t"]
    together = toxicity.scores(pa.array(texts), model)
    assert np.allclose(together, [toxicity.score_text(t, model) for t in texts])
