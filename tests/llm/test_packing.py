import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.helpers import EDGES, documents, prose
from tests.test_queries import DATA
from tokenizers import Tokenizer

from tidelake.llm import packing, queries
from tidelake.llm._common import table


@pytest.fixture(scope="module")
def reference():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 0]


def pack(docs):
    return packing.pack(docs, queries.TOKEN_RANKS, public_tokenizers.PATTERN)


def check(pieces, rows, reference):
    """Every id in one piece, sequences without gaps, and of a whole or a power of two."""
    of = {}
    for p in pieces:
        of.setdefault(p.doc_id, []).append(p)
    wanted = {}
    for i, text in rows:
        wanted.setdefault(i, []).append(reference(text))
    assert of.keys() == wanted.keys()
    for i, own in of.items():
        ids = wanted[i][0]  # rows that repeat an id are alike here
        assert sum(p.length for p in own) == len(ids) * len(wanted[i])
        for p in own:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        covered = np.zeros(len(ids), int)
        for p in own:
            covered[p.start : p.start + p.length] += 1
        assert (covered == len(wanted[i])).all()
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SEQUENCE and at & (at - 1) == 0


def test_all_documents(spark, reference):
    docs = table(spark, DATA, "documents")
    check(pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], reference)


def test_edges(spark, reference):
    rows = [*EDGES, (30, "two  spaces"), (31, " lead"), (32, "trail "), (33, "tab\t x  y　 z"), (34, "line \n break\n\n x"), (35, "<|endoftext|> it's 123 ab!!"), (36, "\U0001f600 é ñ 漢字 \x1c x")]
    check(pack(documents(spark, rows)).collect(), rows, reference)
    assert pack(documents(spark, [])).count() == 0
    check(pack(documents(spark, [(1, "alone")])).collect(), [(1, "alone")], reference)


def test_pieces_of_text_encode_like_whole_texts(reference):
    rng = random.Random(8)
    encode = packing.encoder(queries.TOKEN_RANKS, public_tokenizers.PATTERN)
    for _ in range(400):
        text = "".join(rng.choice(["a", "Be", " ", " ", "  ", "\n", "\t", ".", "'s", "12", "é", " ", " ", "\x1c", "\x85", "!", "漢"]) for _ in range(30))
        assert np.frombuffer(encode(text), encode.dtype).tolist() == reference(text)[:-1], repr(text)


def test_added_tokens_are_one_id_as_in_the_json(spark):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    as_loaded = lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 0]
    rows = [*EDGES, (40, "a <|endoftext|> b"), (41, "<|endoftext|>"), (42, "x<|endoftext|><|endoftext|>  y z"), (43, "two\n<|endoftext|>\nlines <|endof text|>")]
    found = packing.pack(documents(spark, rows), queries.TOKEN_RANKS, public_tokenizers.PATTERN, queries.ADDED_TOKENS).collect()
    check(found, rows, as_loaded)
    encode = packing.encoder(queries.TOKEN_RANKS, public_tokenizers.PATTERN, queries.ADDED_TOKENS)
    assert np.frombuffer(encode("a <|endoftext|> b"), encode.dtype).tolist() == as_loaded("a <|endoftext|> b")[:-1] == [64, 220, 50256, 275]


def test_curve_visits_every_cell_by_single_steps():
    for dimensions, bits in ((2, 3), (3, 2), (3, 3)):
        side = 1 << bits
        cells = np.array(list(np.ndindex(*[side] * dimensions)))
        index = packing.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_alike_texts_stand_together():
    rng = random.Random(9)
    texts = [" ".join(rng.choice([f"{lang}{i}" for i in range(50)]) for _ in range(200)) for lang in ("de", "en", "fr") for _ in range(30)]
    order = np.argsort(packing.curve_keys(packing.pa.array(texts)))
    changes = sum(a // 30 != b // 30 for a, b in zip(order[:-1], order[1:], strict=True))
    assert changes < 30  # at random, 60
