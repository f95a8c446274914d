import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from feedline.llm.bpe import Bpe, _Pieces, decode, encode
from feedline.llm.queries import QUERIES, vocabulary

from .common import docs, odd_rows


@pytest.fixture(scope="module")
def both():
    with open(vocabulary(), encoding="utf-8") as f:
        return Bpe(f.read()), Tokenizer.from_file(vocabulary())


def same(both, text):
    own, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    got = own.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert own.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_ids_and_text_equal_the_library(both):
    end = "<|endoftext|>"
    for t in ["", " ", end, f"a {end} b  {end}", f"{end}{end}x<|endo", " " * 300 + "x", "a" * 5000, "ab" * 3000, "\n\n\t x\r\n",
              "it's we'll I'M", "naïve 東京 🎈🎈 ١٢٣", "aaaa aaaaa " * 50, "\x00\x1c\x85  x", "Ω" * 400]:
        same(both, t)


def test_random_texts(both):
    rng = random.Random(3)
    parts = list("ab cdeinst hoTAé1 2'\n.") + ["<|endoftext|>", "tion", " the", "　"]
    for _ in range(1500):
        same(both, "".join(rng.choice(parts) for _ in range(rng.randint(1, 60))))


def test_compatible_pairs_are_those_that_merge_to_themselves(both):
    own, library = both
    rng = random.Random(1)
    for _ in range(3000):
        a, b = rng.randrange(256, 50256), rng.randrange(256, 50256)
        raw = own.bytes[a] + own.bytes[b]
        assert own.compatible(a, b) == (own.piece(raw) == [a, b])


def test_pieces_are_forgotten_in_turn():
    p = _Pieces(lambda raw: [len(raw)])
    import feedline.llm.bpe as bpe

    keep, bpe.KEEP_PIECES = bpe.KEEP_PIECES, 3
    try:
        for i in range(50):
            assert np.frombuffer(p["x" * (i % 7 + 1)], "<u4").tolist() == [i % 7 + 1]
            assert len(p) <= 3 and len(p.old) <= 3
        assert "y" * 100 not in p and p["y" * 100] and "y" * 100 not in p
    finally:
        bpe.KEEP_PIECES = keep


def test_odd_rows_round_trip(spark):
    rows = odd_rows()
    enc = encode(docs(spark, rows), vocabulary())
    assert enc.columns == ["doc_id", "n_tokens", "ids"]
    back = decode(enc, vocabulary()).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert encode(docs(spark, rows).limit(0), vocabulary()).count() == 0
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), vocabulary()).first().text == ""


def test_query_over_all_documents(spark):
    base = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(vocabulary())
    want = []
    for r in spark.read.parquet(f"{base}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op2_bpe"](spark, base).collect())) == sorted(want)
