import hashlib
import random

import pytest
from tokenizers import Tokenizer

from keystrata.llm import bpe
from keystrata.llm.queries import vocabulary

PATH = vocabulary()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_spec(PATH))


def texts():
    r = random.Random(5)
    alphabets = ["ab c", "the of and thing ", "éüß ñ ", "\t\n\x0b\x0c\r \x1c\x1d\x85\xa0 ", "0123 ½²٣", "'s't're've'll'd !?$", "日本語 한국", "\U0001f600\U0001f3fd‍", "<|endoftext|> "]
    out = ["", " ", "a", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "<|endoftext", "aaaaaaa", "  a   b\n\n c  ", "x" * 3000, "ab" * 900, "".join(r.choice("etaoin") for _ in range(2500))]
    for _ in range(400):
        pick = r.sample(alphabets, r.randint(1, 4))
        out.append("".join(r.choice(r.choice(pick)) if r.random() < 0.9 else r.choice(pick) for _ in range(r.randint(1, 60))))
    return out


def test_ids_and_decoding_equal_the_library(codec, library):
    given = texts()
    for _ in range(2):  # the second time from memory
        ids, ends = codec.encode(given)
        rows = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
        want = [e.ids for e in library.encode_batch(given, add_special_tokens=False)]
        assert rows == want
        assert codec.decode(ids, ends) == [library.decode(x, skip_special_tokens=False) for x in want]


def test_decoding_of_broken_bytes(codec, library):
    import numpy as np

    r = random.Random(1)
    rows = [[r.randrange(50257) for _ in range(r.randint(0, 6))] for _ in range(300)]
    flat = np.array([i for x in rows for i in x], dtype=np.int64)
    got = codec.decode(flat, np.cumsum([len(x) for x in rows]))
    assert got == [library.decode(x, skip_special_tokens=False) for x in rows]


def test_frames(spark, library):
    spec = bpe.read_spec(PATH)
    rows = [(1, "a b", 7), (2, None, 7), (3, "", 7), (1, "a b", 7), (None, "é\n", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.round_trip(docs, spec).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "a b", 2: "", 3: "", None: "é\n"}[r.doc_id]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, spec), spec)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((a or 0, b or "") for a, b, _ in rows)
    assert bpe.round_trip(docs.limit(0), spec).count() == 0


def test_long_pieces(codec, library):
    """Runs of letters, marks and blanks without a break, from the border of the two schedules to a megabyte."""
    r = random.Random(9)
    given = ["".join(r.choice(a) for _ in range(n)) for n in (399, 400, 401, 402, 5_000) for a in ("ab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "日本語한국中文字", "!?$=-_", "é")]
    given += [" " * 3000 + "x", "\n" * 2000, "a" * 1_000_001, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), ("the" * 50_000) + " end"]
    ids, ends = codec.encode(given)
    want = [e.ids for e in library.encode_batch(given, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == want


def test_vocabularies_out_of_order_are_refused():
    import json

    letters = {c: i for i, c in enumerate(bpe.visible_bytes())}
    spec = {"model": {"type": "BPE", "vocab": letters | {"ab": 256, "abc": 257}, "merges": ["ab c", "a b"]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    with pytest.raises(ValueError, match="ranked before"):
        bpe.Codec(json.dumps(spec))
