import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusflow.llm import packing as op
from locusflow.llm.queries import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdeABC 's ll\n\t.,;!?_-'éñßÀ²½ªº0123İ\xa0\x85\x1c"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=8))
def test_ids_are_the_tokenizer_s(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    got = op.word_tokenizer(PATH).encode(texts)
    assert [g.tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_long_words_and_many_texts_at_once(plain, monkeypatch):
    monkeypatch.setattr(op, "SEGMENT", 300)
    texts = ["short one", "y" * 5000, "", "a " + "z1" * 300 + " b", "word " * 100, "\xa0 \n", "x" * 401 + " tail", "plain, again"] * 3
    got = op.WordTokenizer(PATH).encode(texts)
    assert [g.tolist() for g in got] == [plain.encode(x, add_special_tokens=False).ids for x in texts]


def test_small_cache_gives_the_same_ids(plain):
    texts = [f"word{i} other{i * 7} and some more, {i}" for i in range(200)]
    small = op.WordTokenizer(PATH, cached=50)
    for at in range(0, 200, 10):
        assert [g.tolist() for g in small.encode(texts[at : at + 10])] == [plain.encode(x, add_special_tokens=False).ids for x in texts[at : at + 10]]


@pytest.mark.parametrize("window", [64, 4096])
def test_pieces_cover_each_document_once(docs_of, plain, window):
    rows = [(1, "hello world " * 3000), (7, "z" * 9000 + " end"), (2, None), (3, ""), (4, "x"), (4, "x"), (None, "y z"), (5, "the same"), (6, "the same")]
    out = op.pack_documents(docs_of(rows), PATH, window=window).collect()
    assert len({r["sequence_id"] for r in out}) == len(out)
    want = []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for n in op.decompose(len(ids), window):
            want.append((i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids), 0))
            at += n
        assert at == len(ids)
    assert sorted((tuple(r[k] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")) for r in out), key=str) == sorted(want, key=str)


def test_empty_table_and_bad_window(docs_of):
    docs = docs_of([(1, "a")])
    assert op.pack_documents(docs.where("false"), PATH).count() == 0
    with pytest.raises(ValueError):
        op.pack_documents(docs, PATH, window=100)


def test_words_with_one_hash_are_told_apart(plain, monkeypatch, docs_of):
    """Unlike words that a public polynomial confuses, and hashes so short that most words share theirs with others."""
    pair = ["mmmmmnmmnnmmnlmlnmnlnlmmmn", "mnnmnknlkkmllnmnkllnlolmll"]
    got = op.WordTokenizer(PATH).encode([*pair, " ".join(pair * 40)])
    assert [g.tolist() for g in got] == [plain.encode(x, add_special_tokens=False).ids for x in [*pair, " ".join(pair * 40)]]
    assert op.pack_documents(docs_of([(1, " ".join(["one", pair[0]] + [pair[1]] * 80))]), PATH).first()["doc_tokens"] == len(plain.encode(" ".join(["one", pair[0]] + [pair[1]] * 80), add_special_tokens=False).ids) + 1
    monkeypatch.setattr(op, "word_hashes", lambda data, starts, ends, key: np.array([data[a] % 7 for a in starts], np.uint64))
    short = op.WordTokenizer(PATH)
    texts = [f"some word{i % 5} and others, {i}" for i in range(60)] + ["", "a b a b"]
    for at in range(0, len(texts), 9):
        assert [g.tolist() for g in short.encode(texts[at : at + 9])] == [plain.encode(x, add_special_tokens=False).ids for x in texts[at : at + 9]]
