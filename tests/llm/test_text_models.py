import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusflow.llm import sentencepiece as sp
from locusflow.llm import token_counts as tc
from locusflow.llm import toxicity as tx
from locusflow.llm.queries import tokenizer_file

MODEL, RANKS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "a", " two  spaces \n\n", "héllo wörld 日本語 😀\nline", "x" * 5000, "a b " * 3000, "tab\tand \r\n mixed", "▁ mark"]


# ---- toxicity


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    rude = ["idiot", "stupid", "loser", "trash"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 12)):
                w.insert(rng.randrange(len(w)), rng.choice(rude) + rng.choice(["", "", "ness"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_model_separates_held_out_documents(spark, docs_of):
    rows, labels = labelled()
    table = spark.createDataFrame([*labels[:300], (None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    model = tx.train(docs_of(rows + [(1000, None)]), table)
    assert model.thetas == sorted(model.thetas) and min(model.weights.values()) >= 0
    test = rows[300:] + [(2000, None), (2001, ""), (None, "you idiot stupid loser trash"), (2002, "idiot")]
    docs = docs_of(test)
    out = {r["doc_id"]: r for r in tx.predict(docs, model).collect()}
    assert len(out) == len(test)
    truth = dict(labels)
    wrong = [i for i, _ in rows[300:] if out[i]["rejected"] != bool(truth[i])]
    assert len(wrong) <= 3
    for r in out.values():
        assert 0 <= r["expected_severity"] <= tx.GRADES - 1 and r["rejected"] == (r["p_toxic"] >= 0.5)
    assert out[None]["rejected"] and out[None]["expected_severity"] > out[2002]["expected_severity"] > out[2001]["expected_severity"]
    kept = tx.keep_harmless(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if not r["rejected"]}


def plain_terms(text):
    words = {w for w in re.split(r"[\W\d_]+", text.lower()) if w}
    return words | {"^" + w[:k] for w in words for k in (4, 5) if len(w) > k}


def test_model_and_scores_match_brute_force(spark, docs_of):
    rows, labels = labelled(600, 3)
    texts, toxic = dict(rows), dict(labels)
    model = tx.train(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    # Terms by counting, one by one.
    n_toxic, n_all = sum(toxic.values()), len(toxic)
    seen = Counter(t for i in toxic for t in plain_terms(texts[i]))
    bad = Counter(t for i in toxic if toxic[i] for t in plain_terms(texts[i]))
    rate, gain = n_toxic / n_all, {}
    for t, n in seen.items():
        a = bad[t]
        g = (a - n * rate) / (n * rate * (1 - rate)) ** 0.5
        if a >= max(3, tx.TOXIC_SHARE * n_toxic) and a * (n_all - n_toxic) > 2 * (n - a) * n_toxic and g > tx.DEVIATIONS:
            gain[t] = g
    chosen = sorted(gain, key=lambda t: (-gain[t], t))[: tx.TERMS]
    place = {t: k for k, t in enumerate(chosen)}
    indices = [np.array(sorted(place[t] for t in plain_terms(texts[i]) if t in place), np.int64) for i in toxic]
    evidence = np.array([sum(gain[chosen[k]] for k in x) for x in indices])
    own = np.array([bool(toxic[i]) for i in toxic])
    grades = np.where(own, 1 + (evidence > np.quantile(evidence[own], 0.5)), 0)
    weights, thetas = tx.fit(indices, grades, len(chosen))
    assert np.allclose(model.thetas, thetas, atol=1e-6)
    assert {t: round(w, 6) for t, w in model.weights.items()} == {t: round(float(weights[k]), 6) for t, k in place.items() if weights[k] > 1e-6}
    # Scores, document by document.
    docs = [*rows, (9000, None), (9001, "IDIOT!"), (9001, "IDIOT!")]
    got = sorted((r["doc_id"], round(r["expected_severity"], 9), round(r["p_toxic"], 9), r["grade"], r["rejected"]) for r in tx.predict(docs_of(docs), model).collect())
    want = []
    for i, t in docs:
        z = sum(model.weights.get(x, 0) for x in plain_terms(t or ""))
        above = [1 / (1 + math.exp(-(z - c))) for c in model.thetas]
        p = [1 - above[0], above[0] - above[1], above[1]]
        want.append((i, round(sum(above), 9), round(above[0], 9), p.index(max(p)), above[0] >= 0.5))
    assert got == sorted(want)


def test_conflicting_labels_count_as_toxic(spark, docs_of):
    rows, labels = labelled()
    again = [(i, 0) for i, y in labels if y] + [(i, None) for i, y in labels]
    one, two = (tx.train(docs_of(rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, again + labels))
    assert one == two


def test_without_labels_nothing_is_rejected(spark, docs_of):
    docs = docs_of([(1, "idiot"), (2, None)])
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)], [(9, 1), (8, 0)]):
        model = tx.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert not any(r["rejected"] for r in tx.predict(docs, model).collect())
    assert tx.predict(docs.where("false"), model).count() == 0


def test_balanced_and_mostly_toxic_labels_give_a_model(spark, docs_of):
    rows, labels = labelled(1000)
    toxic = dict(labels)
    for every in (4, 12):
        # All 200 toxic documents and a part of the clean ones: toxic shares of one half and three quarters.
        some = [i for i in toxic if toxic[i] or i % every == 1]
        docs = docs_of([(i, t) for i, t in rows if i in some])
        model = tx.train(docs, spark.createDataFrame([(i, toxic[i]) for i in some], "doc_id long, toxic int"))
        got = {r["doc_id"]: r["rejected"] for r in tx.predict(docs, model).collect()}
        assert sum(toxic.values()) >= len(some) / 2 - 20
        assert sum(got[i] != bool(toxic[i]) for i in some) <= len(some) * 0.03


def test_gradient_descends_to_the_maximum_likelihood():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4)) < 0.4
    z = x @ np.array([2.0, 1.0, 0.5, 0.0]) + rng.logistic(size=3000)
    grades = np.searchsorted([1.0, 3.0], z)
    w, t = tx.fit([np.flatnonzero(r) for r in x], grades, 4, penalty=0.0, steps=800)
    assert np.allclose(w, [2, 1, 0.5, 0], atol=0.25) and np.allclose(t, [1, 3], atol=0.25)


# ---- token counts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=30), st.lists(st.integers(0, 12), max_size=8))
def test_attribution_matches_brute_force(tokens, cuts):
    ends = np.cumsum(tokens).astype(np.int64)
    total = int(ends[-1]) if tokens else 0
    sections = np.array(sorted({c for c in np.cumsum(cuts).tolist() if 0 < c < total} | {total}))
    spans = list(zip([0, *sections[:-1].tolist()], sections.tolist()))
    for rule in tc.RULES:
        want, over = [0] * len(spans), [0] * len(spans)
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            shares = [max(0, min(b, y) - max(a, x)) for x, y in spans]
            held = [i for i, s in enumerate(shares) if s]
            want[held[0] if rule == "first" else held[-1] if rule == "last" else shares.index(max(shares))] += 1
            over[held[0]] += len(held) > 1
        got, crossing = tc.attribute(ends, sections, rule)
        assert got.tolist() == want and crossing.tolist() == over


@pytest.mark.parametrize("rule", tc.RULES)
def test_sections_add_up_to_whole_documents(docs_of, rule):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "x\ny")]
    out = tc.section_tokens(docs_of(rows), RANKS, rule=rule).collect()
    for i, t in rows:
        t = t or ""
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["section"])[:: sum(x == i for x, _ in rows)]
        assert "".join(t[r["char_start"] : r["char_end"]] for r in mine) == t
        assert all("\n" not in t[r["char_start"] : r["char_end"] - 1] for r in mine)
        n = len(whole.encode(t, add_special_tokens=False).ids)
        assert sum(r["n_tokens"] for r in mine) == n == mine[0]["doc_tokens"]
    assert tc.section_tokens(docs_of(rows).where("false"), RANKS).count() == 0
    with pytest.raises(ValueError):
        tc.section_tokens(docs_of(rows), RANKS, rule="none")


def test_very_long_runs(docs_of):
    """Runs of a million characters of one class, wherever they stand; split as the pattern splits shorter ones."""
    runs = [" " * 1_000_000, "x" * 1_000_000, "\n" * 1_000_000, "1" * 1_000_000, "!" * 1_000_000, "\u3000 " * 600_000]
    rows = [(i, t) for i, t in enumerate([*runs, "a" + runs[0], runs[0] + "b", "a" + runs[2] + "b " + runs[0] + "."])]
    out = tc.section_tokens(docs_of(rows), RANKS).groupBy("doc_id").agg({"n_tokens": "sum", "doc_tokens": "max", "char_end": "max"}).collect()
    assert {r["doc_id"]: r["max(char_end)"] for r in out} == {i: len(t) for i, t in rows}
    assert all(r["sum(n_tokens)"] == r["max(doc_tokens)"] for r in out)


@pytest.mark.parametrize("around", ["{}", "a{}", "{}b", "a{}b", "a {}. b{}c", "\n{}\t"])
@pytest.mark.parametrize("space", [" ", "\n", "\u3000", " \x85", "\t "])
def test_long_white_space_is_cut_as_the_pattern_cuts_it(monkeypatch, around, space):
    text = around.format(space * 30, space * 17)
    t = tc.ByteTokenizer(RANKS)
    monkeypatch.setattr(tc, "_LONG_SPACE", re.compile(tc._LONG_SPACE.pattern.replace("50000", "9")))
    assert t.ids(text) == t.encoding.encode_ordinary(text)
    # What Python calls white space and the pattern doesn't.
    assert t.ids("a" + "\x1c" * 40 + "b") == t.encoding.encode_ordinary("a" + "\x1c" * 40 + "b")


@pytest.mark.parametrize("rule", tc.RULES)
def test_fields_share_the_tokens_of_their_text(spark, rule):
    ranks = tc.byte_tokenizer(RANKS)
    rows = [(1, "A title", "some body text here", None), (2, None, None, None), (None, "", "日本語 body", "end"), (1, "A title", "some body text here", None), (3, "ti", "tle", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, `a.body` string, field string")
    for sep in ("\n", ""):
        out = tc.field_tokens(docs, RANKS, ["title", "a.body", "field"], separator=sep, rule=rule).collect()
        assert len(out) == 15
        for i in (1, 2, None, 3):
            texts = next([t or "" for t in r[1:]] for r in rows if r[0] == i)
            mine = [r for r in out if r["doc_id"] == i][:3]
            total = len(ranks.ends(sep.join(texts)))
            assert sum(r["n_tokens"] for r in mine) == total == mine[0]["doc_tokens"]
    assert tc.field_tokens(docs.where("false"), RANKS, ["title"]).count() == 0


# ---- SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdeth ing  ▁\n\té日本😀0"), st.characters(exclude_categories=["Cs"], exclude_characters="\0")), max_size=50), max_size=6))
def test_ids_are_the_library_s(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = sp.piece_codec(MODEL)
    got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
    assert got == library.encode(texts)
    assert [codec.decode(np.array(x, "<u4").tobytes()) for x in got] == [library.decode(x) for x in got]


def test_long_words_and_small_caches(library):
    rng = random.Random(1)
    codec = sp.PieceCodec(MODEL, cached=30)
    for _ in range(20):
        texts = ["".join(rng.choice("abcdefghi") for _ in range(rng.choice([3, 50, 2000]))) + " the and" for _ in range(10)]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == library.encode(texts)


@pytest.mark.parametrize("kind", ["base64", "han", "one", "two", "mixed", "lines", "spaces"])
@pytest.mark.parametrize("n", [257, 5000, 120_000, 1_000_000])
def test_very_long_words(library, kind, n):
    import time

    rng = random.Random(n)
    letters = {"base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "han": "日本語中文的一是不了人我在有他這為之大來", "one": "a", "two": "to", "mixed": "theanding日éß😀.-=", "lines": "\n", "spaces": " "}[kind]
    text = "x " + ("".join(rng.choices(letters, k=n)) if kind not in ("two",) else letters * (n // 2)) + " tail"
    began = time.process_time()
    (got,) = sp.piece_codec(MODEL).encode([text])
    assert time.process_time() - began < 30
    assert np.frombuffer(got, "<u4").tolist() == library.encode(text)


def test_windows_of_a_long_word(library, monkeypatch):
    monkeypatch.setattr(sp, "WINDOW", 50)
    monkeypatch.setattr(sp, "LONG", 20)
    rng = random.Random(9)
    codec = sp.PieceCodec(MODEL)
    for _ in range(30):
        t = "".join(rng.choices("theanding日éß😀.-=\0", k=rng.randint(0, 400)))
        assert np.frombuffer(codec.encode([t])[0], "<u4").tolist() == library.encode(t.replace("\0", ""))


def test_query_rows(docs_of, library):
    rows = list(enumerate(TEXTS)) + [(0, ""), (None, "null id")]
    docs = docs_of(rows)
    out = sp.encode_pieces(docs, MODEL)
    got = sorted(((r["doc_id"], r["ids"], r["ids_crc32"], r["round_trip"]) for r in out.collect()), key=str)
    want = sorted(((i, e := library.encode(t or ""), zlib.crc32(np.array(e, "<u4").tobytes()), "▁" not in (t or "")) for i, t in rows), key=str)
    assert got == want
    back = {r["doc_id"]: r["text"] for r in sp.decode_pieces(out.where("doc_id > 0"), MODEL).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in rows if i}
    assert sp.encode_pieces(docs.where("false"), MODEL).count() == 0
