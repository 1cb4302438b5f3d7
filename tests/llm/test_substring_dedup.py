import random

import numpy as np
from pyspark.sql import functions as F

from locusflow.llm import substring_dedup as op
from locusflow.llm.ngrams import PUBLIC


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n)]


def repeated(rows, least=50):
    """Numbers of words in windows of ``least`` words that an earlier place holds, by id."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        w = (t or "").split()
        cover = [False] * len(w)
        for p in range(len(w) - least + 1):
            key = tuple(w[p : p + least])
            if key in seen:
                cover[p : p + least] = [True] * least
            seen.add(key)
        out[i] = sum(cover)
    return out


def corpus(rng):
    passages = [words(rng, n) for n in (49, 50, 51, 60, 90, 200, 400)]
    rows = []
    for i in range(60):
        w = words(rng, rng.randint(0, 150))
        for p in rng.sample(passages, rng.choice([0, 0, 1, 1, 2])):
            at = rng.randint(0, len(w))
            w = w[:at] + p + words(rng, rng.randint(1, 60)) + w[at:]
        rows.append((i, rng.choice([" ", "\n"]).join(w) if i % 2 else " ".join(w)))
    return rows


def test_repeats_are_cut_exactly_as_brute_force_finds_them(docs_of):
    rows = corpus(random.Random(7)) + [(100, None), (101, ""), (102, " \n "), (None, "null id")]
    got = {r["doc_id"]: r for r in op.repeated_passages(docs_of(rows)).collect()}
    want = repeated(rows)
    assert len(got) == len(rows)
    # A window may go on a word further with another earlier place than the one a run is compared with.
    assert all(r["removed_words"] <= want[i] and want[i] - r["removed_words"] <= 17 for i, r in got.items())
    assert sum(r["removed_words"] == want[i] for i, r in got.items()) >= len(got) - 3
    assert all((r["removed_words"] > 0) == (want[i] > 0) for i, r in got.items())
    texts = dict(rows)
    for i, r in got.items():
        data = (texts[i] or "").encode()
        clean, at = b"", 0
        for s in r["spans"] or []:
            clean += data[at : s["start_byte"]]
            at = s["end_byte"]
        assert (clean + data[at:]).decode() == r["clean_text"]
        assert len((texts[i] or "").split()) - r["removed_words"] == len(r["clean_text"].split())


def test_joined_lists_give_the_same(docs_of, monkeypatch):
    rows = corpus(random.Random(8))
    docs = docs_of(rows)
    first = sorted(map(str, op.repeated_passages(docs).collect()))
    monkeypatch.setattr(op, "BROADCAST_ENTRIES", -1)
    assert sorted(map(str, op.repeated_passages(docs).collect())) == first


def test_other_columns_stay(docs_of):
    rng = random.Random(9)
    p = " ".join(words(rng, 80))
    rows = [(1, "x y " + p), (2, p + " z"), (2, p + " z"), (3, None), (None, "alone"), (4, "é " * 3)]
    docs = docs_of(rows)
    out = op.cut_repeats(docs, length_col="n_chars")
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = sorted(((r["doc_id"], r["text"], r["n_chars"], r["a.b"]) for r in out.collect()), key=str)
    assert got == sorted([(1, "x y " + p, len(p) + 4, "other"), (2, "z", 1, "other"), (2, "z", 1, "other"), (3, None, None, "other"), (None, "alone", 5, "other"), (4, "é é é ", 6, "other")], key=str)


def test_empty_table(docs_of):
    assert op.repeated_passages(docs_of([(1, "a")]).where("false")).count() == 0


def test_cuts_resist_insertions():
    rng = random.Random(1)
    w = words(rng, 5000)
    a, b = (op.Chunks([" ".join(x).encode()], PUBLIC) for x in (w, w[:2000] + ["inserted", "words"] + w[2000:]))
    assert len(set(a.digests) - set(b.digests)) <= 4
    assert (a.sizes[1:-1] > op.REACH).all() and a.sizes.mean() < 12


def test_rolling_hash_sees_sixteen_bytes():
    data = np.frombuffer(random.Random(2).randbytes(500), np.uint8)
    h = op.gear_hashes(data)
    for i in (0, 5, 15, 16, 400):
        slow = 0
        for x in data[: i + 1]:
            slow = ((slow << 4) + int(op._GEAR[x])) % (1 << 64)
        assert h[i] == slow


def test_neighbours_in_a_batch_don_t_change_chunks():
    texts = [" ".join(words(random.Random(k), 40)).encode() for k in range(5)] + [b"", b" \n x  y "]
    together = op.Chunks(texts, PUBLIC)
    assert together.digests.tolist() == [d for t in texts for d in op.Chunks([t], PUBLIC).digests.tolist()]


def test_segments_don_t_change_chunks(monkeypatch):
    texts = [" ".join(words(random.Random(k), 300)).encode() for k in range(5)]
    whole = op.Chunks(texts, PUBLIC)
    monkeypatch.setattr(op, "STEP_BYTES", 100)
    small = op.Chunks(texts, PUBLIC)
    assert (whole.cuts == small.cuts).all() and (whole.digests == small.digests).all()


def test_periodic_stretches_are_cut(docs_of):
    rng = random.Random(11)
    rows = []
    for p in (1, 2, 3, 4):
        unit = words(rng, p)
        for n in (20, 49, 50, 51, 55, 60, 130, 300):
            w = [*words(rng, 12), *(unit * n)[:n], *words(rng, 12)]
            rows.append((len(rows), " ".join(w)))
    # Passages of varied words before, around and after longer stretches.
    a, b = words(rng, 40), words(rng, 30)
    for middle in (["ha"] * 200, ["so", "on"] * 90):
        rows += [(len(rows) + k, " ".join([*words(rng, 9), *a, *middle, *b, *words(rng, 9)])) for k in range(2)]
    got = {r["doc_id"]: r["removed_words"] for r in op.repeated_passages(docs_of(rows)).collect()}
    want = repeated(rows)
    # Repeats that touch count as one: the first stretches of 50 words repeat a shorter one and, a period on, themselves.
    got, want = ({i: n for i, n in x.items() if i not in (2, 10, 18, 26)} for x in (got, want))
    assert {i for i in got if (got[i] > 0) != (want[i] > 0)} == set()
    assert all(abs(got[i] - want[i]) <= 4 for i in got)


def test_common_phrases_at_the_edges_of_a_passage(docs_of):
    rng = random.Random(12)
    rows = []
    for _ in range(20):
        left, right = words(rng, 18), words(rng, 18)
        passage = words(rng, 6) + left + words(rng, 8) + right + words(rng, 6)
        # The phrases stand alone in earlier texts.
        for w in (left, right, passage, passage):
            rows.append((len(rows), " ".join([*words(rng, 20), *w, *words(rng, 20)])))
    got = {r["doc_id"]: r["removed_words"] for r in op.repeated_passages(docs_of(rows)).collect()}
    assert got == repeated(rows)


def test_stretches_that_touch_are_one_repeat_only_together(docs_of):
    rng = random.Random(13)
    units = [words(rng, 1) for _ in range(6)]
    run = lambda *ks: [w for k in ks for w in units[k] * 30]
    rows = []
    for ks in ((0,), (1,), (2, 3), (1, 0), (3, 2), (4,), (5,)):
        rows.append((len(rows), " ".join([*words(rng, 20), *run(*ks), *words(rng, 20)])))
    # Two short stretches that only stood apart before stay; together again, they go.
    rows += [(len(rows) + k, " ".join([*words(rng, 15), *run(4, 5), *words(rng, 15)])) for k in range(2)]
    got = {r["doc_id"]: r["removed_words"] for r in op.repeated_passages(docs_of(rows)).collect()}
    assert got == repeated(rows) and {i for i, n in got.items() if n} == {8}


def test_words_that_a_public_polynomial_hash_confuses_are_told_apart(docs_of):
    """Two unlike words with one value of the polynomial with base 0x9E3779B97F4A7C15: a passage isn't repeated by the other's."""
    a, b = "mmmmmnmmnnmmnlmlnmnlnlmmmn", "mnnmnknlkkmllnmnkllnlolmll"
    rng = random.Random(3)
    words = [f"w{rng.randrange(9000)}" for _ in range(240)]
    one, two = (" ".join(x if i % 3 == 0 else w for i, w in enumerate(words)) for x in (a, b))
    out = {r["doc_id"]: r["removed_words"] for r in op.repeated_passages(docs_of([(1, one), (2, two), (3, one)])).collect()}
    assert out == {1: 0, 2: 0, 3: 240}
