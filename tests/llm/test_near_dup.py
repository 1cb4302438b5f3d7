import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import near_dup as op
from locusflow.llm.components import components
from locusflow.llm.ngrams import ngram_sets


def grams(text, n=5):
    w = re.findall(rb"[0-9a-z_\x80-\xff]+", (text or "").lower().encode())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, s=0.8):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            both, any_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= s * any_ - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        out += [(rows[m][0], min(ids) if ids else None, links[m], len(members)) for m in members]
    brute.groups = len(groups)
    return sorted(out, key=str)


def corpus(seed=1, families=8, singles=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(2, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(singles)]
    rows += ["a b", "A  b!", "a b c", "", None, "...", "one", "ONE"]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


def test_matches_brute_force(docs_of):
    rows = corpus() + [(7, "repeated row of some words here"), (7, "repeated row of some words here"), (None, "repeated row of some words here"), (None, "only null ids in this one"), (11, "same id"), (11, "another text with the same id")]
    out = op.near_duplicates(docs_of(rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["class_size"]) for r in out), key=str) == brute(rows)
    assert sum(r["kept"] for r in out) == brute.groups


def test_large_groups_are_verified_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_NODES", 3)
    monkeypatch.setattr(op, "BROADCAST_IDS", 0)
    rows = corpus(2, families=3, singles=4)
    out = op.near_duplicates(docs_of(rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["class_size"]) for r in out), key=str) == brute(rows)


def chained(seed=4, n=60):
    """Windows of one long text: neighbours are linked, and the ends of the chain have nothing in common."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(6 * n + 60)]
    rows = [" ".join(words[6 * i : 6 * i + 60]) for i in range(n)] + [" ".join(words[6 * i : 6 * i + 60]).upper() for i in range(0, n, 7)]
    return list(zip(rng.sample(range(10_000), len(rows)), rows))


@pytest.mark.parametrize("ids", [0, 1000])
def test_chains_are_verified_bucket_by_bucket(docs_of, monkeypatch, ids):
    monkeypatch.setattr(op, "BLOCK_NODES", 8)
    monkeypatch.setattr(op, "BROADCAST_IDS", ids)
    seen = []
    monkeypatch.setattr(op, "_units", lambda *a, of=op._units: seen.append(of(*a)) or seen[0])
    rows = chained() + corpus(6, families=2, singles=3)
    out = op.near_duplicates(docs_of(rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["class_size"]) for r in out), key=str) == brute(rows)
    units = [len(r["units"]) for r in seen[0].where("units IS NOT NULL").collect()]
    assert units and max(units) > 1


def test_a_pair_counts_in_its_first_shared_unit():
    met = op._met_before([[1, 5], [5], [1, 5, 9], [-3, 5], [-3, 9]], 5)
    assert {(i, j) for i, j in zip(*np.nonzero(met), strict=True) if i < j} == {(0, 2), (3, 4)}
    assert not op._met_before([[5], [5, 7]], 5).any()


def test_one_of_each_group_stays(docs_of):
    rows = corpus(3) + [(7, "tied row of five words"), (7, "tied row of five words")]
    docs = docs_of(rows)
    kept = op.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _, _ in brute(rows)})


def test_empty_table(docs_of):
    docs = docs_of([(1, "a")]).where("false")
    assert op.near_duplicates(docs).count() == 0
    assert op.keep_one_of_each(docs).count() == 0


def test_bands_reach_the_recall():
    for s, r in ((0.8, 0.9999), (0.5, 0.99)):
        b = op.bands_for(s, r)
        assert 1 - (1 - s**op.ROWS) ** b >= r > 1 - (1 - s**op.ROWS) ** (b - 1)
    assert op.bands_for(1.0) == 1


def test_linked_counts_shared_grams():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(40)]
    got = op.linked(sets, 0.4)
    for i in range(40):
        for j in range(40):
            both = len(np.intersect1d(sets[i], sets[j]))
            union = len(sets[i]) + len(sets[j]) - both
            assert got[i, j] == (i != j and union > 0 and both >= 0.4 * union)


@pytest.mark.parametrize("segment", [64, 1 << 20])
def test_ngrams_match_brute_force(monkeypatch, segment):
    from locusflow.llm import ngrams

    monkeypatch.setattr(ngrams, "SEGMENT", segment)
    texts = [t or "" for _, t in corpus(5)] + ["é_1 " * 50, "x" * 300]
    seen = {}
    for t, s in zip(texts, ngram_sets([t.lower().encode() for t in texts])):
        assert len(s) == len(grams(t))
        seen.setdefault(grams(t), set()).add(tuple(map(int, s)))
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)] + [(9, 9), (7777, 7777)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_that_a_public_polynomial_hash_confuses_are_told_apart(docs_of):
    a, b = "mmmmmnmmnnmmnlmlnmnlnlmmmn", "mnnmnknlkkmllnmnkllnlolmll"
    rng = random.Random(3)
    words = [f"w{rng.randrange(9000)}" for _ in range(80)]
    rows = [(i, " ".join(x if k % 3 == 0 else w for k, w in enumerate(words))) for i, x in ((1, a), (2, b), (3, b))]
    out = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in op.near_duplicates(docs_of(rows)).collect()}
    assert out == {1: (1, 0, True), 2: (2, 1, True), 3: (2, 1, False)}


def test_hashes_follow_their_key_and_their_bytes_only():
    from locusflow.llm.ngrams import LONG_WORD, PUBLIC, new_key, word_hashes, word_spans

    raw = b" ".join([b"one", b"two", b"one", b"x" * (LONG_WORD + 9), b"y" * LONG_WORD, b"x" * (LONG_WORD + 9), b"a", b"aa", b"one"])
    data = np.frombuffer(raw, np.uint8)
    spans = word_spans(data)
    for key in (PUBLIC, new_key()):
        h = word_hashes(data, *spans, key)
        assert h[0] == h[2] == h[8] and h[3] == h[5] and len(set(h.tolist())) == 6
        assert (word_hashes(data, spans[0][2:], spans[1][2:], key) == h[2:]).all()
    assert (word_hashes(data, *spans, PUBLIC) != word_hashes(data, *spans, new_key())).all()


@pytest.mark.parametrize("ids", [0, 1000])
def test_a_pair_without_a_common_band_counts_nowhere_whatever_the_size(docs_of, monkeypatch, ids):
    """With few bands many linked pairs share none: small components, large ones and chains must agree on each."""
    rows = chained(7, 40) + corpus(8, families=6, singles=5)
    monkeypatch.setattr(op, "BROADCAST_IDS", ids)
    found = []
    for nodes in (10_000, 8, 3):
        monkeypatch.setattr(op, "BLOCK_NODES", nodes)
        found.append(sorted(map(str, op.near_duplicates(docs_of(rows), recall=0.3).select("doc_id", "class_id", "n_links", "class_size", "kept").collect())))
    assert found[0] == found[1] == found[2]
    n_links = sum(r["n_links"] for r in op.near_duplicates(docs_of(rows), recall=0.3).collect())
    assert n_links < sum(x[2] for x in brute(rows))
