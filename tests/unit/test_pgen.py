import struct

import numpy as np
import pytest
from fixtures import write
from pyspark.sql import functions as F

from locusflow.sources import pgen
from locusflow.sources.files import FormatError


def calls(rng, n):
    kind = rng.integers(0, 6)
    shares = [[1, 0, 0, 0], [0.97, 0.02, 0.005, 0.005], [0.3, 0.4, 0.2, 0.1], [0.01, 0.02, 0.97, 0], [0, 0.01, 0.01, 0.98], [0, 1, 0, 0]][kind]
    return rng.choice(4, n, p=shares).astype(np.uint8)


@pytest.mark.parametrize("n", [1, 3, 4, 255, 256, 1000, 70_000])
def test_records_round_trip(n):
    rng = np.random.default_rng(n)
    kinds = set()
    for _ in range(30):
        x = calls(rng, n)
        kind, data = pgen.encode(x)
        kinds.add(kind)
        assert (pgen.decode(kind, data, n, None) == x).all() and len(data) <= -(-n // 4)
    assert n < 255 or {0, 4, 6, 7} <= kinds


def test_kinds_that_only_others_write():
    """Calls of two kinds by bits, and records that lean on the one before, as the format describes them."""
    x = np.array([0, 2, 2, 0, 2, 0, 0, 2, 3, 1], np.uint8)
    bits = np.packbits(x == 2, bitorder="little").tobytes()
    assert (pgen.decode(1, bytes([2]) + bits + pgen.difference_list(np.array([8, 9]), np.array([3, 1], np.uint8), 10), 10, None) == x).all()
    y = x.copy()
    y[[1, 4]] = [1, 3]
    changes = pgen.difference_list(np.array([1, 4]), np.array([1, 3], np.uint8), 10)
    assert (pgen.decode(2, changes, 10, x) == y).all()
    assert (pgen.decode(3, changes, 10, x) == np.array([2, 1, 0, 3])[y]).all()
    assert pgen.difference_list(np.array([5, 300]), np.array([1, 2], np.uint8), 1000) == bytes([2, 5, 0, 0b1001, 0xA7, 2])
    with pytest.raises(FormatError):
        pgen.decode(2, changes, 10, None)
    with pytest.raises(FormatError):
        pgen.decode(8, b"", 10, None)


@pytest.mark.parametrize("n, samples, block", [(700, 300, 1 << 16), (700, 13, 100), (0, 5, 1 << 16), (1, 1, 1 << 16)])
def test_files_are_written_and_read_in_parts(spark, tmp_path, monkeypatch, n, samples, block):
    monkeypatch.setattr(pgen, "BLOCK", block)
    rng = np.random.default_rng(n + samples)
    x = [calls(rng, samples) for _ in range(n)]
    frame = spark.createDataFrame([(k, (v + 48).tobytes()) for k, v in enumerate(x)], "rec long, data binary").repartition(5)
    path = str(tmp_path / "a.pgen")
    assert pgen.write_pgen(frame, ["rec"], samples, path) == n
    head = pgen.Pgen.of(path)
    assert (head.variants, head.samples) == (n, samples)
    for k in [*range(0, n, 37), n - 1][: n and 99]:
        (number, found), = head.records(k, k + 1)
        assert number == k and (found == x[k]).all()
    got = [(k, v) for a in range(0, n, 90) for k, v in head.records(a, min(a + 90, n))]
    assert [k for k, _ in got] == list(range(n)) and all((v == x[k]).all() for k, v in got)
    some = {3, 4, 99, 100, 101, 650} & set(range(n))
    assert {k: v.tolist() for k, v in head.records(0, n, some)} == {k: x[k].tolist() for k in some}


def test_conditions_on_the_number_reach_the_file(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = [calls(rng, 40) for _ in range(500)]
    frame = spark.createDataFrame([(k, (v + 48).tobytes()) for k, v in enumerate(x)], "rec long, data binary")
    pgen.write_pgen(frame, ["rec"], 40, str(tmp_path / "a.pgen"))
    write(tmp_path / "a.pvar", "##note\n#CHROM\tPOS\tID\tREF\tALT\n" + "".join(f"1\t{10 * k}\tv{k}\tA\tC\n" for k in range(500)))
    found, variants = pgen.read_pgen(spark, str(tmp_path / "a"), split=64)
    assert found.rdd.getNumPartitions() == 8
    for condition, want in (("at IN (7, 300, 9999)", {7, 300}), ("at >= 490", set(range(490, 500))), ("at < 3 AND at > 0", {1, 2}), ("at = 5", {5}), ("at = 5 AND at = 6", set())):
        some = found.where(condition)
        assert {r["at"]: [b - 48 for b in r["data"]] for r in some.collect()} == {k: x[k].tolist() for k in want}
        assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    assert [(r["at"], r["id"], r["pos"]) for r in variants.orderBy("at").where("at % 100 = 3").collect()] == [(k, f"v{k}", 10 * k) for k in (3, 103, 203, 303, 403)]
    assert found.join(variants, "at").where(F.col("pos") == 40).count() == 1


def test_wrong_files(tmp_path):
    for data in (b"", b"\x6c\x1b\x01" + bytes(9), pgen.MAGIC + struct.pack("<IIB", 1, 1, 0x10) + bytes(20)):
        with pytest.raises(FormatError):
            pgen.Pgen.of(write(tmp_path / "x.pgen", data))
