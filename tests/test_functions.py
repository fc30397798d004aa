import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratapack.functions import codecs
from stratapack.functions import scalars as S
from stratapack.functions.gear import GEAR, Cuts
from stratapack.operators.chunks import closes


def each(spark, column, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_gear_golden():
    assert [f"{GEAR[i]:08x}" for i in (0, 1, 2, 3, 42, 255)] == ["a1b965f4", "7ae1d440", "7a8514d7", "bd2cc176", "57e77f10", "99d81bde"]
    assert sum(GEAR) == 557048563471


@pytest.mark.parametrize(
    ("data", "sizes"),
    [(bytes([42]) * (1 << 20), [50727] * 20 + [34036]), (bytes([7]) * 100_000 + b"tail", [9214] * 10 + [7864]), (bytes([1]) * 40_000, [9920] * 4 + [320]), (b"abc", [3]), (b"", [])],
)
def test_cuts_golden(data, sizes):
    ends = Cuts().ends(data)
    assert [z - a for a, z in zip([0, *ends], ends, strict=False)] == sizes


def plain_cuts(data, avg, least, most):
    mask, out, h, start = (1 << max(1, round(math.log2(avg)))) - 1, [], 0, 0
    for i in range(len(data)):
        h = (((h << 1) | (h >> 31)) % 2**32 + GEAR[data[i]]) % 2**32
        if i + 1 - start >= most or (i + 1 - start >= least and h & mask == 0):
            out.append(i + 1)
            h, start = 0, i + 1
    return out + [len(data)] if start < len(data) else out


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000))
def test_cuts_are_a_partition(data):
    ends = Cuts(avg=64, least=16, most=256).ends(data)
    assert ends == plain_cuts(data, 64, 16, 256)
    assert all(16 <= z - a <= 256 for a, z in list(zip([0, *ends], ends, strict=False))[:-1])


@pytest.mark.parametrize("kind", ["rotate", "shift"])
def test_cuts_of_many_strings(kind):
    r = np.random.default_rng(7)
    datas = [r.integers(0, 256, int(n), dtype=np.uint8).tobytes() for n in [0, 1, 15, 16, 17, 9000, 5000, *r.integers(0, 1500, 70)]] + [b"", bytes(4000)]
    c = Cuts(64, 16, 256, hash=kind)
    assert c.ends_of_all(datas) == [c.ends(d) for d in datas]
    assert c.ends_of_all(datas[:5]) == [c.ends(d) for d in datas[:5]] and c.ends_of_all([]) == [] and c.ends_of_all([b""] * 40) == [[]] * 40


def test_read_grid():
    data = np.random.default_rng(1).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    whole, grid = Cuts(256, 64, 1024), Cuts(256, 64, 1024, read_grid=4096)
    assert grid.ends(data[:4096]) == whole.ends(data[:4096])
    ends = grid.ends(data)
    assert ends != whole.ends(data) and ends[-1] == len(data) and ends == sorted(set(ends))


@pytest.mark.parametrize("grid", [100, 257, 4096])
def test_read_grid_against_brute_force(grid):
    """The hash goes on over the bytes in the order a reader feeds them: with each block, what is unfinished again."""
    for seed, size in ((1, 0), (2, 99), (3, 20_000), (4, 9_999)):
        data = np.random.default_rng(seed).integers(0, 256 if seed % 2 else 3, size, dtype=np.uint8).tobytes()
        want, h, open_from = [], 0, 0
        for block in range(0, size, grid):
            length = 0
            for at in range(open_from, min(size, block + grid)):
                h, length = (((h * 2) % 2**32 | h // 2**31) + GEAR[data[at]]) % 2**32, length + 1
                if length == 512 or (length >= 64 and h % 128 == 0):
                    want.append(at + 1)
                    h, length, open_from = 0, 0, at + 1
        assert Cuts(128, 64, 512, read_grid=grid).ends(data) == want + [size] * (open_from < size)


def test_shift_hash_comes_back_into_step():
    data = np.random.default_rng(2).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    for kind, least in (("shift", 0.9), ("rotate", 0.0)):
        c = Cuts(256, 64, 1024, hash=kind)
        chunks = lambda d, c=c: {d[a:z] for a, z in zip([0, *c.ends(d)], c.ends(d), strict=False)}
        assert len(chunks(data) & chunks(b"X" + data)) >= least * len(chunks(data))


def test_closes():
    assert closes(np.array([3, 3, 3, 3]), 5, 0)[0].tolist() == [1, 3]
    assert closes(np.array([3, 3]), 5, 4) == (pytest.approx(np.array([0])), 3)
    assert closes(np.array([1]), 5, 2)[1] == 3


def test_humanize(spark):
    cases = {0: "0 B", 1: "1 B", 1023: "1023 B", 1024: "1.00 KB", 1152: "1.13 KB", 102400: "100 KB", 1048575: "1024 KB", 1 << 30: "1.00 GB", 5 << 60: "5.00 EB", (1 << 60) - 1: "1024 PB", 3 << 49: "1.50 PB"}
    assert each(spark, S.humanize_bytes, cases, "bigint") == list(cases.values())


def test_elapsed(spark):
    cases = {0: "0ms", 999: "999ms", 1000: "1.0s", 59_940: "59.9s", 59_960: "60.0s", 59_999: "60.0s", 60_000: "1m 0s", 119_600: "1m 60s"}
    assert each(spark, S.elapsed, cases, "bigint") == list(cases.values())


def test_names_and_modes(spark):
    cases = {"a/b.MP4": "mp4", "x": "", "a.b/c": "", "q.tar.gz": "gz", "bad.é": ""}
    assert each(spark, S.ext_of, cases, "string") == list(cases.values())
    assert each(spark, lambda c: S.default_name(c, F.lit("zip")), ["a/b/", "", "c"], "string") == ["b.zip", "archive.zip", "c.zip"]
    assert each(spark, S.ratio_mode, [1, 3, 6, 10], "int") == ["store", "fast", "max", "ultra"]
    assert each(spark, S.mode_id, ["ultra", "max", "fast", "store", "?"], "string") == [0, 1, 2, 3, 0]
    assert each(spark, S.progress_bar, [0, 50, 100], "int") == [f"[{'░' * 28}]   0%", f"[{'█' * 14}{'░' * 14}]  50%", f"[{'█' * 28}] 100%"]
    assert each(spark, lambda c: S.factor(F.lit(10), c), [0, 4], "int") == [math.inf, 2.5]
    assert each(spark, lambda c: S.saved_percent(c, F.lit(5)), [0, 10], "int") == [0.0, 50.0]
    assert sum(map(len, S.PRECOMPRESSED.values())) == len({x for g in S.PRECOMPRESSED.values() for x in g}) == 49


def test_notes(spark):
    df = spark.createDataFrame([(3.0, 1.0), (1.0, 0.5), (0.5, 0.0), (1.0, 0.0)], "s double, p double")
    got = [r[0] for r in df.select(S.compress_note(F.col("s"), F.col("p"))).collect()]
    assert got[0] is None and [x.split(":")[0] for x in got[1:]] == ["already compressed", "near maximum density", "low compressibility"]


def test_codecs():
    noise = np.random.default_rng(3).integers(0, 256, 600_000, dtype=np.uint8).tobytes()
    assert codecs.looks_incompressible(noise) and not codecs.looks_incompressible(noise[:4095]) and not codecs.looks_incompressible(bytes(5000))
    assert len(codecs.probe_sample(noise)) == 3 * 87381 and codecs.probe_sample(noise)[-9:] == noise[-9:]
    for mode in ("ultra", "max", "fast", "store"):
        for data in (b"", b"abc" * 900, noise[:5000]):
            payload, stored = codecs.pack_block(mode, data)
            assert len(payload) <= len(data)
            assert (payload if stored else codecs.decompress(mode, payload, len(data))) == data
    with pytest.raises(ValueError, match="unknown mode"):
        codecs.compress("tiny", b"x")
    assert zlib.decompress(codecs.deflate(b"hello" * 50, 6), -15) == b"hello" * 50 and codecs.deflate(b"x", 0) == b"x"
