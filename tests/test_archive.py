import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapack import cli
from stratapack.functions.gear import Cuts
from stratapack.operators import chunks as C
from stratapack.operators import files as Files
from stratapack.plans import archive as A
from stratapack.sources import container, filetree, sinks
from stratapack.util import ordered_index


def write(root, files):
    for name, data in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)


ROUNDTRIP = {"src/a.bin": bytes([7]) * 100_000 + b"tail", "src/b.txt": b"packrings " * 5000, "src/sub/c.bin": bytes([1]) * 40_000}


def pack_tree(spark, root, target, options=None):
    files, _ = cli.tree(spark, [os.path.join(root, target)], None, None)
    return A.pack(filetree.with_content(files), options)


def restored(archive, names=None):
    return {r["rel_path"]: bytes(r["content"]) for r in archive.extract(names).collect()}


@pytest.mark.parametrize("mode", ["store", "fast"])
def test_roundtrip(spark, tmp_path, mode):
    write(tmp_path, ROUNDTRIP)
    made = pack_tree(spark, str(tmp_path), "src", A.Options(mode=mode))
    path = str(tmp_path / "out.pack")
    size = container.write(made, path)
    assert size == os.path.getsize(path)
    back = container.read(spark, path)
    assert restored(back) == ROUNDTRIP
    info = back.info().first()
    assert (info["file_count"], info["total_raw"], info["refs"], info["data_start"]) == (3, 190_004, 17, 209)
    if mode == "store":
        assert (info["chunk_count"], info["unique_bytes"], info["block_count"], size) == (5, 77_318, 1, 77_632)
    some = spark.createDataFrame([("./src/b.txt",), ("no",)], "rel_path string")
    assert restored(back, some) == {"src/b.txt": ROUNDTRIP["src/b.txt"]}


def test_many_copies(spark, tmp_path):
    write(tmp_path, {f"dup/f{i}.bin": bytes([42]) * (1 << 20) for i in range(20)})
    made = pack_tree(spark, str(tmp_path), "dup", A.Options(mode="store"))
    t = made.totals().first()
    assert (t["refs"], t["chunk_count"], t["unique_bytes"], t["table_bytes"] + 32, t["data_start"], t["block_count"], t["total_comp"]) == (420, 2, 84_763, 762, 2442, 1, 87_274)
    assert [r["rel_path"] for r in made.list().orderBy("file_ord").limit(3).collect()] == ["dup/f0.bin", "dup/f1.bin", "dup/f10.bin"]
    assert made.info().first()["factor"] > 5


def test_empty_file_and_names(spark, tmp_path):
    write(tmp_path, {"e/x": b""})
    made = pack_tree(spark, str(tmp_path), "e", A.Options(mode="store"))
    assert container.write(made, str(tmp_path / "o")) == 89
    assert restored(container.read(spark, str(tmp_path / "o"))) == {"e/x": b""}
    write(tmp_path, {"h/.h": b"1", "h/_u": b"2"})
    os.symlink(tmp_path / "h/.h", tmp_path / "h/link")
    assert restored(pack_tree(spark, str(tmp_path), "h")) == {"h/.h": b"1", "h/_u": b"2", "h/link": b"1"}


def test_listing(spark, tmp_path):
    write(tmp_path, {"b": b"1", "a": b"22", "z/x": b""})
    os.symlink(tmp_path / "nowhere", tmp_path / "gone")
    rows = filetree.listing(spark, str(tmp_path)).orderBy(*Files.listing_order()).collect()
    assert [(r["name"], r["is_dir"]) for r in rows] == [("z", True), ("a", False), ("b", False)]


def test_same_names_are_reported(spark, tmp_path):
    write(tmp_path, {"p/x": b"1", "q/x": b"22"})
    kept, dropped = cli.tree(spark, [str(tmp_path / "p/x"), str(tmp_path / "q/x")], None, None)
    assert [(r["rel_path"], r["size"]) for r in kept.collect()] == [("x", 1)]
    assert [r["size"] for r in dropped.collect()] == [2]
    with pytest.raises(Exception, match="No such file or directory"):
        filetree.scan(spark, [str(tmp_path / "none")]).collect()
    with pytest.raises(Files.NoFiles):
        A.pack(filetree.with_content(Files.exclude_output(kept, str(tmp_path / "p/x"))))


def test_utf16_order(spark):
    df = spark.createDataFrame([("�",), ("\U0001f600",), ("a",)], "p string")
    assert [r[0] for r in df.orderBy(Files.canonical_key(F.col("p"))).collect()] == ["a", "\U0001f600", "�"]


def test_rename(spark, tmp_path):
    write(tmp_path, {"d/a": b"A", "d/b": b"B", "d/c": b"C"})
    made = pack_tree(spark, str(tmp_path), "d", A.Options(mode="store"))
    renames = spark.createDataFrame([("d/a", "n\\a"), ("d/b", ""), ("d/c", "d/b"), ("zz", "y")], "old string, new string")
    renamed, report = made.rename(renames)
    assert {r["old"]: r["outcome"] for r in report.collect()} == {"d/a": "renamed", "d/b": "ignored", "d/c": "collision", "zz": "missing"}
    assert sorted(r["rel_path"] for r in renamed.list().collect()) == ["d/b", "d/b", "n/a"]
    assert renamed.totals().first()["total_comp"] == made.totals().first()["total_comp"]


def test_damaged(spark, tmp_path):
    write(tmp_path, {"d/a": b"A" * 500})
    path = str(tmp_path / "o")
    container.write(pack_tree(spark, str(tmp_path), "d"), path)
    good = open(path, "rb").read()
    for at, data, message in ((0, b"XXXX", "start mark"), (4, b"\x09", "version 9"), (len(good) - 28, b"ZZZZ", "end mark")):
        open(path, "wb").write(good[:at] + data + good[at + len(data) :])
        with pytest.raises(container.BadArchive, match=message):
            container.read(spark, path)


def test_pushdown_and_native_layout(spark, tmp_path):
    write(tmp_path, ROUNDTRIP)
    made = pack_tree(spark, str(tmp_path), "src")
    container.write(made, str(tmp_path / "o"))
    one = container.relation(spark, str(tmp_path / "o"), "entries").where("rel_path = 'src/b.txt'")
    assert one.count() == 1 and "Filter" not in one._jdf.queryExecution().optimizedPlan().toString()
    made.save(f"file://{tmp_path}/native")
    assert restored(A.load(spark, f"file://{tmp_path}/native")) == ROUNDTRIP


def test_blocks_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGE", 4)
    sizes = np.random.default_rng(5).integers(1, 900, 2000).tolist()
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1].tolist()
    df = spark.createDataFrame(list(zip(range(2000), sizes, before, strict=True)), "chunk_idx long, raw_size int, spool_offset long")
    got = [(r["block_id"], r["off_in_block"]) for r in C.solid_blocks(df, 5000).orderBy("chunk_idx").collect()]
    want, block, held = [], 0, 0
    for s in sizes:
        want.append((block, held))
        held += s
        if held >= 5000:
            block, held = block + 1, 0
    assert got == want


def test_outcomes_of_a_range_are_those_of_each_entry():
    r = np.random.default_rng(3)
    for _ in range(100):
        sizes, limit = r.integers(1, 40, int(r.integers(1, 60))), int(r.integers(1, 200))
        found = C.outcomes(sizes, limit)
        for held in range(limit):
            ends, left = C.closes(sizes, limit, held)
            hit = [x for x in found if 0 <= x[0] <= held]
            assert (max(hit)[1:] if hit else (0, held + found[-1][2])) == (len(ends), left)
    assert len(C.outcomes(np.full(65_536, 100), 1 << 20)) < 65_536


def test_a_file_of_many_chunks_and_a_block_for_many_files(spark, monkeypatch):
    r = np.random.default_rng(6)
    long = r.integers(0, 256, 20_000 * 300, dtype=np.uint8).tobytes()
    same = r.integers(0, 256, 900, dtype=np.uint8).tobytes()
    rows = [("long", bytearray(long))] + [(f"copy{i}", bytearray(same)) for i in range(400)]
    files = spark.createDataFrame(rows, "rel_path string, content binary").selectExpr("rel_path", "content", "cast(octet_length(content) as bigint) as size", "420 as mode", "0L as mtime_ms")
    monkeypatch.setattr(A, "SPLIT", 50_000)
    made = A.pack(files, A.Options(mode="store", cuts=Cuts(avg=256, least=64, most=1024), block=64 << 10))
    assert made.totals().first()["refs"] > 20_000
    assert restored(made) == {n: bytes(b) for n, b in rows}
    with pytest.raises(Files.SameName):
        A.pack(files.unionByName(files))


def test_the_last_rename_of_a_name_counts(spark, tmp_path):
    write(tmp_path, {"d/a": b"A"})
    made = pack_tree(spark, str(tmp_path), "d", A.Options(mode="store"))
    renamed, report = made.rename(spark.createDataFrame([("d/a", f"n{i}") for i in range(50)], "old string, new string").coalesce(1))
    assert [r["rel_path"] for r in renamed.list().collect()] == ["n49"] and [r["new"] for r in report.collect()] == ["n49"]


def test_zip_refuses_what_it_cannot_list(spark, tmp_path):
    many = spark.range(65_536).selectExpr("cast(id as string) as rel_path", "cast('' as binary) as content")
    with pytest.raises(sinks.UnsupportedFormat):
        sinks.write_zip(many, str(tmp_path / "o.zip"), 0)
    assert not os.listdir(tmp_path)


def test_ordered_index(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "k int, v int")
    rows = ordered_index(df, [F.col("k")], "n", {"run": "v"}).orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(1000))
    assert all(b["run"] == a["run"] + a["v"] for a, b in zip(rows, rows[1:], strict=False))


def test_zip_and_extraction(spark, tmp_path):
    write(tmp_path, ROUNDTRIP | {"src/empty": b""})
    files, _ = cli.tree(spark, [str(tmp_path / "src")], None, None)
    for level in (0, 9):
        size = sinks.write_zip(filetree.with_content(files), str(tmp_path / "o.zip"), level)
        assert size == os.path.getsize(tmp_path / "o.zip")
        with zipfile.ZipFile(tmp_path / "o.zip") as z:
            assert z.testzip() is None and z.read("src/sub/c.bin") == ROUNDTRIP["src/sub/c.bin"] and len(z.namelist()) == 4
    made = A.pack(filetree.with_content(files))
    assert sinks.extract_to(made.extract(), str(tmp_path / "dest")).count() == 4
    assert (tmp_path / "dest/src/b.txt").read_bytes() == ROUNDTRIP["src/b.txt"] and (tmp_path / "dest/src/empty").read_bytes() == b""
    with pytest.raises(sinks.UnsafePath):
        sinks.inside("/tmp/d", "../x")
    for fmt in ("7z", "rar", "tar"):
        with pytest.raises(sinks.UnsupportedFormat):
            sinks.pack_to(filetree.with_content(files), "o", fmt)


def test_cli(spark, tmp_path, capsys, monkeypatch):
    write(tmp_path, ROUNDTRIP)
    monkeypatch.chdir(tmp_path)
    assert cli.run(["c", "src", "-m", "fast", "-o", "o.drk"]) == 0
    assert cli.run(["l", "o.drk"]) == 0 and cli.run(["i", "o.drk"]) == 0 and cli.run(["t", "o.drk"]) == 0
    assert cli.run(["r", "o.drk", "src/b.txt=text/b.txt"]) == 0
    assert cli.run(["x", "o.drk"]) == 0
    assert (tmp_path / "o_extracted/text/b.txt").read_bytes() == ROUNDTRIP["src/b.txt"]
    out = capsys.readouterr().out
    assert "3 files" in out and "src/sub/c.bin" in out and "src/b.txt -> text/b.txt: renamed" in out
    assert struct.unpack(">4sB", open("o.drk", "rb").read(5))[1] == 2
    assert cli.run(["about"]) == 0 and "modes ultra" in capsys.readouterr().out
