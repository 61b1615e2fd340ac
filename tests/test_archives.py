import hashlib
import io
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from satchel import api
from satchel.operators import codec, integrity, manifest
from satchel.schema import BLOCK
from satchel.sources import bson, sinks
from satchel.sources.archive import list_archives, read_archive, write_archive
from satchel.sources.directory import ArchiveError, Entry, header
from satchel.sources.files import read_files

MEMBERS = {"d/e/ü 🙂.txt": "text ☃".encode(), "d/empty": b"", ".dot": b"1", "z.bin": bytes(range(256)) * 40, "a b": b"x" * 1000}


@pytest.fixture
def frame(spark):
    rows = [(p, b, False, p == "a b", p == ".dot", None) for p, b in MEMBERS.items()] + [("void", None, True, False, False, None), ("far", None, False, False, True, 77)]
    return spark.createDataFrame(rows, "path string, content binary, is_dir boolean, executable boolean, unpacked boolean, size long").repartition(3)


@pytest.mark.parametrize("kind", ["asar", "bsar"])
@pytest.mark.parametrize("compress", ["true", "false"])
def test_round_trip(spark, frame, tmp_path, kind, compress):
    path = str(tmp_path / f"x.{kind}")
    write_archive(frame, path, compress=compress, integrity="true")
    raw = open(path, "rb").read()
    words = struct.unpack("<4I", raw[:16])
    assert words[0] == (4 if kind == "asar" else 3)
    if kind == "asar":
        assert words[1] == words[2] + 4 and words[2] == (words[3] + 4 + 3) // 4 * 4
    else:
        assert words[1] == words[2] and words[2] % 4 == 0
    rows = {r.path: r for r in read_archive(spark, path, content=True).collect()}
    for p, b in MEMBERS.items():
        r = rows[p]
        if r.unpacked:
            assert r.content is None and r.size == len(b) and r.integrity is None
            continue
        assert bytes(r.content) == b
        assert bytes(r.integrity.hash) == hashlib.sha256(b).digest()
        assert len(r.integrity.blocks) == len(b) // BLOCK + 1
        assert (r.compression is not None) == (compress == "true")
        assert r.executable == (p == "a b")
    assert rows["void"].is_dir and rows["d/e"].is_dir and rows["d/e"].depth == 1
    assert rows["far"].unpacked and rows["far"].size == 77 and rows["far"].offset is None
    assert [r.ordinal for r in sorted(rows.values(), key=lambda r: r.path.split("/"))] == list(range(len(rows)))
    laid = manifest.with_offsets(read_archive(spark, path)).select("path", "offset").collect()
    assert {r.path: r.offset for r in laid} == {p: r.offset for p, r in rows.items()}
    done = integrity.report(integrity.verify(read_archive(spark, path, content=True))).first()
    assert (done.errors, done.bad_blocks, done.wrong_size) == (0, 0, 0) and done.checked == 4
    assert not [f for f in os.listdir(tmp_path) if "spool" in f]


def test_damage_is_found(spark, frame, tmp_path):
    path = str(tmp_path / "x.bsar")
    write_archive(frame, path, integrity="true")
    raw = bytearray(open(path, "rb").read())
    raw[-1] ^= 1
    open(path, "wb").write(raw)
    done = integrity.report(integrity.verify(read_archive(spark, path, content=True))).first()
    assert (done.errors, done.bad_blocks) == (1, 1)


def test_splits_and_filters(spark, frame, tmp_path):
    path = str(tmp_path / "x.bsar")
    write_archive(frame, path)
    df = read_archive(spark, path, content=True, split="1000")
    assert df.rdd.getNumPartitions() > 3
    assert df.count() == len(MEMBERS) + 4
    assert bytes(df.where("path = 'z.bin'").first().content) == MEMBERS["z.bin"]
    assert {r.path for r in df.where(F.col("is_dir")).collect()} == {"d", "d/e", "void"}
    write_archive(frame, str(tmp_path / "y.asar"))
    assert len(list_archives(str(tmp_path))) == 2
    assert read_archive(spark, str(tmp_path)).select("archive_path").distinct().count() == 2


def test_handmade_header(spark, tmp_path):
    text = b'{"files": {"b": {"files": {"x": {"size": 1, "offset": "3"}}}, "a": {"size": 3, "offset": "0"}, "a": {"size": 0, "offset": "4"}}}'
    padded = (len(text) + 7) // 4 * 4
    (tmp_path / "h.asar").write_bytes(struct.pack("<4I", 4, padded + 4, padded, len(text)) + text.ljust(padded, b"\0") + b"abcd")
    rows = read_archive(spark, str(tmp_path / "h.asar"), content=True).orderBy("ordinal").collect()
    assert [(r.path, r.content and bytes(r.content)) for r in rows] == [("b", None), ("b/x", b"d"), ("a", b"abc"), ("a", b"")]


@pytest.mark.parametrize("text", ['{"files":{"a":{"size":1,"link":"b"}}}', '{"files":[]}', '{"x":1}', '{"files":{"a":{"size":-1,"offset":"0"}}}', '{"files":{"a":{"size":1,"offset":"0","integrity":{"algorithm":"MD5"}}}}'])
def test_bad_directories(text):
    from satchel.sources.archive import open_bytes

    body = text.encode()
    padded = (len(body) + 7) // 4 * 4
    with pytest.raises(ArchiveError):
        open_bytes(struct.pack("<4I", 4, padded + 4, padded, len(body)) + body.ljust(padded, b"\0"))
    with pytest.raises(ArchiveError):
        open_bytes(b"PK\3\4" + bytes(40))


def test_header_forms():
    e = [Entry("f", size=3, offset=0, algorithm=1, hash=b"h" * 32, block_size=4, blocks=[b"b" * 32], compression=1, original_size=9)]
    assert b'{"files":{"f":{"size":3,"offset":"0","integrity":{"algorithm":"SHA256","hash":"' in header(e, False)
    d = dict(bson.loads(header(e, True)[12:]))["files"]
    f = dict(dict(d)["f"])
    assert f["size"] == 3 and isinstance(dict(f["integrity"])["algorithm"], bson.Int32) and dict(f["integrity"])["blocks"] == [b"b" * 32]


def test_bson_values():
    doc = bson.Document([("a", 1), ("a", -(1 << 40)), ("n", None), ("t", True), ("d", 1.5), ("s", "é"), ("b", b"\0x"), ("l", [1, "x", bson.Document()]), ("i", bson.Int32(7))])
    assert bson.loads(bson.dumps(doc)) == doc
    for cut in (5, 9, 30):
        with pytest.raises(bson.BsonError):
            bson.loads(bson.dumps(doc)[:cut])
    with pytest.raises(bson.BsonError):
        bson.loads(b"\0\0\0\0\x07a\0")


def test_extract(spark, frame, tmp_path):
    path, out = str(tmp_path / "x.bsar"), tmp_path / "out"
    write_archive(frame, path, compress="true", integrity="true")
    (out / "d").mkdir(parents=True)
    (out / "d" / "empty").write_text("old")
    done = api.extract_to(spark, path, str(out), keep_existing=True, check=True, include=["d", "z*"])
    assert {r.path: r.action for r in done.collect()} == {"d/e/ü 🙂.txt": "written", "d/empty": "kept", "z.bin": "written"}
    assert (out / "z.bin").read_bytes() == MEMBERS["z.bin"] and not (out / "a b").exists() and not (out / "void").exists()
    assert b"".join(sinks.contents(api.members(spark, path, include=["d/e"], content=True))) == MEMBERS["d/e/ü 🙂.txt"]
    for bad in ("../x", "/x", "a/../../x", "~/x"):
        m = read_archive(spark, path, content=True).limit(1).withColumns({"path": F.lit(bad), "is_dir": F.lit(False), "unpacked": F.lit(False)})
        with pytest.raises(ValueError, match="not allowed"):
            sinks.extract(m, str(out))


def test_damaged_members_are_not_written(spark, frame, tmp_path):
    path, out = str(tmp_path / "x.bsar"), tmp_path / "out"
    write_archive(frame, path, integrity="true")
    raw = bytearray(open(path, "rb").read())
    raw[-1] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="1 members"):
        api.extract_to(spark, path, str(out), check=True)
    written = {str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()}
    assert len(written) == 3 and not any(".part" in w for w in written)
    done = sinks.extract(read_archive(spark, path, content=True), str(tmp_path / "again"), check=True)
    assert sorted(r.action for r in done.collect()) == ["damaged"] + ["written"] * 3
    assert all(r.line.startswith("-i") for r in done.collect())


def test_empty_folders_go(tmp_path):
    (tmp_path / "a" / "b" / "c").mkdir(parents=True)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f").write_text("x")
    assert sinks.prune_empty(str(tmp_path)) == 3 and sorted(os.listdir(tmp_path)) == ["d"]


def test_a_member_of_several_blocks(spark, tmp_path):
    data = os.urandom(9 << 20)
    (tmp_path / "big.bin").write_bytes(data)
    path = str(tmp_path / "x.bsar")
    api.create(spark, path, [str(tmp_path / "big.bin")], compress=True, integrity=True)
    api.extract_to(spark, path, str(tmp_path / "out"), check=True)
    assert (tmp_path / "out" / "big.bin").read_bytes() == data


def test_deep_paths():
    from satchel.sources import bson, directory

    e = directory.Entry("/".join(["d"] * 3000) + "/f", size=0, offset=0)
    for kind in (False, True):
        made = directory.document([e], kind)
        if kind:
            made = bson.loads(bson.dumps(made))
        found = list(directory.flatten(dict(made)["files"]))
        assert len(found) == 3001 and found[-1].path == e.path
    assert directory._json(directory.document([e], False)).count('"files"') == 3001
    nested = bson.Document([("a", [1, [2, bson.Document([("b", None)])], []]), ("c", "d")])
    assert bson.loads(bson.dumps(nested)) == nested


def test_shared_folder_is_asked_for():
    from types import SimpleNamespace

    from satchel.session import shared_dir

    far = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(far)


def test_functions_at_their_edges(spark):
    from satchel.functions import arrays, binary, text

    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-0.0,), (1.0,), (1e-45,), (3.4028235e38,), (None,)], "x float")
    rows = df.select("x", binary.hex_float(F.col("x")).alias("h"), binary.float_of_hex(binary.hex_float(F.col("x"))).alias("y")).collect()
    assert [r.h for r in rows] == ["+nan", "+inf", "-0x0.000000p+0", "0x1.000000p+0", "0x0.000002p-126", "0x1.fffffep+127", None]
    assert [str(r.x) for r in rows] == [str(r.y) for r in rows]
    one = spark.range(1)
    bad = ["0x1.00000p+0", "0x2.000000p+0", "1.0", "0x1.000000p+128", "0x1.000000p", ""]
    assert one.select(*[binary.float_of_hex(F.lit(x)) for x in bad]).first()[:] == (None,) * len(bad)
    ranges = F.array(F.struct(F.lit(1).alias("lo"), F.lit(5).alias("hi")))
    assert [tuple(r) for r in one.select(arrays.append_range(ranges, F.lit(6), F.lit(6))).first()[0]] == [(1, 5), (6, 6)]
    for lo, hi in ((5, 9), (9, 8)):
        with pytest.raises(Exception, match="out of order"):
            one.select(arrays.append_range(ranges, F.lit(lo), F.lit(hi))).collect()
    assert one.select(text.lines(F.lit("a\r\n\nb")), text.lines(F.lit("a\n")), text.lines(F.lit("")), text.lines(F.lit("\n"))).first()[:] == (["a", "", "b"], ["a"], [], [""])
    with pytest.raises(ValueError):
        text.printf("%q", F.lit(1))


def test_rows_are_numbered_in_order(spark):
    from satchel.operators import manifest

    df = spark.createDataFrame([(f"d{i % 7}/x{i % 3}" + "/y" * (i % 4), i) for i in range(500)], "path string, n long").repartition(5)
    got = manifest.numbered(df, F.split("path", "/"), F.col("n")).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(500))
    keys = [(r.path.split("/"), r.n) for r in got]
    assert keys == sorted(keys)


def test_files_and_create(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / ".hid").write_text("h")
    (root / "sub" / "a.c").write_text("int a;")
    (root / "sub" / "deep" / "b.o").write_bytes(b"\0")
    os.chmod(root / "sub" / "a.c", 0o755)
    rows = {r.path: r for r in read_files(spark, str(root), content=True, exclude=["*.o"]).collect()}
    assert set(rows) == {"root", "root/.hid", "root/sub", "root/sub/a.c", "root/sub/deep"}
    assert rows["root/sub/a.c"].executable and bytes(rows["root/.hid"].content) == b"h"
    path = str(tmp_path / "y.baz")
    api.create(spark, path, [str(root)], exclude=["deep"], unpack=[".hid"], compress=True)
    lines = [r.line for r in api.listing(spark, path, verbose=True).collect()]
    assert lines[0] == "d--- " + " " * 27 + "root/"
    assert lines[1] == "---u " + " " * 14 + "           1 root/.hid"
    assert lines[-1].startswith("--xz #") and lines[-1].endswith("           6 root/sub/a.c")


def test_dump(spark, tmp_path):
    out = tmp_path / "data.c"
    out.write_text("int before;\n")
    (tmp_path / "m").write_bytes(bytes(range(70)))
    (tmp_path / "b").write_bytes(b"")
    api.create(spark, str(out), [str(tmp_path / "m"), str(tmp_path / "b")])
    first = out.read_text()
    assert first.startswith("int before;\n" + sinks.START) and first.endswith(sinks.END + "\n")
    assert first.index('{ "b", 0, 0, 0, &file_data_') < first.index('{ "m", 70, 0, 0, &file_data_')
    literal = sinks.c_literal(bytes(range(70)))
    assert literal in first and [x.count("\\") for x in literal.split("\n")] == [33, 32, 5]
    out.write_text(first + "int after;\n")
    api.create(spark, str(out), [str(tmp_path / "b")])
    again = out.read_text()
    assert again.startswith("int before;\n") and again.endswith("int after;\n") and again.count(sinks.START) == 1 and '"m"' not in again
    assert sinks.split_dump(["a\n", sinks.START + "\n", "x\n"]) == (["a\n"], [])


def test_inflate_all_block_types(spark):
    text = b"abcabcabc" * 50
    stored = zlib.compressobj(0, zlib.DEFLATED, -15)
    fixed = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_FIXED)
    for z in (stored, fixed):
        assert codec.inflate_bytes(z.compress(text) + z.flush()) == text
    assert codec.inflate_bytes(codec.deflate_bytes(text)) == text
    df = spark.createDataFrame([(b"\xff\xff",), (None,), (codec.deflate_bytes(b""),)], "b binary")
    assert [r[0] for r in df.select(codec.inflate(F.col("b"))).collect()] == [None, None, b""]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("satchel.session.session", lambda *a, **k: spark)
    (tmp_path / "f.txt").write_text("hello")
    path = str(tmp_path / "c.asar")
    assert api.main(["-c", "-f", path, "--integrity=SHA256", str(tmp_path / "f.txt")]) == 0
    assert capsys.readouterr().out == "f.txt\n"  # what was packed
    assert api.main(["-t", "-v", "-f", path]) == 0
    assert capsys.readouterr().out == "-i-- " + " " * 14 + "           5 f.txt\n"
    assert api.main(["-x", "-f", path, "-C", str(tmp_path / "o"), "--integrity"]) == 0
    assert (tmp_path / "o" / "f.txt").read_text() == "hello"
    with pytest.raises(Exception, match="none.asar"):
        api.main(["-t", "-f", str(tmp_path / "none.asar")])
    with pytest.raises(SystemExit):
        api.main(["-t", "-O", "-f", path])


def test_stream(spark, frame, tmp_path):
    from satchel.streaming.archives import members

    folder = tmp_path / "in"
    folder.mkdir()
    write_archive(frame, str(folder / "x.bsar"), integrity="true")
    q = members(spark, str(folder)).writeStream.format("memory").queryName("archive_members").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    write_archive(frame, str(folder / "y.asar"))
    q.processAllAvailable()
    q.stop()
    assert spark.table("archive_members").count() == 2 * (len(MEMBERS) + 4)


def test_the_directory_does_not_pass_through_the_driver(tmp_path, monkeypatch):
    import pickle
    import tracemalloc

    from satchel.sources import archive

    monkeypatch.setattr(archive, "RUN", 500, raising=False)
    monkeypatch.setattr(archive, "FAN", 4, raising=False)
    path = str(tmp_path / "x.asar")
    w = archive.ArchiveWriter({"path": path, "integrity": "true"}, ["path", "content"], True)
    messages = [w.write(iter([(f"d{n % 7}/f{n}", b"%d" % n) for n in range(k, 20_000, 5)])) for k in range(5)]
    assert max(len(pickle.dumps(m)) for m in messages) < 5_000
    tracemalloc.start()
    w.commit(messages)
    assert tracemalloc.get_traced_memory()[1] < 12 << 20  # a block of data, and a batch of each run
    tracemalloc.reset_peak()
    with open(path, "rb") as f:
        entries, base = archive.open_directory(f)
        rows = [(e.path, e.offset, e.size) for e in entries if not e.is_dir]
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
        tracemalloc.stop()
        assert [r[0] for r in rows] == sorted((f"d{n % 7}/f{n}" for n in range(20_000)), key=lambda p: p.split("/"))
        for p, at, size in rows[::999]:
            f.seek(base + at)
            assert f.read(size).decode() == p.rpartition("f")[2]
    assert os.listdir(tmp_path) == ["x.asar"]


@pytest.mark.parametrize("as_bson", [False, True])
def test_directories_by_entry(monkeypatch, as_bson):
    """The same bytes and entries as by whole documents, however the file is dealt out; attributes after files count."""
    from satchel.sources import directory, scan

    files = [Entry(p, size=n, executable=n == 2, unpacked=n == 3, algorithm=1, hash=b"h" * 32, block_size=4, blocks=[b"b" * 32] * n) for n, p in enumerate(["a", "a/ü 🙂/\"", "a/ü 🙂/x", "b/c/d", "b/e", "f//g", "files"])]
    made = sorted([*files, Entry("a/ü 🙂", True, unpacked=True), Entry("void", True)], key=lambda e: (e.path.split("/"), scan.rank(e)))
    out, at = io.BytesIO(), 0
    w = scan.DirectoryWriter(out, as_bson)
    for e in made:
        w.add(e.path, scan.rank(e), *((b"", None) if e.is_dir else scan.encoded(e, as_bson)), at)
        if not e.is_dir and not e.unpacked:
            e.offset, at = at, at + e.size
    before, after = directory.words(w.close(), as_bson)
    raw = before + out.getvalue() + after
    assert raw == header(made, as_bson)
    document = directory.document(made, as_bson)
    want = [e.row("") for e in directory.flatten(dict(document)["files"])]
    for chunk in (1, 3, 64, 1 << 18):
        monkeypatch.setattr(scan, "CHUNK", chunk)
        assert [e.row("") for e in scan.read_directory(io.BytesIO(raw))[0]] == want
    late = bson.Document([("files", bson.Document([("d", bson.Document([("files", bson.Document()), ("unpacked", True)]))]))])
    body = bson.dumps(late) if as_bson else directory._json(late).encode()
    before, after = directory.words(len(body), as_bson)
    assert [(e.path, e.is_dir, e.unpacked) for e in scan.read_directory(io.BytesIO(before + body + after))[0]] == [("d", True, True)]
    with pytest.raises(ValueError):
        scan.read_directory(io.BytesIO(before + body[:-2]))


@pytest.mark.parametrize("kind", ["asar", "bsar"])
def test_a_task_parses_its_own_stretch(spark, tmp_path, monkeypatch, kind):
    from satchel.sources import archive, scan

    path = str(tmp_path / f"x.{kind}")
    files = [(f"d{n % 5}/é{n // 5 % 3}/f{n}", bytes([n % 251]) * (n % 90), False, n % 13 == 0) for n in range(2000)] + [("void", None, True, False)]
    write_archive(spark.createDataFrame(files, "path string, content binary, is_dir boolean, unpacked boolean"), path, compress=str(kind == "bsar").lower())
    reader = archive.ArchiveReader({"path": path, "split": "5000"}, True)
    parts = reader.partitions()
    assert len(parts) > 20
    parsed = 0
    step = scan.Scan._step

    def counted(self):
        nonlocal parsed
        parsed += 1
        return step(self)

    monkeypatch.setattr(scan.Scan, "_step", counted)
    monkeypatch.setattr(scan, "CHUNK", 512)
    rows = [r for p in parts for r in reader.read(p)]
    assert parsed < 2 * len(rows)
    whole = archive.ArchiveReader({"path": path}, True)
    assert len(whole.partitions()) == 1 and list(whole.read(whole.partitions()[0])) == rows
    assert sorted(r[1] for r in rows) == list(range(len(rows)))
    df = read_archive(spark, path, content=True, split="5000")
    assert df.rdd.getNumPartitions() == len(parts)
    assert {r.path: r.content and bytes(r.content) for r in df.where("not is_dir").collect()} == {p: None if u else b for p, b, d, u in files if not d}
    write_archive(spark.createDataFrame(files[:700], "path string, content binary, is_dir boolean, unpacked boolean"), path)  # the cuts of df hold no longer
    assert df.where("not is_dir").count() == 700
