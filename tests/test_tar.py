"""The Tar source and sink on archives that the standard library writes."""

from __future__ import annotations

import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from loomwork.sources.tar import read_tar, write_tar

FILES = [("a.txt", b"first"), ("d/" + "long" * 60 + "/b.bin", bytes(range(256)) * 9), ("ɛ/ɔ.mp3", b""), ("a.txt", b"again"), ("z/" + "n" * 180, b"x" * 5000)]


def archive(path, kind, files=FILES):
    with tarfile.open(path, "w", format=kind) as tar:
        folder = tarfile.TarInfo("d")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(data), 1700000000
            tar.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "a.txt"
        tar.addfile(link)
    return str(path)


def of(df):
    return sorted((r.member, bytes(r.content)) for r in df.collect())


@pytest.mark.parametrize("kind", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
@pytest.mark.parametrize("split", ["1", "3000", "100000000"])
def test_members(spark, tmp_path, kind, split):
    path = archive(tmp_path / "x.tar", kind)
    df = read_tar(spark, path, splitBytes=split)
    rows = df.collect()
    assert sorted((r.member, bytes(r.content)) for r in rows) == sorted(FILES)
    assert all(r.problem is None and r.size == len(r.content) and r.modified.timestamp() == 1700000000 for r in rows)
    raw = open(path, "rb").read()
    assert all(raw[r.offset : r.offset + r.size] == r.content for r in rows)
    assert df.rdd.getNumPartitions() == {"1": 7, "3000": 3, "100000000": 1}[split]


def test_names_reach_the_reader(spark, tmp_path):
    path = archive(tmp_path / "x.tar", tarfile.PAX_FORMAT)
    named = read_tar(spark, path, splitBytes="2000").filter("member in ('a.txt', 'none') and size > 0")
    assert of(named) == [("a.txt", b"again"), ("a.txt", b"first")]
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert "member" not in plan.split("Filter")[1].split("\n")[0] if "Filter" in plan else True
    assert of(read_tar(spark, path).filter(F.col("member") == FILES[1][0])) == [FILES[1]]
    assert read_tar(spark, path).filter("member = 'd'").count() == 0
    assert [r.content for r in read_tar(spark, path, contents="false").collect()] == [None] * 5


def test_folders_and_compression(spark, tmp_path):
    archive(tmp_path / "b.tar", tarfile.GNU_FORMAT, FILES[:2])
    archive(tmp_path / "a.tar", tarfile.GNU_FORMAT, FILES[2:])
    archive(tmp_path / "empty.tar", tarfile.GNU_FORMAT, [])
    raw = archive(tmp_path / "_hidden.tar", tarfile.GNU_FORMAT)
    (tmp_path / "c.tar.gz").write_bytes(gzip.compress(open(raw, "rb").read()))
    (tmp_path / "notes.txt").write_text("no archive")
    df = read_tar(spark, str(tmp_path))
    assert of(df) == sorted(FILES * 2)
    assert sorted({r.path.rsplit("/", 1)[1] for r in df.collect()}) == ["a.tar", "b.tar", "c.tar.gz"]
    (tmp_path / "cut.tgz").write_bytes(gzip.compress(open(raw, "rb").read())[:300])
    assert [bool(r.problem) for r in read_tar(spark, str(tmp_path / "cut.tgz")).collect()][-1]


def test_cut_archives(spark, tmp_path):
    """Wherever an archive is cut, whole members are read, one that is cut is named, and the archive is reported."""
    whole = open(archive(tmp_path / "x.tar", tarfile.GNU_FORMAT), "rb").read()
    ends, at = [], 0
    with tarfile.open(tmp_path / "x.tar") as tar:
        ends = [(m.offset_data, m.offset_data + m.size, m.name) for m in tar if m.isreg()]
    for at in (100, 512, ends[0][0], ends[0][0] + 3, ends[1][0] + 100, ends[1][1], ends[4][1] - 1, ends[4][1] + 500, 0):
        cut = tmp_path / f"cut{at}.tar"
        cut.write_bytes(whole[:at])
        rows = read_tar(spark, str(cut)).collect()
        good = [r.member for r in rows if r.problem is None]
        assert good == [name for begin, end, name in ends if end <= at and begin <= at]
        assert any(r.problem for r in rows)
        broken = [r.member for r in rows if r.problem and r.member]
        assert broken == [name for begin, end, name in ends if begin <= at < end]
        assert all(r.content is None for r in rows if r.problem)
        with pytest.raises(Exception, match="cut|damaged"):
            read_tar(spark, str(cut), mode="FAILFAST").collect()
    (tmp_path / "junk.tar").write_bytes(b"no archive" * 300)
    assert [r.member for r in read_tar(spark, str(tmp_path / "junk.tar")).collect()] == [None]


def test_sink(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(300).select(F.format_string("m%04d-" + "n" * 150, "id").alias("member"), F.when(F.col("id") % 7 != 0, F.repeat(F.col("id").cast("string"), 50)).cast("binary").alias("content"))
    write_tar(df.repartition(4), path)
    want = {(f"m{i:04}-" + "n" * 150, (str(i) * 50).encode() if i % 7 else b"") for i in range(300)}
    assert set(of(read_tar(spark, path))) == want
    write_tar(df.limit(3), path)
    assert read_tar(spark, path).count() == 303
    write_tar(df.limit(3), path, "overwrite")
    assert read_tar(spark, path).count() == 3
    write_tar(df.filter("false"), path)
    assert read_tar(spark, path).count() == 3
    with pytest.raises(Exception, match="without a name"):
        write_tar(df.withColumn("member", F.lit(None).cast("string")), path)
    assert read_tar(spark, path).count() == 3
