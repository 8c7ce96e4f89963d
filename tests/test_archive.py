"""Tar members read by tasks of their own."""

import bz2
import io
import json
import tarfile

import pytest

from hoplattice.sources import archive


def written(path, members):
    with tarfile.open(path, "w") as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return str(path)


RECORDS = [json.dumps({"id": k, "title": f"t{k} é", "text": ["a", "b" * (k % 50)]}) for k in range(3_000)]
PLAIN = "\n".join(RECORDS[:1_000]).encode() + b"\n\n"
MEMBERS = {
    "a/plain.jsonl": PLAIN,
    "a/packed.jsonl.bz2": bz2.compress("\n".join(RECORDS[1_000:]).encode()),
    "two.bz2": bz2.compress(b"x\ny") + bz2.compress(b"z\nlast"),
    "empty": b"",
    "../outside": b"no",
    "/absolute": b"no",
}


def test_members_are_indexed_and_streamed(spark, tmp_path):
    path = written(tmp_path / "x.tar", MEMBERS)
    assert [m.name for m in archive.index(path)] == ["a/plain.jsonl", "a/packed.jsonl.bz2", "two.bz2", "empty"]
    found = archive.tar_lines(spark, path)
    assert found.rdd.getNumPartitions() == 4
    got = {}
    for r in found.collect():
        got.setdefault(r["member"], {})[r["line"]] = r["text"]
    assert [got["a/plain.jsonl"][k] for k in range(1_001)] == [*RECORDS[:1_000], ""]
    assert [got["a/packed.jsonl.bz2"][k] for k in range(2_000)] == RECORDS[1_000:]
    assert list(got["two.bz2"].values()) == ["x", "yz", "last"] and "empty" not in got


def test_source_is_described(spark, tmp_path):
    path = written(tmp_path / "y.tar", {"p": PLAIN + b'{"id": 1}\n'})
    found = archive.tar_lines(spark, path)
    fields = archive.probe(found, {"key": ["uid", "id"], "title": ["title"]}, sample=50)
    assert fields == {"key": "id", "title": "title"}
    row = archive.described(found, fields).first().asDict()
    assert row == {"members": 1, "lines": 1_002, "blank": 1, "lacking": 1, "bytes": len(PLAIN) - 1_001 + 9, "field_key": "id", "field_title": "title"}


def test_bounds_and_broken_members(tmp_path, monkeypatch):
    whole = bz2.compress(b"a" * 500_000)
    path = written(tmp_path / "z.tar", {"bomb.bz2": whole, "cut.bz2": whole[:-5]})
    bomb, cut = archive.index(path)
    assert sum(map(len, archive._opened(path, bomb))) == 500_000
    with pytest.raises(ValueError, match="ends early"):
        list(archive._opened(path, cut))
    monkeypatch.setattr(archive, "MAX_MEMBER_BYTES", 100_000)
    with pytest.raises(ValueError, match="unpacks to over"):
        list(archive._opened(path, bomb))
    big = written(tmp_path / "b.tar", {"big": b"a" * 100_001})
    with pytest.raises(ValueError, match="100001 bytes"):
        archive.index(big)


def test_lines_hold_no_more_than_one():
    assert list(archive.lines(iter([b"a\xc3", b"\xa9\nb", b"", b"\n\nc"]))) == ["aé", "b", "", "c"] and list(archive.lines(iter([]))) == []
