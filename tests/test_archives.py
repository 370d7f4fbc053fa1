"""Archives: members, nesting, and what is refused."""

import gzip
import io
import tarfile
import zipfile

from sievespark.sources.archives import Limits, members, read_archives


def zipped(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def tarred(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for k, v in files.items():
            info = tarfile.TarInfo(k)
            info.size = len(v)
            t.addfile(info, io.BytesIO(v))
    return out.getvalue()


def test_members():
    inner = tarred({"x/y.txt": b"deep", "../out": b"no"})
    data = zipped({"a.txt": b"one", "b.tar.gz": gzip.compress(inner), "/abs": b"no", "empty": b""})
    got = {k: (c, e) for k, c, e in members(data, Limits())}
    assert got == {"a.txt": (b"one", None), "empty": (b"", None), "/abs": (None, "ERR_ARCHIVE_PATH"), "b.tar.gz!x/y.txt": (b"deep", None), "b.tar.gz!../out": (None, "ERR_ARCHIVE_PATH")}


def test_limits():
    assert members(zipped({"a": b"0" * 10_000}), Limits(total=9_999)) == [("", None, "ERR_LIMIT")]
    assert members(zipped({str(i): b"" for i in range(6)}), Limits(members=5)) == [("", None, "ERR_LIMIT")]
    nested = b"text"
    for _ in range(6):
        nested = zipped({"n": nested})
    assert [e for _, _, e in members(nested, Limits())] == ["ERR_ARCHIVE_DEPTH"]
    assert members(zipped({"a": b"one"})[:-30], Limits()) == [("", None, "ERR_ARCHIVE")]
    assert members(gzip.compress(b"one" * 99)[:20], Limits()) == [("", None, "ERR_ARCHIVE")]


def test_read_archives(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped({"a.txt": b"one"}))
    (tmp_path / "b.txt").write_bytes(b"plain")
    (tmp_path / "c").write_bytes(b"x" * 2000)
    got = sorted((r.path.rsplit("/", 1)[1], r.member, r.content and bytes(r.content), r.error) for r in read_archives(spark, str(tmp_path), 1000).collect())
    assert got == [("a.zip", "a.txt", b"one", None), ("b.txt", "", b"plain", None), ("c", "", None, "ERR_TOO_LARGE")]
