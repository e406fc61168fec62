"""Zip archives read by their index, member by member."""

import io
import zipfile

import pytest

from corpusmill.sources import archives


def archive(members, method=zipfile.ZIP_DEFLATED, before=b""):
    out = io.BytesIO()
    out.write(before)
    with zipfile.ZipFile(out, "a", method) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_members_of_many_archives(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.zip").write_bytes(archive([("z.html", "last"), ("1.HTM", "é漢".encode()), ("n/2.html", b"\xff bad"), ("x.txt", "no")], before=b"shell\n" * 9))
    (tmp_path / "deep" / "b.zip").write_bytes(archive([("1.html", ""), ("big.html", "w" * 3_000_000)], zipfile.ZIP_STORED))
    (tmp_path / "c.zip").write_bytes(archive([("only.txt", "no")]))
    (tmp_path / "broken.zip").write_bytes(b"not an archive")
    pages, errors = archives.read_html(spark, str(tmp_path))
    got = [(r["page_id"], r["archive"].rsplit("/", 1)[1], r["url"], r["html"]) for r in pages.orderBy("page_id").collect()]
    assert got == [(0, "a.zip", "1.HTM", "é漢"), (1, "a.zip", "n/2.html", "\ufffd bad"), (2, "a.zip", "z.html", "last"), (3, "b.zip", "1.html", ""), (4, "b.zip", "big.html", "w" * 3_000_000)]
    assert [(r["archive"].rsplit("/", 1)[1], r["name"], r["error"]) for r in errors.collect()] == [("broken.zip", None, "no zip archive")]


def test_an_index_reads_no_member(spark, tmp_path, monkeypatch):
    data = archive([(f"{i}.html", bytes(1000)) for i in range(50)], zipfile.ZIP_STORED)
    (tmp_path / "a.zip").write_bytes(data)
    rows = archives.members(spark, str(tmp_path)).orderBy("offset").collect()
    assert len(rows) == 50 and all(r["size"] == r["packed"] == 1000 and data[r["offset"] : r["offset"] + 4] == b"PK\x03\x04" for r in rows)


@pytest.mark.parametrize("spoil", ["data", "header", "encrypted"])
def test_a_spoilt_member_is_an_error_of_its_own(spark, tmp_path, spoil):
    data = bytearray(archive([("1.html", "good"), ("2.html", "spoilt"), ("3.html", "good too")], zipfile.ZIP_STORED))
    at = data.index(b"spoilt")
    if spoil == "data":
        data[at] ^= 1
    elif spoil == "header":
        data[at - 36] ^= 1
    else:
        data[data.index(b"PK\x01\x02", data.index(b"PK\x01\x02") + 4) + 8] |= 1
    (tmp_path / "a.zip").write_bytes(bytes(data))
    pages, errors = archives.read_html(spark, str(tmp_path))
    assert [r["html"] for r in pages.orderBy("page_id").collect()] == ["good", "good too"] and [r["name"] for r in errors.collect()] == ["2.html"]


def test_written_archives_come_back(spark, tmp_path):
    rows = [(f"k{i % 3}", f"p/{i:03}.html", f"<p>{i}</p>" if i % 7 else None) for i in range(40)]
    written = archives.write_archives(spark.createDataFrame(rows, "archive string, url string, html string"), f"file://{tmp_path}/out")
    assert {r["archive"].rsplit("/", 1)[1]: r["members"] for r in written.collect()} == {"k0.zip": 14, "k1.zip": 13, "k2.zip": 13}
    pages, errors = archives.read_html(spark, f"file://{tmp_path}/out")
    assert {(r["url"], r["html"]) for r in pages.collect()} == {(u, h or "") for _, u, h in rows} and errors.count() == 0


def test_names_are_not_gathered_and_pages_not_shuffled(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(archive([("2.html", "two"), ("1.html", "one"), ("1.html", "one again")]))
    pages, _ = archives.read_html(spark, str(tmp_path))
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.index("MapInArrow") < plan.index("SortMergeJoin")
    assert sorted((r["page_id"], r["html"]) for r in pages.collect()) == [(0, "one"), (0, "one again"), (1, "two")]


def test_no_archives(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    pages, errors = archives.read_html(spark, str(tmp_path))
    assert pages.count() == 0 and errors.count() == 0
