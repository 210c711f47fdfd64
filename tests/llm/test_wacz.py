import base64
import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from tickloom.llm import wacz

PAGES = [
    (5, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (7, "http://c/", None), (3, None, ""),
    (9, "http://d/\r\nX: y", "é漢😀" * 1000), (None, "http://e/", "<p>one</p>"), (None, "http://f/", "only here"),
    (11, "http://g/", "again"), (11, "http://g/", "again"), (12, "http://h/", "again"), (-4, "http://i/", "neg"),
    (0, "http://j/", "neg"), (-1, "http://k/", "neg"), (None, "http://l/", "neg"), (None, "http://l/", "neg"),
]
SCHEMA = "page_id bigint, url string, html string, payload string, _key string, again string, package string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", "x", "x", "x") for p in PAGES], SCHEMA)


def plain(pages):
    first = {}
    for page, _, html in pages:
        key = html or ""
        known = first.get(key)
        first[key] = page if known is None else known if page is None else min(known, page)
    out = []
    for page, _, html in pages:
        data, head = (html or "").encode(), first[html or ""]
        kind = "response" if page == head else "revisit"
        out.append((page, len(data), wacz.digest(data), kind, None if kind == "response" else head))
    return out


def order(rows):
    return sorted(rows, key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("package", [1, 1000, wacz.PACKAGE])
def test_round_trip(pages, package):
    manifest = wacz.write_packages(pages, wacz.shared_folder(pages), package=package)
    index = wacz.read_index(manifest)
    rows = wacz.read_records(index).collect()
    assert order((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) \
        == order(plain(PAGES))
    html = {(i, (h or "").encode()) for i, _, h in PAGES}
    for r in rows:
        if r["record_type"] == "response":
            assert (r["page_id"], bytes(r["payload"])) in html
            assert hashlib.sha1(r["payload"]).digest() == base64.b32decode(r["payload_digest"])
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)


def test_packages_open_with_a_plain_zip_reader(pages):
    for row in wacz.write_packages(pages, wacz.shared_folder(pages)).collect():
        system, path = wacz._target(row["package"])
        archive = zipfile.ZipFile(io.BytesIO(system.open_input_file(path).read()))
        assert archive.testzip() is None
        assert [i.filename for i in archive.infolist()] == [wacz.ARCHIVE, wacz.INDEX]
        assert all(i.compress_type == zipfile.ZIP_STORED for i in archive.infolist())


def test_without_dedupe_all_are_responses(pages):
    manifest = wacz.write_packages(pages, wacz.shared_folder(pages), dedupe=False)
    rows = wacz.read_records(wacz.read_index(manifest), payload=False).collect()
    assert len(rows) == len(PAGES) and {r["record_type"] for r in rows} == {"response"}


def packed(entries, comment=b"", compression=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        for name, data in entries:
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def test_reads_packages_of_other_writers():
    entries = [("a.txt", b"hello"), (wacz.ARCHIVE, b"x" * 70_000), ("dir/b", b"")]
    source = pa.BufferReader(packed(entries, comment=b"PK\x05\x06 is also in the comment" * 3))
    found = wacz.members(source)
    assert len(found) == len(entries)
    for member, (name, data) in zip(found, entries):
        assert member.name == name and source.read_at(member.size, member.start) == data


def test_plain_comment_and_compressed_member():
    source = pa.BufferReader(packed([(wacz.ARCHIVE, b"y" * 1000)], b"a comment", zipfile.ZIP_DEFLATED))
    assert wacz.members(source)[0].method == zipfile.ZIP_DEFLATED
    with pytest.raises(ValueError, match="compressed"):
        wacz.stored(source, wacz.ARCHIVE)
    with pytest.raises(ValueError, match="no member"):
        wacz.stored(source, "other")
    with pytest.raises(ValueError, match="no end"):
        wacz.members(pa.BufferReader(b"not a package"))


def test_empty_table(pages):
    manifest = wacz.write_packages(pages.filter("false"), wacz.shared_folder(pages))
    assert manifest.collect() == [] and wacz.read_records(wacz.read_index(manifest)).collect() == []
