import gzip
import hashlib
import io
import json
import zipfile

import pyarrow as pa
import pytest

from heatlattice.llm import warc


def expected(rows):
    """page_id, payload_bytes, payload_digest, record_type and refers_to of (page_id, url, html) rows."""
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    first, seen, out = {}, set(), []
    for p, data in payloads:
        if len(data) >= 100 and (data not in first or (p is not None and (first[data] is None or p < first[data]))):
            first[data] = p
    for p, data in payloads:
        revisit = len(data) >= 100 and (p != first[data] or data in seen)
        if p == first.get(data, ""):
            seen.add(data)
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=str)


def rows():
    page = lambda i: f"<p>{i} Öl ﬁ</p>\r\n\r\n" * (5 + i % 4)
    out = [(i, f"http://host/{i % 7}?a=%20 b\r\nX: {i}", page(i % 90)) for i in range(300)]
    out += [(1000 + i, None, page(3)) for i in range(200)]
    out += [(2, "u", page(2)), (2, "u", page(2)), (400, "u", "new " * 30), (400, "u", "new " * 30), (None, "u", page(5)), (None, None, "only null " * 20), (None, "", "only null " * 20)]
    return [*out, (500, "u", None), (501, "u", ""), (502, "u", "x" * 99), (503, "u", "x" * 99), (504, "u", "x" * 100), (505, "u", "x" * 100), (506, "u", "long \x00 WARC/1.1\r\n\r\n" * 100_000), (-5, "u", "x" * 100)]


def table(spark, rows):
    full = [(*r, 1, "x", "d", 2) for r in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, rid int, payload string, digest string, `a.b` int")


def test_round_trip(spark, monkeypatch, tmp_path):
    found = warc.round_trip(spark, table(spark, rows()).repartition(4))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows())
    packages = warc.write(warc.roles(table(spark, rows()).repartition(3)), f"file://{tmp_path}", most_bytes=20_000, most_records=40)
    assert packages.count() > 8 and packages.agg({"records": "sum"}).first()[0] == len(rows())
    pieces = warc.ranges(packages, 3000, 7)
    assert all(len(r.offsets) <= 7 and (r["size"] <= 3000 or len(r.offsets) == 1) for r in pieces.collect())
    again = warc.stored(warc.records(pieces))
    assert again.filter("record_type = 'response' and (not intact or payload_bytes <> octet_length(payload))").isEmpty()
    assert sorted(map(tuple, warc.resolved(again).collect()), key=str) == expected(rows())
    texts = {r.page_id: bytes(r.payload).decode() for r in again.filter("record_type = 'response' and page_id is not null").collect()}
    assert texts["506"] == rows()[-2][2] and texts["500"] == ""


def test_no_pages(spark):
    assert warc.round_trip(spark, table(spark, [])).collect() == []


def plain_record(i, refers=None):
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {i}\r\n\r\n".encode()
    kind = "revisit" if refers is not None else "response"
    payload = b"" if refers is not None else b"y" * i
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<r:{i}:{kind}>"), ("WARC-Page-ID", i), ("WARC-Refers-To", refers and f"<r:{refers}:response>"), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(b'y' * i).hexdigest()}"), ("Content-Type", "application/http; msgtype=response")]
    return warc.framed(headers, http + payload)


def packed(members, compress=(), comment=b"", before=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as zipped:
        for name, data in members.items():
            zipped.writestr(name, data, zipfile.ZIP_DEFLATED if name in compress else zipfile.ZIP_STORED)
        zipped.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("zip64", [False, True])
def test_directory(monkeypatch, zip64):
    if zip64:  # every number is then too great for 32 or 16 bits
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 1)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    members = {"a": b"1234", "archive/Ü.warc": b"abc" * 99, "empty": b""}
    data = packed(members, comment=b"PK\5\6 no end record" * 9)
    assert (warc.END64 in data) == zip64
    file = pa.BufferReader(data)
    entries = warc.directory(file, len(data))
    assert [e["name"] for e in entries] == list(members)
    for e in entries:
        begin = warc.start(file, e)
        assert data[begin : begin + e["size"]] == members[e["name"]]


def test_not_readable():
    with pytest.raises(ValueError, match="no end record"):
        warc.directory(pa.BufferReader(b"x" * 100), 100)
    data = packed({"archive/a.warc": b"abc" * 99}, compress=["archive/a.warc"])
    file = pa.BufferReader(data)
    with pytest.raises(ValueError, match="compressed"):
        warc.start(file, warc.directory(file, len(data))[0])


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_sequence(piece):
    whole = [plain_record(i) for i in (0, 5, 300)]
    for data in (b"".join(whole), b"".join(map(gzip.compress, whole)), whole[0] + gzip.compress(whole[1]) + whole[2]):
        found = list(warc.sequence(pa.BufferReader(b"skip" + data + b"rest"), 4, len(data), piece))
        assert [x for _, x in found] == whole
        assert found[0][0] == 0 and found[2][0] == len(data) - (len(whole[2]) if data.endswith(whole[2]) else len(gzip.compress(whole[2])))


def test_foreign_packages(spark, tmp_path):
    """Archives without an index, plain ones, an index in gzip, and a revisit of a record that is nowhere."""
    plain, zipped = b"".join(map(plain_record, (1, 2, 150))), [gzip.compress(plain_record(i, r)) for i, r in ((150, 150), (160, 999))]
    index = "".join(f"k 2024 {json.dumps({'offset': o, 'length': len(x), 'filename': 'b.warc.gz'})}\n" for o, x in ((0, zipped[0]), (len(zipped[0]), zipped[1])))
    (tmp_path / "1.wacz").write_bytes(packed({"archive/a.warc": plain, "other": b"?"}))
    (tmp_path / "2.wacz").write_bytes(packed({"archive/b.warc.gz": b"".join(zipped), "indexes/index.cdx.gz": gzip.compress(index.encode())}))
    packages = spark.createDataFrame([(f"file://{tmp_path}/{n}.wacz",) for n in (1, 2)], "path string")
    got = sorted(map(tuple, warc.resolved(warc.stored(warc.records(warc.ranges(packages)))).collect()), key=str)
    digest = {i: hashlib.sha256(b"y" * i).hexdigest() for i in (1, 2, 150, 160)}
    assert got == [(1, 1, digest[1], "response", None), (150, 150, digest[150], "response", None), (150, 150, digest[150], "revisit", 150), (160, 160, digest[160], "revisit", None), (2, 2, digest[2], "response", None)]
