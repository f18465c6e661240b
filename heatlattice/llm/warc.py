"""WARC archives in ZIP packages: writing them from pages, and reading them back by ranges.

A package holds ``archive/data.warc.gz``, in which every record is a gzip member of its own, and ``indexes/index.cdxj``
with the offset and length of each. Both are stored, not compressed by the ZIP, so a record lies in the package as it is.

Reading takes three steps. (1) From the end of a package, its end record and, where numbers are too great for it, the
ZIP64 one lead to the central directory, and that to the local headers: names and places of all stored members. (2) The
indexes give the records' places, which are put together to ranges of bounded size and dealt out over all tasks, those
of one great package too. (3) Each range is read by itself; nothing is extracted. Archive members that no index lists
are read from their beginning to their end in pieces. Archives may be gzip members or plain; compressed or encrypted
ZIP members cannot be read by ranges and are an error.

Payloads are UTF-8. Of records with equal payloads of ``LEAST`` bytes or more, that with the smallest page_id (null
last; one of them if it is repeated) is a response; the others are revisits, which carry its digest and refer to its record.
Smaller payloads are all responses. Read back, a revisit has the payload of the record it refers to; one whose record is
in no package has what its own header says, and refers to no page.

Files are opened with pyarrow's file systems, so the folder must be one that the tasks reach by its address. A package
counts only if the table of packages, which Spark writes last, names it: what a lost task left is never read.

A null html is the empty text, a null page_id stays null, a null url has no header. Line ends and other control
characters of an url are percent-encoded. Every page gives one row; an empty table gives no package and no row. Only the three
columns are read, so other columns can have any name.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatlattice.llm.common import _arrow, checked_broadcast
from heatlattice.storage import scratch, stored

LEAST = 100
DATE = "2024-01-01T00:00:00Z"
#: A package is closed at so many bytes or records; a range has so many at most, or one record; a piece of a member without an index.
PACKAGE_BYTES, PACKAGE_RECORDS, RANGE_BYTES, RANGE_RECORDS, PIECE = 1 << 28, 1 << 17, 1 << 22, 1024, 1 << 20

# Names of members and headers of the public formats.
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + uri[5:] if re.match(r"file:/[^/]", uri) else uri)


# --- writing


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST) -> DataFrame:
    """rid, page_id, url, payload, digest and first (the rid of the response that a revisit refers to, else null) of every page."""
    payload = F.coalesce(pages[text_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = stored(rows.withColumn("digest", F.sha2("payload", 256)))  # from here on rids stay as they are
    order = F.struct(F.col("page_id").isNull(), "page_id", "rid")
    equal = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min_by("rid", order).alias("first"), F.count("*").alias("n"))
    firsts = stored(equal.filter("n > 1").drop("n"))
    joined = rows.join(checked_broadcast(firsts, firsts.count()), "digest", "left")
    return joined.select("rid", "page_id", "url", "payload", "digest", F.when(F.col("first") != F.col("rid"), F.col("first")).alias("first"))


def record_id(rid: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{rid}').urn}>"


def framed(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", len(block))] if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def record(row: dict, date: str) -> tuple[str | None, bytes]:
    """The target address and the record of a row of roles()."""
    url = None if row["url"] is None else re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), row["url"])
    revisit = row["first"] is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(row["payload"])
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(row["rid"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Page-ID", row["page_id"]),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ("WARC-Profile", REVISIT if revisit else None),
        ("WARC-Refers-To", record_id(row["first"]) if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return url, framed(headers, http if revisit else http + row["payload"])


def package(path: str, rows: Iterator[dict], date: str, most_bytes: int, most_records: int) -> int:
    """Writes rows to one package until it is full; how many records it has."""
    system, at = opened(path)
    lines, size = [], 0
    with system.open_output_stream(at) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as zipped:
        stamp = re.sub(r"\D", "", date)
        with zipped.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as member:
            size += member.write(gzip.compress(framed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(-1)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), mtime=0))
            for row in rows:
                url, plain = record(row, date)
                packed = gzip.compress(plain, 6, mtime=0)
                lines.append(f"{url or '-'} {stamp} {json.dumps({'offset': str(size), 'length': str(len(packed)), 'filename': ARCHIVE.split('/')[1]})}\n")
                size += member.write(packed)
                if size >= most_bytes or len(lines) >= most_records:
                    break
        with zipped.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
            for line in sorted(lines):
                member.write(line.encode())
        zipped.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "created": date}))
    return len(lines)


def write(rows: DataFrame, folder: str, date: str = DATE, most_bytes: int = PACKAGE_BYTES, most_records: int = PACKAGE_RECORDS) -> DataFrame:
    """Writes rows of roles() to packages in a folder; path and records of each, as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, number = TaskContext.get(), 0
        rows = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist())
        while (first := next(rows, None)) is not None:
            path = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}-{number}.wacz"
            number += 1
            n = package(path, (r for part in ([first], rows) for r in part), date, most_bytes, most_records)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return stored(rows.mapInArrow(run, "path string, records long"))


# --- reading packages


def directory(file: pa.NativeFile, size: int) -> list[dict]:
    """name, start and size of every member that is stored, from the central directory."""
    tail_at = max(0, size - 65_557)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) < at + 22 or len(tail) - at - 22 != struct.unpack_from("<H", tail, at + 20)[0]):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end record: not a ZIP package")
    disk, _, _, n, length, offset = struct.unpack_from("<4H2L", tail, at + 4)
    end = tail_at + at
    if 0xFFFF in (disk, n) or 0xFFFFFFFF in (length, offset):
        if end < 20:
            raise ValueError("no ZIP64 locator")
        file.seek(end - 20)
        mark, _, end64, _ = struct.unpack("<4sLQL", file.read(20))
        if mark != LOCATOR:
            raise ValueError("no ZIP64 locator")
        file.seek(end64)
        mark, _, _, _, disk, _, _, n, length, offset = struct.unpack("<4sQ2H2L4Q", file.read(56))
        if mark != END64:
            raise ValueError("no ZIP64 end record")
    if disk:
        raise ValueError("a package of several volumes")
    file.seek(offset)
    entries, at, out = file.read(length), 0, []
    for _ in range(n):
        mark, flags, method = struct.unpack_from("<4s4x2H", entries, at)
        packed, plain, name_n, extra_n, comment_n, header = struct.unpack_from("<2L3H8xL", entries, at + 20)
        if mark != ENTRY:
            raise ValueError("no entry of the directory")
        name = entries[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = entries[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, m = struct.unpack_from("<2H", extra)
            if kind == 1:  # 64-bit numbers, of those fields alone that are full
                numbers = iter(struct.unpack_from(f"<{m // 8}Q", extra, 4))
                plain, packed, header = (next(numbers) if x == 0xFFFFFFFF else x for x in (plain, packed, header))
            extra = extra[4 + m :]
        at += 46 + name_n + extra_n + comment_n
        out.append({"name": name, "header": header, "size": packed, "stored": method == 0 and not flags & 1})
    return out


def start(file: pa.NativeFile, entry: dict) -> int:
    """Where a member's bytes begin."""
    if not entry["stored"]:
        raise ValueError(f"{entry['name']} is compressed or encrypted, so it has no ranges")
    file.seek(entry["header"])
    mark, name, extra = struct.unpack("<4s22x2H", file.read(30))
    if mark != LOCAL:
        raise ValueError("no local header")
    return entry["header"] + 30 + name + extra


def places(file: pa.NativeFile, entries: list[dict]) -> dict[str, list[tuple[int, int]]]:
    """Offset and length of every record that an index lists, by the name of its archive."""
    out: dict[str, list[tuple[int, int]]] = {}
    for entry in entries:
        if not re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", entry["name"]):
            continue
        file.seek(start(file, entry))
        data = file.read(entry["size"])
        for line in (gzip.decompress(data) if entry["name"].endswith(".gz") else data).splitlines():
            if (at := line.find(b"{")) >= 0:
                found = json.loads(line[at:])
                out.setdefault(found["filename"], []).append((int(found["offset"]), int(found["length"])))
    return {name: sorted(set(found)) for name, found in out.items()}


RANGES = "path string, start long, size long, offsets array<long>, lengths array<long>"


def ranges(packages: DataFrame, range_bytes: int = RANGE_BYTES, range_records: int = RANGE_RECORDS) -> DataFrame:
    """path, start, size, and offsets (from start) and lengths of the records of every range; null ones for a whole archive without an index."""

    def cut(path: str) -> Iterator[dict]:
        system, at = opened(path)
        with system.open_input_file(at) as file:
            entries = directory(file, file.size())
            listed = places(file, entries)
            for entry in entries:
                if not re.fullmatch(r"archive/.*\.warc(\.gz)?", entry["name"]):
                    continue
                begin, now = start(file, entry), []
                found = listed.get(entry["name"].split("/", 1)[1])
                if found is None:
                    yield {"path": path, "start": begin, "size": entry["size"], "offsets": None, "lengths": None}
                    continue
                for offset, length in [*found, (None, 0)]:
                    if now and (offset is None or offset + length - now[0][0] > range_bytes or len(now) >= range_records):
                        yield {"path": path, "start": begin + now[0][0], "size": now[-1][0] + now[-1][1] - now[0][0], "offsets": [o - now[0][0] for o, _ in now], "lengths": [n for _, n in now]}
                        now = []
                    now.append((offset, length))

    kinds = T._parse_datatype_string(RANGES)
    schema = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for row in cut(path):
                    yield pa.RecordBatch.from_pylist([row], schema)

    return packages.select("path").repartition("path").mapInArrow(run, kinds)


# --- reading records


def fields(head: bytes) -> dict[str, str]:
    """Headers by lower-case name."""
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in lines if colon}


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    own = fields(head)
    block = rest[: int(own.get("content-length", len(rest)))]
    if not own.get("content-type", "").startswith("application/http"):
        return own, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return own, fields(http), payload


def sequence(file: pa.NativeFile, begin: int, size: int, piece: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of an archive without an index, plain or of gzip members, read in pieces."""
    file.seek(begin)
    left, data, offset = size, b"", 0

    def more() -> bool:
        nonlocal left, data
        part = file.read(min(piece, left))
        left -= len(part)
        data += part
        return bool(part)

    while data or more():
        while len(data) < 2 and more():
            pass
        if data[:2] == b"\x1f\x8b":
            unpack, out, used = zlib.decompressobj(31), [], 0
            while not unpack.eof and (data or more()):
                out.append(unpack.decompress(data))
                used += len(data) - len(unpack.unused_data)
                data = unpack.unused_data
            if not unpack.eof:
                raise ValueError("a record that is cut off")
            yield offset, b"".join(out)
        else:
            while b"\r\n\r\n" not in data and more():
                pass
            head = data.partition(b"\r\n\r\n")[0]
            used = len(head) + 4 + int(fields(head)["content-length"]) + 4
            while len(data) < used and more():
                pass
            yield offset, data[:used]
            data = data[used:]
        offset += used


RECORDS = "path string, offset long, record_id string, record_type string, page_id string, url string, payload_bytes long, payload_digest string, intact boolean, refers_to_record string, payload binary"


def records(found: DataFrame, payload: bool = True) -> DataFrame:
    """A row for each response and revisit of ranges(): its headers, size and digest of what it holds, and the payload if wanted.

    ``intact`` is whether a response's payload has the digest of its header.
    """
    kinds = T._parse_datatype_string(RECORDS)
    schema = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in kinds])

    def row(path: str, offset: int, data: bytes) -> dict | None:
        own, http, body = parsed(data)
        kind = own.get("warc-type")
        if kind not in ("response", "revisit"):
            return None
        said = own.get("warc-payload-digest", "").removeprefix("sha256:")
        digest = hashlib.sha256(body).hexdigest() if kind == "response" else said
        size = len(body) if kind == "response" else int(http.get("content-length", 0))
        return {
            "path": path, "offset": offset, "record_id": own.get("warc-record-id"), "record_type": kind, "page_id": own.get("warc-page-id"), "url": own.get("warc-target-uri"),
            "payload_bytes": size, "payload_digest": digest, "intact": digest == said, "refers_to_record": own.get("warc-refers-to"), "payload": body if payload else None,
        }

    def of_range(r: dict) -> Iterator[dict]:
        system, at = opened(r["path"])
        with system.open_input_file(at) as file:
            if r["offsets"] is None:
                pieces = sequence(file, r["start"], r["size"])
            else:
                file.seek(r["start"])
                data = file.read(r["size"])
                slices = ((o, data[o : o + n]) for o, n in zip(r["offsets"], r["lengths"], strict=True))
                pieces = ((o, gzip.decompress(x) if x[:2] == b"\x1f\x8b" else x) for o, x in slices)
            for offset, x in pieces:
                if (out := row(r["path"], r["start"] + offset, x)) is not None:
                    yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                now, size = [], 0
                for one in of_range(r):
                    now.append(one)
                    size += len(one["payload"] or b"") + 512
                    if size > RANGE_BYTES:
                        yield pa.RecordBatch.from_pylist(now, schema)
                        now, size = [], 0
                if now:
                    yield pa.RecordBatch.from_pylist(now, schema)

    return found.repartition("path", "start").mapInArrow(run, kinds)


def resolved(rows: DataFrame, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page) of stored records(), revisits as the response they refer to."""
    revisits = rows.filter("record_type = 'revisit'")
    wanted = stored(revisits.select(F.col("refers_to_record").alias("record_id")).distinct())
    responses = rows.filter("record_type = 'response'")
    met = stored(responses.join(checked_broadcast(wanted, wanted.count()), "record_id", "left_semi").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("digest")))
    seen = revisits.join(checked_broadcast(met, met.count()), "refers_to_record", "left")
    of = lambda df, n, digest, to: df.select(F.col("page_id").cast(id_type).alias("page_id"), n.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", to.cast(id_type).alias("refers_to"))
    one = of(responses, F.col("payload_bytes"), F.col("payload_digest"), F.lit(None))
    return one.unionByName(of(seen, F.coalesce("n", "payload_bytes"), F.coalesce("digest", "payload_digest"), F.col("to")))


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST) -> DataFrame:
    """resolved() rows of the packages that all pages were written to."""
    packages = write(roles(pages, id_col, url_col, text_col, least), scratch(spark, ".packages"))
    return resolved(stored(records(ranges(packages), payload=False)), dict(pages.dtypes)[id_col])


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page_id NULLS LAST) AS i, min(page_id) OVER (PARTITION BY digest) AS least FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n < {LEAST} OR i = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n >= {LEAST} AND i > 1 THEN least END AS refers_to FROM r"""
