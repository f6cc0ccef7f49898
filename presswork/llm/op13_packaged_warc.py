r"""Web archives packaged as ZIP files, read by ranges without extraction.

Writing: each task fills archives of about ``ARCHIVE`` bytes. An archive is a ZIP file with stored members: the WARC
records, each a gzip member of its own (``archive/data.warc.gz``), an index of them sorted by URL key
(``indexes/index.cdxj``: key, time, JSON with offset and length), and ``datapackage.json`` with sizes and hashes. A
record of a payload that an earlier page has (the smallest page id with an equal payload of ``LEAST`` bytes or more) is
a revisit: it has the HTTP head alone, with the payload's length, its digest and the response it refers to.

Files are committed by a manifest: a task's files have names of their own, and only those in the table that the
successful tasks wrote count, so what a lost executor leaves is never read.

Reading: the end of a file has its end record (behind a comment, at most 64 KB from the end) and, where sizes, counts or
offsets pass 32 or 16 bits, a locator of the ZIP64 end record; the central directory gives each member's place, with
ZIP64 extra fields, and a member's local head gives where its bytes begin. Index lines give the records' ranges; the
ranges are dealt out, neighbours are read together, and each record is inflated and its payload's hash compared. Members
that are no stored archive with an index line aren't read but for the index; an archive member without an index is
walked from record to record. Nothing is unpacked to a disk.

Files are opened by ``pyarrow.fs`` (local and shared folders, S3, GCS, HDFS), from the URI that Spark gives the folder.

Defined cases: a null html is an empty payload; a null URL is empty; page ids of any type are kept as text in the
archive and cast back; a null id comes last among those of equal payloads, and where all are null all are responses; rows
repeated with one id are all responses if their id is the smallest; payloads under ``LEAST`` bytes are always responses;
an empty table writes no archive and gives no row; control characters of a URL are percent-encoded; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import scratch, small_batches, tidy, written

#: Bytes of an archive that are aimed at, of a payload from which on repeats are revisits, of ranges read at once, and
#: of an archive whose records one task reads.
ARCHIVE, LEAST, READ, SPLIT = 64 << 20, 100, 4 << 20, 32 << 20
LEVEL = 4
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
TIME = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Signatures and fixed parts of ZIP's records, and the values that stand for "see the ZIP64 field". Fixed values.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_HEAD, CENTRAL_HEAD, END_HEAD, END64_HEAD, LOCATOR_HEAD = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH", "<4sQ2H2I4Q", "<4sIQI"
FULL16, FULL32, EXTRA64, UTF8_NAMES = 0xFFFF, 0xFFFFFFFF, 0x0001, 0x0800


def opened(uri: str):
    """(file system, path) of a URI."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI with its scheme, as Spark's own file systems understand it."""
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    uri = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toUri().toString()
    return uri if "://" in uri else uri.replace("file:/", "file:///", 1)


# writing


def zipped(members: list[tuple[str, bytes]], wide: bool = False) -> tuple[bytes, list[int]]:
    """A ZIP file of stored members, and where the bytes of each begin; wide: with ZIP64 fields though none is needed."""
    out, directory, begins, at = [], [], [], 0

    def put(data: bytes) -> None:
        nonlocal at
        out.append(data)
        at += len(data)

    for name, data in members:
        label, crc, size, offset = name.encode(), zlib.crc32(data), len(data), at
        far = wide or size >= FULL32 or offset >= FULL32
        local_extra = struct.pack("<2H2Q", EXTRA64, 16, size, size) if far else b""
        shown, version = (FULL32, 45) if far else (size, 20)
        put(struct.pack(LOCAL_HEAD, LOCAL, version, UTF8_NAMES, 0, 0, 33, crc, shown, shown, len(label), len(local_extra)) + label + local_extra)
        begins.append(at)
        put(data)
        extra = struct.pack("<2H3Q", EXTRA64, 24, size, size, offset) if far else b""
        head = struct.pack(CENTRAL_HEAD, CENTRAL, version, version, UTF8_NAMES, 0, 0, 33, crc, shown, shown, len(label), len(extra), 0, 0, 0, 0, FULL32 if far else offset)
        directory.append(head + label + extra)
    start, whole, n = at, b"".join(directory), len(directory)
    put(whole)
    far = wide or n >= FULL16 or start >= FULL32 or len(whole) >= FULL32
    if far:
        end64 = at
        put(struct.pack(END64_HEAD, END64, 44, 45, 45, 0, 0, n, n, len(whole), start))
        put(struct.pack(LOCATOR_HEAD, LOCATOR, 0, end64, 1))
    shown = (FULL16, FULL16, FULL32, FULL32) if far else (n, n, len(whole), start)
    put(struct.pack(END_HEAD, END, 0, 0, *shown, 0))
    return b"".join(out), begins


def url_key(url: str) -> str:
    """The host's labels from the last one, then path and query: pages of a host and folder lie together."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url, safe="/?&=:")
    labels = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return quote(f"{labels}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower(), safe="/?&=:,)")


def urn(page: str) -> str:
    return f"<urn:x-page:{quote(page, safe='')}>"


def page_of(named: str | None) -> str | None:
    return unquote(named.removeprefix("<urn:x-page:").removesuffix(">")) if named else None


def head_line(value: str) -> str:
    """A value in which no line of a head can begin."""
    return quote(value, safe="!#$%&'()*+,/:;=?@[]~") if any(c < " " or c == "\x7f" for c in value) else value


def record(page: str | None, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response, or a revisit of another page's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {TIME}", f"WARC-Target-URI: {head_line(url)}"]
    if page is not None:
        head.append(f"WARC-Record-ID: {urn(page)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Archive:
    """The records of an archive until it is full."""

    def __init__(self):
        self.parts, self.lines, self.size = [], [], 0
        self._put(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: " + TIME.encode() + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n")

    def _put(self, data: bytes) -> tuple[int, int]:
        packed = gzipped(data)
        self.parts.append(packed)
        self.size += len(packed)
        return self.size - len(packed), len(packed)

    def add(self, page: str | None, url: str, payload: bytes, digest: str, refers_to: str | None) -> None:
        offset, length = self._put(record(page, url, payload, digest, refers_to))
        told = {"url": url, "digest": f"sha256:{digest}", "mime": "text/html" if refers_to is None else "warc/revisit", "status": 200, "filename": DATA.rpartition("/")[2], "offset": offset, "length": length}
        self.lines.append(f"{url_key(url)} 19700101000000 {json.dumps(told)}\n")

    def packed(self, wide: bool = False) -> bytes:
        members = [(DATA, b"".join(self.parts)), (INDEX, "".join(sorted(self.lines)).encode())]
        told = {"profile": "data-package", "resources": [{"path": n, "bytes": len(d), "hash": "sha256:" + hashlib.sha256(d).hexdigest()} for n, d in members]}
        return zipped([*members, (PACKAGE, json.dumps(told).encode())], wide)[0]


def payloads(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page, url, html, digest, refers_to: what is written of each page."""
    body = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size")).filter(F.col("size") >= least)
    repeated = sized.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # of known size once written: small, it is sent to the pages, else joined (a hot digest's pages are split by AQE)
    first = written(repeated, "repeated")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest")).join(first, "digest", "left")
    other = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return rows.select(F.col("page_id").cast("string").alias("page"), "url", "html", "digest", F.when(other, F.col("first_page").cast("string")).alias("refers_to"))


MANIFEST = "path string, n_records bigint, n_bytes bigint"


def write_archives(pages: DataFrame, folder: str, size: int = ARCHIVE, wide: bool = False, least: int = LEAST) -> DataFrame:
    """Writes the pages' archives to a folder; the manifest (path, n_records, n_bytes) of those that count."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        held = Archive()

        def full() -> pa.RecordBatch:
            name, data = f"{uuid.uuid4().hex}.wacz", held.packed(wide)
            with files.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [len(held.lines)], "n_bytes": [len(data)]})

        for batch in batches:
            for page, url, html, digest, first in zip(*(batch.column(c) for c in ("page", "url", "html", "digest", "refers_to")), strict=True):
                held.add(page.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), first.as_py())
                if held.size >= size:
                    yield full()
                    held = Archive()
        if held.lines:
            yield full()

    return written(payloads(pages, least).mapInArrow(tidy(write), MANIFEST), "manifest")


# reading


class Package:
    """The members of a ZIP file, from its directories alone."""

    def __init__(self, file):
        """file: with size() and read_at(n, offset), as pyarrow opens it."""
        self.file = file
        self.members = {m["name"]: m for m in self._members(*self._directory())}

    def _at(self, offset: int, kind: str) -> tuple:
        return struct.unpack(kind, self.file.read_at(struct.calcsize(kind), offset))

    def _directory(self) -> tuple[int, int]:
        """(offset, size) of the central directory."""
        whole, least = self.file.size(), struct.calcsize(END_HEAD)
        begin = max(0, whole - least - FULL16)
        tail = self.file.read_at(whole - begin, begin)
        at = tail.rfind(END)
        while at >= 0 and at + least + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(END, 0, at)  # a signature within the comment
        if at < 0:
            raise ValueError("no end of a ZIP directory")
        *_, n, size, offset, _ = struct.unpack_from(END_HEAD, tail, at)
        if FULL16 == n or FULL32 in (size, offset):
            place = begin + at - struct.calcsize(LOCATOR_HEAD)
            sign, _, end64, _ = self._at(place, LOCATOR_HEAD) if place >= 0 else (b"", 0, 0, 0)
            if sign == LOCATOR:
                sign, *_, size, offset = self._at(end64, END64_HEAD)
                if sign != END64:
                    raise ValueError("no ZIP64 directory where its locator points")
        return offset, size

    def _members(self, offset: int, size: int) -> Iterator[dict]:
        raw, at, fixed = self.file.read_at(size, offset), 0, struct.calcsize(CENTRAL_HEAD)
        while at + fixed <= len(raw):
            sign, _, _, _, method, _, _, crc, packed, plain, n_name, n_extra, n_comment, _, _, _, local = struct.unpack_from(CENTRAL_HEAD, raw, at)
            if sign != CENTRAL:
                raise ValueError("a broken ZIP directory")
            name, extra = raw[at + fixed : at + fixed + n_name], raw[at + fixed + n_name : at + fixed + n_name + n_extra]
            at += fixed + n_name + n_extra + n_comment
            wide = self._wide(extra)
            # the ZIP64 field has, in this order, only what doesn't fit
            plain, packed, local = (next(wide, v) if v == FULL32 else v for v in (plain, packed, local))
            yield {"name": name.decode(), "method": method, "crc": crc, "size": packed, "plain": plain, "local": local}

    @staticmethod
    def _wide(extra: bytes) -> Iterator[int]:
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, at)
            if kind == EXTRA64:
                yield from (v for (v,) in struct.iter_unpack("<Q", extra[at + 4 : at + 4 + n // 8 * 8]))
            at += 4 + n

    def begin(self, name: str) -> int:
        """Where a member's bytes begin: behind its local head."""
        m = self.members[name]
        head = self._at(m["local"], LOCAL_HEAD)
        if head[0] != LOCAL:
            raise ValueError(f"no local head of {name}")
        return m["local"] + struct.calcsize(LOCAL_HEAD) + head[-2] + head[-1]

    def read(self, name: str) -> bytes:
        """A whole small member."""
        m = self.members[name]
        data = self.file.read_at(m["size"], self.begin(name))
        return zlib.decompress(data, -15) if m["method"] == 8 else data

    def archives(self) -> list[str]:
        return [n for n, m in self.members.items() if n.startswith("archive/") and n.endswith((".warc.gz", ".warc")) and m["method"] == 0]

    def records(self) -> Iterator[tuple[int, int, int]]:
        """(record, offset in the file, length) of each record; record counts from 0."""
        known = {n.rpartition("/")[2]: n for n in self.archives()}
        begins, seen, k = {n: self.begin(n) for n in known.values()}, set(), 0
        for name in self.members:
            if not (name.startswith("indexes/") and name.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))):
                continue
            data = self.read(name)
            data = zlib.decompress(data, 47) if name.endswith(".gz") else data
            for line in data.splitlines():
                told = line[line.find(b"{") :]
                if told[:1] != b"{":
                    continue
                told = json.loads(told)
                if (member := known.get(told["filename"].rpartition("/")[2])) is not None:
                    seen.add(member)
                    yield k, begins[member] + int(told["offset"]), int(told["length"])
                    k += 1
        for member in begins.keys() - seen:
            for offset, length in self._walked(begins[member], self.members[member]["size"]):
                yield k, offset, length
                k += 1

    def _walked(self, begin: int, size: int) -> Iterator[tuple[int, int]]:
        """The gzip members one after the other, from pieces of a few MB."""
        at, start, end = begin, begin, begin + size
        unpack = zlib.decompressobj(31)
        while at < end:
            data = self.file.read_at(min(READ, end - at), at)
            at += len(data)
            while data:
                unpack.decompress(data)
                if not unpack.eof:
                    break
                data = unpack.unused_data
                yield start, at - len(data) - start
                start, unpack = at - len(data), zlib.decompressobj(31)


def parsed(raw: bytes) -> dict | None:
    """Type, ids, digest, length and payload of a record; None if it has no page."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record where the index points")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    size = len(payload)
    if kind == "revisit":
        told = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size, payload = int(told[0]), None
    elif hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"a payload of {fields.get('warc-record-id')} is not what was written")
    return {
        "page": page_of(fields.get("warc-record-id")), "url": fields.get("warc-target-uri", ""), "record_type": kind, "payload_bytes": size, "payload_digest": digest,
        "refers_to": page_of(fields.get("warc-refers-to")), "payload": payload,
    }


RECORD = "page string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string"


def index(manifest: DataFrame) -> DataFrame:
    """path, record, offset, length of each record in the archives (path) of a manifest."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = opened(path)
                with files.open_input_file(name) as file:
                    found = list(zip(*Package(file).records(), strict=True)) or [(), (), ()]
                columns = [pa.array([path] * len(found[0]), pa.string()), *(pa.array(c, pa.int64()) for c in found)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "record", "offset", "length"])

    return written(manifest.select("path").repartition("path").mapInArrow(tidy(locate), "path string, record bigint, offset bigint, length bigint"), "index")


def ranges(rows: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """(offset, length) in order, those together that one read of about READ bytes covers."""
    held: list[tuple[int, int]] = []
    for offset, length in rows:
        if held and (offset + length - held[0][0] > READ or offset > held[-1][0] + held[-1][1] + 4096):
            yield held
            held = []
        held.append((offset, length))
    if held:
        yield held


def read_records(located: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of an index, read by ranges: RECORD, and the payload's bytes (null for revisits) if they are asked for."""
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [f.split()[0] for f in schema.split(", ")]
    whole = located.agg(F.sum("length")).first()[0] or 0  # the rows are small, what they point to isn't: tasks by its size
    dealt = located.withColumn("_split", F.floor(F.col("offset") / SPLIT)).repartition(whole // SPLIT + 1, "path", "_split").sortWithinPartitions("path", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_path: dict[str, list[tuple[int, int]]] = {}
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                by_path.setdefault(path, []).append((offset, length))
            for path, rows in by_path.items():
                files, name = opened(path)
                with files.open_input_file(name) as file:
                    for group in ranges(rows):
                        begin = group[0][0]
                        data = file.read_at(group[-1][0] + group[-1][1] - begin, begin)
                        found = [parsed(zlib.decompress(data[o - begin : o - begin + n], 47) if data[o - begin : o - begin + 2] == b"\x1f\x8b" else data[o - begin : o - begin + n]) for o, n in group]
                        found = [{k: r[k] for k in names} for r in found if r]
                        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
                        yield pa.RecordBatch.from_pylist(found, pa.schema([(n, kinds.get(n, pa.string())) for n in names]))

    return dealt.mapInArrow(tidy(read), schema)


def restored(records: DataFrame) -> DataFrame:
    """The records (with payloads) where a revisit has the payload of the response it refers to."""
    first = records.filter("record_type = 'response'").select(F.col("page").alias("refers_to"), F.col("payload").alias("_found"), F.col("payload_digest"))
    wanted = records.filter("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    first = first.join(wanted, ["refers_to", "payload_digest"]).groupBy("refers_to", "payload_digest").agg(F.first("_found").alias("_found"))
    both = records.join(first, ["refers_to", "payload_digest"], "left")
    return both.select("page", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", F.coalesce("payload", "_found").alias("payload"))


def archived(pages: DataFrame, folder: str | None = None, wide: bool = False) -> DataFrame:
    """Writes the pages' archives and reads every record back: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType
    found = read_records(index(write_archives(pages, folder or scratch(spark, "archives"), wide=wide)))
    return found.select(F.col("page").cast(kind).alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
