"""WARC archives through a chunked record table.

Writing: payloads are cut into chunks of ``CHUNK`` bytes by Spark, so a Python task sees rows of (record, chunk number, bytes) in
order and never a whole record; it streams them into gzip members (one per record) of archive files in a
shared folder. Digests are known from the table, so headers can go first; the bytes are digested once more as they
pass and must agree.

Reading: each archive is streamed; a record becomes rows of (record, chunk number, bytes) with the digest
of its payload so far, so the last chunk carries the whole payload's digest.

A task writes under names of its own attempt. The names of finished files are the rows of a manifest that is itself written by
Spark, so files of a lost or repeated task are never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import shared_path, stored

#: Payload bytes in a row; payload bytes after which an archive is closed.
CHUNK = 1 << 16
ARCHIVE_BYTES = 1 << 28
#: Payloads from this size are stored once; others always.
MIN_REVISIT = 100
#: Archive dates are not in the table; one date keeps reruns equal.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 1
READ = 1 << 18

# Fixed by the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

RECORDS = "archive string, record long, page_id string, record_type string, refers_to string, digest string, payload_bytes long, chunk int, data binary, digest_so_far string, last boolean"


def plan_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, n_bytes, digest and refers_to (null: response) for each page.

    Of pages with equal payloads of ``min_revisit`` bytes or more the smallest id is the response (every row of it, if rows
    repeat), the others refer to it; pages without an id refer to it too, and are responses where no page has an id. A null payload is empty.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(payload, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.col("n_bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(first.drop("n"), "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def _file(path: str):
    """The file system and path of a Hadoop path as pyarrow has them."""
    from pyarrow import fs

    path = path.replace("s3a://", "s3://", 1)
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _uri(text: str) -> str:
    return quote(text, safe="!#$%&'()*+,/:;=?@[]~")


def _id_field(page_id: str) -> str:
    """A page id as a header field that ``unquote`` turns back into it, ``%`` included."""
    return quote(page_id, safe="")


def record_id(page_id: str) -> str:
    """The id of a page's record: the same in every run, and what its revisits refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + page_id)}>"


class _Archive:
    """One archive file that is being written."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, path = _file(self.path)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        self.records = self.payload = 0
        self.member = None
        self.begin({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n", 0)
        self.end()

    def begin(self, fields: dict[str, str], head: bytes, body: int) -> None:
        self.member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        lines = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "Content-Length": len(head) + body}.items())
        self.write(f"WARC/1.1\r\n{lines}\r\n".encode("ascii") + head)

    def write(self, data: bytes) -> None:
        self.out.write(self.member.compress(data))

    def end(self) -> None:
        self.write(END)
        self.out.write(self.member.flush())

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.payload


def write_archives(records: DataFrame, folder: str, chunk: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes what ``plan_records`` gives as archives under ``folder``; returns the stored manifest (path, records, payload)."""
    pieces = records.withColumn("piece", F.explode(F.when(F.col("refers_to").isNotNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_bytes") / chunk).cast("int") - 1, F.lit(0))))))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("piece") * chunk + 1, F.lit(chunk)))
    rows = pieces.select(F.col("page_id").cast("string"), "url", F.col("refers_to").cast("string"), "n_bytes", "digest", "piece", data.alias("data"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, seen, left = None, None, 0
        done = []
        for batch in batches:
            for page_id, url, refers_to, n_bytes, digest, piece, data in zip(*[c.to_pylist() for c in batch.columns]):
                if piece == 0:  # a new record
                    if archive is not None and archive.payload >= archive_bytes:
                        done.append(archive.close())
                        archive = None
                    archive = archive or _Archive(folder)
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode("ascii")
                    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else record_id(page_id), "WARC-Date": DATE}
                    if url is not None:
                        fields["WARC-Target-URI"] = _uri(url)
                    if page_id is not None:
                        fields["X-Page-ID"] = _id_field(page_id)
                    if refers_to is not None:
                        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": _id_field(refers_to)}
                    fields |= {"WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
                    left = n_bytes if refers_to is None else 0
                    archive.begin(fields, head, left)
                    archive.records += 1
                    seen = hashlib.sha256()
                if data:
                    archive.write(data)
                    archive.payload += len(data)
                    seen.update(data)
                    left -= len(data)
                if left == 0:
                    if refers_to is None and seen.hexdigest() != digest:
                        raise ValueError(f"page {page_id}: the payload is not what its digest says")
                    archive.end()
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "payload"])

    return stored(rows.mapInArrow(write, "path string, records long, payload long"), "manifest")


class _Members:
    """The bytes of the gzip members of a stream, as one stream."""

    def __init__(self, stream):
        self.stream, self.unzip, self.raw, self.held, self.at = stream, None, b"", b"", 0

    def _more(self) -> bool:
        """Unpacks up to READ more bytes behind those that are still held."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(READ)
                if not self.raw:
                    return False
            self.unzip = self.unzip or zlib.decompressobj(31)
            out = self.unzip.decompress(self.raw, READ)
            if self.unzip.eof:
                self.raw, self.unzip = self.unzip.unused_data, None
            else:
                self.raw = self.unzip.unconsumed_tail
            if out:
                self.held, self.at = self.held[self.at :] + out, 0
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is passed over; None at the end."""
        while (end := self.held.find(mark, self.at)) < 0:
            if not self._more():
                return None
        out = self.held[self.at : end]
        self.at = end + len(mark)
        return out

    def take(self, most: int) -> bytes:
        """Up to ``most`` bytes, at least one."""
        if self.at == len(self.held) and not self._more():
            raise EOFError("a record is cut off")
        out = self.held[self.at : self.at + most]
        self.at += len(out)
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("ascii").split("\r\n")[1:])}


def records(path: str, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of RECORDS, all but the archive, for each response and revisit record of an archive."""
    from urllib.parse import unquote

    system, own = _file(path)
    with system.open_input_stream(own, compression=None) as stream:
        data, number = _Members(stream), -1
        while (head := data.until(END)) is not None:
            number += 1
            warc = _fields(head)
            left = int(warc["content-length"])
            kind = warc["warc-type"]
            if kind not in ("response", "revisit"):
                while left:
                    left -= len(data.take(left))
                data.until(END)
                continue
            http_head = data.until(END)
            left -= len(http_head) + len(END)
            page_id = unquote(warc["x-page-id"]) if "x-page-id" in warc else None
            refers_to = unquote(warc["x-refers-to-page-id"]) if kind == "revisit" else None
            stated, size = warc["warc-payload-digest"].removeprefix("sha256:"), int(_fields(http_head)["content-length"])
            seen, piece = hashlib.sha256(), 0
            while True:
                parts, want = [], min(chunk, left)
                while want:
                    parts.append(data.take(want))
                    want -= len(parts[-1])
                part = b"".join(parts)
                left -= len(part)
                seen.update(part)
                yield number, page_id, kind, refers_to, stated, size, piece, part, seen.hexdigest(), left == 0
                piece += 1
                if not left:
                    break
            if data.until(END) != b"":
                raise ValueError(f"{path}: record {number} does not end where its length says")


def read_archives(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` names: a row per record and chunk, one for an empty payload.

    ``digest`` and ``payload_bytes`` are what the record's header states, ``digest_so_far`` is taken from the bytes read. A record that is cut
    off raises an error.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in records(path, chunk):
                    rows.append((path, *row))
                    held += len(row[7]) + 500
                    if held >= 16 * chunk:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInArrow(read, RECORDS)


def page_records(chunks: DataFrame, id_type: str) -> DataFrame:
    """A row per record of the chunked record table: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are those of the bytes read, which must be what the header states; those of a revisit, whose payload is
    in another record, are the header's.
    """
    whole = chunks.groupBy("archive", "record").agg(
        *[F.first(c).alias(c) for c in ("page_id", "record_type", "refers_to", "digest", "payload_bytes")],
        F.sum(F.octet_length("data")).alias("n"), F.max(F.when(F.col("last"), F.col("digest_so_far"))).alias("read"),
    )
    response = F.col("record_type") == "response"
    as_stated = (F.col("n") == F.col("payload_bytes")) & (F.col("read") == F.col("digest"))
    checked = F.when(response & ~as_stated, F.raise_error(F.concat(F.lit("a payload is not what its header states: page "), F.coalesce("page_id", F.lit("?"))))).otherwise(F.col("digest"))
    return whole.select(F.col("page_id").cast(id_type), F.when(response, F.col("n")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), checked.cast("string").alias("payload_digest"), "record_type", F.col("refers_to").cast(id_type))


def round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives in the shared folder and returns the records read back from them."""
    manifest = write_archives(plan_records(pages), shared_path(spark, "warc"))
    return page_records(read_archives(manifest), dict(pages.dtypes)["page_id"])
