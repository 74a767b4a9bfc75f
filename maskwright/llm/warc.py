"""WARC archives: a writer of one gzip member per record and a sequential reader."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import fresh_path, keep
from maskwright.llm.storage import new_file, open_stream

ARCHIVE_BYTES = 64 << 20  # an archive is closed beyond this size
CHUNK = 1 << 16
_MANIFEST = "uri string, n_records long, n_bytes long"
_RECORD = "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


class WarcError(ValueError):
    """An archive that breaks the format."""


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class _Members:
    """Bytes of one gzip member after the other, inflated piece by piece."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.raw, self.out = source, b"", b""
        self.z = None

    def start(self) -> bool:
        """Go to the next member; false at the archive's end."""
        self.raw = self.raw or self.source.read(CHUNK)
        self.z, self.out = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bool:
        """Inflate at most a chunk; false at the member's end."""
        if self.z.eof:
            return False
        self.raw = self.z.unconsumed_tail or self.raw or self.source.read(CHUNK)
        if not self.raw:
            raise WarcError("the archive ends inside a record")
        got = self.z.decompress(self.raw, CHUNK)
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        self.out += got
        return True

    def line(self) -> bytes:
        while (end := self.out.find(b"\r\n")) < 0:
            if not self.more():
                raise WarcError("a header line has no end")
        line, self.out = self.out[:end], self.out[end + 2 :]
        return line

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self.more():
                raise WarcError("a record is shorter than its Content-Length")
            piece, self.out = self.out[:n], self.out[n:]
            n -= len(piece)
            if piece:
                yield piece

    def end(self) -> None:
        while self.more():
            pass
        if self.out != b"\r\n\r\n":
            raise WarcError("a record is not framed by its Content-Length")


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in order; checks framing, block digest and, for responses, payload digest."""
    members = _Members(source)
    while members.start():
        if members.line() != b"WARC/1.1":
            raise WarcError("a record does not begin with its version")
        headers: dict[str, str] = {}
        while line := members.line():
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        digest, block = hashlib.sha256(), []
        for piece in members.take(int(headers["content-length"])):
            digest.update(piece)
            block.append(piece)
        members.end()
        if headers.get("warc-block-digest", "sha256:" + digest.hexdigest()) != "sha256:" + digest.hexdigest():
            raise WarcError(f"the block of {headers.get('warc-record-id')} has another digest")
        yield headers, b"".join(block)


def _plan(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """Pages with payload digest and, for repeats, the page that their record refers to; repeats carry no payload."""
    salts = 16
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html, 256).alias("payload_digest"), html.alias("html"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("_salt"),
    )
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    groups = groups.select("payload_digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    joined = rows.join(groups, ["payload_digest", "_salt"], "left")
    again = (F.col("payload_bytes") >= least) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "target_uri", "payload_bytes", "payload_digest", F.when(again, F.col("_first")).alias("refers_to"), F.when(~F.coalesce(again, F.lit(False)), F.encode("html", "UTF-8")).alias("payload"))


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 or c == "%" else c for c in value)


def _unclean(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value)


def record(page_id, target_uri, payload_bytes, payload_digest, refers_to, payload) -> bytes:
    """A page as a response record or, with ``refers_to``, as a revisit record without payload."""
    kind = "response" if refers_to is None else "revisit"
    block = b"" if payload is None else payload
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if target_uri is not None:
        headers.append(("WARC-Target-URI", _clean(target_uri)))
    if kind == "revisit":
        headers += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    headers += [("WARC-Payload-Digest", f"sha256:{payload_digest}"), ("WARC-Payload-Length", str(payload_bytes)), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest())]
    return member(headers, block)


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, folder: str | None = None) -> DataFrame:
    """Write a record per page and return the manifest: uri, n_records, n_bytes.

    Of pages with equal payloads of at least ``least`` bytes, the smallest
    identifier is the response and the others are revisits; rows that repeat
    that identifier and payload are responses too. A null html counts as
    empty, a null identifier is a page of its own (never a group's smallest
    unless all are null), a null url leaves the header out. An empty table
    gives no archive. Other columns are not read.

    Equal payloads are found by digest: minimum per digest with map-side
    combine, joined back salted, so that a page copied into a third of all
    rows meets in many tasks. Archives that the manifest does not name (lost
    attempts) are never read.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def write(batches):
        from pyspark import TaskContext

        stem = f"part-{TaskContext.get().partitionId():06d}"
        rows = (r for b in batches for r in zip(*(b.column(i) for i in range(b.num_columns)), strict=True))
        row = next(rows, None)
        while row is not None:
            n = size = 0
            with new_file(folder, stem, ".warc.gz") as (sink, uri):
                while row is not None and size < ARCHIVE_BYTES:
                    data = record(*(x.as_py() for x in row))
                    sink.write(data)
                    n, size, row = n + 1, size + len(data), next(rows, None)
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [n], "n_bytes": [size]})

    return keep(_plan(pages, id_col, url_col, html_col, least).mapInArrow(write, _MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the manifest's archives, read from the front with bounded memory.

    Checks that a response's payload has the digest and length that its
    headers state and that each archive holds the records the manifest counts.
    """

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, held, size = 0, [], 0
                with open_stream(row["uri"]) as source:
                    for headers, block in read_records(source):
                        held.append(_parsed(headers, block))
                        n, size = n + 1, size + len(block)
                        if size > 4 << 20 or len(held) >= 1000:
                            yield _batch(held)
                            held, size = [], 0
                if n != row["n_records"]:
                    raise WarcError(f"{row['uri']} has {n} records, not {row['n_records']}")
                if held:
                    yield _batch(held)

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(parts, "uri").mapInArrow(read, _RECORD)


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _parsed(headers: dict[str, str], block: bytes) -> dict:
    kind, digest, n = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["warc-payload-length"])
    if kind == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != n):
        raise WarcError(f"the payload of {headers['warc-record-id']} has another digest or length")
    url = headers.get("warc-target-uri")
    return {"page_id": _number(headers["warc-record-id"]), "target_uri": None if url is None else _unclean(url), "record_type": kind, "payload_bytes": n, "payload_digest": digest, "refers_to": _number(headers.get("warc-refers-to")), "payload": block if kind == "response" else None}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "target_uri": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))
