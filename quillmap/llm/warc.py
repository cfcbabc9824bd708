"""WARC archives: a writer, and a sequential reader that trusts nothing.

Every record is a gzip member of its own, so a reader can start at any record.
The reader inflates step by step, frames a record by its content length and
checks the block digest.

Archives are written and read through Spark's own file sources, which reach any
store that Spark does and survive lost executors: an archive is a file of the
text source, whose rows are records and whose line separator is one zero byte.
A gzip member ends with the high byte of its length, zero for members under
16 MiB, so that byte is left to the separator; behind a longer member an empty
one is put. The file is then nothing but gzip members.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmap.llm.shared import cut, fresh_dir
from quillmap.llm.text import encode

VERSION = b"WARC/1.1"
#: Inflated at once.
STEP = 1 << 20


def member(block: bytes) -> bytes:
    """One gzip member, without name and time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(block) + z.flush()


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """A record: version, headers, content length and block digest, block."""
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"), ("Content-Length", str(len(payload)))]
    # a line break in a value would end the header
    head = b"\r\n".join(f"{k}: {v}".translate({10: " ", 13: " "}).encode("utf-8", "surrogatepass") for k, v in lines)
    return VERSION + b"\r\n" + head + b"\r\n\r\n" + payload + b"\r\n\r\n"


class Inflating:
    """Reads the members of an archive one after another, a step at a time."""

    def __init__(self, data: bytes, start: int = 0):
        self.data, self.at, self.z, self.rest = memoryview(data), start, None, b""

    def more(self) -> bool:
        """Inflates one more step of the current member; false at its end."""
        if self.z.eof:
            return False
        given = self.z.unconsumed_tail or bytes(self.data[self.at : self.at + STEP])
        if not given:
            raise ValueError("the archive ends inside a record")
        if not self.z.unconsumed_tail:
            self.at += len(given)
        self.rest += self.z.decompress(given, STEP)
        if self.z.eof:
            self.at -= len(self.z.unused_data)
        return True

    def members(self) -> Iterator[int]:
        """Starts of the members; each must be read up before the next."""
        while self.at < len(self.data):
            begin, self.z, self.rest = self.at, zlib.decompressobj(31), b""
            yield begin
            while self.more():
                pass

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``; null if the member ends first."""
        while (k := self.rest.find(mark)) < 0:
            if not self.more():
                return None
        found, self.rest = self.rest[:k], self.rest[k + len(mark) :]
        return found

    def exactly(self, n: int) -> bytes:
        parts, have = [], 0
        while True:
            parts.append(self.rest[: n - have])
            have += len(parts[-1])
            self.rest = self.rest[len(parts[-1]) :]
            if have == n:
                return b"".join(parts)
            if not self.rest and not self.more():
                raise ValueError("a record is shorter than its content length")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive.

    An empty member holds no record. A damaged record raises ValueError.
    """
    reader = Inflating(data)
    for begin in reader.members():
        head = reader.until(b"\r\n\r\n")
        if head is None:
            if reader.rest:
                raise ValueError(f"no header in the record at byte {begin}")
            continue
        first, *lines = head.split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {begin}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "surrogatepass").partition(":") for x in lines)}
        block = reader.exactly(int(headers["content-length"]))
        if reader.exactly(4) != b"\r\n\r\n":
            raise ValueError(f"no end mark in the record at byte {begin}")
        digest = headers.get("warc-block-digest", "")
        if digest and digest != f"sha1:{hashlib.sha1(block).hexdigest()}":
            raise ValueError(f"the digest of the record at byte {begin} differs")
        yield headers, block


def planned(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to) of every page.

    Of pages with equal payloads of at least ``least`` bytes, refers_to is null
    for that with the largest id and its id for the others. Only digests
    that occur twice or more, with one row each, meet the pages again, and the
    digests are summed on the map side, so a payload that a third of the
    pages share adds nothing to any one task but rows that adaptive execution
    can split.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.col("html").cast("binary"))})
    large = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
    many = large.agg(F.max("page_id").alias("__last"), F.count("*").alias("__n")).where("__n > 1 and __last is not null").drop("__n")
    # a table of its own, so that the join below sees two plain exchanges
    found = rows.join(cut(many), ["payload_digest", "payload_bytes"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("__last")), F.col("__last"))
    return found.select("page_id", "url", "html", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, archive_bytes: int = 32 << 20) -> None:
    """Write one record for each row of ``planned`` as archives below ``path``.

    A revisit record has the headers of its page and an empty block. A task begins
    a new archive where the last would pass ``archive_bytes``, so a reader that holds
    an archive needs no more memory than that, or than the longest record.
    """
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, held = 0, 0
        for pdf in batches:
            out = []
            for page, url, html, size, digest, refers in pdf[names].itertuples(index=False):
                revisit = refers is not None
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", str(size))]
                headers += [("WARC-Refers-To", f"<urn:page:{refers}>")] * revisit
                whole = member(record(headers, b"" if revisit else encode(html)))
                whole += b"" if whole[-1] == 0 else member(b"")
                if held and held + len(whole) > archive_bytes:
                    archive, held = archive + 1, 0
                held += len(whole)
                out.append((archive, whole[:-1]))
            yield pd.DataFrame(out, columns=["archive", "value"])

    # ids go as text: pandas would make a column of longs with nulls one of doubles
    texts = pages.select(*[F.col(c).cast("string") for c in names])
    packed = texts.mapInPandas(run, "archive int, value binary").select("archive", F.col("value").cast("string"))
    packed.write.partitionBy("archive").option("lineSep", "\0").text(path)


def read(spark, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html)
    of every record below ``path``; html is null for a revisit. Every record's
    digest is verified, and a response's payload digest and size against its block."""

    def number(urn: str) -> int | None:
        x = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                out, held = [], 0
                # a view of the batch, no copy of the archive
                for h, block in records(data.as_buffer()):
                    digest, size, kind = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-bytes"]), h["warc-type"]
                    if kind == "response" and (size != len(block) or digest != hashlib.sha1(block).hexdigest()):
                        raise ValueError(f"the payload of {h['warc-record-id']} differs from its headers")
                    out.append((number(h["warc-record-id"]), h["warc-target-uri"] or None, size, digest, kind, number(h.get("warc-refers-to", "")), block.decode("utf-8", "replace") if kind == "response" else None))
                    held += len(block)
                    if held > 16 * STEP:
                        yield framed(out)
                        out, held = [], 0
                yield framed(out)

    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "html": pa.string()}

    def framed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def round_trip(pages: DataFrame, path: str | None = None, least: int = 1000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read them back.

    One row per row of ``pages``; ids are integers. Null html is an empty payload, a null url
    is an empty header and comes back null; so does an empty url. A null id is kept and refers to the largest
    id with its payload, if there is one. Of rows that repeat the largest id all
    are responses. An empty table gives an empty table; other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or fresh_dir(spark, "warc")
    write(planned(pages, least), path)
    return read(spark, path)
