"""WARC archives: writing pages, normalising whole-file gzip to a member per record, reading records by offset.

Files go through ``pyarrow.fs`` into the shared folder, under a temporary name that is moved into place, so a task that
runs again replaces its own file by the same content.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm.common import column, look_up, whole_text, without_null
from lumenframe.session import materialise, scratch_path

LEAST_BYTES = 100
FILE_BYTES = 1 << 30
LEVEL = 4
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"
GZIP = 31  # zlib's window bits for the gzip format
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Output:
    """A file that appears under its name only when it is whole."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.path)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _one_line(value: str | None) -> str:
    return "" if value is None else " ".join(value.split())


def make_record(page_id: int | None, url: str | None, payload: bytes, payload_bytes: int, digest: str,
                refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit holds the HTTP head only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n"
            ).encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
            f"X-Payload-Bytes: {payload_bytes}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}",
                 f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Inflated:
    """The plain bytes of a gzip stream of one or many members, read once from front to back in chunks."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk = stream, chunk
        self.buffer, self.inflate, self.rest, self.ended = bytearray(), zlib.decompressobj(GZIP), b"", False

    def _more(self) -> bool:
        while not self.ended:
            data = self.rest or self.stream.read(self.chunk)
            self.rest = b""
            if not data:
                if not self.inflate.eof and self.inflate is not None and self.started:
                    raise ValueError("the gzip stream ends within a member")
                self.ended = True
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(GZIP)
            self.started = True
            plain = self.inflate.decompress(data, 4 * self.chunk)
            self.rest = self.inflate.unconsumed_tail or self.inflate.unused_data
            if plain:
                self.buffer += plain
                return True
        return False

    started = False

    def upto(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end."""
        at = 0
        while (hit := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends within a record's head")
                return None
        out = bytes(self.buffer[:hit + len(mark)])
        del self.buffer[:hit + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends within a record")
            piece = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(piece)
            yield piece


def parse_head(head: bytes) -> dict[str, str]:
    """Named fields in lower case; the version line must be that of WARC."""
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise_file(source: str, target: str, level: int = LEVEL) -> Iterator[tuple[int, int, str, str]]:
    """Inflate ``source`` once and write every record as its own gzip member.

    Yields (offset, length, type, record id) for each record, and writes them beside the file as ``target``.idx.
    """
    source_fs, path = _open(source)
    out, index = _Output(target), _Output(target + ".idx")
    with source_fs.open_input_stream(path, compression=None) as stream:
        plain = Inflated(stream)
        while (head := plain.upto(b"\r\n\r\n")) is not None:
            fields = parse_head(head)
            start, pack = out.size, zlib.compressobj(level, zlib.DEFLATED, GZIP)
            out.write(pack.compress(head))
            for piece in plain.take(int(fields["content-length"]) + 4):
                out.write(pack.compress(piece))
            out.write(pack.flush())
            row = (start, out.size - start, fields["warc-type"], fields["warc-record-id"])
            index.write("\t".join(map(str, row)).encode() + b"\n")
            yield row
    out.close()
    index.close()


def _writer(folder: str, file_bytes: int, level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, out, pack, count = TaskContext.get().partitionId(), 0, None, None, 0
        done = []

        def close():
            out.write(pack.flush())
            out.close()
            done.append((f"{folder}/part-{part:06d}-{number:04d}.warc.gz", count, out.size))

        for batch in batches:
            for r in batch.itertuples(index=False):
                if out is None:
                    out = _Output(f"{folder}/part-{part:06d}-{number:04d}.warc.gz")
                    pack, count = zlib.compressobj(level, zlib.DEFLATED, GZIP), 0
                page = None if r.no_id else int(r.id)
                refers = int(r.refers_to) if r.revisit else None
                payload = b"" if r.payload is None else r.payload.encode("utf-8")
                out.write(pack.compress(make_record(page, r.url, payload, int(r.payload_bytes), r.payload_digest, refers,
                                                    bool(r.revisit))))
                count += 1
                if out.size >= file_bytes:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])
    return run


def typed_pages(df: DataFrame, id: str, url: str, html: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """id, url, payload (null for revisits), payload_bytes, payload_digest, refers_to, revisit."""
    rows = df.select(column(id).cast("long").alias("id"), column(url).cast("string").alias("url"),
                     whole_text(html).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"),
                             "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    shared = (rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
              .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL"))
    shared = materialise(shared, "shared-payloads")
    copies = look_up(rows.filter(F.col("payload_bytes") >= least_bytes), shared, ["payload_digest"], "n")
    revisit = ~F.col("id").eqNullSafe(F.col("first"))
    copies = copies.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes",
                           "payload_digest", F.when(revisit, F.col("first")).alias("refers_to"),
                           revisit.alias("revisit"))
    alone = rows.join(shared.select("payload_digest"), "payload_digest", "left_anti").unionByName(
        rows.filter(F.col("payload_bytes") < least_bytes).join(shared.select("payload_digest"), "payload_digest",
                                                              "left_semi"))
    return copies.unionByName(alone.select("id", "url", "payload", "payload_bytes", "payload_digest",
                                           F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit")))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write one gzip stream per file, as older crawlers do. One row per file: path, records, bytes."""
    rows = pages.select(*without_null("id"), "url", "payload", "payload_bytes", "payload_digest", "revisit",
                        F.coalesce("refers_to", F.lit(0)).alias("refers_to"))
    return materialise(rows.mapInPandas(_writer(folder, file_bytes, level), "path string, records long, bytes long"),
                       "archives")


def normalise_archives(files: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """``files``: path. The same records with a gzip member each, and one row per record: path, offset, length,
    record_type, record_id. The rows are written to the shared folder; each file has its own sidecar index as well."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch["path"]:
                name = hashlib.sha256(source.encode()).hexdigest()[:8] + "-" + source.rsplit("/", 1)[1]
                target, rows = f"{folder}/{name}", []
                for row in normalise_file(source, target, level):
                    rows.append((target, *row))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    names = ["path", "offset", "length", "record_type", "record_id"]
    listed = files.select("path")
    tasks = max(1, min(listed.count(), 100_000))
    return materialise(listed.repartition(tasks).mapInPandas(
        run, "path string, offset long, length long, record_type string, record_id string"), "archive-index")


def read_records(index: DataFrame) -> DataFrame:
    """Read every record of an index by its place: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload must have the length and digest that its head states.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, rows in batch.groupby("path", sort=False):
                file_system, place = _open(path)
                with file_system.open_input_file(place) as file:
                    for r in rows.sort_values("offset").itertuples(index=False):
                        file.seek(r.offset)
                        plain = zlib.decompress(file.read(r.length), GZIP)
                        head, _, block = plain.partition(b"\r\n\r\n")
                        fields = parse_head(head)
                        digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-bytes"])
                        if fields["warc-type"] == "response":
                            payload = block[:int(fields["content-length"])].partition(b"\r\n\r\n")[2]
                            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{path} at {r.offset}: the payload differs from its digest")
                        page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
                        out.append((None if page is None else int(page), size, digest, fields["warc-type"],
                                    None if refers is None else int(refers)))
            page_ids, sizes, digests, kinds, refers_to = zip(*out) if out else [()] * 5
            yield pd.DataFrame({"page_id": pd.array(page_ids, dtype="Int64"), "payload_bytes": sizes,
                                "payload_digest": digests, "record_type": kinds,
                                "refers_to": pd.array(refers_to, dtype="Int64")})
    return index.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                  "refers_to long")


def round_trip(df: DataFrame, id: str, url: str, html: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``df`` as archives, normalise them and read them back: one row per row of ``df``.

    Of equal payloads of at least ``least_bytes`` bytes, rows with the smallest id are responses, others revisit it;
    a null id never is the smallest. Null payloads are empty. An empty table writes no record.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, "warc")
    files = write_archives(typed_pages(df, id, url, html, least_bytes), f"{folder}/whole")
    records = read_records(normalise_archives(files, f"{folder}/members"))
    return records.withColumnRenamed("page_id", id) if id != "page_id" else records
