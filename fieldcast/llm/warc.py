"""Operator 1: WARC archives with a two-level capture index.

Archives hold one gzip member a record, so a record can be read alone by file, offset and length.  Equal payloads of at least
``LEAST`` bytes are stored once: the capture with the largest page_id is a ``response``, the others are ``revisit`` records that
refer to it.

The index sorts one line a capture by its reversed-host key (``org,example,www)/path``), time and page_id.  ``LINES`` lines make
a compressed block; blocks stand behind one another in the files of the index.  Upper level: the first line of every block with
the block's place (the sparse directory of a file) and the first line of every file.  A lookup finds the file by binary search in
the list of files, the block by binary search in that file's directory, reads that range of bytes and searches the block.

Tasks write through ``pyarrow.fs`` to the shared folder, each try under a name of its own; only files that a finished task named
in its result are ever read, so a lost executor or a second try harms nothing.

Nulls and odd input: a null or empty html is an empty payload; a null url has the empty key; a null page_id sorts first and is
the response of its payload only if no other id has it; rows that repeat the largest page_id are all responses; an empty table
makes no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm.common import arrow, cut, pieces, shared_folder, spread, table

LEAST = 1000
LINES = 512
ROWS_PER_FILE = 20_000
#: Archive records are read in stretches of this many bytes of a file at most, a longer record alone.
STRETCH = 4 << 20
DATE = "1970-01-01T00:00:00Z"

CAPTURES = "key string, page_id long, url string, file string, at long, length long, record_type string, refers_to long, digest string, payload_bytes long"
FIRSTS = "first string, file string, directory string, lines long"


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as URI or path."""
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def reversed_host(url: str | None) -> str:
    """Sortable key of a URL: host labels from the right, then path and query; scheme, user, fragment and ``www`` are dropped."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    rest = rest.partition("#")[0]
    cut_at = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut_at].rpartition("@")[2].lower(), rest[cut_at:] or "/"
    name, _, port = host.partition(":")
    name = name.removeprefix("www.")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + path


def index_line(key: str, page_id: int | None) -> str:
    """Sort position of a capture as text: ids are shifted to be positive, null comes first."""
    number = "" if page_id is None else f"{page_id + (1 << 63):020d}"
    return f"{key}\t{DATE}\t{number}"


def record(kind: str, url: str | None, page_id: int | None, refers_to: int | None, digest: str, size: int, payload: bytes) -> bytes:
    """One WARC record, a gzip member of its own."""
    def name(i: int | None) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"

    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def with_types(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, payload, digest, payload_bytes, record_type, refers_to``; payloads are compared by digest and length."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    large = rows.where(F.col("payload_bytes") >= least).select("digest", "payload_bytes", "page_id")
    stored = large.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("stored"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored"))
    return rows.join(stored, ["digest", "payload_bytes"], "left").select(
        "page_id", "url", "payload", "digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("stored")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes the archives and returns the captures, a table of its own, so that no record is written twice for one reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        file, at, stream = f"{path}/{uuid.uuid4()}.warc.gz", 0, None
        for batch in batches:
            for part in pieces(batch, "payload"):
                out = []
                for page, url, payload, digest, size, kind, refers in zip(*(c.to_pylist() for c in part.columns)):
                    if stream is None:
                        stream = system.open_output_stream(file, compression=None)
                    member = record(kind, url, page, refers, digest, size, payload)
                    stream.write(member)
                    out.append((reversed_host(url), page, url, file, at, len(member), kind, refers, digest, size))
                    at += len(member)
                yield rows_of(out, CAPTURES)
        if stream is not None:
            stream.close()

    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    return cut(arrow(with_types(pages, least)).mapInArrow(run, CAPTURES))


def rows_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def build_index(captures: DataFrame, folder: str, lines: int = LINES, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Writes blocks and directories; returns ``first, file, directory, lines`` of each file of the index."""
    parts = spread(captures.count(), rows_per_file, most=10_000)
    order = [F.col("key"), F.col("page_id").asc_nulls_first(), F.col("file"), F.col("at")]
    dealt = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        name, blocks, at, held = uuid.uuid4(), [], 0, []
        stream, total = None, 0

        def flush() -> None:
            nonlocal at, stream
            if stream is None:
                stream = system.open_output_stream(f"{path}/{name}.idx.gz", compression=None)
            data = gzip.compress("\n".join(held).encode(), 6, mtime=0)
            stream.write(data)
            blocks.append((held[0].rpartition("\x00")[0], at, len(data)))
            at += len(data)
            held.clear()

        for batch in batches:
            for key, page, _, file, place, length, kind, refers, digest, size in zip(*(c.to_pylist() for c in batch.columns)):
                clean = index_line(key.replace("\n", "%0A").replace("\t", "%09").replace("\x00", "%00"), page)
                held.append(clean + "\x00" + f"{file}\t{place}\t{length}")
                total += 1
                if len(held) == lines:
                    flush()
        if held:
            flush()
        if stream is not None:
            stream.close()
            firsts, places, sizes = zip(*blocks)
            pq.write_table(pa.table({"first": firsts, "at": places, "length": sizes}), f"{path}/{name}.dir.parquet", filesystem=system)
            yield rows_of([(firsts[0], f"{path}/{name}.idx.gz", f"{path}/{name}.dir.parquet", total)], FIRSTS)

    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    return cut(dealt.mapInArrow(run, FIRSTS))


class Index:
    """Lookups in the files of the index; one directory and one block are held at a time, for sorted questions."""

    def __init__(self, folder: str, firsts: list[str], files: list[tuple[str, str]]):
        self.system, _ = opened(folder)
        self.firsts, self.files = firsts, files
        self.file, self.block = -1, -1
        self.lines: list[str] = []

    def enter(self, file: int) -> None:
        if file != self.file:
            found = pq.read_table(self.files[file][1], filesystem=self.system)
            self.heads, self.places, self.sizes = (found[c].to_pylist() for c in ("first", "at", "length"))
            self.stream = self.system.open_input_file(self.files[file][0])
            self.file, self.block = file, -1

    def load(self, file: int, block: int) -> None:
        self.enter(file)
        if block != self.block:
            data = self.stream.read_at(self.sizes[block], self.places[block])
            self.lines = gzip.decompress(data).decode().split("\n")
            self.block = block

    def find(self, line: str) -> list[tuple[str, int, int]]:
        """Places of the captures at this position of the index, which may stand in several blocks and files."""
        out: list[tuple[str, int, int]] = []
        file = max(0, bisect_right(self.firsts, line) - 1)
        while file > 0 and self.firsts[file] == line:
            file -= 1
        while file < len(self.files):
            self.enter(file)
            block = max(0, bisect_right(self.heads, line) - 1)
            while block > 0 and self.heads[block] == line:
                block -= 1
            while block < len(self.heads):
                if self.heads[block] > line:
                    return out
                self.load(file, block)
                at = bisect_right(self.lines, line)  # lines go on behind the position
                while at < len(self.lines) and self.lines[at].startswith(line + "\x00"):
                    path, place, length = self.lines[at].rpartition("\x00")[2].split("\t")
                    out.append((path, int(place), int(length)))
                    at += 1
                if at < len(self.lines):
                    return out
                block += 1
            file += 1
        return out


def lookup(asked: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """``file, at, length`` of the captures of ``asked`` (url, page_id), each position asked once.

    What is sent to the tasks is one line a file of the index, 10,000 at most; questions are sorted so that a block is read once
    by a task.
    """
    listed = sorted((r["first"], r["file"], r["directory"]) for r in index.collect())
    sent = asked.sparkSession.sparkContext.broadcast(listed)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [x[0] for x in sent.value]
        for batch in batches:
            lines = [index_line(reversed_host(u).replace("\n", "%0A").replace("\t", "%09").replace("\x00", "%00"), p) for u, p in zip(*(c.to_pylist() for c in batch.columns))]
            yield rows_of([(x, max(0, bisect_right(firsts, x) - 1)) for x in lines], "line string, shard long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_ = None
        for batch in batches:
            index_ = index_ or Index(folder, [x[0] for x in sent.value], [x[1:] for x in sent.value])
            yield rows_of([place for line in batch.column(0).to_pylist() for place in index_.find(line)], "file string, at long, length long")

    lines = asked.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(keys, "line string, shard long")
    some = F.pmod(F.xxhash64("line"), F.lit(8))  # a file of the index is asked by several tasks
    once = lines.distinct().repartition("shard", some).sortWithinPartitions("line").select("line")
    return once.mapInArrow(run, "file string, at long, length long") if listed else once.select(F.lit("").alias("file"), F.lit(0).alias("at"), F.lit(0).alias("length")).limit(0)


def read_records(places: DataFrame, folder: str, stretch: int = STRETCH) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url, verified`` read from the archives.

    Places are grouped by stretches of a file, and neighbouring records come with one range read.  ``verified`` tells that the
    payload of a response has the length and digest of its header.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, verified long"

    def told(member: bytes) -> tuple:
        fields, payload = parsed(member)
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size, kind = int(fields["X-Payload-Length"]), fields["WARC-Type"]
        good = kind == "revisit" or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
        if kind == "response":
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
        return page and int(page), size, digest, kind, refers and int(refers), fields.get("WARC-Target-URI"), int(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(folder)
        name, source = None, None
        for batch in batches:
            held: list[tuple[int, int]] = []
            for file, at, length in [*zip(*(c.to_pylist() for c in batch.columns)), (None, 0, 0)]:
                if held and (file != name or at + length - held[0][0] > stretch or at > held[-1][0] + held[-1][1] + (64 << 10)):
                    data = source.read_at(held[-1][0] + held[-1][1] - held[0][0], held[0][0])
                    yield rows_of([told(data[a - held[0][0] : a - held[0][0] + n]) for a, n in held], schema)
                    held = []
                if file != name and file is not None:
                    source = system.open_input_file(file)
                name = file
                if file is not None:
                    held.append((at, length))

    piece = F.floor(F.col("at") / stretch)
    return places.repartition("file", piece).sortWithinPartitions("file", "at").mapInArrow(run, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, indexed, looked up and read back."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4()}"
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    captures = write_archives(pages, f"{folder}/archives")
    index = build_index(captures, f"{folder}/index")
    places = lookup(pages.select("url", "page_id"), index, folder)
    return read_records(places, folder).drop("url", "verified")
