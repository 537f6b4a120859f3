"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: a row of text is a record, the record separator is the line separator, so each part file is a plain
WARC/1.1 file. Records whose payload another record already holds are revisits.

Reading: tasks take byte ranges of the archives and emit, for every place where the record magic stands and a
header parses, the candidate's offset and that of its successor, together with what the record says. Inside a range
a task follows the successors itself: each candidate gets the offset at which its chain leaves the range, and its
interval in the tree of chains. Pointer jumping over those exits, from offset 0 of each file, finds where the chain
enters each range, in rounds that grow with the logarithm of a file's ranges; the candidates on the chain from there
are the records. Magic inside a payload is never reached.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import cut, dealt_join, shared_dir

MAGIC, RANGE, AHEAD, RECORDS_PER_FILE, SMALLEST_REVISIT = b"WARC/1.1\r\n", 4 << 20, 1 << 16, 20_000, 1000
GROUPS_AT_ONCE, _GROUP = 500_000, ["payload_digest", "payload_bytes"]
_END = "\r\n"


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of at least 1000 bytes the row with the largest id is the response and the others revisit it;
    rows that repeat that id are responses too, rows without an id revisit it, and without any id all are responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    shared = rows.where(F.col("payload_bytes") >= SMALLEST_REVISIT).groupBy("payload_digest", "payload_bytes")
    shared = cut(shared.agg(F.max("page_id").alias("response_id"), F.count("*").alias("count")).where("count > 1 and response_id is not null"))
    # payloads move only if the groups are too many for a broadcast, and then those of a group to several tasks
    few = shared.limit(GROUPS_AT_ONCE + 1).count() <= GROUPS_AT_ONCE
    out = rows.join(F.broadcast(shared.drop("count")), _GROUP, "left") if few else dealt_join(rows, shared, _GROUP, "page_id", "left")
    again = F.col("response_id").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("response_id"), F.lit(False))
    return out.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("response_id"))).drop("response_id")


def _urn(page_id) -> object:
    """A record id from the page id's 16 hexadecimal digits."""
    h = F.lower(F.lpad(F.hex(page_id), 16, "0"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-8000-000000000000>"))


def write_archives(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write planned records as WARC files under path."""

    def line(name: str, value) -> object:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))

    def text(c: str) -> object:
        return F.col(c).cast("string")

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), text("payload_bytes"), F.lit(_END * 2))
    block = F.when(F.col("record_type") == "response", F.concat(http, "payload")).otherwise(http)
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        line("WARC-Target-URI", F.regexp_replace("url", r"\s", "%20")),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        line("WARC-Refers-To", _urn(F.col("refers_to"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_END),
    )
    records.select(F.concat(head, block).alias("value")).write.option("lineSep", _END * 2).option("maxRecordsPerFile", records_per_file).text(path)


def _page_id(urn: bytes | None) -> int | None:
    if not urn:
        return None
    n = int(urn.strip(b"<>").rpartition(b":")[2].replace(b"-", b"")[:16], 16)
    return n - (1 << 64) if n >> 63 else n


def _open(path: str):
    """Any store that pyarrow knows by its address; Spark writes file: addresses with one slash."""
    store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(inner)


def _fields(header: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in header.split(b"\r\n")[1:])}


def candidates_of(file, start: int, end: int, size: int):
    """Every candidate with its magic in [start, end): offset, successor and what the record says."""
    data = bytearray(file.read_at(min(end + AHEAD, size) - start, start))
    at = data.find(MAGIC)
    while 0 <= at < end - start:
        while (stop := data.find(b"\r\n\r\n", at)) < 0 and start + len(data) < size:  # a header of any length
            data += file.read_at(min(max(AHEAD, len(data)), size - start - len(data)), start + len(data))
        fields = _fields(bytes(data[at:stop])) if stop >= 0 else {}
        length = fields.get(b"content-length", b"")
        if length.isdigit() and b"warc-type" in fields:
            body, n = start + stop + 4, int(length)
            after = body + n + 4
            inner = bytes(data[stop + 4 : stop + 4 + n]) if after <= start + len(data) else file.read_at(n, body) if after <= size else b""
            if len(inner) == n and file.read_at(4, body + n) == b"\r\n\r\n":
                http, _, payload = inner.partition(b"\r\n\r\n")
                told = _fields(http).get(b"content-length", b"")
                kind = fields[b"warc-type"].decode()
                found = hashlib.sha1(payload).hexdigest() if kind == "response" else None
                digest = fields.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode()
                yield start + at, after, _page_id(fields.get(b"warc-record-id")), int(told) if told.isdigit() else None, digest, kind, _page_id(fields.get(b"warc-refers-to")), found, len(payload)
        at = data.find(MAGIC, at + 1)


def chains(steps: dict[int, int], end: int) -> dict[int, tuple[int | None, int, int]]:
    """Of each candidate of a range that ends at `end`: exit, and interval in the tree in which successors are parents.

    The chain from a candidate visits those whose interval holds the candidate's first number. A chain that runs into
    a place in the range without a candidate has no exit.
    """
    out: dict[int, tuple[int | None, int, int]] = {}
    below: dict[int, list[int]] = {}
    exits: dict[int, int | None] = {}
    for at in sorted(steps, reverse=True):
        after = steps[at]
        exits[at] = after if after >= end else exits.get(after)
        if after in steps:
            below.setdefault(after, []).append(at)
    first: dict[int, int] = {}
    n = 0
    for top in (at for at in steps if steps[at] not in steps):
        todo = [top]
        while todo:
            at = todo.pop()
            if at >= 0:
                first[at] = n
                n += 1
                todo.append(~at)  # when it comes up again, all below it have their numbers
                todo += below.get(at, [])
            else:
                out[~at] = exits[~at], first[~at], n
    return out


_CANDIDATE = "file long, range long, at long, exit long, first long, last long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, found_digest string, found_bytes long"


def _scan_batches(batches):
    names, kinds = zip(*(x.split() for x in _CANDIDATE.split(", ")))
    types = [pa.string() if k == "string" else pa.int64() for k in kinds]
    for batch in batches:
        for name, path, start, end, size in zip(*(batch.column(i).to_pylist() for i in range(5))):
            with _open(path) as file:
                found = list(candidates_of(file, start, end, size))
            chain = chains({x[0]: x[1] for x in found}, end)
            rows = [(name, start, x[0], *chain[x[0]], *x[2:]) for x in found]
            cols = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(names))


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, length) of the archives under path that aren't empty."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.xxhash64("path").alias("file"), "path", "length").where("length > 0")


def candidates(files: DataFrame, size: int = RANGE) -> DataFrame:
    """All candidate records of archives."""
    total = files.agg(F.sum("length")).first()[0] or 0
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    ranges = files.select("file", "path", start.alias("start"), "length")
    ranges = ranges.select("file", "path", "start", F.least(F.col("start") + size, "length").alias("end"), "length")
    return ranges.repartition(max(1, total // (2 * size))).mapInArrow(_scan_batches, _CANDIDATE)


def entries(steps: DataFrame) -> DataFrame:
    """The (file, at) of steps(file, range, at, exit) where the chain from at = 0 enters a range, and where it ends, by pointer jumping."""
    jump = cut(steps.where("exit is not null").select("file", "at", F.col("exit").alias("to")))
    found = cut(steps.where("at = 0").select("file", "at"))
    longest = steps.groupBy("file").agg(F.count_distinct("range").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        further = found.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        found = cut(found.unionByName(further).distinct())
        onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = cut(jump.join(onward, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")))
    return found


def reachable(found: DataFrame, files: DataFrame) -> DataFrame:
    """The candidates on the chains from the files' starts. A chain that doesn't end where its file does is an error."""
    entered = cut(entries(found))
    broken = files.join(entered, (files["file"] == entered["file"]) & (files["length"] == entered["at"]), "left_anti").select("path").first()
    if broken:
        raise ValueError(f"the chain of records breaks off in {broken[0]}")
    ways = found.join(entered, ["file", "at"]).select("file", "range", F.col("first").alias("entered"))
    return found.join(ways, ["file", "range"]).where("first <= entered and entered < last").drop("entered")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record that the files' chains reach.

    A response whose payload doesn't have the digest that its header tells is an error, and so is a chain that breaks off
    before its file's end. No archives: no rows. The archives aren't needed any more when this returns.
    """
    files = cut(files_of(spark, path))
    kept = reachable(cut(candidates(files)), files)
    wrong = (F.col("record_type") == "response") & ((F.col("found_digest") != F.col("payload_digest")) | (F.col("found_bytes") != F.col("payload_bytes")))
    digest = F.when(wrong, F.raise_error(F.lit("a payload doesn't have its digest"))).otherwise(F.col("payload_digest"))
    return kept.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Write a record for each row of pages to the shared folder, read the archives back, and delete them."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(plan_records(pages, id_col, payload_col), path)
    out = read_archives(spark, path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return out
