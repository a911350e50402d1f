"""WARC archives: written by Spark, indexed first, then read back by sorted and coalesced byte ranges.

Equal payloads are found on narrow rows (length and digest), and of each set one page is the response that the others
revisit.  The pages themselves are written by the tasks that read them; only where the list of revisits is too large to
broadcast are they shuffled, by a hash of the row, so a payload that a third of the pages share is spread.  A record is one value of Spark's text writer whose line separator is the end of a WARC record, so any file
system and the usual commit protocol serve.  The index has file, offset, length, URL and digest of every record.
Reading takes chosen index rows, sorts them by place, merges near ranges into one read, and checks every payload
against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.llm.common import scratch_path, small_side, stored
from tidewatch.session import spread

END = "\r\n\r\n"
#: Payload bytes of one archive, about.
ARCHIVE_BYTES = 16 << 20
#: Ranges at most this far apart are read as one, up to READ_BYTES at a time.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Stores that the range reader opens itself (Spark's name: its name); archives elsewhere are read whole through Spark.
STORES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
INDEX = "file string, offset long, length long, page_id long, record_type string, url string, digest string, payload_bytes long, refers_to long"


def digest(payload: Column) -> Column:
    """Base32 SHA-1: five hex digits are twenty bits, which are four base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """id, key and refers_to of the rows that revisit another one; ``rows`` is narrow (id, key, bytes, digest)."""
    same = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("refers_to"), F.count("*").alias("n"))
    same = stored(same.where("n > 1 AND refers_to IS NOT NULL").drop("n"), "warc-payloads")
    again = rows.join(small_side(same, 96), ["digest", "bytes"]).where("NOT id <=> refers_to")
    return stored(again.select("id", "key", "refers_to").distinct(), "warc-revisits")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``folder``.

    Null html is an empty payload, a null url an empty one; line ends in a url are per-cent coded, so they cannot end a
    header.  Of equal payloads of ``least_bytes`` or more the largest page_id is the response (every row that has it),
    the others revisit it; if none has an id all are responses.  Rows that repeat everything get a record each.
    """
    payload = F.coalesce("html", F.lit(""))
    every = pages.select(F.col("page_id").cast("long").alias("id"), F.xxhash64("url", "html").alias("key"), "url", payload.alias("payload"))
    narrow = stored(every.select("id", "key", F.octet_length("payload").cast("long").alias("bytes"), digest(F.col("payload")).alias("digest")), "warc-pages")
    again = revisits(narrow, least_bytes).select(F.coalesce("id", F.lit(-(2**63))).alias("i"), F.col("key").alias("k"), "refers_to")
    n, total = narrow.agg(F.count("*"), F.sum("bytes")).first()
    per_archive = max(1, archive_bytes * n // max(total or 0, 1))
    rows = every.withColumn("i", F.coalesce("id", F.lit(-(2**63)))).withColumnRenamed("key", "k").join(small_side(again, 64), ["i", "k"], "left")
    rows = rows.withColumn("digest", digest(F.col("payload")))
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("payload")
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(":"), F.lower(F.hex("k")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.concat(F.lit("X-Payload-Length: "), size.cast("string")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(size).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *head), F.lit(END), F.when(revisit, "").otherwise(F.col("payload")))
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_archive).text(folder)


def parse_head(head: bytes) -> dict[str, str]:
    return {k: v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def _records(data: bytes) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Offset, length (without the end mark) and header of each record of an archive."""
    at = 0
    while at < len(data):
        body = data.index(END.encode(), at) + len(END)
        head = parse_head(data[at : body - len(END)])
        stop = body + int(head["Content-Length"])
        yield at, stop - at, head
        at = stop + len(END)


def _fields(head: dict[str, str]) -> tuple:
    own, refers = re.fullmatch(r"<urn:page:(.*):\w+>", head["WARC-Record-ID"])[1], re.fullmatch(r"<urn:page:(.*)>", head.get("WARC-Refers-To", ""))
    return (None if own == "none" else int(own), head["WARC-Type"], head.get("WARC-Target-URI", ""), head["WARC-Payload-Digest"].removeprefix("sha1:"),
            int(head["X-Payload-Length"]), int(refers[1]) if refers else None)


def index_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The stored index of all archives below ``folder``: where each record lies, its URL and its payload's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        types = [pa.string() if "string" in x else pa.int64() for x in INDEX.split(", ")]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(path, at, size, *_fields(head)) for at, size, head in _records(content.as_py())]
                cols = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0")
    return stored(files.select("path", "content").mapInArrow(run, INDEX), "warc-index")


def _payload(record: bytes, want: str, kind: str) -> bytes | None:
    """Payload of a record, checked against its digest; None for a revisit, which has none."""
    if kind == "revisit":
        return None
    payload = record[record.index(END.encode()) + len(END) :]
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != want:
        raise ValueError("payload and digest differ")
    return payload


def _open(path: str):
    scheme, _, rest = path.partition(":")
    store, inside = fs.FileSystem.from_uri(f"{STORES[scheme]}://{'/' * (scheme == 'file')}{quote(rest.lstrip('/'), safe='/:@')}")
    return store.open_input_file(inside)


def _runs(rows: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches (first, after last) of sorted (file, offset, length) that one read covers."""
    first = 0
    for k in range(1, len(rows) + 1):
        near = k < len(rows) and rows[k][0] == rows[first][0] and rows[k][1] - (rows[k - 1][1] + rows[k - 1][2]) <= GAP_BYTES
        if not near or rows[k][1] + rows[k][2] - rows[first][1] > READ_BYTES:
            yield first, k
            first = k


OUT = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _batch(rows: list[tuple], payloads: list[bytes | None]) -> pa.RecordBatch:
    cols = [[r["page_id"] for r in rows], [r["url"] for r in rows], payloads, [r["payload_bytes"] for r in rows], [r["digest"] for r in rows], [r["record_type"] for r in rows], [r["refers_to"] for r in rows]]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in OUT.split(", ")])


def read_records(chosen: DataFrame, whole: bool | None = None) -> DataFrame:
    """The records of index rows, in a row each: page_id, url, payload (null for a revisit), its full size and digest, type, refers_to.

    Rows are dealt by file and sorted by offset; each task merges them into reads.  Where the store is one that only
    Spark opens (``whole``; by default as the first path tells), archives come through Spark and are cut in memory.
    """
    spark = chosen.sparkSession
    if whole is None:
        some = chosen.select("file").head()
        whole = bool(some) and some[0].partition(":")[0] not in STORES
    if whole:
        return _read_whole(spark, chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for a, z in _runs([(r["file"], r["offset"], r["length"]) for r in rows]):
                start, part = rows[a]["offset"], rows[a:z]
                with _open(rows[a]["file"]) as f:
                    data = f.read_at(part[-1]["offset"] + part[-1]["length"] - start, start)
                yield _batch(part, [_payload(data[r["offset"] - start :][: r["length"]], r["digest"], r["record_type"]) for r in part])

    return spread(chosen, "file").sortWithinPartitions("file", "offset").mapInArrow(run, OUT)


def _read_whole(spark: SparkSession, chosen: DataFrame) -> DataFrame:
    chosen = stored(chosen, "warc-chosen")
    folders = [r[0] for r in chosen.select(F.regexp_extract("file", "^(.*)/[^/]*$", 1)).distinct().collect()]
    places = chosen.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "page_id", "url", "payload_bytes", "digest", "record_type", "refers_to"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, rows in zip(b.column(0), b.column(1).to_pylist()):
                data = content.as_py()
                yield _batch(rows, [_payload(data[r["offset"] : r["offset"] + r["length"]], r["digest"], r["record_type"]) for r in rows])

    files = spark.read.format("binaryFile").load(folders).select("path", "content")
    return files.join(small_side(stored(places, "warc-places"), 1 << 16), F.col("path") == F.col("file")).select("content", "places").mapInArrow(run, OUT)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """All records of ``pages`` after writing, indexing and reading them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, folder, least_bytes)
    return read_records(index_archives(pages.sparkSession, folder))
