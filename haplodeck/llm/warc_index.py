"""WARC archives of pages, read back, with an external merge of their indexes.

Writing. A record is a line of text (header, HTTP head, payload) and the text writer's separator is the
blank lines that end a WARC record, so Spark itself writes the archives, gzipped, wherever its paths
reach, each task its own of about ARCHIVE_BYTES. Of records with equal
payloads of LEAST bytes or more, that of the smallest page id is a response and the others revisit it.

Reading. Each archive is one binary row; its records are cut by their Content-Length, and the payload
digest of responses is computed anew and compared with the header. Each archive's captures, sorted by
(URL key, timestamp, page id), are one run of the index.

Merging. Runs are split into ranges of the same bounds (range partitioning over all runs); in each
range's task the runs come one after the other, each in order, and a loser tree merges them: k - 1
inner nodes hold the losers of their matches, the winner leaves and only its path is played again.
The ranges in order are the capture history of all archives.

Null html is empty. Null page ids never are a response others refer to; null URLs have an empty key.
Pages that occur twice with the smallest id of their payload are both responses. Line breaks and
blanks in URLs are percent-encoded in headers. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haplodeck.llm.tables import scratch, written

LEAST = 100
ARCHIVE_BYTES = 32 << 20
BROADCAST_OWNERS = 200_000
#: Captures per range of the merge.
RANGE_ROWS = 100_000
EPOCH = "2020-01-01T00:00:00Z"
_END = "\r\n\r\n"


def url_key(url: Column) -> Column:
    """Sort-friendly form: host labels reversed and comma-joined, port kept, then path and query in
    lower case, without scheme, leading `www.` and fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://", ""),
                            r"#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?:]*)", 1), r"^www\d*\.", "")
    port = F.regexp_extract(bare, r"^[^/?:]*(:\d+)", 1)
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[^/?]*", ""), r"^$", "/")
    return F.when(bare == "", "").otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), rest))


def _header_safe(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for letter in "\r\n \t":
        out = F.replace(out, F.lit(letter), F.lit(f"%{ord(letter):02X}"))
    return out


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
            captured: Column | None = None) -> DataFrame:
    """One row per page: key, url, captured (timestamp text), payload, digest, bytes, refers_to.

    Payload owners are one pre-aggregated row per digest that occurs twice or more; up to BROADCAST_OWNERS
    of them, checked, meet the pages inside the scan, so no payload is shuffled. Beyond, the pages are
    joined by digest, and adaptive execution splits a digest that a third of them has."""
    raw = F.coalesce(F.col(html), F.lit(""))
    at = captured if captured is not None else F.timestamp_seconds(
        F.unix_seconds(F.lit(EPOCH).cast("timestamp")) + F.coalesce(F.col(key), F.lit(0)))
    rows = pages.select(
        F.col(key), F.col(url).alias("url"), F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        raw.alias("payload"), F.sha2(raw.cast("binary"), 256).alias("digest"),
        F.octet_length(raw).cast("long").alias("bytes"))
    owner = rows.where(F.col("bytes") >= LEAST).groupBy("digest").agg(
        F.min(key).alias("_owner"), F.count("*").alias("_n")).where("_n > 1").select("digest", "_owner")
    owner = written(owner, "warc-owners")
    few = owner.limit(BROADCAST_OWNERS + 1).count() <= BROADCAST_OWNERS
    return rows.join(F.broadcast(owner) if few else owner, "digest", "left").select(
        *rows.columns, F.when(F.col("_owner") != F.col(key), F.col("_owner")).when(
            F.col(key).isNull(), F.col("_owner")).alias("refers_to"))


def _record_text(key: str) -> Column:
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit(_END))
    block = F.concat(head, F.when(revisit, "").otherwise(F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), F.regexp_replace(
            F.md5(F.concat_ws(" ", F.col(key).cast("string"), "url", "digest").cast("binary")),
            r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.coalesce("captured", F.lit(""))),
        F.concat(F.lit("WARC-Target-URI: "), _header_safe(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col(key).cast("string"), F.lit(""))),
        F.concat(F.lit("X-URL-Key: "), _header_safe(url_key(F.col("url")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Page: "), F.col("refers_to").cast("string"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block)


def write_archives(rows: DataFrame, path: str, key: str = "page_id", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """records() as .warc.gz files, where the rows are; a file ends after as many records as make about
    archive_bytes (uncompressed) at the mean size."""
    mean = rows.agg(F.avg(F.col("bytes") + 600)).first()[0] or 600
    # a record is separated from the next by the two line ends that close it
    rows.select(_record_text(key).alias("value")).write.option("compression", "gzip").option(
        "lineSep", _END).option("maxRecordsPerFile", max(1, int(archive_bytes / mean))).text(path)


def _cut(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(headers, offset, length, block) of the records of an unpacked archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(fields["Content-Length"])
        block = data[head + 4:head + 4 + size]
        if lines[0] != "WARC/1.1" or len(block) != size:
            raise ValueError(f"no WARC record at {at}")
        end = head + 4 + size + 4
        yield fields, at, end - at, block
        at = end


def read_index(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """Captures of all archives: run (archive), offset, length (of the record, unpacked), url_key,
    captured, page_id, record_type, payload_bytes, payload_digest, refers_to. Digests of responses are
    computed from what was read; one that differs from its header fails the job."""
    number = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                archive, rows = name.as_py().rsplit("/", 1)[-1], []
                for f, at, size, block in _cut(zlib.decompress(content.as_buffer(), 31)):
                    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:")
                    length = int(f["X-Payload-Length"])
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        found, length = sha256(payload).hexdigest(), len(payload)
                        if found != digest:
                            raise ValueError(f"payload digest of {archive} at {at}")
                    refers = f.get("WARC-Refers-To-Page")
                    rows.append((archive, at, size, f["X-URL-Key"], f["WARC-Date"],
                                 int(f["X-Page-ID"]) if f["X-Page-ID"] else None, kind, length, digest,
                                 int(refers) if refers else None))
                cols = list(zip(*rows, strict=True)) or [()] * 10
                types = [pa.string(), number, number, pa.string(), pa.string(), number, pa.string(), number,
                         pa.string(), number]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = ["run", "offset", "length", "url_key", "captured", "page_id", "record_type", "payload_bytes",
             "payload_digest", "refers_to"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(
        run, "run string, offset long, length long, url_key string, captured string, page_id long, "
             "record_type string, payload_bytes long, payload_digest string, refers_to long")


class LoserTree:
    """k-way merge of sorted runs. Inner node i keeps the loser of the match below it; the overall
    winner is replayed along its leaf's path after it moves on."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _head(self, run: int):
        at = self.at[run]
        return self.runs[run][at] if at < len(self.runs[run]) else None

    def _less(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self):
        while self.k and (head := self._head(self.winner)) is not None:
            yield self.winner, self.at[self.winner], head
            self.at[self.winner] += 1
            now, node = self.winner, (self.winner + self.k) // 2
            while node:
                if self._less(self.losers[node], now):
                    self.losers[node], now = now, self.losers[node]
                node //= 2
            self.winner = now


def merged_history(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index in global order of (url_key, captured, page_id): range (number of the key range, in
    order) and position (place in the range), beside the index's columns. A range holds about
    range_rows captures, whatever the number of runs, also of one URL key."""
    index = written(index.sortWithinPartitions("url_key", "captured", "page_id"), "warc-index")
    n = index.count()
    order = ["url_key", "captured", "page_id", "run", "offset"]
    ranged = index.repartitionByRange(max(1, -(-n // range_rows)), *order).sortWithinPartitions(
        "run", "url_key", "captured", "page_id", "offset").withColumn("range", F.spark_partition_id())
    columns = [*index.columns, "range"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        names = table.column("run").to_pylist()
        heads = list(zip(table.column("url_key").to_pylist(), table.column("captured").to_pylist(),
                         [(p is not None, p or 0) for p in table.column("page_id").to_pylist()],
                         table.column("offset").to_pylist(), strict=True))
        bounds = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        tree = LoserTree([heads[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
        taken = [bounds[r] + at for r, at, _ in tree]
        out = table.take(pa.array(taken)).append_column("position", pa.array(range(len(taken)), pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.select(*columns).schema)
    return ranged.select(*columns).mapInArrow(run, f"{schema}, position long")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives written, read back and merged: one row per page from the capture history."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    rows = records(pages, key, url, html)
    write_archives(rows, path, key)
    return merged_history(read_index(spark, path))
