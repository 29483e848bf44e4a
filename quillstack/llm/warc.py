"""WARC archives of pages with revisit records, and their index by external merge.

Writing: payload digests are grouped, the smallest page_id of a digest is the response and the others become revisits of it;
each record is one row of Spark's text writer with the record end ``CRLF CRLF`` as line separator, so archives are written where
the shared file system is, by any executor, and retried like any output. Reading goes by Content-Length, since payloads may hold
anything, and digests the payloads anew.

Index: every archive yields a run of captures sorted by URL key, timestamp and page. The runs are range-partitioned on that
whole key, so that one URL with a very long history is spread as well, and each partition merges its k runs with a loser tree;
partition after partition that is the global order, numbered without a gap.

Scale: html is shuffled once (by digest, joined with one row per digest; Spark splits a hot digest's partition), the archives are
at most ``records_per_file`` records each, and a merge task holds the index entries of its range only, about ``range_rows``.

Defined cases: a null html is an empty payload; a null url has an empty key and no target line; blanks and control characters in a
url are percent-coded; a null page_id never is the record others refer to, unless no other has the payload, when nothing refers to it;
rows that repeat page_id and html are written and read as often as they occur; an empty table gives empty results;
pages without a capture time are dated a fixed day plus page_id seconds; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width

CRLF = "\r\n"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FIRST_DATE = 1_704_067_200
INDEX = "run string, url_key string, captured string, page_id long, record_offset long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: 160 bits are eight groups of four letters."""
    digest, letters = F.sha1(text), []
    for group in range(8):
        value = F.conv(F.substring(digest, group * 5 + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_revisits(pages: DataFrame, min_bytes: int = 0, captured: str | None = None) -> DataFrame:
    """page_id, url, date, payload, payload_bytes, digest, first: the page each payload of ``min_bytes`` or more is stored with."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    when = F.col(captured) if captured else F.timestamp_seconds(F.lit(FIRST_DATE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000)))
    rows = pages.select("page_id", "url", when.alias("date"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", sha1_base32(F.col("payload")))
    firsts = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("digest").alias("f_digest")).agg(F.min("page_id").alias("first"))
    return rows.join(firsts, F.col("digest") == F.col("f_digest"), "left").drop("f_digest")


def record_text(is_revisit: Column) -> Column:
    """A whole record without its end, from the columns of ``with_revisits``."""
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.col("payload_bytes"), F.lit(CRLF * 2))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = [
        F.lit("WARC/1.1"),
        F.when(is_revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Date: "), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(is_revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    # concat_ws leaves out the lines that are null.
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, captured: str | None = None, records_per_file: int = 20_000) -> None:
    rows = with_revisits(pages, min_bytes, captured)
    is_revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = rows.select(record_text(is_revisit).alias("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then the rest, in lower case."""
    rest = url.partition("://")[2]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:cut].lower(), rest[cut:].lower()
    return ",".join(reversed(host.split("."))) + ")" + tail if rest else ""


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """(url_key, captured, page_id, offset, type, refers_to, payload_bytes, payload_digest) of each record of one archive."""

    def fields(until: bytes) -> tuple[dict[str, str], int]:
        found, size = {}, 0
        while (line := stream.readline()) and line != until:
            size += len(line)
            name, _, value = line.decode().partition(":")
            found[name.strip().lower()] = value.strip()
        return found, size + len(until)

    def page(urn: str) -> int | None:
        name = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(name) if name not in ("none", "") else None

    offset = 0
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at {offset}: {version[:40]!r}")
        head, size = fields(b"\r\n")
        http, http_size = fields(b"\r\n")
        left, sha = int(head["content-length"]) - http_size, hashlib.sha1()
        payload = left
        while left:
            piece = stream.read(min(left, 1 << 20))
            if not piece:
                raise ValueError(f"the record at {offset} is cut off")
            sha.update(piece)
            left -= len(piece)
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {offset} has no end")
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "response":
            if base64.b32encode(sha.digest()).decode() != digest:
                raise ValueError(f"the payload at {offset} does not have its digest")
            length = payload
        else:
            length = int(http["content-length"])
        yield (url_key(head.get("warc-target-uri", "")), head["warc-date"], page(head["warc-record-id"]), offset, head["warc-type"], page(head.get("warc-refers-to", "")), length, digest)
        offset += len(version) + size + int(head["content-length"]) + 4


def _order(entry: tuple) -> tuple:
    page_id = entry[2]
    return entry[0], entry[1], page_id is not None, page_id or 0, entry[3]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``; those of one archive are a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().rpartition("/")[2]
                with gzip.GzipFile(fileobj=io.BytesIO(batch.column(1)[i].as_py())) as raw:
                    entries = sorted(read_records(io.BufferedReader(raw)), key=_order)
                if entries:
                    columns = [pa.array(c) for c in zip(*entries, strict=True)]
                    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                    columns = [c.cast(t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(entries)), *columns], names=[f.split()[0] for f in INDEX.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, INDEX)


class LoserTree:
    """Merges k sorted lists: each inner node keeps the loser of its match, and the winner replays its path only."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        self.tree = [-1] * max(len(runs), 1)
        for leaf in range(len(runs)):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        node, winner = (leaf + len(self.runs)) // 2, leaf
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.runs and self.heads[winner := self.tree[0]] is not None:
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            rest = self.at[winner]
            self.heads[winner] = self.key(self.runs[winner][rest]) if rest < len(self.runs[winner]) else None
            self._play(winner)


def merge_runs(runs: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """The captures in global order by (url_key, captured, page_id), with ``ordinal`` from 0. ``runs`` is a stored table."""
    spark = runs.sparkSession
    scratch = Scratch(spark, "warc-merge")
    names = runs.columns
    order = ["url_key", "captured", "page_id", "record_offset"]
    ranges = max(shuffle_width(spark), -(-runs.count() // range_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        rows = list(zip(*(table[c].to_pylist() for c in ["url_key", "captured", "page_id", "record_offset", "run"]), range(table.num_rows), strict=True))
        parts: list[list] = []
        for row in rows:
            if not parts or parts[-1][-1][4] != row[4]:
                parts.append([])
            parts[-1].append(row)
        merged = [row[5] for row in LoserTree(parts, _order)]
        out = table.take(pa.array(merged)).append_column("_qs_at", pa.array(range(len(merged)), pa.int64()))
        yield from out.to_batches()

    ranged = runs.repartitionByRange(ranges, *order).sortWithinPartitions("run", *order)
    merged = ranged.mapInArrow(merge, f"{INDEX}, _qs_at long").withColumn("_qs_part", F.spark_partition_id())
    merged = scratch.keep(merged, "merged")
    counts, start, starts = {r["_qs_part"]: r["n"] for r in merged.groupBy("_qs_part").agg(F.count("*").alias("n")).collect()}, 0, []
    for part in sorted(counts):
        starts.append((part, start))
        start += counts[part]
    starts = F.broadcast(spark.createDataFrame(starts, "_qs_p int, _qs_start long"))
    return merged.join(starts, F.col("_qs_part") == F.col("_qs_p")).select(*names, (F.col("_qs_start") + F.col("_qs_at")).alias("ordinal"))


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the archives, reads them back and returns their merged index: one row per page."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = path or scratch.path("archives")
    write_archives(pages, path, **options)
    return merge_runs(scratch.keep(read_runs(spark, path), "runs"))
