"""WARC archives: written from payloads, read back by boundary-chain verification.

Writing: one record per row, through Spark's text writer, whose line separator is the blank
lines that end a record. Of equal payloads one row is the response, the others revisit it.

Reading: tasks look for the record magic in byte ranges of the archives and emit, for every
candidate, its offset and that of its successor, and size and digest of its payload, so that bytes
stay where they are read and chains carry numbers only. Payloads may hold the magic too, so only
candidates on the chain from a file's start count: pointers are doubled round by round, and
what they reach from offset 0 is kept, and must reach the file's end. Payloads are cut out, if
they are asked for, at verified offsets only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import BATCH_BYTES, small_batches, table, written
from waymark.session import fresh_path

END = "\r\n\r\n"
MAGIC = b"WARC/1.0\r\n"
# Records and bytes per archive file (a longer record is a file of its own), bytes of a range
# searched by one task row, and behind it for the rest of its last record (what is longer is looked
# up in the file, in a second pass over the archives that hold such a record).
ARCHIVE_RECORDS = 2000
ARCHIVE_BYTES = 128 << 20
FIELD_BYTES = 1 << 10
RANGE_BYTES = 4 << 20
TAIL_BYTES = 1 << 20
# Bytes digested in a range at most, in ranges: false candidates may hold each other.
DIGESTED = 4
# Archives whose open records are listed in one broadcast.
BROADCAST_ARCHIVES = 1 << 12
LEAST_PAYLOAD = 0
# Repeated digests, of some forty bytes, that may be broadcast.
BROADCAST_DIGESTS = 1 << 18
_BASE16, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*\r?$", re.M)
CANDIDATES = (
    "path string, start long, next long, payload long, length long, kind string, page string, "
    "refers string, digest string, full_length long, sha1 string"
)


def payload_digest(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: ten hex digits are eight digits of base 32."""
    hexed = F.sha1(payload)
    eight = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*eight), _BASE16, _BASE32)


def write_archives(
    pages: DataFrame, path: str, least: int = LEAST_PAYLOAD, records: int = ARCHIVE_RECORDS, most: int = ARCHIVE_BYTES
) -> None:
    """Write `pages` (`page_id`, `url`, `html`; other columns are ignored) as WARC files at `path`.

    A null payload is empty. Of rows with equal payloads of `least` bytes or more the one with
    the least page_id is the response (rows that repeat that id too; a null id never is, unless
    all are null); the others are revisits without a body. An empty table writes no record.
    A file has up to `records` records and, unless it is a single one, about `most` bytes.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", "").alias("url"),
        body.alias("body"),
        F.octet_length(body).cast("long").alias("size"),
        payload_digest(body.cast("binary")).alias("digest"),
    )
    # Equal payloads are found by digest alone. Digests that repeat are usually few, and then go
    # to the bodies; else the bodies move, in a join that Spark can split where one is common.
    first = (
        rows.where(F.col("size") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    first = written(first, "repeated")
    if first.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        first = F.broadcast(first)
    told = rows.join(first, "digest", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    held = F.when(revisit, "").otherwise(F.col("body"))
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url")), F.lit("")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name("response"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("size"),
        F.lit("\r\nContent-Length: "), F.octet_length(held), F.lit(END), held,
    )
    # Spark bounds a file by records only, so rows are written by length: those of which `records`
    # fit a file, then those of which an eighth fit, and so on. Mostly all are of the first kind.
    limits = [max(1, records >> 3 * k) for k in range(records.bit_length() // 3 + 1)]
    length = F.octet_length("body").cast("long") + F.coalesce(F.octet_length("url"), F.lit(0)) + FIELD_BYTES
    kind = F.lit(len(limits) - 1)
    for k in reversed(range(len(limits) - 1)):
        kind = F.when(length <= most // limits[k], k).otherwise(kind)
    kinds = sorted(r.kind for r in rows.select(kind.alias("kind")).distinct().collect()) or [0]
    for k in kinds:
        part = told.where(kind == k) if len(kinds) > 1 else told
        out = part.select(record.alias("value")).write.mode("errorifexists" if k == kinds[0] else "append")
        out.option("lineSep", END).option("maxRecordsPerFile", str(limits[k])).text(path)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _candidates(path: str, begin: int, piece: bytes, own: int, last: bool) -> Iterator[tuple]:
    """Candidate records whose magic starts in the first `own` bytes of a file's piece.

    One whose header goes on behind a piece that is not the `last` has nulls but for its place; one
    whose payload does, or comes after enough others, has no `sha1`.
    """
    at, end, left = piece.find(MAGIC), None, DIGESTED * own
    while 0 <= at < own:
        if end is None or 0 <= end < at:
            end = piece.find(END.encode(), at)
        if end >= 0:
            for row in _candidate(path, begin + at, piece[at:end]):
                first, size = row[3] - begin, row[4]
                if first + size <= len(piece) and size <= left:
                    left -= size
                    row = (*row[:-1], _digest(piece[first : first + size]))
                yield row
        elif not last:
            yield (path, begin + at, *[None] * 9)
        at = piece.find(MAGIC, at + 1)


def _candidate(path: str, start: int, header: bytes) -> Iterator[tuple]:
    fields = {k.lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(header)}
    length = fields.get(b"content-length", "")
    if length.isascii() and length.isdigit():
        payload = start + len(header) + len(END)
        whole = fields.get(b"x-payload-length", "")
        yield (
            path, start, payload + int(length) + len(END), payload, int(length),
            fields.get(b"warc-type"), fields.get(b"warc-record-id"), fields.get(b"warc-refers-to"),
            fields.get(b"warc-payload-digest"),
            int(whole) if whole.isascii() and whole.isdigit() else None, None,
        )


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATES.split(", ")])
    return made.astype(dict.fromkeys(["next", "payload", "length", "full_length"], "Int64"))


def _with_archives(spark: SparkSession, path: str, rows: DataFrame, columns: str) -> DataFrame:
    """The archives that `rows` are of, each with a list of their `columns`."""
    listed = rows.groupBy("path").agg(F.collect_list(F.struct(*columns.split())).alias("open"))
    listed = written(listed, "open-records")
    # A path and up to an archive's number of records each, for so many archives, go to all tasks; a
    # longer list meets the archives it names in a shuffle.
    if listed.limit(BROADCAST_ARCHIVES + 1).count() <= BROADCAST_ARCHIVES:
        listed = F.broadcast(listed)
    return _archives(spark, path).select("path", "content").join(listed, "path").select("path", "content", "open")


def verified_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, tail_bytes: int = TAIL_BYTES) -> DataFrame:
    """The header rows of the records on each archive's chain from its start, payloads digested (`sha1`).

    An archive whose chain does not end where the file does is an error.
    """
    small_batches(spark)
    ranges = _archives(spark, path).select(
        "path", "length", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("begin")
    ).select("path", "begin", F.expr(f"substring(content, int(begin + 1), {range_bytes + tail_bytes})").alias("piece"), F.expr(f"begin + {range_bytes + tail_bytes} >= length").alias("last"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, begin, piece, last in zip(batch["path"], batch["begin"], batch["piece"], batch["last"]):
                yield _frame(list(_candidates(file, int(begin), piece, range_bytes, last)))

    def search_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content, starts in zip(batch["path"], batch["content"], batch["open"]):
                rows, end = [], None
                for start in sorted(s["start"] for s in starts):
                    if end is None or 0 <= end < start:
                        end = content.find(END.encode(), start)
                    if end >= 0:
                        rows += _candidate(file, int(start), content[start:end])
                yield _frame(rows)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content, rows in zip(batch["path"], batch["content"], batch["open"]):
                made = [(file, r["start"], _digest(content[r["payload"] : r["payload"] + r["length"]])) for r in rows]
                yield pd.DataFrame(made, columns=["path", "start", "late"])

    found = written(ranges.mapInPandas(search, CANDIDATES), "candidates")
    cut = found.where("next IS NULL")
    if not cut.isEmpty():
        more = _with_archives(spark, path, cut, "start").mapInPandas(search_on, CANDIDATES)
        found = written(found.where("next IS NOT NULL").unionByName(more), "candidates")
    jumps = found.select("path", "start", "next")
    reached = found.where("start = 0").select("path", "start")
    while True:
        # What is reached in one more stride of the present length.
        ahead = reached.join(jumps, ["path", "start"]).select("path", F.col("next").alias("start"))
        more = written(reached.unionByName(ahead.join(found, ["path", "start"], "left_semi")), "reached")
        after = jumps.select("path", F.col("start").alias("next"), F.col("next").alias("onward"))
        jumps = written(jumps.join(after, ["path", "next"]).select("path", "start", F.col("onward").alias("next")), "jumps")
        reached = more
        # A stride that no record can make any more leaves nothing to reach.
        if jumps.isEmpty():
            break
    records = found.join(reached.distinct(), ["path", "start"], "left_semi")
    ends = records.groupBy("path").agg(F.max("next").alias("end"))
    lengths = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    broken = lengths.join(ends, "path", "left").where(~F.col("end").eqNullSafe(F.col("length"))).limit(3).collect()
    if broken:
        raise ValueError("; ".join(f"{r.path}: records end at {r.end or 0} of {r.length} bytes" for r in broken))
    late = records.where("sha1 IS NULL")
    if late.isEmpty():
        return records
    told = written(_with_archives(spark, path, late, "start payload length").mapInPandas(digest, "path string, start long, late string"), "late")
    return records.join(told, ["path", "start"], "left").withColumn("sha1", F.coalesce("sha1", "late")).drop("late")


def record_table(records: DataFrame, *more: str) -> DataFrame:
    """Per verified record: `page_id, record_type, refers_to, payload_bytes, payload_digest`.

    Bytes and digest of a response are those of what was read; a revisit has those of its header.
    `more` columns of `records` come along.
    """
    revisit = F.col("kind").eqNullSafe("revisit")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return records.select(
        number("page").alias("page_id"), F.col("kind").alias("record_type"), number("refers").alias("refers_to"),
        F.when(revisit, F.col("full_length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("digest", "^sha1:", "")).otherwise(F.col("sha1")).alias("payload_digest"),
        *more,
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """`record_table` and the `payload` of every verified record (null for a revisit).

    Payloads are cut out where their archive is read again, which meets its list of records.
    """
    records = verified_records(spark, path)
    cut_rows = _with_archives(spark, path, records, "payload length kind page refers digest full_length sha1")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = "page kind refers digest full_length length sha1 payload".split()
        for batch in batches:
            for content, records in zip(batch["content"], batch["open"]):
                rows, held = [], 0
                for r in records:
                    whole = None if r["kind"] == "revisit" else content[r["payload"] : r["payload"] + r["length"]]
                    held += r["length"]
                    rows.append((*[r[c] for c in columns[:-1]], whole))
                    if held > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns).astype({"full_length": "Int64"})
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns).astype({"full_length": "Int64"})

    schema = "page string, kind string, refers string, digest string, full_length long, length long, sha1 string, payload binary"
    return record_table(cut_rows.mapInPandas(cut, schema), "payload")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return record_table(verified_records(spark, path))


OP5_SQL = r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hexed FROM pages
), q AS (
    SELECT page_id, hexed, strlen(body) AS payload_bytes, min(page_id) OVER (PARTITION BY body) AS m FROM p
)
SELECT page_id, payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (1 + (((('0x' || substr(hexed, (1 + 10 * (i // 8))::INT, 10))::BIGINT) >> (35 - 5 * (i % 8))) & 31))::INT, 1)
        FOR i IN range(32)], '')
        AS payload_digest,
    CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> m THEN m END AS refers_to
FROM q
"""
