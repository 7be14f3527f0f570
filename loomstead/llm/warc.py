"""WARC records and Merkle fixity audits of archive replicas.

Records: `write_record` and `read_records` make and parse WARC/1.1 response records; `WarcSource` reads and writes files of them as
DataFrames. A replica is a table of records (archive, seq, offset, length, digest): an archive's records lie one after another in order of
seq, and the digest is the SHA-256 of a record's bytes, head and all.

Audit: a leaf is the SHA-256 of a record's offset, length and digest; a node is the SHA-256 of its children's
hashes in order, FANOUT ordered offset ranges at a time, up to one root per archive; each level is written once. Two replicas' roots are compared, and
only the children of unequal nodes are joined on the next level down, so that the records compared are those of damaged
ranges alone. A record that one replica lacks shows as a leaf that differs.

An archive has a bounded number of records (RECORDS on average, by hash), so ranges and offsets are windows of bounded size.

Edge cases: null url or content count as empty; rows equal in all three columns are one record with its number of copies;
other columns are ignored; an empty table has no archive; a file of no bytes has no record.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import common

RECORDS, FANOUT = 1024, 16
_HEAD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {}\r\nWARC-Payload-Digest: sha256:{}\r\nContent-Type: text/html\r\nContent-Length: {}\r\n\r\n"


def write_record(url: str | None, content: str | None) -> bytes:
    body = (content or "").encode()
    return _HEAD.format(url or "", hashlib.sha256(body).hexdigest(), len(body)).encode() + body + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[int, int, str, bytes, bool]]:
    """(offset, length, url, body, digest holds) of each record; ValueError where the data isn't a run of records."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        stop = end + 4 + int(head["Content-Length"])
        body = data[end + 4 : stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} isn't closed")
        yield at, stop + 4 - at, head.get("WARC-Target-URI", ""), body, head.get("WARC-Payload-Digest") == "sha256:" + hashlib.sha256(body).hexdigest()
        at = stop + 4


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_Part]:
        return [_Part(os.path.join(self.folder, x)) for x in sorted(os.listdir(self.folder)) if x.endswith(".warc")]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for k, (at, length, url, body, intact) in enumerate(read_records(f.read())):
                yield os.path.basename(partition.path), k, at, length, url, body.decode("utf-8", "replace"), intact


class _Done(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceWriter):
    """A file for each partition; files get their names when all are written."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names

    def write(self, rows: Iterator) -> _Done:
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f".{uuid.uuid4().hex}.part")
        url, content = self.names.index("url"), self.names.index("content")
        with open(path, "wb") as f:
            for row in rows:
                f.write(write_record(row[url], row[content]))
        return _Done(path)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.rename(m.path, os.path.join(self.folder, os.path.basename(m.path)[1:-5] + ".warc"))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class WarcSource(DataSource):
    """Format `warc`: a folder, on storage that all executors mount, of files of records. Writes url and content; reads whole files, one task each."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "archive string, seq long, offset long, length long, url string, content string, intact boolean"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        folder = self.options["path"]
        if overwrite and os.path.isdir(folder):
            for x in os.listdir(folder):
                if x.endswith(".warc"):
                    os.remove(os.path.join(folder, x))
        return _Writer(folder, list(schema.names))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def _record(url: F.Column, content: F.Column) -> F.Column:
    """What write_record gives, as a column."""
    u, c = F.coalesce(url, F.lit("")), F.coalesce(content, F.lit(""))
    head, digest, size, end = _HEAD.split("{}")
    return F.concat(F.lit(head), u, F.lit(digest), F.sha2(c, 256), F.lit(size), F.octet_length(c).cast("string"), F.lit(end), c, F.lit("\r\n\r\n"))


def _placed(pages: DataFrame, per_archive: int, one_in: int | None) -> DataFrame:
    base = common.pick(pages, page_id="long", url="string", html="string")
    archives = max(1, -(-base.count() // per_archive))
    record = _record(F.col("url"), F.col("html"))
    digest = F.sha2(record, 256)
    other = digest if one_in is None else F.when(_rotten(digest, one_in), F.sha2(F.concat(F.lit("V"), F.substring(record, 2, 2**31 - 1)), 256)).otherwise(digest)
    narrow = base.select("page_id", digest.alias("digest"), F.octet_length(record).cast("long").alias("length"), other.alias("other")).groupBy("page_id", "digest", "length", "other").agg(F.count("*").alias("copies"))
    archive = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "digest")), 1, 8), 16, 10).cast("long") % archives
    order = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    return narrow.withColumn("archive", archive).select(
        "page_id", "archive", (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("offset"), "length", "digest", "copies", "other",
    )


def records(pages: DataFrame, per_archive: int = RECORDS) -> DataFrame:
    """page_id, archive, seq, offset, length, digest, copies: the replica that holds pages as they are."""
    return _placed(pages, per_archive, None).drop("other")


def leaves(replica: DataFrame) -> DataFrame:
    """(archive, node, hash) on level 0; node is seq."""
    return replica.select("archive", F.col("seq").alias("node"), F.sha2(F.concat_ws("|", "offset", "length", "digest"), 256).alias("hash"))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level up: hashes of `fanout` children in order."""
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    return level.groupBy("archive", F.floor(F.col("node") / fanout).cast("long").alias("up")).agg(F.sha2(F.array_join(F.transform(children, lambda x: x["hash"]), ""), 256).alias("hash")).select("archive", F.col("up").alias("node"), "hash")


def tree(replica: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from leaves to roots, written one after another. Their number follows the longest archive."""
    most = replica.agg(F.max("seq")).first()[0]
    levels, width = [common.save(leaves(replica), "warc-level")], (most or 0) + 1
    while width > 1:
        levels.append(common.save(parents(levels[-1], fanout), "warc-level"))
        width = -(-width // fanout)
    return levels


def audit(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(archive, seq): records in which the replicas differ, found from the roots down."""
    a, b = tree(ours, fanout), tree(theirs, fanout)
    for short, long in ((a, b), (b, a)):
        while len(short) < len(long):
            short.append(parents(short[-1], fanout))
    suspects = None
    for x, y in zip(reversed(a), reversed(b)):
        if suspects is not None:  # only below unequal nodes
            below = suspects.select("archive", F.col("node").alias("up"))
            x, y = (z.withColumn("up", F.floor(F.col("node") / fanout).cast("long")).join(below, ["archive", "up"], "left_semi").drop("up") for z in (x, y))
        both = x.select("archive", "node", F.col("hash").alias("ha")).join(y.select("archive", "node", F.col("hash").alias("hb")), ["archive", "node"], "full")
        suspects = both.filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("archive", "node")
    return suspects.select("archive", F.col("node").alias("seq"))


def _rotten(digest: F.Column, one_in: int) -> F.Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % one_in == 0


def damaged(replica: DataFrame, one_in: int = 500) -> DataFrame:
    """A replica in which about one record in `one_in` (by digest) has rotted: its digest is another."""
    return replica.withColumn("digest", F.when(_rotten(F.col("digest"), one_in), F.sha2(F.concat(F.lit("rot"), "digest"), 256)).otherwise(F.col("digest")))


def audit_report(pages: DataFrame, one_in: int = 500) -> DataFrame:
    """One row per record: page_id, archive, seq, offset, length, digest, copies, intact.

    In the second replica the first byte of one record in `one_in` (by digest) is another; its bytes are hashed anew like the first's.
    """
    both = common.save(_placed(pages, RECORDS, one_in), "warc-records")
    ours = both.drop("other")
    found = audit(ours, both.drop("digest").withColumnRenamed("other", "digest")).withColumn("bad", F.lit(True))
    return ours.join(found, ["archive", "seq"], "left").select("page_id", "archive", "seq", "offset", "length", "digest", "copies", F.col("bad").isNull().alias("intact"))
