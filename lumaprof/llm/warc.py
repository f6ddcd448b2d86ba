"""Merkle fixity audit of archived records.

Every page is one record, named by a digest of what was archived (its record id). The
order of record ids is the order of records; an archive is a range of that order, with
about ``ARCHIVE_RECORDS`` records. A leaf of the tree is a record's id, digest and
length; every level above digests the ordered ranges below it, with the bytes each of
them takes, so that offsets are fixed by the tree, until one root is left. An audit
compares the roots of two replicas and then, level by level, only the ranges below
nodes that differ, down to single records.

Ranges are cut by prefixes of the record id and not by position: a lost or extra record
changes one leaf and the nodes above it, and no other record is reported.

Levels are group-bys over narrow rows of ever fewer nodes, each with at most
``FAN_OUT`` children (those above the records with about as many). Offsets are added
up for the archives with damage only.

Null urls and pages count as empty; null ids are written as none. Repeated rows have
one record id and are copies of a record: they are counted, and an audit reports
another number of copies. Pages of any length are read whole, one record each. An
empty replica lacks all records of the other; two empty ones do not differ. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaprof.llm.common import written

#: Children of a node (one hexadecimal digit) and records of an archive (two digits).
FAN_OUT, ARCHIVE_RECORDS = 16, 256
#: Ends a record.
END = "\r\n\r\n"
#: The date of a record whose page has none.
NO_DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: Column, url: Column, html: Column) -> Column:
    """The name a page's record is given when it is first archived."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    return F.sha2(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("")), F.octet_length(url).cast("string"),
                              F.concat(url, html)).cast("binary"), 256)


def record(name: Column, page_id: Column, url: Column, payload: Column, date: Column | None = None) -> Column:
    """A resource record without its end: header lines, a blank line and the payload. Line ends in urls are written as %0D and %0A."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [F.lit("WARC/1.0"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:sha256:"), name, F.lit(">")),
             F.concat(F.lit("WARC-Date: "), F.coalesce(date, F.lit(NO_DATE)) if date is not None else F.lit(NO_DATE)),
             F.concat(F.lit("WARC-Target-URI: "), url), F.lit("Content-Type: text/html"),
             F.concat(F.lit("X-Page-Id: "), F.coalesce(page_id.cast("string"), F.lit(""))),
             F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), payload)


def records(pages: DataFrame, payload: Column | None = None) -> DataFrame:
    """(record_id, page_id, content): the records of pages; ``payload`` is what a replica holds in place of ``html``."""
    name = record_id(F.col("page_id"), F.col("url"), F.col("html"))
    held = F.col("html") if payload is None else payload
    named = pages.select(name.alias("record_id"), F.col("page_id").cast("bigint").alias("page_id"), "url", held.alias("held"))
    return named.select("record_id", "page_id", record(F.col("record_id"), F.col("page_id"), F.col("url"), F.col("held")).alias("content"))


def catalogue(held: DataFrame) -> DataFrame:
    """(record_id, page_id, length, digest) of the records of a replica."""
    whole = F.concat("content", F.lit(END))
    return held.select("record_id", "page_id", F.octet_length(whole).cast("bigint").alias("length"),
                       F.sha2(whole.cast("binary"), 256).alias("digest"))


def leaves(catalogued: DataFrame) -> DataFrame:
    """One row per record id: copies, their bytes, the least digest, and the leaf over all of them."""
    sums = catalogued.groupBy("record_id").agg(
        F.min("page_id").alias("page_id"), F.count("*").alias("copies"), F.sum("length").alias("bytes"), F.min("digest").alias("record_digest"),
        F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("_all"))
    leaf = F.sha2(F.concat_ws(":", "record_id", "copies", "bytes", "record_digest", F.col("_all").cast("string")), 256)
    return written(sums.withColumn("digest", leaf).drop("_all"), "leaves")


def archive_digits(count: int) -> int:
    """Digits of the record id that name an archive when there are so many records."""
    digits = 0
    while ARCHIVE_RECORDS * FAN_OUT ** digits < count:
        digits += 1
    return digits


def tree(leaf_rows: DataFrame, digits: int) -> list[DataFrame]:
    """Levels from the records to the root, each (node, bytes, digest); the records' level has all columns of ``leaves``."""
    levels = [leaf_rows.withColumn("node", F.col("record_id"))]
    for width in range(digits + 1, -1, -1):
        part = F.struct("node", "bytes", "digest")
        above = levels[-1].groupBy(F.left("node", F.lit(width)).alias("up")).agg(
            F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list(part)).alias("parts"))
        digest = F.sha2(F.concat_ws(",", F.transform("parts", lambda p: F.concat_ws(":", p["node"], p["bytes"], p["digest"]))), 256)
        levels.append(written(above.select(F.col("up").alias("node"), "bytes", digest.alias("digest")), f"level{width}"))
    return levels


def audit(primary: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """Records that differ: what was expected (copies, digest, archive, offset of the first copy, bytes) and what was found.

    A record that only the replica has lies in no archive of the primary: its offset is null.
    """
    digits = len(primary) - 3
    differing = None
    for level in range(len(primary) - 1, 0, -1):
        sides = [t[level].select("node", "digest") for t in (primary, replica)]
        if differing is not None:
            up = F.left("node", F.lit(digits + 1 - level))
            sides = [s.join(differing.withColumnRenamed("node", "_up"), up == F.col("_up"), "left_semi") for s in sides]
        a, b = sides[0].withColumnRenamed("digest", "a"), sides[1].withColumnRenamed("digest", "b")
        differing = written(a.join(b, "node", "full").filter("not (a <=> b)").select("node"), f"differing{level}")
        if differing.isEmpty():
            break
    below = differing.withColumnRenamed("node", "_up")
    a, b = (t[0].join(below, F.left("record_id", F.lit(digits + 1)) == F.col("_up"), "left_semi")
            .select("record_id", *(F.col(c).alias(f"{side}_{c}") for c in ("page_id", "copies", "bytes", "record_digest", "digest")))
            for side, t in (("a", primary), ("b", replica)))
    found = written(a.join(b, "record_id", "full").filter("not (a_digest <=> b_digest)").withColumn("_in", F.left("record_id", F.lit(digits))), "damage")
    # A window holds one archive, about ARCHIVE_RECORDS records, whatever their ids and texts.
    damaged = primary[0].withColumn("_in", F.left("record_id", F.lit(digits))).join(found.select("_in").distinct(), "_in", "left_semi")
    before = "coalesce(sum(bytes) over (partition by _in order by record_id rows between unbounded preceding and 1 preceding), 0)"
    places = damaged.select("record_id", F.expr(before).alias("offset"))
    return found.join(places, "record_id", "left").select(
        "record_id", F.concat(F.lit("a"), "_in").alias("archive"), F.coalesce("a_page_id", "b_page_id").alias("page_id"), "offset",
        F.coalesce("a_bytes", F.lit(0)).alias("bytes"), F.coalesce("a_copies", F.lit(0)).alias("copies"),
        F.coalesce("b_copies", F.lit(0)).alias("found_copies"), F.col("a_record_digest").alias("expected"), F.col("b_record_digest").alias("found"))


def compared(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The audit of one replica's catalogue against another's."""
    a, b = leaves(primary), leaves(replica)
    digits = archive_digits(a.count())
    return audit(tree(a, digits), tree(b, digits))


def write_archives(held: DataFrame, path: str) -> None:
    """Records as ``archive=aXX`` folders of one file each, in the order of record ids."""
    digits = archive_digits(held.select("record_id").distinct().count())
    named = held.withColumn("archive", F.concat(F.lit("a"), F.left("record_id", F.lit(digits))))
    (named.repartition("archive").sortWithinPartitions("archive", "record_id")
     .select("archive", F.col("content").alias("value")).write.partitionBy("archive").option("lineSep", END).text(path))


def parsed(content: bytes) -> Iterator[tuple]:
    """(offset, length, record id, page id, url, payload, error) of the records of one file.

    What cannot be read as a record up to its end is one row with an error, and reading goes on at the next record's first line.
    """
    start, at, end = b"WARC/1.0\r\n", 0, END.encode()
    while at < len(content):
        head = content.find(end, at)
        fields, length = {}, -1
        if content.startswith(start, at) and head >= 0:
            fields = dict(line.split(": ", 1) for line in content[at:head].decode(errors="replace").split("\r\n")[1:] if ": " in line)
            size = fields.get("Content-Length", "")
            length = head + len(end) + int(size) + len(end) - at if size.isascii() and size.isdigit() else -1
        if length > 0 and content[at + length - len(end):at + length] == end and fields.get("WARC-Record-ID", "").startswith("<urn:sha256:"):
            page = fields.get("X-Page-Id", "")
            yield (at, length, fields["WARC-Record-ID"][12:-1], int(page) if page.lstrip("-").isdigit() else None,
                   fields.get("WARC-Target-URI"), content[head + len(end):at + length - len(end)].decode(errors="replace"), None)
        else:
            following = content.find(end + start, at + 1)
            length = (following + len(end) if following >= 0 else len(content)) - at
            yield at, length, None, None, None, None, "not a whole record"
        at += length


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, offset, length, record_id, page_id, url, html, digest, error) of all files; a file is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("archive", "content")
    schema = "archive string, offset bigint, length bigint, record_id string, page_id bigint, url string, html string, error string, digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "offset", "length", "record_id", "page_id", "url", "html", "error", "digest"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist()):
                rows = [(archive, *row, hashlib.sha256(content[row[0]:row[0] + row[1]]).hexdigest()) for row in parsed(content)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else
                                                 [pa.array([], t) for t in types], names)

    return files.mapInArrow(run, schema)


def decayed(payload: Column, page_id: Column, one_in: int = 97) -> Column:
    """What a failing disk makes of some payloads: every ``one_in``-th page loses its last character to a tilde."""
    text = F.coalesce(payload, F.lit(""))
    short = F.left(text, F.greatest(F.char_length(text), F.lit(1)) - 1)
    return F.when(F.pmod(page_id, F.lit(one_in)) == 5, F.concat(short, F.lit("~"))).otherwise(text)


def lost(page_id: Column, one_in: int = 89) -> Column:
    """Whether a failing disk has lost the page's record."""
    return F.coalesce(F.pmod(page_id, F.lit(one_in)) == 7, F.lit(False))


def audited(pages: DataFrame) -> DataFrame:
    """The audit of a replica in which ``decayed`` and ``lost`` have been at work."""
    replica = records(pages.filter(~lost(F.col("page_id"))), decayed(F.col("html"), F.col("page_id")))
    return compared(catalogue(records(pages)), catalogue(replica))
