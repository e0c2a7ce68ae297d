r"""WARC archives: written with revisit records, read back by boundary-chain verification.

Writing.  One record per page; of pages with equal payloads the one with the smallest id
holds the payload and the others refer to it.  Spark's text writer makes the files: a row
is a record, the line separator is the record terminator.

Reading.  A record's first line after the end of the line before it, ``\nWARC/1.1\r\n``, is
the separator of a text scan, so every task emits the places in its part of a file that look
like a record's start, true or not.  No header holds that separator (it has no line that is
``WARC/1.1`` alone), and no false place overlaps a true one (a record ends with two line
breaks), so every true start is a place.  Lengths give each place its offset, its header the
offset of its successor.

Pointer jumping then follows the chain from offset 0 of every file.  Within a part of a file
(``spark.sql.files.maxPartitionBytes`` of it at most) all pointers double until they leave
the part: one grouped pass, whose rows are places without payloads.  Files of several parts
(uncompressed ones) go on with one pointer for each place over parts, by joins, in
log2(parts) rounds.  Entered at the offset where the chain arrives, each part then marks what
is reachable in it.  Places that are not reached are text inside payloads; they are put back
where they belong.

Defined results
    * null html: an empty payload; payloads under ``min_bytes`` are never revisited;
    * pages that repeat the smallest id of a payload are all responses; pages without an id
      are revisits if any page with an id has their payload;
    * line breaks in an url are written as %0D and %0A;
    * a record whose chain breaks (a torn or truncated file) and all after it in its file are
      not returned; ``intact`` is false where a payload's digest is not the claimed one;
    * extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.llm.storage import drop, new_path, stash

MAGIC = "WARC/1.1\r\n"
SEPARATOR = "\n" + MAGIC
END = "\r\n\r\n"
#: What a header ends with where its last line break opens a separator: its payload begins with MAGIC.
CLIPPED_END = END.removesuffix("\n")

#: Records of one archive file at most.
FILE_RECORDS = 4096

# The alphabet of base32 (RFC 4648), and the profile of revisit records (WARC 1.1).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: its 160 bits as 12, 12 and 8 digits to the base 32, spelled in the alphabet."""

    def spelled(digest: Column) -> Column:
        digits = (F.lpad(F.conv(F.substring(digest, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10)))
        return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)

    # The digest is bound once; as a plain expression it would be worked out for each of its parts.
    return F.get(F.transform(F.array(F.sha1(payload)), spelled), F.lit(0))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with payload, payload_bytes, payload_digest, record_type and refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    key = ["payload_digest", "payload_bytes"]
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(*key).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    out = rows.join(first.where("n > 1").drop("n"), key, "left")
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    return out.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).otherwise("").alias("payload"), *key[::-1],
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip", date: str = "1970-01-01T00:00:00Z") -> None:
    """``date`` is the WARC-Date of all records: the same input gives the same files."""
    rows = records(pages, min_bytes)
    clean = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", urn("page_id")),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", clean),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("refers_to").isNotNull(), F.concat(field("WARC-Refers-To", urn("refers_to")), field("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.octet_length("payload").cast("string")),
        F.lit("\r\n"),
        F.col("payload"),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Text between separators, with its place: file, part of the file, order within it."""
    return spark.read.option("lineSep", SEPARATOR).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))


PLACES_SCHEMA = "file string, part long, row long, at long, successor long, onward long"
REACHED_SCHEMA = "file string, part long, row long, at long, verified boolean, owner long"


def _jumps(offset: np.ndarray, successor: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers between places of a part: the place of each one's successor, or itself where that is none."""
    spot = np.searchsorted(offset, successor)
    spot = np.minimum(spot, len(offset) - 1)
    inside = live & (offset[spot] == successor) & live[spot]
    return np.where(inside, spot, np.arange(len(offset))), inside


def _follow(table: pa.Table) -> pa.Table:
    """Where each place's chain leaves its part, by pointer doubling."""
    table = table.sort_by("row")
    offset, live = table["at"].to_numpy(), table["live"].to_numpy(zero_copy_only=False)
    successor = table["successor"].fill_null(-1).to_numpy()
    jump, _ = _jumps(offset, successor, live)
    while (jump[jump] != jump).any():
        jump = jump[jump]
    onward = successor[jump]
    return pa.table({
        "file": table["file"], "part": table["part"], "row": table["row"], "at": table["at"],
        "successor": pa.array(successor, mask=successor < 0), "onward": pa.array(onward, mask=~live | (onward < 0)),
    })


def _mark(table: pa.Table) -> pa.Table:
    """The places of a part on the chain that enters it, and for each place the verified one before it."""
    table = table.sort_by("row")
    offset, live = table["at"].to_numpy(), table["live"].to_numpy(zero_copy_only=False)
    jump, _ = _jumps(offset, table["successor"].fill_null(-1).to_numpy(), live)
    entry = table["entry"][0].as_py()
    reached = live & (offset == (-1 if entry is None else entry))
    while True:  # pointers double, and all that the reached ones point at is reached
        grown = reached.copy()
        grown[jump[reached]] = True
        if (grown == reached).all() and (jump[jump] == jump).all():
            break
        reached, jump = grown, jump[jump]
    last = np.maximum.accumulate(np.where(reached, np.arange(len(offset)), -1))
    owner = pa.array(offset[np.maximum(last, 0)], mask=last < 0)
    return pa.table({"file": table["file"], "part": table["part"], "row": table["row"], "at": table["at"], "verified": pa.array(reached), "owner": owner})


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place that looks like a record's start: file, part, row, offset (``at``), successor, header fields, payload digest.

    ``live`` is false for a file's first text where that is no record.
    """
    # The first text of a file begins with its own first line; all others follow a separator.
    # A payload that begins with the separator's end takes the last break of its header with it.
    clipped = (F.instr("value", END) == 0) & F.endswith("value", F.lit(CLIPPED_END))
    header = F.when(clipped, F.expr(f"left(value, char_length(value) - {len(CLIPPED_END)})")).otherwise(F.substring_index("value", END, 1))
    name = lambda n, pattern: F.regexp_extract("header", rf"(?i)(?:^|\r\n){n}:[ \t]*{pattern}", 1)
    rows = _scan(spark, path).withColumn("header", header).withColumn("bytes", F.octet_length("value").cast("long"))
    rows = rows.withColumn("body_at", F.octet_length("header").cast("long") + len(END)).withColumn("length", name("Content-Length", r"([0-9]{1,18})").try_cast("long"))
    # Within a file a text ends before the separator's line break, which is the last of its terminator.
    whole = F.col("bytes").between(F.col("body_at") + F.col("length") + len(END) - 1, F.col("body_at") + F.col("length") + len(END))
    body = F.substring(F.col("value").cast("binary"), F.col("body_at").cast("int") + 1, F.col("length").cast("int"))
    rows = rows.select(
        "file", "part", "row", "bytes", "body_at", "length", F.startswith("value", F.lit(MAGIC)).alias("first_line"),
        name("WARC-Type", r"([a-z]+)").alias("record_type"),
        name("WARC-Record-ID", r"<urn:page:(-?[0-9]*)>").try_cast("long").alias("page_id"),
        name("WARC-Refers-To", r"<urn:page:(-?[0-9]*)>").try_cast("long").alias("refers_to"),
        name("WARC-Payload-Digest", r"sha1:([A-Z2-7]+)").alias("claimed_digest"),
        name("X-Payload-Length", r"([0-9]{1,18})").try_cast("long").alias("claimed_bytes"),
        F.when(whole, base32_sha1(body)).alias("digest"),
    )
    rows = stash(rows, "candidates")
    span = F.col("bytes") + len(SEPARATOR)
    parts = rows.groupBy("file", "part").agg(F.sum(span).alias("span"))
    before = parts.select("file", "part", F.coalesce(F.sum("span").over(W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum(span).over(W.partitionBy("file", "part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("inside", inside).join(before, ["file", "part"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")
    rows = rows.withColumn("at", F.when(F.col("start") == 0, 0).otherwise(F.col("start") - len(MAGIC)))
    rows = rows.withColumn("live", (F.col("start") > 0) | F.col("first_line")).drop("first_line")
    return rows.withColumn("successor", F.col("start") + F.col("body_at") + F.col("length") + len(END))


def _entries(places: DataFrame) -> DataFrame:
    """(file, part, entry): where the chain from offset 0 enters each part that it reaches.

    Over places that stand for parts: a pointer leads to where its chain leaves the part.
    """
    jumps = stash(places.select("file", "part", "at", F.col("onward").alias("jump")), "jumps")
    reached = stash(jumps.where("at = 0").select("file", "part", "at"), "reached")
    # Only a pointer to a place of another part leads on; files of one part are done at once.
    far = jumps.groupBy("file").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("file")
    if far.isEmpty():
        drop(jumps)
        return reached.withColumnRenamed("at", "entry")
    wide = stash(jumps.join(far, "file", "left_semi"), "jumps")
    drop(jumps)
    jumps, count = wide, reached.count()
    while True:
        to = reached.join(jumps, ["file", "part", "at"]).select("file", F.col("jump").alias("at"))
        grown = stash(reached.unionByName(to.join(jumps, ["file", "at"]).select("file", "part", "at")).distinct(), "reached")
        now = grown.count()
        drop(reached)
        reached = grown
        if now == count:
            drop(jumps)
            return reached.withColumnRenamed("at", "entry")
        count = now
        second = jumps.select("file", F.col("at").alias("jump"), F.col("jump").alias("next"))
        doubled = stash(jumps.join(second, ["file", "jump"], "left").select("file", "part", "at", F.col("next").alias("jump")), "jumps")
        drop(jumps)
        jumps = doubled


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Verified records: file, offset, page_id, record_type, refers_to, payload_bytes, payload_digest, intact.

    The digest of a response is that of the payload as read; a revisit has only the claimed one.
    """
    found = stash(candidates(spark, path), "places")
    links = found.select("file", "part", "row", "at", "live", "successor")
    entries = _entries(links.groupBy("file", "part").applyInArrow(_follow, PLACES_SCHEMA))
    marked = stash(links.join(entries, ["file", "part"], "left").groupBy("file", "part").applyInArrow(_mark, REACHED_SCHEMA), "marked")
    # Places before a part's first verified one belong to the last verified one of an earlier part.
    parts = marked.groupBy("file", "part").agg(F.max("owner").alias("last"))
    earlier = parts.select("file", "part", F.last("last", ignorenulls=True).over(W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))
    heads = found.join(marked.where("verified").select("file", "part", "row"), ["file", "part", "row"], "left_semi")
    # Records whose payload holds a separator are read again and joined from their pieces.
    torn = heads.where("digest IS NULL").select("file", F.col("at").alias("owner"))
    if torn.isEmpty():
        heads = heads.withColumn("raw", F.lit(None).cast("binary"))
    else:
        owned = marked.join(earlier, ["file", "part"], "left").select("file", "part", "row", "at", F.coalesce("owner", "earlier").alias("owner"))
        pieces = owned.join(torn, ["file", "owner"], "left_semi")
        value = _scan(spark, path).join(pieces, ["file", "part", "row"])
        whole = value.groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: p["value"]), SEPARATOR).alias("text"))
        heads = heads.join(whole.select("file", F.col("owner").alias("at"), F.col("text").cast("binary").alias("raw")), ["file", "at"], "left")
    body = F.substring(F.col("raw"), F.col("body_at").cast("int") + 1, F.col("length").cast("int"))
    digest = F.coalesce("digest", F.when(F.col("raw").isNotNull(), base32_sha1(body)))
    revisit = F.col("record_type") == "revisit"
    return heads.select(
        "file", F.col("at").alias("offset"), "page_id", "record_type", "refers_to",
        F.when(revisit, F.col("claimed_bytes")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("claimed_digest")).otherwise(digest).alias("payload_digest"),
        (revisit | F.coalesce(digest == F.col("claimed_digest"), F.lit(False))).alias("intact"),
    )


def op2_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Forty hex digits are eight groups of five, and each of those is four letters of five bits.
_BITS = "(instr('0123456789abcdef', h[5 * g + 1]) - 1) * 65536 + (instr('0123456789abcdef', h[5 * g + 2]) - 1) * 4096 + (instr('0123456789abcdef', h[5 * g + 3]) - 1) * 256 + (instr('0123456789abcdef', h[5 * g + 4]) - 1) * 16 + instr('0123456789abcdef', h[5 * g + 5]) - 1"

ORACLE_SQL = {
    "op2_warc_round_trip": f"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([32768, 1024, 32, 1], lambda s: '{BASE32}'[CAST((({_BITS}) // s) % 32 AS INT) + 1]), '')), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f""",
}
