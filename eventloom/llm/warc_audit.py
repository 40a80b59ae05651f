"""Merkle fixity audit of WARC records.

A page becomes a WARC response record; records lie in files of at most RECORDS slots, at running offsets in slot order (`laid_out`). A replica is a table of
slots: length and digest of the bytes that it has there, and their offset. For each replica the record digests (SHA-256 over the record's bytes) and ordered offset ranges are hashed into trees: a leaf is digest, offset and length of one slot, a node an offset range
(from file and offset to file and offset) with the hash of its up to FANOUT children's ranges and hashes in order; a file is one node. Trees of two replicas are compared from the roots down; only children of mismatching nodes are
looked at (a join on the node number), so the work below the roots is in proportion to the damage. Every level is a table in the shared folder.

A located slot is `truncated` (fewer bytes), `corrupt` (other bytes), `missing` or `extra` (in one replica only), or `moved` (same bytes at another offset).

Defined results: null urls and texts count as empty; null page ids have no slot, and are left out of the tree (`unslotted` lists them); rows that repeat a page id
are one slot whose digest covers all their records (`slotted`). Ids may be sparse. Two empty replicas match. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import stored, table, whole

RECORDS, FANOUT = 1024, 32


def record(url: Column, body: Column) -> Column:
    """The bytes (as text) of a WARC response record."""
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def digested(records: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """(id_col, length, digest) of each record: what the trees need, so no record's bytes are shuffled."""
    return records.select(F.col(id_col), F.octet_length(record_col).cast("long").alias("length"), F.sha2(F.col(record_col), 256).alias("digest"))


def slotted(records: DataFrame, id_col: str = "page_id", sides: tuple[str, ...] = ("",)) -> DataFrame:
    """(id_col, length, digest): one slot for each id that isn't null. Records that repeat an id are one slot: its length is their sum, and its digest covers the number of records and the
    sums of their digests' quarters, so that it needs no order and a hot id no list. sides: prefixes of further pairs of such columns."""
    several = F.count(F.lit(1)) > 1
    out = []
    for side in sides:
        quarters = [F.sum(F.conv(F.substring(f"{side}digest", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
        out += [F.sum(f"{side}length").alias(f"{side}length"), F.when(several, F.sha2(F.concat_ws(":", F.count(F.lit(1)), *quarters), 256)).otherwise(F.max(f"{side}digest")).alias(f"{side}digest")]
    return records.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*out)


def laid_out(slots: DataFrame, id_col: str = "page_id", rows: int = RECORDS) -> DataFrame:
    """slots(id_col, length, digest, ...), one an id, with their offset in their file (at most `rows` slots): the manifest of an archive."""
    w = Window.partitionBy(F.floor(F.col(id_col) / rows)).orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0)
    return slots.where(F.col(id_col).isNotNull()).withColumn("offset", F.sum("length").over(w) - F.col("length"))


def leaves(slots: DataFrame, id_col: str = "page_id", rows: int = RECORDS) -> DataFrame:
    """(node, file, offset, length, digest, first, last, hash) for each slot; node is the id. first and last are the ends of its range: (file, offset)."""
    own = slots.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), "offset", "length", "digest").withColumn("file", F.floor(F.col("node") / rows).cast("long"))
    ends = own.withColumn("first", F.struct("file", "offset")).withColumn("last", F.struct("file", (F.col("offset") + F.col("length")).alias("offset")))
    return ends.withColumn("hash", F.sha2(F.concat_ws(":", "digest", "offset", "length"), 256))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level up: (node, first, last, hash). A node stands for the offset range from its first child's start to its last child's end; its hash covers the numbers, ranges and hashes of
    its children (at most `fanout`) in order of their numbers. Since RECORDS is a power of FANOUT, no range below a whole file crosses files."""
    kids = F.array_sort(F.collect_list(F.struct("node", "first", "last", "hash")))
    up = level.select(F.floor(F.col("node") / fanout).cast("long").alias("up"), "node", "first", "last", "hash").groupBy("up").agg(kids.alias("kids"), F.min("first").alias("first"), F.max("last").alias("last"))
    said = lambda k: F.concat_ws(":", k["node"], k["first"]["file"], k["first"]["offset"], k["last"]["file"], k["last"]["offset"], k["hash"])
    return up.select(F.col("up").alias("node"), "first", "last", F.sha2(F.array_join(F.transform("kids", said), "/"), 256).alias("hash"))


def tree(leaf: DataFrame, height: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves up; the last has the root."""
    levels = [leaf]
    for k in range(height):
        levels.append(stored(parents(levels[-1], fanout), f"merkle-{k + 1}"))
    return levels


def height_for(leaf: DataFrame, other: DataFrame, fanout: int = FANOUT) -> int:
    """Levels above the leaves until every slot of both replicas has one ancestor (negative ids end at two: -1 and 0)."""
    span = leaf.select("node").union(other.select("node")).agg(F.coalesce(F.max(F.abs("node")), F.lit(0))).first()[0]
    height = 1
    while fanout**height <= span:
        height += 1
    return height


def audit(left: DataFrame, right: DataFrame, id_col: str = "page_id", rows: int = RECORDS, fanout: int = FANOUT) -> DataFrame:
    """Differences of two replicas (id_col, length, digest, offset): (id_col, warc_file, status, offsets, lengths and digests on both sides)."""
    a, b = (stored(leaves(x, id_col, rows), "merkle-0") for x in (left, right))
    height = height_for(a, b, fanout)
    mine, theirs = tree(a, height, fanout), tree(b, height, fanout)
    differ = lambda x, y: x.select("node", F.col("hash").alias("hash_a")).join(y.select("node", F.col("hash").alias("hash_b")), "node", "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("node")
    open_nodes = stored(differ(mine[height], theirs[height]), "merkle-open")
    for k in range(height - 1, 0, -1):
        below = [x[k].withColumn("up", F.floor(F.col("node") / fanout).cast("long")).join(open_nodes.withColumnRenamed("node", "up"), "up", "left_semi") for x in (mine, theirs)]
        open_nodes = stored(differ(*below), "merkle-open")
    cols = ("file", "offset", "length", "digest", "hash")
    kids = [x[0].withColumn("up", F.floor(F.col("node") / fanout).cast("long")).join(open_nodes.withColumnRenamed("node", "up"), "up", "left_semi").select("node", *(F.col(c).alias(f"{c}_{s}") for c in cols)) for x, s in ((mine, "a"), (theirs, "b"))]
    met = kids[0].join(kids[1], "node", "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").when(F.col("length_b") < F.col("length_a"), "truncated").when(F.col("digest_a") != F.col("digest_b"), "corrupt").otherwise("moved")
    return met.select(F.col("node").alias(id_col), F.coalesce("file_a", "file_b").alias("warc_file"), status.alias("status"), F.col("offset_a").alias("offset"), F.col("offset_b").alias("found_offset"), F.col("length_a").alias("length"), F.col("length_b").alias("found_length"), F.col("digest_a").alias("sha256"), F.col("digest_b").alias("found_sha256"))


def unslotted(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    return records.where(F.col(id_col).isNull())


def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the archive of all pages against a replica that Spark derives from it, with damage planted by the SHA-256 of the id: four records in 256 have a byte
    changed, one lacks its last byte, one is gone, one lies a byte further, and one is in the replica alone."""
    pages = table(spark, sf_dir, "pages").select("page_id", record(whole("url"), whole("html")).alias("record"))
    code = F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 2)
    hurt = F.when(code.isin("00", "01", "02", "03"), F.concat(F.lit("w"), F.substring("record", 2, 1 << 30))).when(code == "a0", F.substring(F.col("record"), F.lit(1), F.char_length("record") - 1)).otherwise(F.col("record"))
    both = pages.withColumn("hurt", hurt).select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), F.octet_length("hurt").cast("long").alias("found_length"), F.sha2("hurt", 256).alias("found_digest"))
    every = stored(laid_out(slotted(both, sides=("", "found_"))), "warc-manifest")
    replica = every.where(code != "b0").select("page_id", F.col("found_length").alias("length"), F.col("found_digest").alias("digest"), (F.col("offset") + (code == "c0").cast("int")).alias("offset"))
    return audit(every.where(code != "d0").select("page_id", "length", "digest", "offset"), replica)


OP3_SQL = """
WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record, left(sha256(CAST(page_id AS VARCHAR)), 2) AS code FROM pages),
o AS (SELECT *, page_id // 1024 AS warc_file, strlen(record)::BIGINT AS length, (sum(strlen(record)) OVER (PARTITION BY page_id // 1024 ORDER BY page_id) - strlen(record))::BIGINT AS "offset" FROM r),
h AS (SELECT *, CASE WHEN code IN ('00', '01', '02', '03') THEN 'w' || substr(record, 2) WHEN code = 'a0' THEN left(record, length(record) - 1) WHEN code <> 'b0' THEN record END AS found, code <> 'd0' AS kept FROM o)
SELECT page_id, warc_file, CASE WHEN found IS NULL THEN 'missing' WHEN NOT kept THEN 'extra' WHEN code = 'a0' THEN 'truncated' WHEN code = 'c0' THEN 'moved' ELSE 'corrupt' END AS status, CASE WHEN kept THEN "offset" END AS "offset", CASE WHEN found IS NOT NULL THEN "offset" + CASE WHEN code = 'c0' THEN 1 ELSE 0 END END AS found_offset,
  CASE WHEN kept THEN length END AS length, strlen(found)::BIGINT AS found_length, CASE WHEN kept THEN sha256(record) END AS sha256, sha256(found) AS found_sha256 FROM h WHERE found IS NULL OR found <> record OR code IN ('c0', 'd0')
"""
