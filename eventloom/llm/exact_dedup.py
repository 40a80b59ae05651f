r"""Exact dedup over a log-structured merge index of text digests, with DataFrame operations only.

* A memtable is one slice of the arriving rows (by hash of the id). Flushing writes a *run* for each: one row per digest (smallest identifier, row count),
  sorted by digest, in the shared folder, and beside it the run's *filter*: a bitmap over its digests, in slots of 4 KB, as many as its counted rows ask for.
* Merging runs probes each digest in the other runs' stored filters: rows meet the filters of their slot. A digest that none of them lets through is in its run alone and is copied as it is;
  only the others are grouped: the smallest identifier stays, counts add up.
* Compaction is tiered by size: as soon as FAN_IN runs of one tier are there, they become one of a higher tier, and their tables are deleted. So an index takes further loads (`DigestIndex.add`), and a row is
  rewritten as often as there are tiers. `save` writes the list of runs, `open` takes an index up again from it.
* A digest of more than one row is a hit. Hits receive byte verification: their whole normalised texts are
  grouped by (digest, text), so texts that merely share a digest part again. Map-side aggregation sends one row
  per task and distinct text, so a group of copies of any size costs each task one row.
* Texts are normalised once and stored. Only digests and file numbers are shuffled to find where hits lie; then the files are read in loads of at most LOAD_ROWS rows, each with a filter of the hits in it,
  and only texts that this filter lets through are shuffled. The size of a filter is bound by its load, the number of loads grows with the table, and each load reads its own files only.

Filters of runs are broadcast up to BROADCAST_BITS together and else met in a shuffle of narrow rows; they are used at every size.

Defined results: null text counts as empty, so all empty and null texts form one group (white space alone normalises to one
blank, another group). A null id is never the smallest unless the whole group has none; then keep_id is null and
kept is true for all of that group, since nothing tells its rows apart. Rows that repeat an id and its text are one document: they get equal results.
Other columns are not read, so extra or clashing ones don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import BLANKS, discard, stored, table, whole

#: Digest bits that one filter row holds: Spark's bitmap aggregate has 4,096 bytes.
ROW_BITS = 32768
#: Bits for each digest (one in sixteen others passes by chance).
DIGEST_BITS = 16
#: Run filters of up to so many bits together (8 MB) are broadcast; larger ones meet their rows in a shuffle.
BROADCAST_BITS = 1 << 26
#: Rows of a load (a file with more is a load by itself): its filter has at most 64 MB.
LOAD_ROWS = 1 << 25
#: Bits of a filter over a set of any size: beyond this number more rows pass by chance, none is lost.
SIEVE_BITS = 1 << 29
#: A group with more than this share of the rows is hot; there are at most as many hot groups.
HOT_SHARE = 1000
#: Runs of one tier that are merged; a tier's runs have FAN_IN times the rows of the tier below.
FAN_IN = 4


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(whole(text), BLANKS, " ")


def text_digest(norm: Column) -> Column:
    return F.xxhash64(norm)


def _slots_for(count: int) -> int:
    """Slots of a filter of count digests: a power of two, so that the slots of a larger filter fall on those of a smaller one."""
    return 1 << max(0, -(-count * DIGEST_BITS // ROW_BITS) - 1).bit_length()


def _slot(digest: str, slots: int) -> Column:
    return F.floor(F.pmod(F.col(digest), F.lit(slots * ROW_BITS)) / ROW_BITS).cast("int")


def _bitmaps(digests: DataFrame, slots: int, *by: str) -> DataFrame:
    """(*by, slot, bits) of digests(*by, digest)."""
    return digests.groupBy(*by, _slot("digest", slots).alias("slot")).agg(F.bitmap_construct_agg(F.pmod("digest", F.lit(ROW_BITS))).alias("bits"))


def _is_set(bits: Column, digest: Column) -> Column:
    bit = F.pmod(digest, F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.bit_get(byte, (bit % 8).cast("int")) == 1, F.lit(False))


@dataclass
class Sieve:
    """A filter of a set of digests: (slot, bits)."""

    bitmaps: DataFrame
    slots: int

    @staticmethod
    def of(digests: DataFrame, digest: str = "digest") -> Sieve:
        """digests: a stored table; its rows are counted."""
        slots = min(_slots_for(digests.count()), SIEVE_BITS // ROW_BITS)
        return Sieve(_bitmaps(digests.select(F.col(digest).alias("digest")), slots), slots)

    def split(self, rows: DataFrame, digest: str = "digest") -> tuple[DataFrame, DataFrame]:
        """(rows whose digest may be in the set, rows whose digest surely isn't)."""
        side = F.broadcast(self.bitmaps.select(F.col("slot").alias("__slot"), F.col("bits").alias("__bits")))
        probed = rows.withColumn("__slot", _slot(digest, self.slots)).join(side, "__slot", "left")
        hit = _is_set(F.col("__bits"), F.col(digest))
        return tuple(probed.where(x).drop("__slot", "__bits") for x in (hit, ~hit))


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is in gone(id_col, distinct; a stored table). Rows that the filter of gone rules out stay where they are; the others meet gone in a shuffle."""
    sieve = Sieve.of(gone.select(F.xxhash64(id_col).alias("digest")))
    maybe, sure = (part.select(*docs.columns) for part in sieve.split(docs.withColumn("__digest", F.xxhash64(id_col)), "__digest"))
    return sure.unionByName(maybe.join(gone, id_col, "left_anti").select(*docs.columns))


@dataclass
class Run:
    """A sorted run (digest, min_id, n_rows) with its number of rows, and its filter (slot, bits): both are the rows of `number` in stored tables."""

    table: DataFrame
    filters: DataFrame
    number: int
    size: int
    slots: int

    @property
    def rows(self) -> DataFrame:
        return self.table.where(F.col("run") == self.number).select("digest", "min_id", "n_rows")

    @property
    def filter(self) -> DataFrame:
        return self.filters.where(F.col("run") == self.number).select("slot", "bits")

    @property
    def tier(self) -> int:
        tier = 0
        while self.size >= FAN_IN ** (tier + 1):
            tier += 1
        return tier


def _flushed(rows: DataFrame) -> list[Run]:
    """The runs of rows(run, digest, min_id, n_rows), written with their filters."""
    kept = stored(rows.select("run", "digest", "min_id", "n_rows").sortWithinPartitions("run", "digest"), "dedup-runs")
    sizes = {r.run: r.n for r in kept.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each memtable
    slots = _slots_for(max(sizes.values(), default=0))
    filters = stored(_bitmaps(kept, slots, "run"), "dedup-filters")
    return [Run(kept, filters, k, n, slots) for k, n in sorted(sizes.items())]


def merged(runs: list[Run]) -> DataFrame:
    """All runs as one: (digest, min_id, n_rows). Digests that no other run's filter lets through are not grouped."""
    if len(runs) == 1:
        return runs[0].rows
    tagged = reduce(DataFrame.unionByName, (r.rows.withColumn("run", F.lit(k)) for k, r in enumerate(runs)))
    slots = max(r.slots for r in runs)
    spread = lambda r: F.explode(F.sequence(F.col("slot"), F.lit(slots - 1), F.lit(r.slots)))  # noqa: E731  a smaller filter serves several slots of the largest
    filters = reduce(DataFrame.unionByName, (r.filter.select(F.lit(k).alias("run"), "bits", spread(r).alias("__slot")) for k, r in enumerate(runs)))
    by_slot = filters.groupBy("__slot").agg(F.collect_list(F.struct("run", "bits")).alias("__filters"))  # one entry for each run
    if slots * ROW_BITS * len(runs) <= BROADCAST_BITS:
        by_slot = F.broadcast(by_slot)
    probed = tagged.withColumn("__slot", _slot("digest", slots)).join(by_slot, "__slot")
    elsewhere = F.exists("__filters", lambda f: (f["run"] != F.col("run")) & _is_set(f["bits"], F.col("digest")))
    alone, met = (probed.where(x).select("digest", "min_id", "n_rows") for x in (~elsewhere, elsewhere))
    return alone.unionByName(met.groupBy("digest").agg(F.min("min_id").alias("min_id"), F.sum("n_rows").alias("n_rows")))


class DigestIndex:
    """The runs of all loads so far."""

    def __init__(self) -> None:
        self.runs: list[Run] = []

    def add(self, keyed: DataFrame, memtables: int = FAN_IN) -> DigestIndex:
        """Takes a load keyed(id, digest): flushes it as `memtables` sorted runs, then compacts. Identifiers of all loads must have one type."""
        sliced = keyed.withColumn("run", F.pmod(F.xxhash64("id", "digest"), F.lit(memtables)).cast("int"))
        self.runs += _flushed(sliced.groupBy("run", "digest").agg(F.min("id").alias("min_id"), F.count(F.lit(1)).alias("n_rows")))
        return self.compact()

    def compact(self) -> DigestIndex:
        while True:
            tiers: dict[int, list[Run]] = {}
            for run in self.runs:
                tiers.setdefault(run.tier, []).append(run)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= FAN_IN), None)
            if full is None:
                return self
            one = _flushed(merged(tiers[full]).withColumn("run", F.lit(0)))
            self.runs = [r for r in self.runs if r.tier != full] + one
            live = {r.table.stored_at for r in self.runs}
            for gone in {r.table.stored_at: r for r in tiers[full] if r.table.stored_at not in live}.values():
                discard(gone.table, gone.filters)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the list of runs to path."""
        rows = [(r.table.stored_at, r.filters.stored_at, r.number, r.size, r.slots) for r in self.runs]
        spark.createDataFrame(rows, "rows string, filters string, number int, size long, slots int").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> DigestIndex:
        """The index whose list of runs save() wrote to path."""
        index, tables = DigestIndex(), {}
        for r in spark.read.parquet(path).orderBy("rows", "number").collect():  # a few runs for each tier
            for at in (r.rows, r.filters):
                if at not in tables:
                    tables[at] = spark.read.parquet(at)
                    tables[at].stored_at = at
            index.runs.append(Run(tables[r.rows], tables[r.filters], r.number, r.size, r.slots))
        return index

    def drop(self) -> None:
        """Deletes the tables of all runs."""
        for run in {r.table.stored_at: r for r in self.runs}.values():
            discard(run.table, run.filters)
        self.runs = []

    def entries(self) -> DataFrame:
        """(digest, min_id, n_rows) of all runs."""
        return merged(self.runs)

    def hits(self) -> DataFrame:
        """(digest) of more than one row, of all loads."""
        return self.entries().where("n_rows > 1").select("digest")


def _grouped(texts: DataFrame) -> DataFrame:
    return texts.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _verified(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """(digest, text_sha256, keep_id, group_size) of the texts that more than one row has. texts: a stored table (id, norm, digest, part), part by part in files of its own; hits: a stored table (digest)."""
    files = texts.groupBy("part", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each file, as the scan lists them
    parts = max(1, LOAD_ROWS // max(f.n for f in files))
    of_load: dict[int, list[str]] = {}
    for f in files:
        of_load.setdefault(f.part // parts, []).append(f.file)
    slots = _slots_for(min(hits.count(), max(f.n for f in files) * parts))
    places = texts.select(F.floor(F.col("part") / parts).cast("int").alias("load"), "digest").distinct()
    filters = stored(_bitmaps(places.join(hits, "digest"), slots, "load"), "dedup-places")
    done = []
    for load, names in sorted(of_load.items()):
        here = texts.where(F.col("_metadata.file_path").isin(names)) if len(of_load) > 1 else texts
        maybe, _ = Sieve(filters.where(F.col("load") == load), slots).split(here.select("id", "norm", "digest"))
        found = _grouped(maybe.select("digest", "norm", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
        done.append(stored(found, "dedup-load") if len(of_load) > 1 else found)
    every = done[0] if len(done) == 1 else _grouped(texts.sparkSession.read.schema(done[0].schema).parquet(*(d.stored_at for d in done)))
    verified = stored(every.where("group_size > 1").select("digest", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "dedup-classes")
    discard(filters, *(d for d in done if len(done) > 1))
    return verified


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtables: int = FAN_IN, digest=text_digest, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of docs: (id_col, keep_id, group_size, kept, text_sha256). digest: column of the normalised text -> long column.
    index: the index of docs, if it is there already (see `keyed`); else docs are one load. The result reads the tables `spent`, an attribute of it: `discard` them when it has been used."""
    norm = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).select("id", "norm", digest(F.col("norm")).alias("digest"))
    texts = stored(norm.select("*", F.sha2("norm", 256).alias("text_sha256"), F.spark_partition_id().alias("part")), "dedup-texts")
    own = DigestIndex().add(texts.select("id", "digest"), memtables) if index is None else DigestIndex()
    index = own if index is None else index
    total = texts.count()
    if not index.runs or not total:
        alone = texts.select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        alone.spent = [texts]
        return alone
    hits = stored(index.hits(), "dedup-hits")
    own.drop()
    verified = _verified(texts, hits)
    discard(hits)
    hot = verified.where(F.col("group_size") * HOT_SHARE > total).select("digest", "text_sha256", F.struct("keep_id", "group_size").alias("hot"))
    cold = verified.where(F.col("group_size") * HOT_SHARE <= total).select("digest", "text_sha256", F.struct("keep_id", "group_size").alias("cold"))
    every = texts.select("id", "digest", "text_sha256").join(F.broadcast(hot), ["digest", "text_sha256"], "left")
    every = every.withColumn("digest", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.xxhash64("id", "text_sha256", F.spark_partition_id())))  # a hot group is dealt out evenly
    found = every.join(cold, ["digest", "text_sha256"], "left").withColumn("class", F.coalesce("hot", "cold"))
    keep = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class.keep_id"))
    found = found.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("class.group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
    found.spent = [texts, verified]
    return found


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=text_digest) -> DataFrame:
    """(id, digest) of every row: what an index takes."""
    return docs.select(F.col(id_col).alias("id"), digest(normalised(text_col)).alias("digest"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""
