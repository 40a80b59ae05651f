r"""N-gram Jaccard join by MinHash banding.

Words are the runs without white space of the lower-cased text (ASCII capitals); a text's n-gram set holds its runs of five words, or all its
words where there are fewer. Two texts are linked when the Jaccard similarity of their whole sets is at least 0.8.

1. One pass in numpy makes, for each document, a 128-bit digest of its set and one hash per band; bands and rows follow
   from the threshold and the target recall (`choose_bands`). Texts with equal sets form one class, which goes on as one representative.
2. Representatives meet in a shuffle on the band hashes. Buckets of up to SMALL representatives list all their pairs. The members of larger buckets are dealt
   into blocks of bounded size (BLOCK members, BLOCK_GRAMS hashes), and each two blocks of a bucket meet in a task, which compares all pairs that share a band.
   Large buckets of one pivot (smallest id) are dealt together. A pair that several buckets hold is compared in a small one, or else in the one whose owner is smallest.
   So every pair that shares a band is compared, and no pair twice. Links of blocks are listed only by `ngram_links`: `ngram_classes` takes each member's number of links and
   a spanning forest from every two blocks, so its rows grow with the members times the blocks, not with the pairs.
3. Pairs whose set sizes allow the threshold are verified on the full sets of 64-bit n-gram hashes.
4. Links between representatives are joined to components; each document gets its class.

Defined results: null counts as empty; a text without words is like no text, and its own class. A null id gets no class and no link.
Rows that repeat an id count as copies. Extra columns aren't read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import discard, mapped, stored, table, whole
from eventloom.llm.exact_dedup import HOT_SHARE, Sieve
from eventloom.operators.graph import components
from eventloom.llm.texthash import mix, shingle_hashes, slices, word_hashes

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Most representatives of a bucket whose pairs are listed one by one, at most SMALL / 2 pairs a row; larger ones are compared in blocks.
SMALL = 24


#: What a band's row in the shuffle costs in MinHash values, and what it costs in them if all unlike pairs met.
BAND_COST, PAIR_COST = 8, 3000
MOST_ROWS = 10


def meeting(similarity: float, bands: int, rows: int) -> float:
    """Probability that a pair shares a band."""
    return 1 - (1 - similarity**rows) ** bands


@lru_cache
def choose_bands(threshold: float, recall: float) -> tuple[int, int]:
    """(bands, rows) that reach the target recall at the threshold at the least cost: of making and sending the bands, and of the pairs below the threshold that meet
    for nothing (the mean of `meeting` over all similarities below it)."""
    found = []
    for rows in range(1, MOST_ROWS + 1):
        bands = 1
        while meeting(threshold, bands, rows) < recall:
            bands += 1
        below = [meeting(threshold * (k + 0.5) / 100, bands, rows) for k in range(100)]
        found.append((bands * (rows + BAND_COST) + PAIR_COST * sum(below) / 100, bands, rows))
    return min(found)[1:]


def ngram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct n-gram hashes text by text, start of every text and of the end), slice by slice."""
    for first, data, starts in slices(texts):
        grams, at = shingle_hashes(*word_hashes(data, starts), n)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.lexsort((grams, text))
        grams, text = grams[order], text[order]
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
        grams, text = grams[fresh], text[fresh]
        yield first, grams, np.searchsorted(text, np.arange(len(at)))


def _signed(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
    for batch in batches:
        for first, grams, at in ngram_sets(batch.column(1), n):
            sizes = np.diff(at)
            full = np.flatnonzero(sizes)
            begin = at[:-1][full]
            keys = np.zeros((len(sizes), bands), np.uint64)
            low, high = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            if len(full):
                low[full] = np.add.reduceat(mix(grams), begin)
                high[full] = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
                for band in range(bands):
                    key = np.full(len(full), band + 1, np.uint64)
                    for row in range(rows):
                        seed = seeds[band * rows + row]
                        hashed = (grams ^ seed) * (seed | np.uint64(1))
                        hashed ^= hashed >> np.uint64(32)
                        hashed *= np.uint64(0xD6E8FEB86659FD93)
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashed, begin))
                    keys[full, band] = key
            listed = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(sizes)], pa.array(sizes.astype(np.int32)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), listed], ["id", "n", "low", "high", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, grams, at in ngram_sets(batch.column(1), n):
            data = [grams[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(data)], pa.array(data, pa.binary())], ["id", "grams"])


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int(np.count_nonzero(y[at] == x))
            out.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "jaccard"])


def _fits(m: Column, n: Column) -> Column:
    return F.least(m, n) >= F.lit(THRESHOLD) * F.greatest(m, n) - 1e-9


def _small_pairs(met: DataFrame, small: int) -> DataFrame:
    """All pairs (a, b) of buckets of up to `small` members."""
    near = met.where(F.col("size") <= small).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rep", "n"))).alias("all"))
    near = near.select("all", F.posexplode("all").alias("i", "x")).select("x", F.explode(F.slice("all", F.col("i") + 2, F.lit(small))).alias("y"))
    return near.where(_fits(F.col("x.n"), F.col("y.n")) & (F.col("x.rep") != F.col("y.rep"))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


#: Most members and n-gram hashes of a block, on average: a task holds two blocks at once.
BLOCK, BLOCK_GRAMS = 512, 1 << 19
#: Hashes that are compared at once, and products of the matrices that cost as much as one comparison of two sets.
WIDTH, PRODUCTS = 4096, 200_000
#: Owners of small buckets, which are the first of all, and of none.
FIRST, NONE = -(1 << 63), (1 << 63) - 1


def _shared(one: list[np.ndarray], other: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets in `one` with those in `other`, where wanted."""
    both = np.zeros(wanted.shape, np.int64)
    if not wanted.any():
        return both
    rows, cols = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    sides = [(np.concatenate([sets[k] for k in at]), np.repeat(np.arange(len(at)), [len(sets[k]) for k in at])) for sets, at in ((one, rows), (other, cols))]
    known = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    if np.count_nonzero(wanted) * PRODUCTS < len(rows) * len(cols) * len(known):
        for k, m in zip(*np.nonzero(wanted), strict=True):
            x, y = one[k], other[m]
            both[k, m] = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
        return both
    placed = []
    for grams, owner in sides:
        at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
        there = known[at] == grams if len(known) else np.zeros(len(grams), bool)
        order = np.argsort(at[there], kind="stable")
        placed.append((at[there][order], owner[there][order]))
    met = np.zeros((len(rows), len(cols)), np.float32)
    for begin in range(0, len(known), WIDTH):
        held = []
        for (at, owner), size in zip(placed, met.shape, strict=True):
            first, last = np.searchsorted(at, (begin, begin + WIDTH))
            part = np.zeros((size, min(WIDTH, len(known) - begin)), np.float32)
            part[owner[first:last], at[first:last] - begin] = 1
            held.append(part)
        met += held[0] @ held[1].T
    both[np.ix_(rows, cols)] = np.rint(met).astype(np.int64)
    return both


def _block_links(t: pa.Table, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, row numbers, jaccard) of the links between the two blocks in t, or within one block."""
    column = lambda name: t.column(name).combine_chunks() if t.column(name).num_chunks != 1 else t.column(name).chunk(0)
    side, n, owner = np.asarray(column("side")), np.asarray(column("n")).astype(np.int64), int(t.column("owner")[0].as_py())
    listed = column("sig")
    row, sig = np.repeat(np.arange(len(n)), np.asarray(pc.list_value_length(listed))), listed.flatten()
    keys, owners = np.zeros((len(n), bands), np.int64), np.full((len(n), bands), NONE, np.int64)
    band = np.asarray(sig.field("band"))
    keys[row, band], owners[row, band] = np.asarray(sig.field("key")), np.asarray(sig.field("owner"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in column("grams")]
    x, y = np.flatnonzero(side <= 0), np.flatnonzero(np.abs(side) == 1)
    least = np.full((len(x), len(y)), NONE, np.int64)
    for k in range(bands):
        same = keys[x, k][:, None] == keys[y, k][None, :]
        least = np.where(same, np.minimum(least, owners[x, k][:, None]), least)
    wanted = least == owner
    wanted &= 5 * np.minimum(n[x][:, None], n[y][None, :]) >= 4 * np.maximum(n[x][:, None], n[y][None, :])
    if len(side) and side[0] == -1:
        wanted = np.triu(wanted, 1)
    both = _shared([sets[k] for k in x], [sets[k] for k in y], wanted)
    jaccard = both / (n[x][:, None] + n[y][None, :] - both)
    found = np.nonzero(wanted & (jaccard >= THRESHOLD))
    return x[found[0]], y[found[1]], jaccard[found]


def _forest(size: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Some of the links (a, b) between `size` rows that join all that the links join, without circles."""
    linked = np.zeros((size, size), bool)
    linked[a, b] = linked[b, a] = True
    fresh, out = linked.any(axis=1), []
    for start in range(size):
        queue = [start] if fresh[start] else []
        fresh[start] = False
        while queue:
            k = queue.pop()
            new = np.flatnonzero(linked[k] & fresh)
            fresh[new] = False
            out += [(k, int(m)) for m in new]
            queue += new.tolist()
    return out


def _listed(t: pa.Table, bands: int) -> pa.Table:
    a, b, jaccard = _block_links(t, bands)
    rep = t.column("rep")
    return pa.table({"a": rep.take(pa.array(a)), "b": rep.take(pa.array(b)), "jaccard": pa.array(jaccard, pa.float64())})


def _summed(t: pa.Table, bands: int) -> pa.Table:
    """(a, b, null) for the links of a spanning forest, (rep, null, links) for each row that has links."""
    a, b, _ = _block_links(t, bands)
    rep, degree = t.column("rep"), np.bincount(np.concatenate((a, b)), minlength=t.num_rows)
    tree, some = np.array(_forest(t.num_rows, a, b), np.int64).reshape(-1, 2), np.flatnonzero(degree)
    one = rep.take(pa.array(np.concatenate((tree[:, 0], some)), pa.int64()))
    other = rep.take(pa.array([*tree[:, 1].tolist(), *[None] * len(some)], pa.int64()))
    return pa.table({"a": one, "b": other, "links": pa.array([*[None] * len(tree), *degree[some].tolist()], pa.int64())})


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, recall: float = RECALL, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(links(a, b, jaccard) between representatives a < b, members(id, rep, copies)): the whole join, copies not expanded into pairs."""
    links, blocks, members, spent = _joined(docs, id_col, text_col, words, recall, small)
    if blocks is None:
        discard(*spent)
    else:
        bands, kind = choose_bands(THRESHOLD, recall)[0], links.schema["a"].dataType.simpleString()
        more = blocks.applyInArrow(lambda t: _listed(t, bands), f"a {kind}, b {kind}, jaccard double")
        links = links.union(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard"))
    return links, members


def _joined(docs: DataFrame, id_col: str, text_col: str, words: int, recall: float, small: int) -> tuple[DataFrame, GroupedData | None, DataFrame, list[DataFrame]]:
    """(links(a, b, jaccard) of small buckets, members of large ones grouped by two blocks each or None, members(id, rep, copies), tables that only the blocks read)."""
    bands, rows = choose_bands(THRESHOLD, recall)
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    signed = stored(mapped(texts, lambda it: _signed(it, words, bands, rows), f"id {kind}, n int, low long, high long, bands array<long>"), "ngram-signed")

    named = signed.where("id IS NOT NULL")
    full = named.where("n > 0")
    classes = stored(full.groupBy("low", "high").agg(F.min(F.struct("id", "n", "bands")).alias("first"), F.count(F.lit(1)).alias("copies")), "ngram-classes")
    total = named.count()
    ids = classes.select("low", "high", F.struct(F.col("first.id").alias("rep"), "copies").alias("found"))
    hot = ids.where(F.col("found.copies") * HOT_SHARE > total).withColumnRenamed("found", "hot")  # at most HOT_SHARE rows
    cold = ids.where(F.col("found.copies") * HOT_SHARE <= total).withColumnRenamed("found", "cold")
    every = named.select("id", "n", "low", "high").join(F.broadcast(hot), ["low", "high"], "left")
    every = every.withColumn("low", F.when((F.col("n") > 0) & F.col("hot").isNull(), F.col("low")).otherwise(F.xxhash64("id")))
    every = every.join(cold, ["low", "high"], "left").withColumn("found", F.coalesce("hot", "cold"))
    members = every.select("id", F.coalesce("found.rep", "id").alias("rep"), F.coalesce("found.copies", F.lit(1)).cast("long").alias("copies"))

    met = classes.select(F.posexplode("first.bands").alias("band", "key"), F.col("first.id").alias("rep"), F.col("first.n").alias("n"))
    counted = stored(met.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")).where("size > 1"), "ngram-buckets")
    met = stored(met.join(counted, "key"), "ngram-met")
    discard(counted)
    pairs = stored(_small_pairs(met, small).distinct(), "ngram-pairs")
    large = met.withColumn("owner", F.when(F.col("size") <= small, F.lit(FIRST)).otherwise(F.greatest(F.xxhash64("pivot"), F.lit(FIRST + 1))))
    held = large.groupBy("rep", "n").agg(F.max("owner").alias("last"), F.collect_list(F.struct("band", "key", "owner")).alias("sig")).where(F.col("last") != FIRST)
    placed = stored(held.select("rep", "n", "sig", F.explode(F.array_distinct(F.filter(F.col("sig.owner"), lambda o: o != FIRST))).alias("owner")), "ngram-placed")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(placed.select(F.col("rep").alias("id"))).distinct()
    sets = _sets_of(texts, wanted, words)
    links = _verified(pairs, sets)
    discard(met, pairs)
    if placed.limit(1).count() == 0:
        return links, None, members, [placed, sets]
    count = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int")
    sizes = stored(placed.groupBy("owner").agg(count.alias("blocks")), "ngram-blocks")
    dealt = placed.join(sizes, "owner")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int")).join(sets.withColumnRenamed("id", "rep"), "rep")
    spread = dealt.select("owner", "rep", "n", "sig", "grams", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1)  # -1: one block with itself
    spread = spread.select("owner", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"), "rep", "n", "sig", "grams")
    return links, spread.groupBy("owner", "i", "j"), members, [placed, sizes, sets]


def _sets_of(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, grams) of the texts in wanted(id), and of others that its filter lets through by chance."""
    asked = stored(wanted.select(F.xxhash64("id").alias("digest")), "ngram-wanted")
    kept = Sieve.of(asked).split(texts.withColumn("digest", F.xxhash64("id")))[0].select("id", "text")
    kind = texts.schema["id"].dataType.simpleString()
    sets = stored(mapped(kept, lambda it: _sets(it, words), f"id {kind}, grams binary").dropDuplicates(["id"]), "ngram-sets")
    discard(asked)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) whose whole sets are similar enough: (a, b, jaccard)."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    return stored(mapped(both.select("a", "b", "x", "y"), _jaccard, f"a {kind}, b {kind}, jaccard double").where(F.col("jaccard") >= THRESHOLD), "ngram-verified")


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, recall: float = RECALL, small: int = SMALL) -> DataFrame:
    """One row per document: (id_col, class_id, n_links, n_copies). class_id: smallest id of the documents that links and copies join;
    n_links: links of its text to different texts, all of them verified; n_copies: rows with its n-gram set, itself included."""
    links, blocks, members, spent = _joined(docs, id_col, text_col, words, recall, small)
    joins = links.select("a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    if blocks is not None:
        bands, kind = choose_bands(THRESHOLD, recall)[0], links.schema["a"].dataType.simpleString()
        sums = stored(blocks.applyInArrow(lambda t: _summed(t, bands), f"a {kind}, b {kind}, links long"), "ngram-sums")  # cuts the lineage: what the blocks read is needed no more
        joins = joins.union(sums.where("links IS NULL").select("a", "b"))
        degree = degree.union(sums.where("links IS NOT NULL").select("a", "links"))
    discard(*spent)
    degree = degree.groupBy("rep").agg(F.sum("n").alias("n_links"))
    classes = degree.join(components(joins).withColumnRenamed("id", "rep"), "rep")
    found = members.join(classes, "rep", "left")
    named = found.select(F.col("id").alias(id_col), F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("copies").alias("n_copies"))
    nameless = docs.where(F.col(id_col).isNull()).select(id_col, F.col(id_col).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return named.union(nameless)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents"))
