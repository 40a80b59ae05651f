r"""Document fingerprints by winnowing over characters (code points), with DataFrame operations only.

* k-grams: every run of K code points has a 64-bit cyclic polynomial hash: the exclusive or of its characters' hashes, each turned by its distance from the
  run's end. It rolls by doubling: neighbouring runs share the hashes of their parts, so a run costs a few steps whatever K is.
* Windows: of every W consecutive runs the smallest hash is chosen, the rightmost one of ties, and kept once with its position (of its first code point, from 0).
  So two texts that share K + W - 1 code points share a kept run. A text of fewer runs has one window of all; a text of fewer than K code points is one run.
* A kept run is identified by the xxhash64 of its characters, all 64 bits.

How it runs: a text is cut into pieces of PIECE window starts plus the overlap that their windows need, a row each. A row's characters, runs and windows are
*columns* of plain arithmetic (a few hundred each), which Spark compiles; lambdas over arrays of single characters are fifty times slower. So memory is
bounded by the piece, whatever the text's length. Within a piece, a run's hash (its lowest 64 - PLACE_BITS bits) and place lie in one long, `hash << PLACE_BITS | (PLACES - 1 - place)`: the
smallest long is the smallest hash at its rightmost place.

Defined results: null counts as empty; an empty text has the empty fingerprint; two empty fingerprints are alike (1.0), an
empty and another one not (0.0). Equal texts have equal fingerprints. Every row has one result in the edited texts: null ids come
after all others, and rows that repeat an id follow each other by the hashes of their texts. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from eventloom.llm.common import stored, table, whole
from eventloom.llm.exact_dedup import Sieve

#: Code points of a run (a power of two), runs of a window (a multiple of eight). Two texts that share 63 code points share a kept run.
K, W = 16, 48
PIECE, PLACE_BITS = 128, 8
PLACES = 1 << PLACE_BITS
OVERLAP = K + W - 2
NO_RUN = (1 << 63) - 1


def _turned(x: str, by: int) -> str:
    return f"shiftleft({x}, {by}) | shiftrightunsigned({x}, {64 - by})" if by else x


def _level(df: DataFrame, made: list[str], keep: list[str]) -> DataFrame:
    """Columns v0, v1, ... in place of those before; each level is a projection of its own, so that none of its values is computed twice."""
    return df.selectExpr(*keep, *(f"{x} AS v{i}" for i, x in enumerate(made)))


def window_minima(pieces: DataFrame) -> DataFrame:
    """pieces(..., piece, n_windows) with the column `kept`: the distinct packed minima of the windows that start in the piece's first n_windows places, in order.

    No column is null (compiled code is then shortest): a place without a run has the largest long, and every window has a run."""
    keep = list(pieces.columns)
    n = PIECE + W + K - 2
    df = _level(pieces, [f"xxhash64(get(split(piece, ''), {i}))" for i in range(n)], keep)
    by = 1
    while by < K // 2:  # runs of `by` code points to runs of 2 * by
        n -= by
        df = _level(df, [f"({_turned(f'v{i}', by)}) ^ v{i + by}" for i in range(n)], keep)
        by *= 2
    n -= by
    packed = [f"if({i + K} <= char_length(piece), shiftleft(({_turned(f'v{i}', by)}) ^ v{i + by}, {PLACE_BITS}) | {PLACES - 1 - i}L, {NO_RUN}L)" for i in range(n)]
    packed[0] = packed[0].replace(f"{NO_RUN}L", f"if(char_length(piece) > 0, shiftleft(xxhash64(piece), {PLACE_BITS}) | {PLACES - 1}L, {NO_RUN}L)")
    df = _level(df, packed, keep)
    df = _level(df, [f"least({', '.join(f'v{i + d}' for d in range(8))})" for i in range(n - 7)], keep)
    df = _level(df, [f"least({', '.join(f'v{i + 8 * d}' for d in range(W // 8))})" for i in range(PIECE)], keep)
    return df.select(*keep, F.array_distinct(F.slice(F.array(*(f"v{i}" for i in range(PIECE))), F.lit(1), F.col("n_windows"))).alias("kept"))


def n_windows(n_chars: Column) -> Column:
    return F.when(n_chars > 0, F.greatest(n_chars - OVERLAP, F.lit(1))).otherwise(0)


def chunks(text: Column) -> Column:
    """The text in stretches of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def pieces_of(chunk_col: str, n_chars: Column, first: Column | int = 0) -> Column:
    """Pieces from number `first` on, one at least: struct(place, piece, n_windows). chunk_col is a plain column that holds chunks(text)."""
    first = F.lit(first) if isinstance(first, int) else first
    last = F.greatest(F.floor((n_windows(n_chars) - 1) / PIECE).cast("int"), first)
    body = lambda k: F.concat(F.coalesce(F.get(F.col(chunk_col), k), F.lit("")), F.substring(F.coalesce(F.get(F.col(chunk_col), k + 1), F.lit("")), 1, OVERLAP))
    one = lambda k: F.struct((k * PIECE).cast("long").alias("place"), body(k).alias("piece"), F.greatest(F.least(n_windows(n_chars) - k * PIECE, F.lit(PIECE)), F.lit(0)).alias("n_windows"))
    return F.transform(F.sequence(first, last), one)


def with_prints(pieces: DataFrame) -> DataFrame:
    """pieces(..., place, piece, n_windows) with `prints`: array of struct(hash, position) in place of the piece."""
    at = lambda x: (F.lit(PLACES - 1) - x.bitwiseAND(F.lit(PLACES - 1))).cast("int")
    one = lambda x: F.struct(F.xxhash64(F.substring(F.col("piece"), at(x) + 1, F.lit(K))).alias("hash"), (F.col("place") + at(x)).alias("position"))
    found = window_minima(pieces)
    # `kept` stands twice, so that it stays a projection of its own: Spark compiles no lambda nor anything merged into one
    return found.withColumn("prints", F.when(F.size("kept") >= 0, F.transform("kept", one))).drop("piece", "kept", "n_windows")


def gathered(rows: Column) -> Column:
    """struct(place, prints) of a text's pieces, as one array; see without_repeats."""
    return F.flatten(F.transform(F.sort_array(F.collect_list(rows)), lambda x: x["prints"]))


def without_repeats(prints: str) -> Column:
    """A run that two neighbouring pieces keep stands once: positions never fall, so its copies are neighbours. prints is a plain column."""
    return F.filter(F.col(prints), lambda x, i: (i == 0) | (x["position"] != F.get(F.col(prints), i - 1)["position"]))


def shown(prints: Column) -> Column:
    """hash:position pairs in text order."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit(":"), x["position"].cast("string"))), ",")


def hashes(prints: Column) -> Column:
    return F.array_distinct(prints["hash"])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def winnow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, prints) for every row: prints is an array of struct(hash, position)."""
    rows = stored(docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "winnow-texts")
    rows = rows.select("id", "row", F.char_length("text").alias("n_chars"), chunks(F.col("text")).alias("chunks"))
    rows = rows.select("id", "row", "n_chars", F.explode(pieces_of("chunks", F.col("n_chars"))).alias("p")).select("id", "row", "n_chars", "p.*")
    found = with_prints(rows).groupBy("row", "id", "n_chars").agg(gathered(F.struct("place", "prints")).alias("prints"))
    return found.select(F.col("id").alias(id_col), "n_chars", without_repeats("prints").alias("prints"))


def ranked(ids: DataFrame, id_col: str, *ties: str) -> DataFrame:
    """ids with `rank`, 0 for the largest id, ties by further columns: one range shuffle of narrow rows; the only window over everything is over one row per partition."""
    by = [F.col(id_col).desc_nulls_last(), *(F.col(c) for c in ties)]
    dealt = ids.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    firsts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(F.broadcast(firsts.drop("_n")), "_part").withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before")


#: What tells rows apart: the id (as text, which casts back to it, and whether it is null) and two hashes of the text. Rows that are equal in all are copies, any of which serves for the others.
ROW = ("name", "nameless", "low", "high")


def _single(texts: DataFrame, order: DataFrame) -> DataFrame:
    """One of the rows of texts that are copies of each other. Only rows that may have a copy are shuffled."""
    digest = F.xxhash64(*ROW).alias("digest")
    repeated = stored(order.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(digest), "winnow-repeated")
    if repeated.limit(1).count() == 0:
        return texts
    maybe, sure = (part.select(*texts.columns) for part in Sieve.of(repeated).split(texts.withColumn("digest", digest)))
    return sure.unionByName(maybe.dropDuplicates(list(ROW)))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (last half replaced by the head of the next document, descending id)."""
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    texts = rows.select("id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), F.col("id").isNull().alias("nameless"), F.xxhash64("text").alias("low"), F.xxhash64(F.lit(7), F.col("text")).alias("high"), "text")
    order = ranked(texts.select("id", *ROW, F.char_length("text").alias("n_chars")), "id", "low", "high").drop("id")
    rows = order.count()
    texts = _single(texts.drop("id"), order)  # the same columns meet twice, so that their shuffle is used twice
    order = order.withColumn("after", (F.col("rank") + 1) % max(rows, 1))
    # the row of rank `at` gives its head to the row `to` of rank `to_rank`, which needs `n_take` code points
    takes = order.select(F.col("after").alias("at"), F.col("rank").alias("to_rank"), F.struct(*ROW).alias("to"), F.floor(F.col("n_chars") / 2).cast("int").alias("n_take"))
    gives = stored(order.select(F.col("rank").alias("at"), *ROW).join(takes, "at").drop("at"), "winnow-next")
    # a text's prints are computed where it gives and where it takes: cheaper than to send them. What isn't a piece stands in a text's first row only
    given = texts.join(gives, list(ROW)).select(*ROW, "to", "to_rank", F.substring(F.col("text"), F.lit(1), F.col("n_take")).alias("head"), F.char_length("text").alias("n_chars"), chunks(F.col("text")).alias("chunks"))
    given = given.select(*ROW, "to", "to_rank", "head", F.posexplode(pieces_of("chunks", F.col("n_chars"))).alias("k", "p")).select(*ROW, "to", "to_rank", F.when(F.col("k") == 0, F.col("head")).alias("head"), "p.*")
    given = with_prints(given).groupBy(*ROW, "to", "to_rank").agg(F.max("head").alias("head"), F.array_distinct(F.flatten(F.collect_list(F.col("prints.hash")))).alias("next_hashes"))
    given = given.select(*(F.col(f"to.{c}").alias(c) for c in ROW), "to_rank", "head", "next_hashes")

    n, stay = F.col("n_chars"), F.col("n_chars") - F.floor(F.col("n_chars") / 2).cast("int")
    met = texts.join(given, list(ROW)).withColumn("n_chars", F.char_length("text"))
    met = met.select(*ROW, "to_rank", "n_chars", "next_hashes", "text", F.concat(F.substring(F.col("text"), F.lit(1), stay), F.col("head")).alias("edited"))
    met = met.select(*ROW, "to_rank", "n_chars", "next_hashes", F.sha2("edited", 256).alias("edited_sha256"), F.char_length("edited").alias("n_edited"), chunks(F.col("text")).alias("own"), chunks(F.col("edited")).alias("other"))
    # pieces that end in the part that stays are the same in both texts
    same = F.when((n_windows(n) > 0) & (n_windows(F.col("n_edited")) > 0), F.greatest(F.floor((F.least(stay, F.col("n_edited")) - OVERLAP) / PIECE).cast("int"), F.lit(0))).otherwise(0)
    met = met.withColumn("same", same)
    tag = lambda pieces, mine: F.transform(pieces, lambda p: F.struct((F.lit(mine) | (p["place"] < F.col("same") * PIECE)).alias("mine"), (F.lit(not mine) | (p["place"] < F.col("same") * PIECE)).alias("edits"), p["place"].alias("place"), p["piece"].alias("piece"), p["n_windows"].alias("n_windows")))
    every = F.concat(tag(pieces_of("own", n), True), tag(pieces_of("other", F.col("n_edited"), F.col("same")), False))
    met = met.select(*ROW, "to_rank", "n_chars", "edited_sha256", "next_hashes", F.posexplode(every).alias("k", "p"))
    met = met.select(*ROW, "to_rank", "n_chars", "edited_sha256", F.when(F.col("k") == 0, F.col("next_hashes")).alias("next_hashes"), "p.*")
    met = with_prints(met).groupBy(*ROW, "to_rank", "n_chars", "edited_sha256").agg(
        F.max("next_hashes").alias("next_hashes"), gathered(F.when(F.col("mine"), F.struct("place", "prints"))).alias("mine"), gathered(F.when(F.col("edits"), F.struct("place", "prints"))).alias("edits"),
    )
    met = met.select(F.when(~F.col("nameless"), F.col("name").cast(kind)).alias("id"), "n_chars", "edited_sha256", "next_hashes", without_repeats("mine").alias("mine"), without_repeats("edits").alias("edits"))
    met = met.select("*", hashes(F.col("mine")).alias("hashes"))
    return met.select(
        F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", shown(F.col("mine")).alias("fingerprint"), shown(F.col("edits")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), hashes(F.col("edits"))).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
