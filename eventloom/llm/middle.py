r"""Fill-in-middle transformation by content-defined chunk memoization.

A text is cut into lines, `[^\n]*\n|[^\n]+`; two hashes of its id choose after how many lines prefix and middle end. To find these places a rolling hash over 32 bytes chunks the text where its content
says so, so that passages which documents share become the same chunks wherever they stand. A chunk's boundary summary (line ends and code points in it) is kept in a bounded content cache: a chunk is
summed up once, and a kept summary serves only a chunk of the same bytes. Running totals of the chunks' counts give the number of lines and tell in which chunk a cut lies; only that chunk is looked into.

The cut places are code points, so Spark puts the parts together itself: texts go to Python but don't come back. `restored` rebuilds the text from output and form alone.

Defined results: null text counts as empty (n 0, form plain, output empty). A null id hashes as no digits after the salt. Rows that repeat an id and a text get equal results. Other columns
aren't read, so clashing names don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import small_batches, table, whole

#: Marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of the rolling hash's window; a chunk ends where its BITS upper bits are 0, after LEAST bytes at least and at MOST at most.
WINDOW, BITS, LEAST, MOST = 32, 10, 256, 8192
#: Bytes that are hashed at once, and bytes of contents in each of the cache's two generations.
BLOCK, CACHE_BYTES = 1 << 20, 8 << 20
_FACTOR = 2654435769
_VALUES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def window_hashes(data: np.ndarray) -> np.ndarray:
    """For every byte the hash of the up to WINDOW bytes that end with it: sum of value * factor^distance, by doubling."""
    h, factor, width = _VALUES[data], _FACTOR, 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += np.uint32(factor) * h[:-width]
        h, factor, width = longer, factor * factor & 0xFFFFFFFF, 2 * width
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of UTF-8 bytes; none lies within a character."""
    starts = np.concatenate(((data & 0xC0) != 0x80, [True]))  # places where a character may start, the end included
    wanted = []
    for begin in range(0, len(data), BLOCK):  # a block sees the window before it
        before = min(begin, WINDOW - 1)
        h = window_hashes(data[begin - before : begin + BLOCK])[before:]
        wanted.append(np.flatnonzero((h >> np.uint32(32 - BITS) == 0) & starts[begin + 1 : begin + 1 + len(h)]) + begin + 1)
    out, last = [], 0
    for end in [*(np.concatenate(wanted).tolist() if wanted else []), len(data)]:
        while end - last > MOST:
            last += MOST - next((k for k in range(4) if starts[last + MOST - k]), 0)
            out.append(last)
        if end - last >= LEAST or (end == len(data) > last):
            out.append(end)
            last = end
    return out


class ChunkCache:
    """Boundary summaries (line ends, code points) of chunks by content, in two generations of at most `most` bytes each: a full generation becomes the old one, and chunks met again move on."""

    def __init__(self, most: int = CACHE_BYTES) -> None:
        self.most, self.size, self.new, self.old, self.hits = most, 0, {}, {}, 0

    def summary(self, chunk: bytes) -> tuple[int, int]:
        found = self.new.get(chunk)  # a dictionary compares whole contents where hashes agree
        if found:
            self.hits += 1
            return found
        found = self.old.get(chunk)
        if found:
            self.hits += 1
        else:
            found = chunk.count(b"\n"), characters(chunk)
        if self.size + len(chunk) > self.most:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[chunk] = found
        self.size += len(chunk)
        return found


def characters(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def cut(data: bytes, h1: int, h2: int, cache: ChunkCache) -> tuple[int, int, int, int]:
    """(lines, code points of the prefix, code points of the middle, chunks) of a text's UTF-8 bytes."""
    ends = chunk_ends(np.frombuffer(data, np.uint8))
    chunks = [data[a:b] for a, b in zip([0, *ends], ends)]
    said = [cache.summary(c) for c in chunks]
    lines, chars = list(accumulate(s[0] for s in said)), [0, *accumulate(s[1] for s in said)]
    n = (lines[-1] if lines else 0) + (len(data) > 0 and not data.endswith(b"\n"))

    def before(k: int) -> int:
        """Code points of the first k lines."""
        if k in (0, n):
            return chars[-1] if k else 0
        at = bisect_left(lines, k)
        place = -1
        for _ in range(k - (lines[at - 1] if at else 0)):
            place = chunks[at].index(b"\n", place + 1)
        return chars[at] + characters(chunks[at][: place + 1])

    first, last = (before(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    return n, first, last - first, len(chunks)


_cache = ChunkCache()  # one for each Python worker


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars", "chunks")]))
def cuts(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    rows = [cut(t.as_buffer().to_pybytes() if t.is_valid else b"", a.as_py(), b.as_py(), _cache) for t, a, b in zip(texts.cast(pa.binary()), h1, h2)]
    columns = zip(*rows) if rows else ((),) * 4
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "prefix_chars", "middle_chars", "chunks"])


def id_hash(id_col: str | Column, k: int, salt: str = "7") -> Column:
    """The k-th (from 1) group of eight digits of the SHA-256 of salt, colon and id."""
    name = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), name), 256), 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 100, spm: int = 50, salt: str = "7") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, chunks, output) of every document. rate: per cent of the texts that are transformed; spm: per cent of these with the suffix first."""
    small_batches(docs.sparkSession)
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("cut", cuts(text, id_hash("id", 1, salt), id_hash("id", 2, salt)))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (id_hash("id", 3, salt) % 100 >= rate), "plain").when(id_hash("id", 4, salt) % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    first, second = F.col("cut.prefix_chars").cast("int"), F.col("cut.middle_chars").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second), F.substring(text, first + second + 1, F.char_length(text))
    head = {"psm": (F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix), "spm": (F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix)}
    output = F.when(F.col("form") == "plain", text)
    for name, parts in head.items():
        output = output.when(F.col("form") == name, F.concat(*parts, F.lit(MIDDLE), middle))
    number = lambda c: F.when(F.col("form") != "plain", F.col(f"cut.{c}"))
    return rows.select(F.col("id").alias(id_col), F.col("cut.n").alias("n"), "form", number("prefix_chars").alias("prefix_chars"), number("middle_chars").alias("middle_chars"), F.col("cut.chunks").alias("chunks"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: a transformed text has no mark of its own, so each mark's first place parts it."""
    size = F.char_length(output)
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    third = F.instr(output, MIDDLE)
    one, two, three = F.substring(output, F.lit(4), second - 4), F.substring(output, second + 3, third - second - 3), F.substring(output, third + 3, size)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid, coalesce(array_to_string(units[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
