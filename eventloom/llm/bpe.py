"""Byte-level BPE encoding and decoding with a pair occurrence index.

A partition's texts are cut into pieces (the tokenizer's own pattern); each distinct piece of a run of texts is encoded once. For
all new pieces together, one array holds their symbols, and an index maps each adjacent pair to all its positions. The ranks of
the pairs that are there are taken in ascending order from a heap: the pair is merged at all its positions, and the
position lists of the neighbouring pairs are updated. Merging never crosses a piece, since pieces are parted by a sentinel.

A merge makes a symbol that only later ranks use, or such that a pair with a lower rank appears; the heap then gives that one next. Within a
piece this is the order of plain BPE: always the lowest rank, leftmost first; pieces don't touch each other.

Defined results: null counts as empty; an empty text has no ids and decodes to the empty text. The added tokens of the file (its special
tokens) are cut out first, as the tokenizers library does. Texts are encoded whole. Null ids are kept, rows that repeat are coded each. Extra columns
aren't read. A tokenizer file of another form (FORM) is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import mapped, table
from eventloom.llm.texthash import spans

#: Fixed value: the pattern of the byte-level pre-tokenizer, as the tokenizer file's library has it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same cut for texts of ASCII and Latin letters alone (without the control characters that the two modules class differently): twice as fast.
LATIN_PATTERN = re.compile(r""" ?[A-Za-zÀ-ÖØ-öø-ɏ]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ɏ0-9]+|\s+(?!\S)|\s+""")
NOT_LATIN = re.compile(r"[^\x00-\x1b\x20-\x7e\x80-\x84\x86-\x9fÀ-ÖØ-öø-ɏ]")
#: Distinct pieces that a worker keeps encoded in each of two generations: when the younger one is full, the elder one goes. Costs time only.
CACHED_PIECES = 200_000
#: Longer pieces (in characters) are encoded wherever they are met and not kept, so the kept ones have a bound in bytes.
KEPT_LENGTH = 200
#: What a tokenizer file must say, for anything else would change the ids: byte-level cutting by PATTERN, plain merges, added tokens as they stand.
FORM = {
    "normalizer": (None,), "model.type": ("BPE",), "model.dropout": (None, 0, 0.0), "model.continuing_subword_prefix": (None, ""), "model.end_of_word_suffix": (None, ""), "model.byte_fallback": (None, False),
    "model.ignore_merges": (None, False), "pre_tokenizer.type": ("ByteLevel",), "pre_tokenizer.add_prefix_space": (False,), "pre_tokenizer.use_regex": (None, True), "decoder.type": ("ByteLevel",),
}


def check_form(spec: dict) -> None:
    """Raises ValueError for a tokenizer file that this module would not follow to the letter."""
    for name, allowed in FORM.items():
        value = spec
        for key in name.split("."):
            value = (value or {}).get(key)
        if value not in allowed:
            raise ValueError(f"tokenizer file: {name} is {value!r}, only {allowed[-1]!r} is supported")
    for token in spec.get("added_tokens") or []:
        for flag in ("single_word", "lstrip", "rstrip"):
            if token.get(flag):
                raise ValueError(f"tokenizer file: added token {token['content']!r} has {flag}, which is not supported")
    if max(spec["model"]["vocab"].values()) >= 1 << 20:
        raise ValueError("tokenizer file: ids of 2^20 and more are not supported")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """What encoding and decoding need of a tokenizer file: ids of bytes, pair -> rank and id (packed by 20 bits each), bytes of ids, added tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        check_form(spec)
        ids, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [ids[c] for c in letters]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {ids[a] << 20 | ids[b]: rank << 20 | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.bytes = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        self.numbers = list(range(max(ids.values()) + 1))  # one object for each id, however many pieces have it
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None


@lru_cache(maxsize=2)
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def encode_pieces(pieces: list[str], vocab: Vocabulary) -> list[list[int]]:
    """The ids of each piece, by one pair occurrence index over all of them."""
    symbols: list[int] = []
    bounds = [0]
    for piece in pieces:
        symbols.extend(map(vocab.byte_ids.__getitem__, piece.encode()))
        symbols.append(-1)
        bounds.append(len(symbols))
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges = vocab.merges
    places: dict[int, list[int]] = {}
    place, rank_of = places.get, merges.get
    for i, (left, right) in enumerate(zip(symbols, symbols[1:], strict=False)):
        code = left << 20 | right
        spots = place(code)
        if spots is not None:
            spots.append(i)
        elif code in merges:
            places[code] = [i]
    heap = [(merges[p], p) for p in places]
    heapify(heap)
    while heap:
        ranked, pair = heappop(heap)
        left, right, made, spots = pair >> 20, pair & 0xFFFFF, ranked & 0xFFFFF, places.pop(pair)
        if left == right:
            spots.sort()  # overlapping places: leftmost first
        for i in spots:
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # an earlier merge has used one of the two
            k, h = after[j], before[i]
            symbols[i], symbols[j] = made, -2
            after[i] = k
            if k < n:
                before[k] = i
                code = made << 20 | symbols[k]
                near = place(code)
                if near is not None:
                    near.append(i)
                elif (ranked := rank_of(code)) is not None:
                    places[code] = [i]
                    heappush(heap, (ranked, code))
            if h >= 0:
                code = symbols[h] << 20 | made
                near = place(code)
                if near is not None:
                    near.append(h)
                elif (ranked := rank_of(code)) is not None:
                    places[code] = [h]
                    heappush(heap, (ranked, code))
    numbers = vocab.numbers
    return [[numbers[s] for s in symbols[a : b - 1] if s >= 0] for a, b in zip(bounds, bounds[1:], strict=False)]


class Coder:
    """Encodes texts; keeps the ids of pieces it has met."""

    def __init__(self, spec: str):
        self.vocab, self.pattern = vocabulary(spec), regex.compile(PATTERN)
        self.known, self.elder = {t: (i,) for t, i in self.vocab.added.items()}, {}

    def pieces(self, text: str) -> list[str]:
        find = (self.pattern if NOT_LATIN.search(text) else LATIN_PATTERN).findall
        if not self.vocab.cut or not any(t in text for t in self.vocab.added):
            return find(text)
        return [x for part in self.vocab.cut.split(text) for x in ([part] if part in self.vocab.added else find(part))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text."""
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > CACHED_PIECES:
            self.known, self.elder = {t: (i,) for t, i in self.vocab.added.items()}, self.known
        missed = set().union(*cut) - self.known.keys()
        again = missed & self.elder.keys()
        self.known.update((p, self.elder[p]) for p in again)
        fresh = sorted(missed - again)
        self.known.update(zip(fresh, map(tuple, encode_pieces(fresh, self.vocab)), strict=True))
        ids = [list(chain.from_iterable(map(self.known.__getitem__, pieces))) for pieces in cut]
        for piece in fresh:
            if len(piece) > KEPT_LENGTH:
                del self.known[piece]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.vocab.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def coder_of(spec: str) -> Coder:
    """One coder for each Python worker, whose known pieces serve all of its tasks."""
    return Coder(spec)


def _coded(batches: Iterator[pa.RecordBatch], spec: str, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Adds ids and decoded to the rows; text is the last column, and isn't returned."""
    coder = coder_of(spec)
    for batch in batches:
        rest = batch.schema.names[:-1]
        for first, last in spans(batch.column(len(rest)), chunk_bytes):
            ids = coder.encode([t or "" for t in batch.column(len(rest))[first:last].to_pylist()])
            own = [batch.column(k)[first:last] for k in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(ids, pa.list_(pa.int32())), pa.array(map(coder.decode, ids), pa.string())], [*rest, "ids", "decoded"])


def bpe_encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), chunk_bytes: int = 1 << 20) -> DataFrame:
    """(id_col, *keep, ids array<int>, decoded string). The tokenizer file is read once by the driver and travels with the task (its size is fixed: about 1.6 MB)."""
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())
    names = [f"c{k}" for k in range(len(keep) + 1)]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip((id_col, *keep), names, strict=True)), F.col(text_col).alias("text"))
    kept = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    coded = mapped(rows, lambda it: _coded(it, spec.value, chunk_bytes), f"{kept}, ids array<int>, decoded string")
    return coded.select(*(F.col(n).alias(c) for c, n in zip((id_col, *keep), names, strict=True)), "ids", "decoded")


def bpe_digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """bpe_encode's rows as the contract lists them: (id_col, *keep, n_tokens, ids_sha256, decoded_sha256)."""
    coded = bpe_encode(docs, tokenizer_file, id_col, text_col, keep)
    listed = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select(id_col, *keep, F.size("ids").cast("long").alias("n_tokens"), listed.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizer())
