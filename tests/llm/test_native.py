"""Exact dedup, licence scan, fingerprints, WARC audit and sharding on odd rows and against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom.llm import exact_dedup, fingerprint, license_scan, sharding, warc_audit
from eventloom.sources.shared import stored

BLANKS = re.compile("[\x20\x09-\x0d]+")


def brute_dedup(rows):
    norm = [(i, BLANKS.sub(" ", t or "")) for i, t in rows]
    out = []
    for i, n in norm:
        same = [j for j, m in norm if m == n]
        out.append((i, min(same), len(same), i == min(same), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def test_dedup_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(odd).collect())
    assert got == brute_dedup(rows)


def test_dedup_verifies_bytes(spark, odd):
    """Under a digest of three values nearly every row is a hit; only equal bytes stay together."""
    rows = [(k, f"text {k % 17}  {'x' * (k % 3)}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    weak = lambda norm: F.pmod(F.xxhash64(norm), F.lit(3))
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(df, digest=weak).collect()) == brute_dedup(rows)


def test_dedup_hot_group(spark):
    rows = [(k, "same text" if k % 3 == 0 else f"t{k}") for k in range(3000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("group_size = 1000 AND keep_id = 0").count() == 1000 and got.where("group_size = 1").count() == 2000


def test_dedup_null_ids_and_empty_table(spark, none):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (None, "b")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == [("3", "3", 2, True), ("None", "3", 2, False), ("None", "None", 2, True), ("None", "None", 2, True)]
    assert exact_dedup.exact_dedup(none).count() == 0


def test_filters_let_every_digest_through(spark):
    df = stored(spark.range(5000).select(F.xxhash64("id").alias("digest")), "t")
    half = stored(df.where("digest % 2 = 0"), "t")
    sieve = exact_dedup.Sieve.of(half)
    maybe, sure = sieve.split(df)
    assert maybe.where("digest % 2 = 0").count() == half.count() and maybe.count() + sure.count() == 5000 and sure.count() > 2000


def test_removal_keeps_clashing_columns(spark, odd):
    gone = stored(spark.createDataFrame([(2,), (6,)], "doc_id long"), "t")
    got = exact_dedup.without(odd, gone, "doc_id")
    assert got.columns == odd.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5, 5, 7, 8, 9]


def test_dedup_index_of_several_loads(spark):
    """Loads of an index give what one load gives; runs are merged tier by tier; identifiers and counts are exact."""
    rows = [(k, f"text {k % 37} {'y' * (k % 11)}") for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    index = exact_dedup.DigestIndex()
    for load in ("doc_id % 3 = 0", "doc_id % 3 = 1", "doc_id % 3 = 2"):
        index.add(exact_dedup.keyed(df.where(load)), memtables=2)
    want = {}
    for k, t in rows:
        want.setdefault(t, []).append(k)
    assert sorted((r.min_id, r.n_rows) for r in index.entries().collect()) == sorted((min(x), len(x)) for x in want.values())
    one = exact_dedup.exact_dedup(df).collect()
    assert sorted(map(tuple, exact_dedup.exact_dedup(df, index=index).collect())) == sorted(map(tuple, one)) == brute_dedup(rows)
    tiers = [r.tier for r in index.runs]
    assert all(tiers.count(t) < exact_dedup.FAN_IN for t in tiers)
    digests = [r.digest for r in index.runs[-1].rows.coalesce(1).collect()]
    assert len(digests) == len(set(digests))


def test_dedup_plan_is_alike_at_every_size(spark, monkeypatch):
    """Small bounds stand for large tables: run filters meet their rows in a shuffle, texts are read in many loads, filters have less bits than they ask for. The rows are the same."""
    rows = [(k, f"text {k % 170} {'z' * (k % 3)}") for k in range(900)] + [(900 + k, "one hot text") for k in range(450)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute_dedup(rows)
    for name, value in (("BROADCAST_BITS", 1), ("LOAD_ROWS", 300), ("SIEVE_BITS", exact_dedup.ROW_BITS)):
        monkeypatch.setattr(exact_dedup, name, value)
        found = exact_dedup.exact_dedup(df)
        assert sorted(map(tuple, found.collect())) == want
        exact_dedup.discard(*found.spent)


def test_dedup_filters_of_other_sizes(spark):
    """A small run's filter serves a large run's slots, and nothing is lost when they are merged."""
    index = exact_dedup.DigestIndex()
    ids = lambda lo, hi: spark.range(lo, hi).select("id", F.xxhash64("id").alias("digest"))
    index.add(ids(0, 30_000), memtables=1).add(ids(29_990, 30_010), memtables=1)
    assert [r.slots for r in index.runs] == [16, 1] and index.hits().count() == 10 and index.entries().count() == 30_010


def test_dedup_index_opens_again(spark, tmp_path):
    """An index is taken up from its list of runs; each run has its filter beside it; replaced runs are deleted."""
    import os

    from eventloom.sources.shared import shared_dir

    tables = lambda: {x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith(("dedup-runs", "dedup-filters"))}
    before = tables()
    ids = lambda lo, hi: spark.range(lo, hi).select("id", F.xxhash64("id").alias("digest"))
    index = exact_dedup.DigestIndex().add(ids(0, 1000)).add(ids(500, 1500), memtables=1)
    index.save(spark, str(tmp_path / "index"))
    kept = {os.path.basename(x) for r in index.runs for x in (r.table.stored_at, r.filters.stored_at)}
    assert tables() - before == kept
    again = exact_dedup.DigestIndex.open(spark, str(tmp_path / "index"))
    assert again.hits().count() == 500 and again.add(ids(0, 10)).hits().count() == 510
    again.drop()
    assert not again.runs


def test_licences(spark, odd, none):
    texts = [
        (1, "intro\nReleased under the MIT License.\nend"), (2, "RELEASED UNDER -- THE MIT LICENSE"), (3, "released under the license"), (4, "Licensed under the Apache License,\nVersion 2.0."), (5, None),
        (6, "x " * 20_000 + "\nLicensed under CC BY-NC 4.0.\n"), (7, "MIT"), (8, "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = {(r.doc_id, r.license, r.dice, r.unit) for r in license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (1, "MIT", 1.0, "line") in got and (2, "MIT", 1.0, "text") in got and (4, "Apache-2.0", 1.0, "text") in got and (6, "CC-BY-NC-4.0", 1.0, "line") in got and (8, "GPL-3.0", 1.0, "text") in got
    assert not {g[0] for g in got} & {3, 5, 7}
    assert license_scan.license_scan(odd).count() == license_scan.license_scan(none).count() == 0


def test_licences_inside_longer_text(spark):
    """Notices within a line, over line ends, with usual wordings; licences of like wording don't add their names; null ids are one document."""
    texts = [
        (1, "Copyright 2020 Foo Corp and contributors. Released under the MIT License. See the file for details."),
        (2, "some words before it, licensed under the\nApache License,\nVersion 2.0, and words after"), (3, "This project is licensed under the GNU General Public License, version 2."),
        (4, "Copyright 2024 Acme Corp. Licensed under the MIT License."), (5, "available under the Eclipse Public License 2.0"), (6, "the license was available under the public bridge and released the work"),
        (7, "x y z " * 300 + "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution." + " q" * 500),
        (None, "Released under the ISC License."), (None, "a. Released under the ISC License. b"), (8, "License"), (9, "Licensed under CC BY 4.0. Also: licensed under CC BY-SA 4.0."),
    ]
    got = license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got) == [(0, "ISC"), (1, "MIT"), (2, "Apache-2.0"), (3, "GPL-2.0"), (4, "MIT"), (5, "EPL-2.0"), (7, "BSD-2-Clause"), (7, "BSD-3-Clause"), (9, "CC-BY-4.0"), (9, "CC-BY-SA-4.0")]
    assert {(r.doc_id, r.unit) for r in got} >= {(1, "window"), (2, "window"), (3, "text")} and all(r.dice >= 0.8 for r in got)


def test_licence_headings_and_tags(spark):
    """Lines that name a licence, tags amid code, the warranty; a name amid a sentence, an unknown tag and a bare word are no notices."""
    warranty = license_scan.TEXTS["MIT"][2]
    texts = [
        (1, "/* SPDX-License-Identifier: MIT */ int main() { return 0; }"), (2, "# SPDX-License-Identifier: Apache-2.0\nimport os"), (3, "MIT License\n\nCopyright (c) 2020 Foo"), (4, "Name: foo\nLicense: GPLv3+\n"),
        (5, "x\n\n" + warranty.replace("WITHOUT", "\nWITHOUT")), (6, "we compared the MIT License with others"), (7, "SPDX-License-Identifier: Foo"), (8, "Classifier: License :: OSI Approved :: MIT License"),
        (9, "// SPDX-License-Identifier: GPL-2.0-or-later"), (10, "The MIT License (MIT)"), (11, "License: Foo"), (12, "License"),
    ]
    got = license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "MIT"), (2, "Apache-2.0"), (3, "MIT"), (4, "GPL-3.0"), (5, "MIT"), (8, "MIT"), (9, "GPL-2.0"), (10, "MIT")]


def test_licences_of_cut_texts(spark, monkeypatch):
    """Stretches of any length give the same windows; an anchor that fills a text makes few of them."""
    texts = [(1, "a b c " * 40 + "released under the MIT License " + "d e " * 60 + "licensed under the Apache License, Version 2.0 " + "f " * 30), (2, "license " * 20_000 + "\nReleased under the MIT License.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    scan = lambda: sorted(map(tuple, license_scan.license_scan(docs).collect()))
    want = scan()
    assert [w[:2] for w in want] == [(1, "Apache-2.0"), (1, "MIT"), (2, "MIT")]
    monkeypatch.setattr(license_scan, "LONG_TEXT", 10)
    for words in (64, 1000):
        monkeypatch.setattr(license_scan, "STRETCH", words)
        assert scan() == want


@pytest.mark.parametrize("telling", [False, True])
def test_licence_pruning_loses_nothing(telling):
    """Brute force: every subset of a template that reaches the threshold holds an anchor and an admitted size."""
    rng = np.random.default_rng(1)
    every = license_scan.both(license_scan.TEMPLATES, license_scan.HEADINGS)
    shared = set(license_scan.all_anchors(every, 0.8))
    for texts in every.values():
        for text in texts:
            grams = license_scan.template_bigrams(text)
            anchors = license_scan.anchor_words(grams, 0.8, telling) if telling else shared
            for _ in range(200):
                part = [g for g in grams if rng.random() < 0.75]
                if part and 2 * len(part) / (len(part) + len(grams)) >= 0.8:
                    assert any(set(g.split()) & anchors for g in part)
                    assert len(grams) * 0.8 / 1.2 <= len(part) + 1e-9


def turned(x, by):
    return (x << by | x >> (64 - by)) & ((1 << 64) - 1)


def brute_runs(text, k):
    """(hash, place) of every run of k characters, hashed afresh."""
    if 0 < len(text) < k:
        return [xxhash.xxh64_intdigest(text.encode(), 42)]
    own, out = [xxhash.xxh64_intdigest(c.encode(), 42) for c in text], []
    for i in range(len(text) - k + 1):
        h = 0
        for d, x in enumerate(own[i : i + k]):
            h ^= turned(x, k - 1 - d)
        out.append(h)
    return out if text else []


def brute_winnow(text, k=fingerprint.K, w=fingerprint.W):
    bits = 64 - fingerprint.PLACE_BITS
    low = [h & ((1 << bits) - 1) for h in brute_runs(text, k)]
    own = [h - (1 << bits) if h >> (bits - 1) else h for h in low]
    kept = []
    for i in range(max(len(own) - w + 1, min(len(own), 1))):
        window = own[i : i + w]
        best = i + max(j for j, g in enumerate(window) if g == min(window))
        if not kept or kept[-1] != best:
            kept.append(best)
    return ",".join(f"{xxhash.xxh64_intdigest(text[p : p + k].encode(), 42):x}:{p}" for p in kept)


def test_fingerprints_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    assert got.keys() == texts.keys()
    hashes = lambda s: {x.split(":")[0] for x in s.split(",") if x}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, doc in enumerate(order):
        text, after = texts[doc], texts[order[(i + 1) % len(order)]]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        r = got[doc]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute_winnow(text) and r.edited_fingerprint == brute_winnow(edited)
        assert abs(r.near_edited - alike(hashes(r.fingerprint), hashes(r.edited_fingerprint))) < 1e-9
        assert abs(r.near_next - alike(hashes(r.fingerprint), hashes(brute_winnow(after)))) < 1e-9


def test_fingerprint_guarantee(spark):
    """Shared runs of K + W - 1 characters share a kept run, wherever they stand, pieces' ends included; texts without blanks too."""
    rng = random.Random(3)
    shared = "".join(rng.choices("数据工程师的文本处理引擎abcdefgh\U0001f600", k=fingerprint.K + fingerprint.W - 1))
    texts = [(k, "".join(rng.choices("木林森水火土金", k=k * 23)) + shared + "".join(rng.choices("0123456789", k=900 - k))) for k in range(40)]
    got = fingerprint.winnow(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    prints = {r.doc_id: {(x.hash, x.position - 23 * r.doc_id) for x in r.prints if 0 <= x.position - 23 * r.doc_id < fingerprint.W} for r in got}
    assert prints[0] and all(prints[0] & p for p in prints.values())
    shown = {r.doc_id: ",".join(f"{x.hash & (2**64 - 1):x}:{x.position}" for x in r.prints) for r in got}
    assert shown == {k: brute_winnow(t) for k, t in texts}
    assert brute_winnow(shared[:63]) and {r.n_chars for r in got} == {len(t) for _, t in texts}


def test_fingerprints_of_odd_rows(odd, none):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    got = fingerprint.edited_fingerprints(odd).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted([*((i, brute_winnow(t)) for i, t in texts.items()), (5, brute_winnow(texts[5]))])
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint == "" and by_id[6].fingerprint == by_id[7].fingerprint
    assert by_id[2].near_next == by_id[1].near_edited == 1.0 and by_id[7].near_next == 1.0 and by_id[6].near_next == 0.0
    assert fingerprint.edited_fingerprints(none).count() == 0


def test_fingerprints_of_texts_without_blanks(spark):
    rng = random.Random(5)
    text = "".join(rng.choices("春夏秋冬山川草木花鳥風月", k=2000))
    df = spark.createDataFrame([(2, text), (1, text[:1900] + "".join(rng.choices("一二三四五六七八九十", k=100)))], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(df).collect()}
    assert got[2].near_next > 0.8 and got[1].near_next > 0.8 and got[2].near_edited > 0.2


def test_fingerprints_of_null_and_repeated_ids(spark, odd):
    """Every row has a result, and its edited text ends with the head of exactly one other row."""
    assert sorted(r.doc_id for r in fingerprint.edited_fingerprints(odd).collect()) == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    rows = [(None, "no name one"), (None, "without a name"), (3, "aaaa bbbb"), (3, "aaaa bbbb"), (3, "cccc dddd eeee"), (7, "the first of all"), (5, "middle text")]
    got = fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.fingerprint) for r in got) == sorted((i or 0, brute_winnow(t)) for i, t in rows)
    cut = lambda t, after: hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()
    possible = []
    for nameless in (rows[:2], rows[1::-1]):
        for threes in (rows[2:5], [rows[4], *rows[2:4]]):
            order = [rows[5], rows[6], *threes, *nameless]
            possible.append(sorted((i or 0, cut(t, order[(k + 1) % 7][1])) for k, (i, t) in enumerate(order)))
    assert sorted((r.doc_id or 0, r.edited_sha256) for r in got) in possible


def test_warc_audit(spark):
    rows = spark.range(3000).select(F.col("id").alias("page_id"), warc_audit.record(F.concat(F.lit("u"), F.col("id").cast("string")), F.lit("body é")).alias("record"))
    good = warc_audit.laid_out(warc_audit.slotted(warc_audit.digested(rows)))
    hurt = rows.where("page_id <> 7").withColumn("record", F.when(F.col("page_id") == 1500, F.concat(F.lit("w"), F.substring("record", 2, 1000))).when(F.col("page_id") == 2999, F.lit("")).otherwise(F.col("record")))
    bad = warc_audit.digested(hurt).join(good.select("page_id", (F.col("offset") + (F.col("page_id") == 9).cast("int")).alias("offset")), "page_id")
    bad = bad.union(spark.createDataFrame([(5000, 3, "new", 0)], "page_id long, length long, digest string, offset long"))
    got = {(r.page_id, r.status) for r in warc_audit.audit(good, bad).collect()}
    assert got == {(7, "missing"), (9, "moved"), (1500, "corrupt"), (2999, "truncated"), (5000, "extra")}
    assert warc_audit.audit(good, good).count() == 0


def test_warc_odd_rows(spark):
    rows = spark.createDataFrame([(None, "x"), (1, "a"), (1, "a"), (1, "b"), (1 << 40, "far")], "page_id long, record string")
    lay = lambda df: warc_audit.laid_out(warc_audit.slotted(warc_audit.digested(df)))
    laid = lay(rows)
    assert warc_audit.audit(laid, laid).count() == 0 and warc_audit.unslotted(rows).count() == 1
    assert [r.status for r in warc_audit.audit(laid, lay(rows.where("record <> 'b'"))).collect()] == ["truncated"]
    swapped = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1 << 40, "far")], "page_id long, record string")
    assert [(r.page_id, r.status) for r in warc_audit.audit(laid, lay(swapped)).collect()] == [(1, "corrupt")]
    clashing = rows.select("page_id", "record", F.lit("x").alias("digest"), F.lit("y").alias("offset"), F.lit(1).alias("node"), F.lit(2).alias("length"))
    assert warc_audit.audit(laid, lay(clashing)).count() == 0
    empty = laid.limit(0)
    assert warc_audit.audit(empty, empty).count() == 0


def test_nodes_are_offset_ranges(spark):
    """Every inner node spans its slots, from file and offset to file and offset, against plain Python."""
    rows = spark.range(2500).select(F.col("id").alias("page_id"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("record"))
    leaf = warc_audit.leaves(warc_audit.laid_out(warc_audit.slotted(warc_audit.digested(rows))))
    offset, end = {}, {}
    for k in range(2500):
        offset[k] = 0 if k % 1024 == 0 else end[k - 1]
        end[k] = offset[k] + k % 7
    level, size = leaf, 1
    for _ in range(3):
        level, size = warc_audit.parents(level), size * warc_audit.FANOUT
        for r in level.collect():
            low, high = r.node * size, min((r.node + 1) * size, 2500) - 1
            assert tuple(r.first) == (low // 1024, offset[low]) and tuple(r.last) == (high // 1024, max(end[k] for k in range(low, high + 1) if k // 1024 == high // 1024))


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 3), (3, 2), (3, 4)):
        side = range(1 << bits)
        cells = [()]
        for _ in range(dims):
            cells = [(*c, x) for c in cells for x in side]
        at = {sharding.hilbert_index(c, bits): c for c in cells}
        assert sorted(at) == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(len(cells) - 1))


def test_shards(spark, sf):
    got = sharding.op5_sharding(spark, sf).toPandas()
    sizes = got.groupby("shard").size()
    assert set(got["shard"]) == set(range(40)) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got.sort_values(["shard", "slot"])["curve_index"].is_monotonic_increasing
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    assert all(zlib.crc32(docs.text[d].encode()) == c and len(docs.text[d].encode()) + 16 == s for d, c, s in zip(got.doc_id, got.text_crc32, got["size"], strict=True))
    assert got.groupby("shard")["lang"].nunique().mean() < 3  # files prune on each dimension


def test_shards_of_odd_rows(odd, none):
    dims = {"lang": F.col("lang"), "source": F.col("source")}
    got = sharding.hilbert_shards(odd, dims, shards=4).toPandas()
    assert sorted(got["shard"].value_counts()) == [2, 2, 3, 3] and got[got.doc_id == 1]["size"].item() == 16
    assert sharding.hilbert_shards(none, dims).count() == 0


def test_bins_of_long_shared_prefixes(spark):
    """Values are ranked whole: ten sources with one long prefix fall into ten bins, numbers beyond 2^53 into their own."""
    rows = spark.createDataFrame([(k, f"xhttps://a.org/a/long/shared/path/{k % 10}", (1 << 60) + k % 4, None if k % 2 else "v") for k in range(400)], "id long, s string, n long, half string")
    got = sharding.quantised(rows, ["s", "n", "half"], 4)
    assert got.select("s", "bin_0").distinct().count() == got.select("bin_0").distinct().count() == 10
    assert sorted(r.bin_1 for r in got.select("bin_1").distinct().collect()) == [0, 4, 8, 12]
    assert [r.bin_2 for r in got.select("bin_2").distinct().collect()] == [0]
    assert sorted((r.s, r.bin_0) for r in got.select("s", "bin_0").distinct().collect()) == [(f"xhttps://a.org/a/long/shared/path/{k}", k * 16 // 10) for k in range(10)]


def test_shards_of_null_ids(spark):
    rows = spark.createDataFrame([(None, "a", "en"), (None, "a", "en"), (2, None, None)], "doc_id long, text string, lang string")
    got = sharding.hilbert_shards(rows, {"lang": F.col("lang")}, shards=2).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 17), (0, 17), (2, 16)] and sorted(r.shard for r in got) == [0, 0, 1]
