import hashlib
import os
import random
import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from wayglass.llm import line_dedup, shared, simhash

SPACE = " \t\n\r\x0b\x0c"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """doc to smallest doc reachable, by comparing all."""
    low = {d: d for d in prints}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            ra, rb = sorted((root(a), root(b)))
            low[rb] = ra
    return {d: root(d) for d in prints}


def test_fingerprints(spark):
    for text in [None, "", "  \n", "One", "one TWO", "Ein Zwei DREI vier", "É e É e É e", "x " * 9000]:
        assert simhash.fingerprint((text or "").encode()) == print_of(text)


def test_bit_slices_count_like_plain_distances():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    prints = np.concatenate([base, base ^ np.uint64(1 << 40), base ^ np.uint64(0b111), base ^ np.uint64(0b11110000), np.zeros(200, np.uint64)])
    group = np.sort(rng.integers(0, 4, len(prints)))
    a, b = simhash.linked(group, prints)
    assert (group[a] == group[b]).all() and all((int(prints[x]) ^ int(prints[y])).bit_count() <= 3 for x, y in zip(a, b, strict=True))
    joined = list(range(len(prints)))

    def root(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = sorted((root(x), root(y)))
        assert rx != ry
        joined[ry] = rx
    for x, y in combinations(range(len(prints)), 2):
        if group[x] == group[y] and (int(prints[x]) ^ int(prints[y])).bit_count() <= 3:
            assert root(x) == root(y)


@pytest.mark.parametrize("part", [4096, 5])
def test_links_and_components(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in list(prints[:20]):  # chains, whose ends are far apart
        for _ in range(6):
            p ^= 1 << rng.randrange(64) | 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.append(p)
    prints += [p ^ 1 << 63 for p in prints[:10]]
    by = {i: p for i, p in enumerate(dict.fromkeys(prints))}
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in by.items()]
    df = spark.createDataFrame(signed, "fingerprint long, node long")
    found = {r.node: r.component for r in simhash.components(simhash.links(df)).collect()}
    assert {i: found.get(i, i) for i in by} == classes(by)


def test_large_groups_and_stars_are_taken_apart(spark, monkeypatch):
    for module, name, value in ((simhash, "PART", 20), (simhash, "BROADCAST_ROWS", 0), (shared, "BROADCAST_ROWS", 2), (shared, "HOT", 3)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(5, 33), k)) for k in (0, 1, 2, 5, 8, 11) for _ in range(60)} | {rng.getrandbits(64) for _ in range(30)}
    by = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in by.items()], "fingerprint long, node long")
    sizes = [(r["count"], (r.mask & (1 << 64) - 1).bit_count()) for r in simhash.grouped(df).groupBy("mask", "key").count().collect()]
    assert all(n <= 20 or bits >= 64 - simhash.FREE for n, bits in sizes) and max(bits for _, bits in sizes) > 40
    found = {r.node: r.component for r in simhash.components(simhash.links(df)).collect()}
    assert {i: found.get(i, i) for i in by} == classes(by)


def test_a_tie_of_ids_and_texts_goes_by_the_other_columns(spark):
    rows = [(1, "a b c d", x) for x in "pqrstuvw"] + [(2, "a b c d", "z")]
    kept = {simhash.first_of_each(spark.createDataFrame(rng, "doc_id long, text string, source string").repartition(4)).first().source for rng in (rows, rows[::-1])}
    assert len(kept) == 1 and kept < set("pqrstuvw")


def test_query_two_over_the_whole_table(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    prints = {r.doc_id: print_of(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    low = classes(prints)
    found = e.queries()["op2_simhash"](spark, d).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {k: (f"{p:016x}", low[k]) for k, p in prints.items()}


def test_one_of_each_group_stays(spark):
    same = "the same words again and again in one text"
    rows = [(9, same, "b"), (4, same, "a"), (4, same, "a"), (None, same, "c"), (None, "other text of its own here", "d"), (None, "other text of its own here", "e"), (7, "", "f"), (8, None, "g"), (5, "alone with words that nobody else has", "h"), (5, same, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    kept = sorted((r.doc_id or -1, r.text) for r in simhash.first_of_each(df).collect())
    assert kept == sorted([(4, same), (-1, "other text of its own here"), (7, ""), (5, "alone with words that nobody else has")])
    assert simhash.first_of_each(df.limit(0)).count() == 0 and simhash.first_of_each(df).columns == df.columns
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id == 9} == {4}


def kept_of(rows):
    keys = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= 10:
                keys.setdefault(key, set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if not (len(k := lower(x.strip(SPACE))) >= 10 and len(keys[k]) > 1 and doc != min(keys[k]))]
        out.append((doc, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out)


LINES = [
    (5, "A line that repeats\nshort\n  a LINE that repeats \t\nown line here\n"),
    (3, "a line THAT repeats\nshort\nÉtroit été\nétroit été"),
    (9, "\n\na line that repeats\nÉtroit été\n\xa0a line that repeats"),
    (2, None),
    (1, ""),
    (7, "tab\tinside a line\x0b\ntab inside a line"),
    (8, "tab\tinside a line\nmid\rreturn here"),
    (8, "mid\rreturn here\nmid\rreturn here"),
    (11, "x\n" * 3000 + "a line that repeats\n" + "long " * 4000),
    (12, "long " * 4000),
]


@pytest.mark.parametrize("full", [False, True])
def test_lines_match_brute_force(spark, monkeypatch, full):
    if full:
        monkeypatch.setattr(line_dedup, "HOT_LINE", 2)
    if full:  # a filter that is full suspects every line, and changes nothing
        monkeypatch.setattr(line_dedup, "twice_seen", lambda documents, bits: np.full(bits // 8, 255, np.uint8))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in LINES], "doc_id long, text string, doc string, digest int")
    found = line_dedup.drop_repeated_lines(df)
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()) == kept_of(LINES)
    assert found.columns == ["doc_id", "text", "doc", "digest", "n_lines", "n_dropped"]


def test_lines_without_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "some longer line"), (1, "some longer line"), (None, "lonely longer line"), (None, "lonely longer line"), (None, "shared by two a\nx"), (None, "shared by two a\ny")], "doc_id long, text string")
    found = sorted(((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(df).collect()), key=str)
    assert (1, "some longer line") in found and found.count((None, "lonely longer line")) == 2 and (None, "") in found
    assert sum("shared" in t for _, t in found) == 1 and sum(t in ("x", "y") for _, t in found) == 1
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_tables_of_an_operator_before_are_let_go(spark):
    def keep(batches):
        yield from batches
        shared.kept("a test", lambda: list(range(100_000)))
        time.sleep(1)  # so that no worker has two of these tasks

    def keeping(batches):
        for _ in batches:
            pass
        time.sleep(1)
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([shared._kept[:1] == ["a test"]])], ["pid", "kept"])

    def state():
        return {r.pid: r.kept for r in spark.range(0, 8, 1, 8).mapInArrow(keeping, "pid long, kept boolean").collect()}

    df = spark.createDataFrame([(d, t) for d, t in LINES if d != 8], "doc_id long, text string").repartition(8)
    for operator in (line_dedup.drop_repeated_lines, simhash.first_of_each):
        spark.range(0, 8, 1, 8).mapInArrow(keep, "id long").collect()
        before = state()
        assert any(before.values())
        operator(df).collect()
        after = state()
        assert any(before[pid] and not after.get(pid, True) for pid in before), operator


def test_query_three_over_the_whole_table(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, k in kept_of(rows)]
    assert sorted(map(tuple, e.queries()["op3_line_dedup"](spark, d).collect())) == want
