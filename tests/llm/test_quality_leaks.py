import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayglass.llm import decontaminate, quality


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


TEXTS = [None, "", "a b c d e a b c d e", "x " * 40, "one two three four five six seven eight nine ten", "#é $|< x\n#é $|< x\n \n \nüß*", "a b c d e f " * 3 + " ".join(f"w{i}" for i in range(200)), "\x0ba\x0cb\x85c\xa0d 🙂", "p q r s t u v w x y z " + "long" * 5000]


def test_statistics_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, n_words int")
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df).collect()}
    assert found == {i: base_of(t) for i, t in enumerate(TEXTS)}
    assert quality.judge(df.limit(0)).count() == 0


def test_hosts_are_judged_with_shrinkage(spark):
    good, bad = " ".join(f"word{i}" for i in range(12)), "short"
    rows = [(f"ok{h}", good) for h in range(20) for _ in range(10)] + [(f"ok{h}", bad) for h in range(20)]
    rows += [("spam", bad)] * 60 + [("spam", good)] * 3 + [("one", bad)] + [("one", good)] + [(None, good), (None, bad)]
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    found = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, (host, text) in enumerate(rows):
        assert found[i].kept == (text == good and host != "spam") and found[i].host_failed == (host == "spam")
    rates = {r.host: r.rate for r in quality.host_rates(quality.statistics(df)).collect()}
    assert rates["one"] < 0.5 < rates["spam"] and None not in rates


def items_in(docs, items):
    def grams(words, n):
        return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}

    def norm(t):
        return [w for w in ("".join(c for c in x if c.isalnum()) for x in (t or "").lower().split()) if w]

    out = set()
    for doc, text in docs:
        for item, said in items:
            w = norm(said)
            if w:
                want = grams(w, min(5, len(w)))
                found = want & grams(norm(text), min(5, len(w)))
                if 5 * len(found) >= 4 * len(want):
                    out.add((doc, item, len(want), len(found)))
    return sorted(out)


@pytest.mark.parametrize("item_bytes", [decontaminate.ITEM_BYTES, 1])
def test_containment_matches_brute_force(spark, monkeypatch, item_bytes):
    monkeypatch.setattr(decontaminate.contained, "__defaults__", ("contained", decontaminate.THRESHOLD, item_bytes))
    item = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(item)), (2, "two words"), (3, "One!"), (4, None), (5, "..."), (6, " ".join(item[:7])), (7, "a b c d e f g h i j"), (7, "k l m n o p q r s t")]
    filler = " ".join(f"f{i % 50}" for i in range(3000))
    docs = [(10, f"{filler} {' '.join(item)} {filler}"), (11, filler), (12, " ".join(item[:38])), (13, " ".join(item[:20] + ["x"] + item[21:])), (14, " ".join(item[:33])), (15, "TWO, (words) one"), (16, None), (17, ""), (18, " | ".join(item)), (19, "K L M N O P Q R S T"), (20, "w1"), (21, " ".join(item[:10] + ["x"] + item[11:30] + ["y"] + item[31:]))]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.leaks(df, benchmark).collect())) == items_in(docs, items)
    leaked = {d for d, *_ in items_in(docs, items)}
    kept = decontaminate.clean(df, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in leaked) and kept.columns == df.columns


def test_nothing_in_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "x y"), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == 3
    items = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.leaks(docs, items).collect()] == [(None, 1, 1, 1)]
    assert decontaminate.leaks(docs.limit(0), items).count() == 0


def test_a_benchmark_too_large_to_send_is_joined(spark, monkeypatch):
    """Items of some three times what is sent to all tasks (here a sixteenth of the usual), of which every tenth lies in a document, one in many."""
    monkeypatch.setattr(decontaminate.contained, "__defaults__", ("contained", decontaminate.THRESHOLD, decontaminate.ITEM_BYTES // 16))
    n = 3 * decontaminate.ITEM_BYTES // 16 // 400
    words = F.transform(F.sequence(F.lit(0), F.lit(44)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(10_000_000)).cast("string")))
    items = spark.range(0, n, 1, 8).select(F.col("id").alias("item_id"), F.concat_ws(" ", words).alias("text"))
    held = items.where("item_id % 10 = 0")
    docs = held.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before it "), "text", F.lit(" and after it")).alias("text")).unionByName(spark.range(500).select((-F.col("id") - 1).alias("doc_id"), F.lit("copies of " ).alias("text")).crossJoin(held.where("item_id = 0").select(F.col("text").alias("t"))).select("doc_id", F.concat("text", "t").alias("text")))
    found = decontaminate.leaks(docs, items)
    assert found.count() == held.count() + 500
    assert found.where("n_found = n_shingles AND (item_id = doc_id OR (doc_id < 0 AND item_id = 0))").count() == held.count() + 500


def test_sketches_have_what_a_containing_text_cannot_miss():
    for n in range(1, 200):
        missing = n - decontaminate.needed(n, 0.8)
        assert missing <= 0.2 * n + 1e-9 and decontaminate.needed(n, 0.8) >= 0.8 * n - 1e-9
