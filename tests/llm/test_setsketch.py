import re

import numpy as np
import pytest

from wayglass.llm import setsketch

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def set_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def brute(docs):
    sets = [set_of(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: (len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(docs)}


def edited(rng, words, share):
    out = list(words)
    for i in rng.choice(len(out), int(share * len(out)), replace=False):
        out[i] = f"new{int(rng.integers(1 << 40))}"
    return out


def corpus(seed, groups=25, copies=14):
    """Groups of texts that differ in about as many words as a link allows, chains of such, exact copies and strangers."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{int(x)}" for x in rng.integers(0, 3000, int(rng.integers(3, 160)))]
        for _ in range(int(rng.integers(1, copies))):
            base = edited(rng, base, float(rng.uniform(0, 0.05)))
            texts.append(" ".join(base))
            if rng.random() < 0.3:
                texts.append(" ".join(base).upper())
    order = rng.permutation(len(texts))
    return [(int(i) * 3 + 1, texts[int(j)]) for i, j in enumerate(order)]


def found_of(spark, docs):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, component_id string, n_shingles int")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(df).collect()}


def test_components_match_brute_force(spark):
    docs = corpus(1)
    assert found_of(spark, docs) == brute(docs)


def test_large_groups_are_dealt_out_and_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(setsketch, "PART", 8)
    monkeypatch.setattr(setsketch, "PART_SHINGLES", 700)
    base = [f"b{i}" for i in range(60)]
    close = [" ".join(edited(rng, base, 0.02)) for _ in range(60)]  # all near the first
    chain, far = list(base), []
    for i in range(24):  # each near the one before, few near the first
        chain = edited(rng, chain, 0.035)
        far.append(" ".join(chain))
    docs = list(enumerate(close + far)) + [(1000 + d, t) for d, t in corpus(6, 6, 6)]
    want = brute(docs)
    assert len({c for d, (_, c) in want.items() if 60 <= d < 84}) >= 1
    assert found_of(spark, docs) == want


def test_odd_rows(spark):
    long = " ".join(f"v{i % 70_001}" for i in range(300_000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "É b c d"), (8, "é b c d"), (9, long), (10, long + " end"), (11, "a b c d"), (12, "a b c d")]
    assert found_of(spark, docs) == brute(docs)
    df = spark.createDataFrame([(1, "a b c d e"), (1, "p q r s t"), (1, "p q r s t"), (4, "a b c d e"), (5, "p q r s t"), (None, "a b c d e"), (None, "k l m n"), (None, None)], "doc_id long, text string")
    rows = sorted((str(r.doc_id), str(r.component_id)) for r in setsketch.near_duplicates(df).collect())
    assert rows == sorted([("1", "1")] * 3 + [("4", "1"), ("5", "1"), ("None", "1"), ("None", "None"), ("None", "None")])
    assert setsketch.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.8, 0.85, 0.95])
def test_sketches_estimate_merge_and_keep_what_may_link(share):
    rng = np.random.default_rng(int(100 * share))
    for n in (5, 60, 4000):
        m = int(round(2 * n / (1 + share) - n))  # n shared of n + m each: about this similarity
        pool = rng.integers(0, 1 << 63, n + 2 * m, np.uint64)
        a, b = pool[: n + m], np.concatenate((pool[:n], pool[n + m :]))
        x, y = setsketch.registers(a), setsketch.registers(b)
        assert (np.maximum(x, y) == setsketch.registers(np.unique(np.concatenate((a, b))))).all()
        ask = lambda p, q, i, j: setsketch.may_link(np.array([(p > q).sum()]), np.array([(p < q).sum()]), np.array([i]), np.array([j]))[0]
        if 100 * n >= 80 * (n + 2 * m):
            assert ask(x, y, n + m, n + m)
        far = setsketch.registers(rng.integers(0, 1 << 63, n + m, np.uint64))
        assert not ask(x, far, n + m, n + m)
