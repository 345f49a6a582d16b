import math
import re
from collections import Counter

import numpy as np

from wayglass.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(UP))


def best(docs, items, k=20):
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    n = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in items:
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if s > 0:
                scores.append((-s, d if d is not None else float("inf"), d))
        out |= {(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2])[:k])}
    return out


def rows_of(df):
    found = df.collect()
    out = {(r.item_id, r["rank"], r.doc_id, r.score) for r in found}
    assert len(out) == len(found)
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, item_id string"), spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, rank int")


def random_texts(n, seed, words=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, int(rng.integers(0, 120))), words)) for _ in range(n)]


def test_ranking_matches_brute_force(spark, monkeypatch):
    docs = list(enumerate(random_texts(3000, 1)))
    items = [(i, t) for i, t in enumerate(random_texts(40, 2))] + [(100, "w1 w1 w1 w2"), (101, "nothing here")]
    want = best(docs, items)
    assert rows_of(ranked_search.search(*frames(spark, docs, items))) == want
    monkeypatch.setattr(ranked_search, "BLOCK_CHARS", 2000)  # several goes
    assert rows_of(ranked_search.search(*frames(spark, docs, items))) == want


def test_probing_drops_documents_and_loses_none():
    texts = [t.encode() for t in random_texts(4000, 3)]
    words = ranked_search.Words([t.encode() for t in random_texts(30, 4)])
    lengths, document, code, n = words.count(texts)
    holding = np.bincount(code, minlength=len(words.code))
    weights = np.array([ranked_search.weight(4000, int(h)) for h in holding], np.int64)
    share = 1_000_000_000 * n // (1000 * n + 12 * (75 + 25 * lengths * 4000 // lengths.sum())[document])
    shard = ranked_search.Shard(np.arange(4000), document, code, share, len(words.code))
    for codes, times in words.items:
        every, scores = shard.best(codes, weights[codes] * times, 1)
        if len(every):
            for least in (int(np.sort(scores)[-min(20, len(scores))]), int(scores.max()), int(scores.max()) + 1):
                found, new = shard.best(codes, weights[codes] * times, least)
                assert dict(zip(found, new, strict=True)) == {d: s for d, s in zip(every, scores, strict=True) if s >= least}


def test_odd_rows(spark):
    long = "gold mine " * 200_000
    docs = [(3, "Gold"), (1, "gold"), (1, "gold"), (None, "gold"), (7, None), (8, ""), (9, "... --"), (5, "GOLD é mine"), (6, long), (2, "ÉÉ É éé")]
    items = [(1, "gold mine"), (2, None), (3, ""), (1, "gold mine"), (4, "é éé"), (None, "mine"), (4, "ÉÉ")]
    found = ranked_search.search(*frames(spark, docs, items))
    want = best(docs, [(1, "gold mine"), (4, "é éé"), (4, "ÉÉ"), (None, "mine")])
    assert {(r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()} == want
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    d, i = frames(spark, docs, items)
    assert ranked_search.search(d.limit(0), i).count() == 0 and ranked_search.search(d, i.limit(0)).count() == 0
