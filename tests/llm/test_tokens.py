import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayglass.llm import shared, token_shards, word_bpe

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "it's <|endoftext|> x, don't'' WO'LL, ÀB. ß! straße, ﬁne １２ naïve… éa, b's. I'd!! #x*,",
    "a​b c\xa0d İx Ǆ. ÿ, µ. ª!  two  blanks\n\n\nlines\t\ttabs \r\n end ",
    "",
    None,
    "   ",
    "🙂🙂 \x00\x1f 中文字 <|startoftext|>",
    "word " * 3000 + "x" * 5000,
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(-5, "first"), (3, "again"), (3, "again"), (None, "no id"), (None, None)]


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_shards_hold_what_the_tokenizer_says(spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, ids string, key int")
    manifest = token_shards.write(spark, df, folder, WORDS)
    tokenizer = plain(WORDS)
    want = {}
    for doc, text in ROWS:
        want.setdefault(doc, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2])
    found = token_shards.lookup(spark, folder, df.select("doc_id").distinct()).collect()
    assert len(found) == len(ROWS) and manifest["keys"] == len(want)
    got = {}
    for r in sorted(found, key=lambda r: r.start):
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.n_tokens == len(ids)
        got.setdefault(r.doc_id, []).append(ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    starts = [r.start for r in sorted(found, key=lambda r: r.start)]
    assert starts == np.cumsum([0, *[r.n_tokens for r in sorted(found, key=lambda r: r.start)]])[:-1].tolist()
    unknown = spark.createDataFrame([(77,), (10**12,)], "doc_id long")
    assert token_shards.lookup(spark, folder, unknown).count() == 0
    assert [x.tolist() for x in token_shards.get(folder, -5)] == want[-5] and token_shards.get(folder, 99) == []


def test_empty_table_gives_no_shards(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_shards.write(spark, df, folder, WORDS)["shards"] == []
    assert token_shards.lookup(spark, folder, spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_perfect_hash_is_minimal_and_tells_strangers_apart():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    at = np.arange(len(keys))
    index = token_shards.Mph.load(b"".join(token_shards.Mph.build(keys, at % 7, at, at + 1).parts()))
    assert sorted(index.slot(keys).tolist()) == list(range(len(keys)))
    found = index.find(keys)
    assert (found["ordinal"] == at).all() and (found["count"] == at + 1).all()
    strangers = np.setdiff1d(rng.integers(0, 1 << 63, 20_000).astype(np.uint64), keys)
    assert (index.find(strangers)["count"] > 0).mean() < 1e-3


def test_query_one_over_the_whole_table(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    tokenizer = plain(WORDS)
    start, want = 0, []
    for r in sorted(spark.read.parquet(f"{d}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, e.queries()["op1_token_shards"](spark, d).collect())) == want


def test_bpe_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, decoded string")
    tokenizer = plain(BYTES)
    found = word_bpe.round_trip(df, BYTES).collect()
    assert len(found) == len(ROWS)
    want = []
    for doc, text in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((doc, text, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, r.text, r.ids, r.decoded) for r in found), key=str) == sorted(want, key=str)
    assert word_bpe.round_trip(df.limit(0), BYTES).count() == 0


def test_query_six_over_the_whole_table(spark):
    import hashlib

    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    tokenizer = plain(BYTES)
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in e.queries()["op6_word_bpe"](spark, d).collect()} == want


def test_words_are_encoded_in_calls_of_a_bounded_size():
    class Counting:
        def __init__(self, own):
            self.own, self.sizes = own, []

        def encode_batch_fast(self, words, **options):
            self.sizes.append(len(words))
            return self.own.encode_batch_fast(words, **options)

    bpe, text = word_bpe.WordBpe(BYTES), " ".join(f"w{i}é" for i in range(12_001))
    bpe.tokenizer = Counting(bpe.tokenizer)
    for part in (text[:30], text, "once more " + text):
        ids, counts = bpe.encode([part])
        assert ids.tolist() == plain(BYTES).encode(part, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
        assert bpe.decode(ids, counts) == [part]
    assert max(bpe.tokenizer.sizes) <= 5_000 and sum(bpe.tokenizer.sizes) < 12_010


@pytest.mark.parametrize("cap", [3, 10**6])
def test_word_tables_start_anew_without_changing_results(cap):
    bpe = word_bpe.WordBpe(BYTES)
    bpe.table.cap = cap
    for text in ["a b c d e f", "d e f g a", "zz a"]:
        ids, counts = bpe.encode([text, text])
        assert bpe.decode(ids, counts) == [text, text] and ids[: counts[0]].tolist() == bpe.tokenizer.encode(text).ids


def test_few_and_many_facts_join_alike(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    facts = spark.createDataFrame([("a", True), ("c", False)], "k string, f boolean")
    want = [("a", 1, True), ("a", 2, True), ("b", 3, None), (None, 4, None)]
    assert sorted(map(tuple, shared.join_facts(rows, facts, "k").collect()), key=str) == sorted(want, key=str)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, shared.join_facts(rows, facts, "k").collect()), key=str) == sorted(want, key=str)
