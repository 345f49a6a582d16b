import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayglass.llm import toxicity

D, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
INSULTS = ["worthless", "dimwit", "scumbag"]


def corpus(spark, n=300):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioubcdlmnprst") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if i % 3 == 0:
            w = rng.choice(INSULTS)
            text.insert(rng.randrange(len(text)), rng.choice([w, w.upper(), "*".join(w), w[:3] + "." + w[3:]]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), words


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels, words = corpus(spark)
    return toxicity.train(docs, labels), words


def test_gapped_and_spelled_out_insults_are_found(spark, trained):
    model, words = trained
    plain = " ".join(words[:40])
    said = ["w-o-r-t-h-l-e-s-s", "wor*th*less", "d i m w i t", "scummbag", "SCUMBAG!"]
    rows = [(i, f"{plain} {w} {plain}") for i, w in enumerate(said)] + [(100 + i, " ".join(words[20 * i : 20 * i + 30])) for i in range(15)]
    found = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [found[i].predicted for i in range(len(said))] == [1] * len(said)
    assert sum(found[100 + i].predicted for i in range(15)) <= 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())


def test_nulls_repeats_clashes_and_empty_tables(spark, trained):
    model, words = trained
    rows = [(None, None, "x", 5.0), (1, "", "x", 5.0), (1, "", "x", 5.0), (2, "worthless " * 20000, "x", 5.0), (3, "\x00 🙂 ..", "x", 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, worst string, score double")
    out = toxicity.score(df, model)
    found = out.collect()
    assert out.columns == ["doc_id", "text", "worst", "score", "predicted"] and len(found) == 5
    assert {r.doc_id: r.predicted for r in found} == {None: 0, 1: 0, 2: 1, 3: 0}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_without_both_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "bad words"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1), (2, 1)], [(1, 0)], [(None, 1), (1, None)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0, 0]


def test_kernel_is_the_cosine_of_weighted_subsequences():
    def features(word):
        text = "^" + word + "$"
        out = {}
        for i in range(len(text)):
            for j in range(i + 1, len(text)):
                for k in range(j + 1, min(len(text), i + toxicity.SPAN)):
                    key = text[i] + text[j] + text[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    words = ["idiot", "idiiot", "plum", "lump", "to"]
    got = toxicity.kernel(words, words)
    owner, _, weight = toxicity.subsequences(words)
    assert np.allclose(np.bincount(owner, weight**2), 1)
    assert (np.diag(got) >= 1 - 1e-5).all() and got[0, 1] > 0.5 > got[0, 2] and np.allclose(got, got.T, atol=1e-5)
    shared = lambda a, b: sum(v * features(b).get(k, 0) for k, v in features(a).items())
    assert (got[0, 1] > got[0, 3]) == (shared("idiot", "idiiot") > shared("idiot", "lump"))


def test_scores_match_brute_force(spark, trained):
    """Every word by plain enumeration, the worst three and the counts, and the logistic step."""
    model, words = trained
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))

    def word_score(word):
        text, total, norm = "\0" + word + "\U0010ffff", 0.0, 0.0
        for i in range(len(text)):
            for j in range(i + 1, len(text)):
                for k in range(j + 1, min(len(text), i + toxicity.SPAN)):
                    w = toxicity.DECAY ** (k - i - 2)
                    total += w * weights.get((ord(text[i]) << 42) | (ord(text[j]) << 21) | ord(text[k]), 0.0)
                    norm += w * w
        return total / norm**0.5 + model.bias if len(word) >= 2 else toxicity.FLOOR

    def doc_score(text):
        said = ["".join(c for c in w.lower() if c.isalpha()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        runs = {m.group().replace(" ", "") for m in re.finditer(r"(?<!\S)\S(?: \S){2,}(?!\S)", " ".join(w or "--" for w in said))}
        each = [word_score(w) for w in said]
        spelled = [word_score(r) for r in runs]
        top = sorted([word_score(w) for w in _by_word(text)] + spelled, reverse=True)[: toxicity.WORST]
        top += [toxicity.FLOOR] * (toxicity.WORST - len(top))
        bad = sum(x > toxicity.BAD for x in each + spelled)
        logit = sum(c * x for c, x in zip(model.document, [*top, np.log1p(bad), np.log1p(len(said)), 1.0], strict=True))
        return 1 / (1 + np.exp(-logit))

    def _by_word(text):  # words that are the same, as written, count once among the worst
        return ["".join(c for c in w.lower() if c.isalpha()) for w in set(re.findall(r"[^\x20\x09-\x0D]+", text or ""))]

    texts = [None, "", "x", "W-O-R-T-H-L-E-S-S words", "d i m w i t and s c u m b a g", " ".join(words[:30]), "scumbag Scumbag scumbag " + words[0], "ωorthless 無価値 тупица dimwit", "a b", " ".join(words[5:50]) + " dimmwit"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all(abs(found[i] - doc_score(t)) < 1e-9 for i, t in enumerate(texts)), [(i, found[i], doc_score(t)) for i, t in enumerate(texts)]


def test_letters_of_other_scripts_are_told_apart(spark):
    docs = [(i, f"слово дом река {'тупица' if i % 2 else 'окно'} поле день {'ж' * (i % 5 + 2)}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int"))
    said = spark.createDataFrame([(0, "день ту-пица река поле"), (1, "день окно река поле"), (2, "день тупиица поле")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(said, model).collect()} == {0: 1, 1: 0, 2: 1}


def test_held_out_accuracy(spark):
    import __spark_entry__ as e

    found = {r.doc_id: r for r in e.queries()["op5_toxicity"](spark, LARGER).collect()}  # 825 held-out labels; the smaller table has 70, 6 of them toxic
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    labels = [(found[r.doc_id].predicted, r.toxic, found[r.doc_id].score) for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if found[r.doc_id].held_out]
    right = sum(p == t for p, t, _ in labels) / len(labels)
    toxic, clean = [s for _, t, s in labels if t], [s for _, t, s in labels if not t]
    order = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert right >= 0.95 and order >= 0.9, (right, order)


def test_labels_of_held_out_rows_are_never_read(spark):
    import __spark_entry__ as e

    assert "held_out" in e.queries()["op5_toxicity"].__code__.co_names
    docs, labels, _ = corpus(spark, 120)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x.where(~toxicity.held_out())) for x in (labels, flipped))
    assert np.array_equal(a.keys, b.keys) and np.array_equal(a.weights, b.weights) and np.array_equal(a.document, b.document)


def test_pipeline_stages(spark):
    import corpus_pipeline

    from wayglass.llm import decontaminate, line_dedup, simhash, word_bpe
    from wayglass.llm.shared import saved

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontaminate", "word_bpe"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(saved(stage(spark, seen[-1], D), name))
    raw, calm, cut, single, clean, tokens = seen
    assert all(x.columns == docs.columns for x in seen[:5])
    toxic = {r.doc_id for r in spark.read.parquet(f"{D}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & ids(calm)) <= 0.5 * len(toxic) and len(ids(calm)) >= 0.85 * len(ids(raw))
    assert ids(cut) == ids(calm) and line_dedup.repeats(cut).count() == 0
    assert cut.where(F.length("text") != F.col("n_chars")).count() == 0
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(cut).collect()}
    assert ids(single) == set(groups.values())
    leaked = {r.doc_id for r in decontaminate.leaks(single, spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
    assert leaked and ids(clean) == ids(single) - leaked
    assert ids(tokens) == ids(clean)
    back = {r.doc_id: r.decoded for r in word_bpe.round_trip(clean, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert back == {r.doc_id: r.text for r in clean.collect()}
    assert ids(corpus_pipeline.run(spark, D)) == ids(clean)


def test_stages_take_nulls_repeats_clashing_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs, labels, words = corpus(spark, 120)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words[50:90]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = " ".join(words[:30])
    rows = [(None, None, 7, 7.0, "n"), (1000, None, 7, 7.0, "n"), (1000, None, 7, 7.0, "n"), (1001, "", 7, 7.0, "e"), (1002, plain, 7, 7.0, "a"), (1002, plain, 7, 7.0, "a"), (1003, " ".join(words[40:95]), 7, 7.0, "leak"), (1004, "long " * 50000, 7, 7.0, "l")]
    extra = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, score double, fingerprint string")
    mixed = docs.selectExpr("doc_id", "text", "7 AS n_lines", "7.0D AS score", "'f' AS fingerprint").unionByName(extra)
    mixed.cache()
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, mixed.limit(0), str(tmp_path))
        assert empty.count() == 0
        found = stage(spark, mixed, str(tmp_path))
        if name == "word_bpe":
            assert found.count() == mixed.count()
            continue
        assert found.columns == mixed.columns and empty.columns == mixed.columns
        assert {(r.n_lines, r.score) for r in found.select("n_lines", "score").distinct().collect()} == {(7, 7.0)}
        kept = [r.doc_id for r in found.where("doc_id >= 1000").collect()]
        if name == "toxicity":  # what a machine of so few documents says of the others is not fixed
            assert sorted(kept)[:3] == [1000, 1000, 1001] and kept.count(1002) in (0, 2)
            continue
        want = {"line_dedup": [1000, 1000, 1001, 1002, 1002, 1003, 1004], "simhash": [1000, 1002, 1003, 1004], "decontaminate": [1000, 1000, 1001, 1002, 1002, 1004]}
        assert sorted(kept) == want[name], name
    assert corpus_pipeline.ORACLE_SQL is None
