import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wayglass.llm import token_align
from wayglass.llm.queries import op11_token_align

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(ids, lengths):
    at, out = 0, []
    for i in ids:
        out.append((i, at, at + lengths[i]))
        at += lengths[i]
    return out


def brute(texts):
    """Whole texts encoded as they are, all pairs of tokens compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    bytes_a = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    bytes_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    each, counts = [], Counter()
    for text in texts:
        want = f" {text}".encode() if text else b""
        x, y = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or b"".join(bytes_a[i] for i in x) != want or b"".join(bytes_b[i] for i in y) != want:
            each.append(None)
            continue
        x, y = spans(x, {i: len(v) for i, v in bytes_a.items()}), spans(y, {i: len(v) for i, v in bytes_b.items()})
        cuts = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in (x, y)))
            start = cut
        links, k = [], 0
        for i, s, e in x:
            while k < len(y) and y[k][2] <= s:
                k += 1
            j = k
            while j < len(y) and y[j][1] < e:
                links.append((i, y[j][0]))
                j += 1
        counts.update(links)
        each.append((len(x), len(y), groups, links))
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    out = []
    for found in each:
        if found is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = found
            best = sum(counts[p] == highest[p[1]] for p in links)
            out.append((n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), ";".join(groups)))
    return out


ODD = [None, "", " ", "a", "  two  blanks ", "line\none\r\n\r\ntwo;\r\n x\t\ty", "<|endoftext|> and </s><s> <unk> <0x41>", "a▁b changes", "▁", "é é ﬁ １  x　y", "日本語のテキスト 🙂🙂 ünï", "x" * 3000, "} );\r {\r\r a \r b", "\x00 \x1c\x85  end ", "word " * 500, "no​break﻿"]


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, *(r[c] for c in token_align.SUMS), r.groups) for r in df.collect())


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_odd_texts_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(token_align, "MAX_PAIRS", most)
    monkeypatch.setattr(token_align, "WORDS", 8)  # tables start anew
    texts = [*ODD, "a", "word word"]
    df = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a int")
    want = sorted((-1 if i == 3 else i, *w) for i, w in enumerate(brute(texts)))
    assert rows_of(token_align.align(df, *PATHS, text=True)) == want
    assert token_align.align(df.limit(0), *PATHS).count() == 0


def test_whole_table_matches_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(docs, brute([r.text for r in docs]), strict=True)}
    found = op11_token_align(spark, folder).collect()
    assert {r.doc_id: (*(r[c] for c in token_align.SUMS), r.groups_sha256) for r in found} == want


def test_relational_links_of_whole_documents(spark):
    """links() over documents' own tokens, all pairs of overlapping ranges compared."""
    both = token_align.Tokenizers(*PATHS)
    rows = []
    for d, text in enumerate(t for t in ODD if t):
        ids, _, good = both.encode([f" {text}"])
        if good[0]:
            for side, ids in enumerate(ids):
                rows += [(d, side, k, int(i), int(both.lengths[side][i])) for k, i in enumerate(ids)]
    found = token_align.links(spark.createDataFrame(rows, "doc long, side int, pos int, id int, len int"), ["doc"]).collect()
    want, groups = Counter(), Counter()
    for d in {r[0] for r in rows}:
        x, y = (spans([r[3] for r in rows if r[:2] == (d, side)], both.lengths[side]) for side in (0, 1))
        want.update((d, i, j) for i, s, e in x for j, p, q in y if s < q and p < e)
        groups[d] = len({e for _, _, e in x} & {e for _, _, e in y})
    assert Counter((r.doc, r.a, r.b) for r in found) == want
    assert {d: len({r.group for r in found if r.doc == d}) for d in groups} == groups
    counts = token_align.pair_counts(spark.createDataFrame([(1, 2, 3), (1, 2, 1), (5, 2, 4), (6, 2, 1)], "a int, b int, n int"), F.col("n")).collect()
    assert sorted((r.a, r.b, r["count"], r.best) for r in counts) == [(1, 2, 4, True), (5, 2, 4, True), (6, 2, 1, False)]
