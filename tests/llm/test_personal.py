import re

import pytest
from pyspark.sql import functions as F

from wayglass.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_of(text):
    spans = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if right(k, m.group())]
    return sorted(spans)


def run(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string" + extra)
    return [(r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in personal.find(df).collect()]


TEXTS = [
    None,
    "",
    "é a@b.co, x.y@z.org.uk. a@b a@.c a@b.c_d@e.f a@b.c.@d.e %+@x-y.z--",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 1.256.1.1 001.02.3.0004 1.2.3 999.1.2.3.4.5",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 0000000000000 12 3 4",
    "4465758382889437 4465758382889437 +1 (771) 555-1655 On +12 +1 23456789 0 + 1 +1( ) 2 ++123456789-",
    "ünï +1.2.3.4@5.6 12.34.56.78@9.ab 4111111111111111@x.yz 🙂 10.0.0.1🙂 a🙂b@c.de",
    "a.b" * 3000 + "@" + "c.d" * 3000,
    "1 " * 20000,
    "9" * 30000 + " 1.1.1.1",
    "7." * 9000,
]


def test_known_formats_match_brute_force(spark):
    found = run(spark, list(enumerate(TEXTS)))
    assert len(found) == len(TEXTS)
    for i, base, spans in found:
        assert base == base_of(TEXTS[i] or ""), i
        assert set(base) <= set(spans)


def test_query_over_whole_table(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    import hashlib

    rows = e.queries()["op10_personal"](spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_of(texts[r.doc_id])
        said = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"word{'abcdefgh'[i]} some text\nplease call me at +1 (555) 555-01{i}0 today") for i in range(8)]
    rows += [(100, "stuff please call me at (555) 0199-222 soon"), (101, "there were 55,000 people and 123456 more"), (102, "mail: jo99")]
    found = {d: (base, spans) for d, base, spans in run(spark, rows)}
    text = dict(rows)
    (start, kind, end), = found[100][1]
    assert personal.KINDS[kind] == "phone" and text[100][start:end] == "(555) 0199-222"
    assert found[100][0] == [] and found[101] == ([], []) and found[102] == ([], [])
    assert all(found[i][0] == found[i][1] and len(found[i][0]) == 1 for i in range(8))


def test_mixed_contexts_are_not_trusted(spark):
    kinds = ["+1 (555) 555-0{}10", "10.0.0.{}", "a{}@b.co"]
    rows = [(10 * j + i, "we saw the " + k.format(i) + " there") for j, k in enumerate(kinds) for i in range(1, 8)]
    rows.append((900, "we saw the 1234-55 there"))
    assert [s for d, _, s in run(spark, rows) if d == 900] == [[]]


@pytest.mark.parametrize("unknown", [20, 100, 200])
@pytest.mark.parametrize("contexts", [["so we met at {} again"], ["so we met at {} again", "then it was on {} there"]])
def test_few_seeds_do_not_turn_a_common_context(spark, unknown, contexts):
    seen = [f"a{i}@b.co" for i in range(4)] + [f"20{i // 12:02d}-{i % 12 + 1:02d}-11" for i in range(unknown)]
    rows = list(enumerate(c.format(x) for c in contexts for x in seen))
    assert [(d, s) for d, base, s in run(spark, rows) if s != base] == []


def test_instances_vouched_for_elsewhere_carry_a_context(spark):
    local = [f"(555) 0199-22{i}" for i in range(6)]
    first = [f"+1 (555) 555-01{i:02d}" for i in range(20)]
    texts = [f"please call me at {x} today" for x in first + local] + [f"or by fax {x} if so" for x in first[:4] + local + ["(555) 0177-333"]]
    rows = list(enumerate(texts))
    missed = [texts[d] for d, _, s in run(spark, rows) if len(s) != 1 or personal.KINDS[s[0][1]] != "phone"]
    assert missed == []


def test_nulls_repeats_empty_table_and_clashing_names(spark):
    assert run(spark, []) == []
    rows = [(None, "a@b.co", "x", 1), (None, "a@b.co", "x", 1), (3, None, None, None), (3, "1.1.1.1 z", "y", 2), (3, "1.1.1.1 z", "y", 2)]
    found = run(spark, rows, ", base string, known int")
    assert sorted((d or -1, b) for d, b, _ in found) == [(-1, [(0, 0, 6)])] * 2 + [(3, []), (3, [(0, 1, 7)]), (3, [(0, 1, 7)])]


@pytest.mark.parametrize("digits,passes", [("79927398713", True), ("79927398710", False), ("4111111111111111", True)])
def test_luhn(spark, digits, passes):
    assert spark.range(1).select(personal.luhn(F.lit(digits))).first()[0] is passes


def test_a_text_of_many_identifiers_takes_time_in_line_with_its_length(spark):
    import time

    text = " ".join(f"mail user{i}@example.com and id {i}x{i} at" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, "user1@example.com"), (3, None)], "doc_id long, text string")
    began = time.perf_counter()
    found = {r.doc_id: (len(r.base), len(r.spans)) for r in personal.find(df).collect()}
    assert found[1][0] == 20_000 and found[2] == (1, 1) and found[3] == (0, 0)
    assert time.perf_counter() - began < 90


def test_candidates_that_touch_a_known_span_go(spark):
    text = "a12345 and user@x.org,b99999 then +1 (234) 567-8901 9 or c55555 at 10.0.0.1:80801 in end77777"
    row = personal.read(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = [(s.start, s.end) for s in row.known]
    assert spans and all(text[m.start : m.end] == m.match for m in row.others)
    assert {m.match for m in row.others} == {"a12345", "c55555", "end77777"}
    assert all(e <= m.start or m.end <= s for m in row.others for s, e in spans)
