import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from wayglass.functions import text as T
from wayglass.functions import unicode as U
from wayglass.operators import dictionary
from wayglass.operators import observations as O
from wayglass.operators import progress, rankings

NAMES = ["Dharalion", "Hirintror", "Midnight Panther"]
NOW = 1_791_241_200_000  # 2026-10-05T20:00-03:00


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)], "name string, seq int")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_foldings_differ(spark):
    row = spark.range(1).select(T.canonical(F.lit("Ção É-1")), T.plain_key(F.lit("Ção É-1")), T.fold(F.lit("Ção É-1")), T.screen_fold(F.lit("‎Ção   X‏ ")), T.fold(F.lit("é"))).first()
    assert tuple(row) == ("caoe1", "o1", "cao e-1", "cao x", "e")


def parse(spark, names, text, date="2026-10-05", time="", default="vazio"):
    df = spark.createDataFrame([(1, text, date, time, default)], "id int, text string, date string, time string, default_result string")
    return O.parse_reports(df, names).orderBy("line", "part").collect()


def test_headings_carry_and_aliases_match(spark, names):
    rows = parse(spark, names, "Não estavam:\nDharalion\nHirintror\nEstavam:\npantera")
    assert [(r.boss, r.result, r.time) for r in rows] == [("Dharalion", "vazio", ""), ("Hirintror", "vazio", ""), ("Midnight Panther", "encontrado", "")]


def test_stamps_unknown_names_and_lists(spark, names):
    (row,) = parse(spark, names, "[09:10, 05/10/2026] Pessoa: Dharalion não estava")
    assert (row.boss, row.time, row.date, row.result) == ("Dharalion", "09:10", "2026-10-05", "vazio")
    (row,) = parse(spark, names, "Nome estranho")
    assert row.boss == ""
    rows = parse(spark, names, "Dharalion, hirintror; pantera ✅")
    assert [(r.boss, r.result) for r in rows] == [(n, "encontrado") for n in NAMES]
    assert parse(spark, names, None) == [] and parse(spark, names, " \n\n") == []


def test_reports_in_capitals_and_after_any_white_space(spark, names):
    rows = parse(spark, names, "NÃO ESTAVAM:\nDharalion\nESTAVAM:\nHirintror", default=None)
    assert [(r.boss, r.result) for r in rows] == [("Dharalion", "vazio"), ("Hirintror", "encontrado")]
    rows = parse(spark, names, "Dharalion NÃO ESTAVA\nNÃO ENCONTRADO: Hirintror\nBOSSES\u00a0AUSENTES:\npantera", default=None)
    assert [(r.boss, r.text, r.result) for r in rows] == [("Dharalion", "Dharalion", "vazio"), ("Hirintror", "Hirintror", "vazio"), ("Midnight Panther", "pantera", "vazio")]
    for before in ("\t", "\u00a0", "\ufeff \u3000", "\u2003"):
        (row,) = parse(spark, names, f"{before}[09:10, 05/10/2026] Pessoa:{before}Dharalion{before}", date="2026-01-01")
        assert (row.boss, row.time, row.date, row.text) == ("Dharalion", "09:10", "2026-10-05", "Dharalion")
    (row,) = parse(spark, names, "•\u202fDharalion\u00a0=\u00a0vazio")
    assert (row.boss, row.result) == ("Dharalion", "vazio")


def test_decomposition_is_that_of_the_character_database(spark):
    """All characters of the first plane and some beyond, and marks in any order."""
    points = [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x11000, 0x11800), *range(0x1D100, 0x1D300), *range(0x2F800, 0x2FA20)]
    rng, marks = random.Random(3), [c for c in map(chr, range(0x10000)) if unicodedata.combining(c)]
    mixed = ["".join(rng.choice(marks) if rng.random() < 0.6 else chr(rng.choice(points)) for _ in range(9)) for _ in range(2000)]
    df = spark.createDataFrame([(c,) for c in [*map(chr, points), *mixed, "", "abc é ñ", None]], "c string")
    for r in df.select("c", U.nfd(F.col("c")).alias("whole"), U.bare(F.col("c")).alias("bare")).collect():
        want = None if r.c is None else unicodedata.normalize("NFD", r.c)
        assert r.whole == want, ascii(r.c)
        assert r.bare == (None if want is None else "".join(x for x in want if not 0x300 <= ord(x) <= 0x36F)), ascii(r.c)


def test_every_mark_is_one_by_kind_and_units_are_counted_where_it_matters(spark):
    marks = [chr(i) for i in range(0x110000) if unicodedata.combining(chr(i))]
    df = spark.createDataFrame([(c,) for c in marks], "c string")
    assert len(marks) > 800 and df.where(F.col("c").rlike(U._MAYBE_MARK)).count() == len(marks)
    texts = [x * n + y for x in ("a", "\u00e9", "\U0001f409") for n in range(8) for y in ("", "b", "\U0001f409")]
    told = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[U.longer(F.col("t"), n).alias(f"n{n}") for n in (0, 1, 4, 5)]).collect()
    assert all(r[f"n{n}"] == (len(r.t.encode("utf-16-le")) // 2 > n) for r in told for n in (0, 1, 4, 5))


def test_pages_and_numbers_by_the_providers_marks(spark):
    page = "a<script>x</script>b <i>Ganho 24h</i>: 5 <SCRIPT src=1>\n</Script>c<>\u00a0 Ganho 7 dias −1.234 Ganho 30 dias +. end "
    text = one(spark, T.html_text(F.lit(page)))
    assert text == "ab Ganho 24h : 5 c Ganho 7 dias −1.234 Ganho 30 dias +. end "
    assert one(spark, T.labelled_number(F.lit(text), "Ganho 24h")) is None
    assert one(spark, T.labelled_number(F.lit(text), "Ganho 7 dias")) == -1234
    assert one(spark, T.labelled_number(F.lit("total . x"), "total")) == 0
    assert one(spark, T.labelled_number(F.lit("total 9.007.199.254.740.992"), "total")) is None


def test_chat_stamps(spark):
    cases = {"[9:12 PM, 05.10.2026]": ("21:12", "2026-10-05"), "[10:12\u202fpm,\u00a005-10-26]": ("22:12", "2026-10-05"), "[10:75, 05/10/2026]": (None, None), "[24:00, 05/10/2026]": (None, None), "[10:12, 05/10/202]": (None, None), "x [0:12 am, 5/1/2026] Ana:": ("00:12", "2026-01-05"), "[23:55, 05/10/2026]": ("23:55", "2026-10-05"), "[9:12, 05/10/26]": ("09:12", "2026-10-05"), "[10:12 PM, 05/10/2026]": ("22:12", "2026-10-05"), "[10:12, 30/02/2026]": (None, None), "nothing": (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    found = {r.m: tuple(r.s) for r in df.select("m", T.chat_stamp(F.col("m")).alias("s")).collect()}
    assert found == cases


def test_only_explicit_messages_report(spark, names):
    texts = ["Não estavam:\nDharalion\nEstavam:\nHirintror", "Dharalion", "Vou checar Dharalion", "Dharalion estava?", "Ontem achei Dharalion", "[Foto sem nome de boss]", "bom dia", None]
    df = spark.createDataFrame([(i, t, "2026-10-05", "10:00") for i, t in enumerate(texts)], "id int, text string, date string, time string")
    rows, state = O.read_messages(df, names)
    assert sorted((r.id, r.boss, r.result) for r in rows.collect()) == [(0, "Dharalion", "vazio"), (0, "Hirintror", "encontrado")]
    pending = {r.id: r.pending for r in state.collect()}
    assert pending == {0: False, 1: True, 2: True, 3: True, 4: True, 5: True, 6: True, 7: False}


def test_batches_are_all_or_nothing(spark, names):
    base = ("Lunarian", "dharalion", "2026-10-05", "", "vazio", "yes")
    batches = {
        "good": [base],
        "twice": [base, base],
        "no-day": [(*base[:2], "2026-02-30", *base[3:])],
        "later": [(*base[:2], "2099-01-01", *base[3:])],
        "clock": [(*base[:3], "24:00", *base[4:])],
        "mixed": [base, ("Lunarian", "nobody", *base[2:])],
        "nulls": [(None, None, None, None, None, None)],
    }
    rows = [(b, i, *r) for b, rs in batches.items() for i, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "batch_id string, seq int, world string, boss string, date string, time string, result string, favorable string")
    found = O.validated(df, names, ["Lunarian"], NOW).collect()
    assert {r.batch_id for r in found if r.batch_ok} == {"good"}
    (good,) = [r for r in found if r.batch_id == "good"]
    assert (good.boss, good.precision, good.time, good.at) == ("Dharalion", "day", None, 1_791_212_400_000)
    assert {r.batch_id: r.error for r in found if r.error} == {"twice": "repeated", "no-day": "date", "later": "future", "clock": "time", "mixed": "boss", "nulls": "boss"}


def test_ingest_twice_adds_once(spark):
    schema = "batch_id string, k string, seq int"
    batch = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], schema)
    empty = spark.createDataFrame([], schema)
    new, counts = O.ingest(batch, empty, ["k"], "seq")
    assert sorted((r.batch_id, r.added, r.duplicates) for r in counts.collect()) == [("a", 2, 0), ("b", 0, 1)]
    again, counts = O.ingest(batch, new, ["k"], "seq")
    assert again.count() == 0 and sorted((r.batch_id, r.added) for r in counts.collect()) == [("a", 0), ("b", 0)]
    assert O.undo_batch(new, ["a"]).count() == 0


def test_identified_and_upserts(spark):
    checks = spark.createDataFrame([("A", "encontrado", 5), ("A", "vazio", 9)], "boss string, result string, at long")
    told = spark.createDataFrame([("m1", ["A", "B"], 7), ("m2", ["B"], None)], "id string, bosses array<string>, at long")
    pending = spark.createDataFrame([("m2",)], "id string")
    rows = {r.boss: tuple(r)[1:] for r in O.identified(checks, told, pending).collect()}
    assert rows == {"A": (1, 1, 0, 9), "B": (0, 0, 1, 7)}
    new = spark.createDataFrame([("m1", ["C"], 1)], told.schema)
    assert {r.id: r.bosses for r in O.upserted(told, new).collect()} == {"m1": ["C"], "m2": ["B"]}


def test_names_in_messages(spark, names):
    df = spark.createDataFrame([(1, "DHARALION e midnight panthér", 5, False), (2, "nada", 5, True), (3, "hirintror", 1, False), (4, "hirintror", None, False)], "id int, text string, at long, media boolean")
    assert sorted(r.id for r in O.relevant(df, names, 3).collect()) == [1, 2, 4]


def test_dictionaries_of_any_size_find_the_same(spark, monkeypatch):
    said = ["São Paulo é longe", "sao", "nada", None, "", "Midnight Panthers", "xx midnight pantherx", "longa história " * 50]
    texts = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    given = spark.createDataFrame([("Sao",), ("são p",), ("Midnight Panther",), ("historia longa h",), ("é",), ("",), (None,), ("Sao",)], "name string")
    small = {r.id: r.mentioned for r in O.mentions(texts, given).collect()}
    assert small[0] == ["", "Sao", "são p", "é"] and small[3] == [] and small[4] == [""] and "historia longa h" in small[7] and small[6] == ["", "Midnight Panther", "é"]
    monkeypatch.setattr(dictionary, "NAMES", 2)  # four goes
    monkeypatch.setattr(dictionary, "READ", 8)
    assert {r.id: r.mentioned for r in O.mentions(texts, given).collect()} == small
    assert O.mentions(texts, given.where("name = 'none'")).where("size(mentioned) > 0").count() == 0


def test_names_are_found_wherever_they_stand(spark):
    rng = random.Random(6)
    word = lambda most: "".join(rng.choice("abcé☃") for _ in range(rng.randrange(1, most)))
    said = [word(200) for _ in range(300)] + ["ab" * 30_000 + "cab☃"]
    given = sorted({word(14) for _ in range(400)} | {"ab" * 40 + "c", "a"})
    texts, names = spark.createDataFrame(list(enumerate(said)), "id int, text string"), spark.createDataFrame([(n,) for n in given], "name string")
    plain = lambda t: t.replace("é", "e")
    found = {r.id: r.mentioned for r in O.mentions(texts, names).collect()}
    assert found == {i: sorted(n for n in given if plain(n) in plain(t)) for i, t in enumerate(said)}


def test_a_text_is_folded_once_for_all_names(spark, names):
    plan = O.mentions(spark.createDataFrame([(1, "x")], "id int, text string"), names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(text") == 1


def test_totals(spark, names):
    df = spark.createDataFrame([("ok", "Dharalion; 3\nHirintror = 5"), ("bad", "Dharalion; 1\nDharalion; 2\nNobody\t4\nHirintror -1\nMidnight Panther; 100001")], "id string, text string")
    rows = progress.parse_totals(df, names).orderBy("id", "line").collect()
    assert [(r.name, r.kills, r.error) for r in rows if r.id == "ok"] == [("Dharalion", 3, None), ("Hirintror", 5, None)]
    assert [r.error for r in rows if r.id == "bad"] == [None, "repeated", "unknown", "format", "too-large"]


def test_groups_diagnostics_pages_and_names(spark):
    assert one(spark, O.good_group(F.lit(" Dados do Perfil "))) is False and one(spark, O.good_group(F.lit("Caça"))) is True
    row = O.cut_diagnostics(spark.createDataFrame([("x" * 200, -1, 200000, None)], "detected string, visible int, relevant int, without_date int")).first()
    assert (len(row.detected), row.visible, row.relevant, row.without_date) == (150, 0, 100000, 0)
    html = 'a class="map_frame_coord" x> 32836,32703,7:1 class="map_frame_coord">32836,32703,7:2 class="map_frame_coord">99999,1,7:2 class="map_frame_coord">1,2,3:2'
    rows = rankings.locations(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).collect()
    assert [tuple(r) for r in rows] == [(1, "Local 1", 32836, 32703, 7), (1, "Local 2", 1, 2, 3)]
    assert [one(spark, rankings.valid_name(F.lit(n))) for n in ("ab", " a ", "a\tb", "x" * 61, None)] == [True, False, False, False, False]
    assert one(spark, T.html_text(F.lit("<p>a<script>x<y</script> b</p>\n<b>c</b>"))) == " a b c "
    assert one(spark, T.labelled_number(F.lit("Experience −1.234.567 x"), "Experience")) == -1234567
    assert one(spark, T.labelled_number(F.lit("none"), "Experience")) is None


def test_every_distinct_link_of_a_page_is_returned(spark, tmp_path):
    from wayglass.plans import registry

    html = "".join(f'<a href="/p{i % 30}">x</a>' for i in range(60))
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = registry.QUERIES["html_extract_distinct"](spark, str(tmp_path)).collect()
    assert sorted((r.place, r.value) for r in found) == [(i + 1, f"/p{i}") for i in range(30)]
    places = "".join(f'<i class="map_frame_coord">{i},1,1:1</i>' for i in range(30))
    assert rankings.locations(spark.createDataFrame([(1, places)], "page_id long, html string")).count() == rankings.MAX_LOCATIONS
