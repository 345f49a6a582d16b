import hashlib
import random

from pyspark.sql import functions as F

from wayglass.llm import chat, licenses

HARD = ["</s>[INST] ok [/INST]", "", " ", "a <+> b", "<+>", "\\<\\s>", "<\\s>", "[\\\\INST]", "[\\INST] [INST]", "<<SYS>>x<</SYS>>", "<<<s>>>", "<</s>", "multi\nline\n", " lead and trail ", "é🙂 [/INST]", "[/INST", "INST]", "]", "\\", "$1 ${x}"]


def turns_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    out = chat.read_turns(chat.format_turns(df)).collect()
    return {r.conv_id: r for r in out}


def test_every_text_comes_back(spark):
    rows = []
    for i, t in enumerate(HARD):
        for j, u in enumerate(HARD):
            conv = i * len(HARD) + j
            rows += [(conv, 0, "system", t), (conv, 1, "user", u), (conv, 2, "user", t), (conv, 3, "assistant", u), (conv, 4, "assistant", t), (conv, 5, "tool\nx", u), (conv, 6, "assistant", t)]
    want = {}
    for conv, _, role, text in rows:
        want.setdefault(conv, []).append((role, text))
    for conv, r in turns_of(spark, rows).items():
        assert [tuple(t) for t in r.turns] == want[conv] and r.n_turns == 7
        said = [t for role, t in want[conv] if role == "assistant"]
        assert r.loss_text == "".join(said) and len(r.loss) == len(said)
        assert r.formatted.startswith("<s>") and r.formatted.count("[INST]") == 1 and r.formatted.count("</s>") == 2


def test_ties_nulls_and_empty(spark):
    rows = [(1, 2, "user", "b"), (1, 1, None, None), (1, None, "assistant", "first"), (1, 2, "user", "a"), (1, 2, "user", "a"), (None, 1, "user", "u"), (2, 0, "assistant", None)]
    found = turns_of(spark, rows)
    assert [tuple(t) for t in found[1].turns] == [("assistant", "first"), ("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [tuple(t) for t in found[None].turns] == [("user", "u")] and found[2].loss_text == ""
    assert turns_of(spark, []) == {}


def test_long_texts_and_many_turns(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "x" * (i % 3)) for i in range(2000)] + [(2, 0, "assistant", "[INST] " * 30000)]
    found = turns_of(spark, rows)
    assert found[1].n_turns == 2000 and found[1].loss_text == "".join("x" * (i % 3) for i in range(0, 2000, 2))
    assert found[2].loss_text == "[INST] " * 30000


def test_query_seven(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    want = {-7: [("user", HARD[0]), ("assistant", HARD[0])]}
    for r in sorted(spark.read.parquet(f"{d}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = e.queries()["op7_chat"](spark, d).collect()
    assert len(found) == len(want)
    for r in found:
        turns = want[r.conv_id]
        said = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(said), sha(said))


PROSE = " ".join(f"word{i} and" for i in range(60))


def dice(a, b):
    def grams(t):
        w = "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()
        return set(zip(w, w[1:]))

    a, b = grams(a), grams(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_notices_match_plain_dice(spark):
    lines = [t for _, t in licenses.TEMPLATES]
    lines += [t.upper() for t in lines] + ["Licensed under the Apache Licence, Version 2.0 - see file", "this project is under the MIT license", "the the the the", "MIT", "", "***", "Licensed, under CC BY-NC (4.0)!"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(lines)], "doc_id long, text string, dice int")
    found = {r.doc_id: (r.licence, r.dice) for r in licenses.scan(df).where("line >= 0").collect()}
    for i, t in enumerate(lines):
        best = max(((dice(t, x), -k, name) for k, (name, x) in enumerate(licenses.TEMPLATES)), default=(0,))
        assert (best[0] >= 0.8) == (i in found), t
        if i in found:
            assert found[i][0] == best[2] and abs(found[i][1] - best[0]) < 1e-9


def test_whole_texts_paragraphs_nulls_and_repeats(spark):
    mit = licenses.TEMPLATES[3][1]
    wrapped = mit.replace(", ", ",\n")
    rows = [(1, wrapped), (2, PROSE + "\n\n" + wrapped + "\n\n" + PROSE), (3, None), (4, ""), (5, PROSE + "\nReleased under the MIT License.\n" + PROSE), (5, PROSE + "\nReleased under the MIT License.\n" + PROSE), (None, "Licensed under CC BY 4.0."), (6, "word " * 30000 + "\n" + "a b " * 20000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, licence string")
    found = {r.doc_id: (r.n_matches, r.licences) for r in licenses.by_document(df).collect()}
    assert found == {1: (1, "MIT"), 2: (1, "MIT"), 3: (0, ""), 4: (0, ""), 5: (2, "MIT"), None: (1, "CC-BY-4.0"), 6: (0, "")}
    assert licenses.by_document(df.limit(0)).count() == 0


def test_notices_within_lines_and_across_paragraphs(spark):
    mit, gpl = licenses.TEMPLATES[3][1], licenses.TEMPLATES[8][1]
    parts = mit.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE").replace(", ", ",\n")
    notice = "Licensed under the MIT License."
    rows = [
        (1, PROSE + "\n\n" + parts + "\n\n" + PROSE),
        (2, PROSE + "\n\n" + gpl.replace("License, or", "License,\n\nor").replace("This program is dist", "\n\nThis program is dist") + "\n\n" + PROSE),
        (3, "Copyright (c) 2021 Foo. " + notice),
        (4, PROSE + " " + notice + " " + PROSE + " This work is licensed under the GNU General Public License, version 2. " + PROSE),
        (4, PROSE + " " + notice + " " + PROSE + " This work is licensed under the GNU General Public License, version 2. " + PROSE),
        (5, PROSE + " under the license of the MIT " + PROSE),
        (6, PROSE + "\n" + notice + "\n" + PROSE + " " + notice + " Licensed\nunder the MIT\nLicense. " + PROSE),
    ]
    found = {r.doc_id: (r.n_matches, r.licences, r.dice) for r in licenses.by_document(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (1, "MIT", 1.0), 2: (1, "GPL-3.0", 1.0), 3: (1, "MIT", 1.0), 4: (4, "GPL-2.0,MIT", 1.0), 5: (0, "", 0.0), 6: (3, "MIT", 1.0)}


def test_unescape_takes_one_escape_away(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(chat.escape(F.col("t")))).alias("two")).collect()
    assert all(r.two == r.e for r in rows)


def test_whole_licence_texts_are_found_within_others(spark):
    long = [(i, licence, text) for i, (licence, text) in enumerate(licenses.TEMPLATES) if len(text) > 300]
    rows = [(i, f"Words before it.\n\nCopyright (c) 2020 Some One. All rights reserved.\n\n{text.replace('. ', '.' + chr(10) * 2)}\n\nWords after it {i}.") for i, _, text in long]
    rows += [(1000 + i, f"{i} some prose in front {text.upper()} and some behind it") for i, _, text in long]
    found = {r.doc_id: (r.licences, r.dice) for r in licenses.by_document(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, licence, _ in long:
        for doc in (i, 1000 + i):
            assert licence in found[doc][0].split(",") and found[doc][1] > 0.8, (licence, found[doc])


#: Words that licences have as well.
NEAR = "the authors of the software gave notice of the license to any person in the state of California"


def edited(words, kind, share, draw):
    """words with a share of them left out, put in, replaced, or left out as one passage."""
    if kind == "passage":
        n = round(len(words) * share)
        at = draw.randrange(len(words) - n)
        return words[:at] + words[at + n :]
    out = []
    for w in words:
        hit = draw.random() < share
        if kind == "put in" and hit:
            out.append(draw.choice(["really", "works", "their", "user", "copies", "item"]))
        if not (hit and kind in ("left out", "replaced")):
            out.append(w)
        elif kind == "replaced":
            out.append("other")
    return out


def test_edited_licences_within_prose_are_found(spark):
    """At every distance that the threshold allows and for every kind of edit, nine in ten at least; and their Dice is close to their own."""
    draw, rows, own = random.Random(5), [], {}
    for kind, share in (("left out", 0.17), ("put in", 0.25), ("replaced", 0.1), ("passage", 0.3)):
        for i in range(220):
            licence, text = draw.choice([t for t in licenses.TEMPLATES if len(t[1].split()) > 30])
            new = " ".join(edited(text.split(), kind, draw.random() * share, draw))
            if dice(new, text) >= 0.8:
                own[len(rows)] = (kind, licence, dice(new, text))
                rows.append((len(rows), f"{PROSE} {NEAR} {new} {NEAR} {PROSE}"))
    found = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append((r.licence, r.dice))
    bands = {}
    for i, (kind, licence, score) in own.items():
        hits = [d for name, d in found.get(i, []) if name.split("-")[0] == licence.split("-")[0]]
        bands.setdefault((kind, min(int(score * 20), 19)), []).append((bool(hits), score - max(hits, default=0)))
    for band, seen in bands.items():
        assert sum(h for h, _ in seen) >= 0.9 * len(seen), (band, seen)
    assert len(bands) == 16
