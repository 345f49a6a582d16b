"""Personal data: formats known beforehand, and identifiers found by the contexts that known ones have.

Known formats (e-mail, IP address, card and phone numbers) are the seeds. Their contexts induce lexical
patterns: the word before, the two words before, and the words on both sides, within a
line. Patterns and instances (identifier strings) form a graph, over which confidence is passed for a few rounds: a
pattern is worth what its instances are worth, an instance what its best trusted pattern is. What an instance is worth
to a pattern never comes from that pattern, nor from one with the same word before: these are of the same occurrences. Instances that
no format knows, but trusted patterns do, are identifiers too. All in Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bound, join_counted, join_facts, running, saved

#: Distinct instances of known format that a pattern needs, the confidence it needs, and an instance then needs.
MIN_SEEDS = 4
CONFIDENCE = 0.75
#: Of a pattern's distinct instances, the least share that must be of known format and of its kind.
MIN_SHARE = 0.25
ROUNDS = 3
#: What an instance that nothing vouches for counts, when a pattern is judged by its instances.
UNKNOWN = 0.25
#: Characters around an instance in which its context's words are looked for.
CONTEXT = 48

_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
# The formats. A match can only begin where a run of its characters does, or where the
# last match ended, so that failures inside a run need not be tried; nothing else differs from
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) ;
# [0-9]([\x20-]?[0-9])+ ; \+[0-9][\x20().0-9-]+[0-9]
FORMATS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = tuple(FORMATS)
#: What can be an identifier of unknown format: words with a digit or an @, and such words in a row.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+"
#: What each format needs to be tried at all.
_NEEDS = {"email": "@", "phone": "+"}
_FOUND = "array<struct<start:bigint,end:bigint,match:string,left:string,right:string>>"


def occurrences(text: Column, pattern: str) -> Column:
    """Matches of pattern as _FOUND, in code points, with the text around each up to the next match. The text is read twice, however many matches it has."""

    def laid(pieces: Column) -> Column:
        """pieces: match and the text before (a) and after it (b)."""
        ends = running(F.transform(pieces, lambda p: (F.length(p["a"]) + F.length(p["match"])).cast("long")))
        row = lambda p, end: F.struct((end - F.length(p["match"])).alias("start"), end.alias("end"), p["match"].alias("match"), F.right(p["a"], F.lit(CONTEXT)).alias("left"), F.left(p["b"], F.lit(CONTEXT)).alias("right"))
        return F.zip_with(pieces, ends, row)

    def pieces(both: Column) -> Column:
        matches, between = both["matches"], both["between"]
        around = F.zip_with(F.slice(between, 1, F.size(matches)), F.slice(between, 2, F.size(matches)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.zip_with(matches, around, lambda m, x: F.struct(m.alias("match"), x["a"].alias("a"), x["b"].alias("b")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("matches"), F.split(text, pattern, -1).alias("between"))
    found = bound(both, lambda x: F.when(F.size(x["matches"]) > 0, bound(pieces(x), laid)))
    return F.coalesce(found, F.array().cast(_FOUND))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether digits pass the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of a format counts."""
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(_digits(match))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), luhn(_digits(match))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def known(text: Column) -> Column:
    """Identifiers of known format: array of kind (place in KINDS), start, end, match, left, right; by start, then kind."""

    def of(i: int, kind: str) -> Column:
        tried = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]")
        found = F.when(tried, occurrences(text, FORMATS[kind])).otherwise(F.array().cast(_FOUND))
        kept = F.filter(found, lambda m: valid(kind, m["match"]))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), m["match"].alias("match"), m["left"].alias("left"), m["right"].alias("right")))

    return F.array_sort(F.concat(*[of(i, kind) for i, kind in enumerate(KINDS)]))


def candidates(text: Column, spans: Column) -> Column:
    """What may be an identifier and touches no known one (spans, by start); kind is null. Marks at its ends do not count."""
    found = F.when(text.rlike("[0-9@]"), occurrences(text, CANDIDATE)).otherwise(F.array().cast(_FOUND))
    head, tail = r"^[^\p{L}\p{N}+(@]+", r"[^\p{L}\p{N})@]+$"

    def trimmed(m: Column) -> Column:
        before = F.length(m["match"]) - F.length(F.regexp_replace(m["match"], head, ""))
        core = F.regexp_replace(F.regexp_replace(m["match"], head, ""), tail, "")
        start = m["start"] + before
        marks = F.concat(m["left"], F.left(m["match"], before))
        return F.struct(start.alias("start"), F.lit(None).cast("int").alias("kind"), (start + F.length(core)).alias("end"), core.alias("match"), marks.alias("left"), m["right"].alias("right"))

    shaped = F.filter(F.transform(found, trimmed), lambda m: F.length(F.regexp_replace(m["match"], r"[^\p{L}\p{N}]", "")) >= 5)
    return bound(F.struct(shaped.alias("shaped"), spans.alias("spans")), lambda x: F.when((F.size(x["spans"]) == 0) | (F.size(x["shaped"]) == 0), x["shaped"]).otherwise(_apart(x["shaped"], x["spans"])))


def _apart(found: Column, spans: Column) -> Column:
    """Elements of found, which do not touch each other, that touch none of spans.

    One does if, of the spans that begin before it ends, one ends after it begins: both are put in one order, over which the greatest end runs.
    """
    none = F.lit(None).cast("struct<start:bigint,kind:int,end:bigint,match:string,left:string,right:string>")
    own = F.transform(found, lambda m: F.struct(m["end"].alias("at"), F.lit(0).alias("order"), F.lit(0).cast("long").alias("reach"), m.alias("m")))
    others = F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("order"), s["end"].alias("reach"), none.alias("m")))

    def kept(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["reach"]), lambda a, b: F.greatest(a, b))
        free = F.zip_with(events, reach, lambda e, r: F.when(e["m"].isNotNull() & (r <= e["m"]["start"]), e["m"]))
        return F.filter(free, lambda m: m.isNotNull())

    return bound(F.array_sort(F.concat(own, others)), kept)


def patterns(left: Column, right: Column) -> Column:
    """The patterns of a context: words before, on the same line, and the word after. A line's ends count as words."""
    line = F.lower(F.substring_index(left, "\n", -1))
    near = F.filter(F.split(F.concat(F.when(F.contains(left, F.lit("\n")) | (F.length(left) < CONTEXT), F.lit("^ ")).otherwise(F.lit("")), line), r"[ \t\r\x0b\f]+"), lambda w: w != "")
    after = F.filter(F.split(F.concat(F.lower(F.substring_index(right, "\n", 1)), F.lit(" $")), r"[ \t\r\x0b\f]+"), lambda w: w.rlike(r"[\p{L}\p{N}$]"))
    one, two, next_one = F.try_element_at(near, F.lit(-1)), F.try_element_at(near, F.lit(-2)), F.get(after, F.lit(0))
    made = F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two, F.lit(" "), one), F.concat(F.lit("3 "), one, F.lit(" _ "), next_one))
    # A line's beginning alone says nothing.
    return F.when(one.isNull() | (one == "^"), F.array().cast("array<string>")).otherwise(F.filter(made, lambda p: p.isNotNull()))


def read(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, known and others (candidates) of every row; the text itself is left behind."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), known(text).alias("known"))
    return rows.select("doc_id", "text_hash", "known", candidates(F.col("text"), F.col("known")).alias("others"))


def bootstrap(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns (kind, pattern, confidence) and instances (kind, instance, score) of unknown format, from read()."""
    seen = found.select(F.explode(F.concat("known", "others")).alias("m")).select(F.col("m.kind").alias("kind"), F.lower("m.match").alias("instance"), F.explode(patterns(F.col("m.left"), F.col("m.right"))).alias("pattern"))
    edges = saved(seen.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")), "personal-edges")
    # Only patterns of enough known instances can ever be accepted: others leave the graph, and with them what only they touch.
    each = [F.count(F.when(F.col("kind") == i, 1)) for i in range(len(KINDS))]
    able = edges.groupBy("pattern").agg(F.greatest(*each).alias("seeds")).where(F.col("seeds") >= MIN_SEEDS)
    graph = saved(join_facts(edges, able, "pattern").where("seeds IS NOT NULL").drop("seeds"), "personal-graph")
    unknown = graph.where("kind IS NULL").select("pattern", "instance", _word_before(F.col("pattern")).alias("word"))
    kinds = range(len(KINDS))
    sure = graph.where("kind IS NOT NULL").groupBy("pattern").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("kind") == i, 1)).cast("double").alias(f"s{i}") for i in kinds])
    votes = None
    for _ in range(ROUNDS):
        told = [F.lit(0.0) if votes is None else F.coalesce(F.when(F.col(f"w{i}") == F.col("word"), F.col(f"b{i}")).otherwise(F.col(f"a{i}")), F.lit(0.0)) for i in kinds]
        heard = unknown if votes is None else join_counted(unknown, votes, "instance", votes.count())
        passed = heard.groupBy("pattern").agg(F.count("*").alias("u"), F.sum(F.greatest(F.lit(UNKNOWN), *told)).alias("more"), *[F.sum(k).alias(f"k{i}") for i, k in enumerate(told)])
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        enough = lambda i: (F.col(f"s{i}") >= MIN_SEEDS) & (F.col(f"s{i}") >= MIN_SHARE * (F.col("n") + zero("u")))
        each = [F.struct(F.when(enough(i), (F.col(f"s{i}") + zero(f"k{i}")) / (F.col("n") + zero("more") + 1)).otherwise(0.0).alias("confidence"), F.lit(-i).alias("order")) for i in kinds]
        best = sure.join(passed, "pattern", "left").select("pattern", F.greatest(*each).alias("best")).where(F.col("best.confidence") >= CONFIDENCE)
        trusted = saved(best.select("pattern", (-F.col("best.order")).alias("kind"), "best.confidence"), "personal-patterns")
        told_of = join_counted(unknown, trusted, "pattern", trusted.count()).where("confidence IS NOT NULL")
        votes = _votes(told_of)
    scores = told_of.groupBy("instance").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("order"))).alias("best"))
    return trusted, scores.select("instance", (-F.col("best.order")).alias("kind"), F.col("best.confidence").alias("score"))


def _word_before(pattern: Column) -> Column:
    """The word before an instance, which all patterns of one occurrence share."""
    return F.get(F.split(pattern, " "), F.when(pattern.startswith("2 "), 2).otherwise(1))


def _votes(told: DataFrame) -> DataFrame:
    """instance and, for each kind i, its best score a{i}, the word w{i} before it there, and its best score b{i} after any other word."""
    each = told.groupBy("instance", "kind", "word").agg(F.max("confidence").alias("score"))
    place = F.row_number().over(Window.partitionBy("instance", "kind").orderBy(F.desc("score"), "word"))
    two = each.withColumn("place", place).where("place <= 2")
    at = lambda i, place, c: F.max(F.when((F.col("kind") == i) & (F.col("place") == place), F.col(c)))
    return saved(two.groupBy("instance").agg(*[at(i, p, c).alias(f"{n}{i}") for i in range(len(KINDS)) for n, p, c in (("a", 1, "score"), ("w", 1, "word"), ("b", 2, "score"))]), "personal-votes")


def find(documents: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind and end; kind is a place in KINDS) of every row of documents (doc_id, text).

    base are the identifiers of known format, spans these and the discovered ones. A null or empty text
    has none. Rows that repeat stay; those of one doc_id and one text have the same spans. A very long text is
    read twice for each format, and n matches take some n log n steps; an empty table gives none, other columns are ignored.
    """
    found = saved(read(documents), "personal")
    accepted = bootstrap(found)[1].select("instance", F.col("kind").alias("accepted"))
    others = found.where(F.size("others") > 0).select("doc_id", "text_hash", F.explode("others").alias("m")).select("doc_id", "text_hash", F.lower("m.match").alias("instance"), "m.start", "m.end")
    discovered = join_facts(others, accepted, "instance").where("accepted IS NOT NULL")
    # Rows of one key are equal texts, so a set of their spans is those of each.
    new = discovered.groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "text_hash").agg(F.collect_set(F.struct("start", F.col("accepted").alias("kind"), "end")).alias("new"))
    base = F.transform("known", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    rows = found.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "text_hash", base.alias("base"))
    joined = rows.join(new, ["key", "text_hash"], "left")
    return joined.select("doc_id", "base", F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "new"))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
