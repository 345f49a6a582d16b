"""Two tokenizers' tokens of the same texts: where both end, which overlap, and how often two ids do."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, _Codes, drop_saved, expand, kept, run_sums, saved, slices
from .simhash import text_hash
from .word_bpe import _WHITE, piece_bytes

A, B = 0, 1
SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
#: Id pairs whose counts are sent to all tasks (32 MB); of more, documents' pairs are joined with them.
MAX_PAIRS = 2_000_000
#: Distinct words of a Python worker's table of digests, and those that a task counts before it sends them on.
WORDS, COUNTED = 200_000, 300_000


class Tokenizers:
    """A byte-level BPE (A) and a sentence-piece BPE (B) over words, of which both encode each apart as within a text.

    A splits before white space that follows anything else. B does, too, unless a piece of it goes on over such white
    space: a blank must not be among these, others (joining) do not part words.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        with open(path_b, "rb") as f:
            # a model's last settings count: no blank of its own before a text (normalizer_spec.add_dummy_prefix = false)
            self.b = sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x1a\x02\x18\x00")
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a[i] = piece_bytes(token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.pieces = (a, b)
        self.lengths = tuple(np.array([len(p) for p in x], np.int64) for x in self.pieces)
        self.joining = sorted({c for x in b for s in [x.decode(errors="replace")] for p, c in zip(s, s[1:], strict=False) if c.isspace() and not p.isspace()})
        self.white = frozenset(c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{_WHITE}]", c))
        if " " in self.joining:
            raise ValueError("a piece goes on over a blank: its words cannot be encoded apart")

    def pattern(self) -> str:
        """Words of a text that begins with a blank, as a regular expression: white space and what follows it."""
        on = f"(?:[{''.join(f'\\x{ord(c):02x}' for c in self.joining)}][{_WHITE}]*+[^{_WHITE}]*+)*+" if self.joining else ""
        return f"[{_WHITE}]*+[^{_WHITE}]++{on}|[{_WHITE}]++"

    def encode(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """A's and B's ids of all words one after the other, how many each word has, and whether both keep its bytes; words that are not kept have none.

        Many words are encoded as one text, as they part there anyway; a word that ends in white space goes alone.
        """
        runs: list[tuple[list[int], list[np.ndarray], list[np.ndarray]]] = []

        def take(at: list[int]) -> None:
            raw = [words[i].encode() for i in at]
            text, ends = b"".join(raw), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
            said = [self.a.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, self.b.encode(text.decode())]
            ids = [np.array(x, np.int64) for x in said]
            stops = [np.cumsum(self.lengths[side][x]) for side, x in enumerate(ids)]
            places = [np.searchsorted(x, ends, "right") for x in stops]
            whole = all(b"".join([self.pieces[side][i] for i in x]) == text for side, x in enumerate(said))
            if whole and all((p > 0).all() and (x[p - 1] == ends).all() for x, p in zip(stops, places, strict=True)):
                runs.append((at, ids, [np.diff(p, prepend=0) for p in places]))
            elif len(at) > 1:
                take(at[: len(at) // 2])
                take(at[len(at) // 2 :])

        loose = [i for i, w in enumerate(words) if w[-1] in self.white]
        firm = sorted(set(range(len(words))).difference(loose)) if loose else list(range(len(words)))
        for i in range(0, len(firm), 2000):
            take(firm[i : i + 2000])
        for i in loose:
            take([i])
        good = np.zeros(len(words), bool)
        order = np.array([i for at, _, _ in runs for i in at], np.int64)
        good[order] = True
        out, counts = [], []
        for side in (A, B):
            flat = np.concatenate([ids[side] for _, ids, _ in runs]) if runs else np.zeros(0, np.int64)
            held = np.concatenate([c[side] for _, _, c in runs]) if runs else np.zeros(0, np.int64)
            n, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            n[order], start[order] = held, np.cumsum(held) - held
            out.append(flat[expand(start, n)])
            counts.append(n)
        return out, counts, good


def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return kept(("token_align", path_a, path_b), lambda: Tokenizers(path_a, path_b))


# --- the relational operator ---


def links(tokens: DataFrame, key: list[str]) -> DataFrame:
    """key, group, a, b of every pair of overlapping tokens, from tokens (key, side A or B, pos, id, len in bytes).

    Each side's tokens of a key cover the same bytes without gaps; len is over 0. A token ends at the sum of the lengths
    up to it. Tokens of both sides meet by key and end; where both end there is a cut, and a group of a key has the cuts from its last
    token on down to its own (the last group is 1). Between two neighbouring ends lie just one token of A and one of B: the next to end there, so
    each overlap is one row, and what a key costs grows with its tokens and not with their pairs. All steps
    are partitioned by key; a key's tokens are met by windows that hold no row.
    """
    along = Window.partitionBy(*key, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = tokens.withColumn("end", F.sum("len").over(along))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("id")))
    met = ends.groupBy(*key, "end").agg(of(A).alias("a"), of(B).alias("b"))
    back = Window.partitionBy(*key).orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("long")
    return met.select(*key, "end", F.sum(cut).over(back).alias("group"), F.last("a", True).over(back).alias("a"), F.last("b", True).over(back).alias("b"))


def pair_counts(found: DataFrame, weight: Column) -> DataFrame:
    """a, b, count (sum of weight over links) and best (whether no other a has a higher count with this b)."""
    counts = found.groupBy("a", "b").agg(F.sum(weight).alias("count"))
    highest = F.max("count").over(Window.partitionBy("b"))
    return counts.withColumn("best", F.col("count") == highest)


def words_of(pattern: str) -> Column:
    """The words of a text, with the blank that goes before it; a null or empty text has none."""
    text = F.when(F.col("text") != "", F.concat(F.lit(" "), F.col("text")))
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), 0), F.array().cast("array<string>"))


def word_counts(documents: DataFrame, pattern: str) -> DataFrame:
    """word and n of all words of all texts; tasks count what they can hold before anything moves."""
    words = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in slices(batches, 50):
            for text in batch["text"].to_pylist():
                if text:
                    held.update(words.findall(f" {text}"))
            if len(held) > COUNTED:
                yield out()
        yield out()

    return documents.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_tokens(words: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """words (word, n) with tokens: structs of side, pos, id and len of A's and B's tokens; null where their bytes are not the word's."""

    @F.arrow_udf("array<struct<side:int,pos:int,id:int,len:int>>")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        both = _tokenizers(path_a, path_b)
        for batch in batches:
            flat, each, good = both.encode(batch.to_pylist())
            counts = np.stack(each, axis=1).reshape(-1)  # of A and B by turns
            starts = np.stack([np.cumsum(n) - n for n in each], axis=1)
            starts[:, B] += len(flat[A])
            at = expand(starts.reshape(-1), counts)
            size = np.concatenate([both.lengths[side][ids] for side, ids in enumerate(flat)])[at]
            side, pos = np.repeat(np.tile((A, B), len(good)), counts), expand(np.zeros(len(counts), np.int64), counts)
            rows = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (side, pos, np.concatenate(flat)[at], size)], ["side", "pos", "id", "len"])
            ends = np.concatenate(([0], np.cumsum(counts.reshape(-1, 2).sum(axis=1)))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), rows, mask=pa.array(~good))

    return words.withColumn("tokens", tokens("word"))


def corpus_pairs(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """pair_counts() over all documents (doc_id, text) whose bytes both tokenizers keep.

    Texts are split into words, each distinct word is encoded and aligned once, and its links count as often as it is met. Words
    that are not kept tell which texts have no tokens; then these are left out and the rest is counted anew.
    """
    pattern = Tokenizers(path_a, path_b).pattern()

    def told(texts: DataFrame) -> DataFrame:
        return word_tokens(word_counts(texts, pattern), path_a, path_b)

    def pairs(words: DataFrame) -> DataFrame:
        dealt = words.repartition("word").select("word", "n", F.inline_outer("tokens"))  # once, and all steps of links() stay within these parts
        return saved(pair_counts(links(dealt, ["word", "n"]), F.col("n")), "pairs")

    found = pairs(told(documents))
    if found.where("a IS NULL").isEmpty():  # a word without tokens has one row without ids
        return found
    drop_saved(found)
    lost = saved(told(documents).where("tokens IS NULL").select("word"), "lost")
    met = documents.select(text_hash().alias("mark"), F.explode(F.array_distinct(words_of(pattern))).alias("word")).join(_sent(lost), "word", "left_semi")
    gone = saved(met.select("mark").distinct(), "gone")
    return pairs(told(documents.select("text", text_hash().alias("mark")).join(_sent(gone), "mark", "left_anti")))


def _sent(rows: DataFrame) -> DataFrame:
    """rows, to be sent to all tasks if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


# --- digests of documents ---


class Digests:
    """What each distinct word of a worker's documents adds to a document: sums, and its groups as text.

    The words' links come as links() has them: one for each end, of the tokens of both sides that end there next. Once there are more than
    WORDS words, the half that was met most often stays; others are worked on anew when they come again.
    """

    def __init__(self, both: Tokenizers, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], linked: bool) -> None:
        self.both, (self.pairs, self.counts, self.best), self.keeps = both, pairs, linked
        self.words = re.compile(both.pattern())
        each = [str(i) for i in range(max(map(len, both.pieces)))]
        #: Every number with what may follow it: a comma, a bar or a semicolon.
        self.said = np.array([n + mark for mark in ",|;" for n in each], object)
        self.numbers = len(each)
        self.codes, self.met_often, self.groups = _Codes(), np.zeros(0, np.int64), np.zeros(0, object)
        self.sums = np.zeros((len(SUMS) + 1, 0), np.int64)
        self.links: list[np.ndarray] = []

    def _shrink(self) -> None:
        often = np.sort(np.argsort(-self.met_often, kind="stable")[: WORDS // 2])
        words = list(self.codes)
        self.codes = _Codes()
        for i in often.tolist():
            self.codes[words[i]]
        self.codes.fresh = []
        self.sums, self.groups, self.met_often = self.sums[:, often], self.groups[often], self.met_often[often] // 2
        self.links = [self.links[i] for i in often.tolist()] if self.keeps else []

    def _add(self, words: list[str]) -> None:
        (a, b), (n_a, n_b), good = self.both.encode(words)
        end_a, end_b = np.cumsum(self.both.lengths[A][a]), np.cumsum(self.both.lengths[B][b])
        word_end = np.concatenate(([0], end_a))[np.cumsum(n_a)]
        every = np.sort(np.concatenate((end_a, end_b)), kind="stable")
        new = np.diff(every, prepend=0) > 0
        ends, cut = every[new], ~new  # an end of both sides stands twice, the second time as a cut
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        pair = a[at_a] << 32 | b[at_b]
        last = np.searchsorted(ends, word_end, "right")
        at = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        count, best = (x[at] if len(x) else np.zeros(len(pair), np.int64) for x in (self.counts, self.best))
        cuts = every[cut]
        cut_a, cut_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        cut_a[np.searchsorted(end_a, cuts)] = 1
        cut_b[np.searchsorted(end_b, cuts)] = 1
        # ids as they are written: by group, A's before B's, a bar or a semicolon after the last of each
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        told = self.said[np.concatenate((a + self.numbers * cut_a, b + 2 * self.numbers * cut_b))[order]].tolist()
        stops = np.cumsum(n_a + n_b).tolist()
        groups = np.empty(len(words), object)
        groups[:] = ["".join(told[i:j]) for i, j in zip([0, *stops], stops, strict=False)]
        rows = np.stack([n_a, n_b, run_sums(cut_a, np.cumsum(n_a)), np.diff(last, prepend=0), run_sums(best, last), run_sums(count, last), good.astype(np.int64)])
        self.sums, self.groups = np.concatenate((self.sums, rows), axis=1), np.concatenate((self.groups, groups))
        self.met_often = np.concatenate((self.met_often, np.zeros(len(words), np.int64)))
        if self.keeps:
            self.links += np.split(pair, last[:-1]) if len(words) else []

    def digest(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], list[np.ndarray]]:
        """For each text six sums (n_a to count_sum), its groups, and the codes of its words if it has tokens."""
        if len(self.codes) > WORDS:
            self._shrink()
        found = [self.words.findall(f" {t}") if t else [] for t in texts]
        ends = np.cumsum([len(f) for f in found], dtype=np.int64)
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(found)), np.int64, int(ends[-1]) if len(ends) else 0)
        if self.codes.fresh:
            fresh, self.codes.fresh = self.codes.fresh, []
            self._add(fresh)
        self.met_often += np.bincount(codes, minlength=len(self.met_often))
        whole = run_sums(self.sums[-1][codes], ends) == np.diff(ends, prepend=0)
        each = [codes[i:j] if w else codes[:0] for i, j, w in zip([0, *ends.tolist()], ends.tolist(), whole.tolist(), strict=False)]
        told = ["".join(self.groups[c].tolist())[:-1] for c in each]
        return [np.where(whole, run_sums(x[codes], ends), 0) for x in self.sums[:-1]], told, each

    def met(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked pairs (A's id << 32 | B's id) of a text's words, and how often each is linked."""
        every = [self.links[c] for c in codes.tolist()]
        return np.unique(np.concatenate(every) if every else np.zeros(0, np.int64), return_counts=True)


def align(documents: DataFrame, path_a: str, path_b: str, text: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best and count_sum (long) and groups of every row of documents (doc_id, text).

    A encodes a blank and the text, B the text, before which it puts a blank itself; strings of special tokens are plain text.
    groups is the SHA-256 of the ids between cuts, written `a1,a2|b1;a3|b2`, or with text this itself. A link is a pair of overlapping
    tokens; n_best counts links whose pair no other with the same B id outnumbers in all documents, count_sum adds up the pairs'
    numbers. A null or empty text, or one whose bytes a tokenizer changes, has zeros and an empty groups and counts nowhere.
    Repeated rows count each; rows without doc_id stay. An empty table gives an empty one. A text of any length is read whole, in one task.
    """
    pairs = corpus_pairs(documents, path_a, path_b)
    few = pairs.count() <= MAX_PAIRS
    held = pairs.select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "count", F.col("best").cast("long").alias("best"))
    known = _sorted(held) if few else (np.zeros(0, np.int64),) * 3
    sent, run_id = documents.sparkSession.sparkContext.broadcast(known), uuid.uuid4().hex
    schema = ", ".join(["doc_id long, row long", *(f"{c} long" for c in SUMS), "groups string"]) + ("" if few else ", linked array<struct<pair:long,times:long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = kept(("token_align digests", path_a, path_b, run_id), lambda: Digests(Tokenizers(path_a, path_b), sent.value, not few))
        for batch in slices(batches, 100):
            sums, groups, codes = digests.digest([t or "" for t in batch["text"].to_pylist()])
            if not text:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            columns = [batch["doc_id"], batch["row"], *map(pa.array, sums), pa.array(groups, pa.string())]
            if not few:
                linked = [[{"pair": p, "times": t} for p, t in zip(*(x.tolist() for x in digests.met(c)), strict=True)] for c in codes]
                columns.append(pa.array(linked, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", *SUMS, "groups", *([] if few else ["linked"])])

    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, schema)
    if few:
        return found.drop("row")
    found = saved(found, "digests")
    met = found.select("row", F.inline("linked")).join(held, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return found.drop("n_best", "count_sum", "linked").join(met, "row", "left").select("doc_id", *SUMS[:4], *(F.coalesce(c, F.lit(0)).alias(c) for c in SUMS[4:]), "groups")


def _sorted(held: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair, count and best of all pairs, by pair; at most MAX_PAIRS rows."""
    table = held.toArrow()
    order = np.argsort(table["pair"].to_numpy())
    return tuple(table[c].to_numpy()[order] for c in ("pair", "count", "best"))
