"""Byte-level BPE by distinct words: split, encode each distinct word once, join ids by position, decode by id."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Growing, WordTable, expand, kept, run_sums, slices

# Unicode's White_Space characters, which the tokenizer's pattern calls \s.
_WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where the tokenizer always splits: before a space or other white space, as its own pattern does; what
#: it splits further inside a word depends on that word alone.
_WORDS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def piece_bytes(token: str) -> bytes:
    """Bytes of a byte-level piece: printable Latin-1 stands for itself, the rest for 256 and up in order."""
    return bytes(_BYTE_OF[c] for c in token) if all(c in _BYTE_OF for c in token) else token.encode()


def _byte_of() -> dict[str, int]:
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTE_OF = _byte_of()


#: Words that the tokenizer encodes in one call: what it says of a word takes far more room than the ids that are kept of it.
AT_ONCE = 5_000


class WordBpe:
    """A byte-level tokenizer over distinct words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = WordTable(self._fill, [np.int64, np.int64], self._clear)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            pieces[i] = piece_bytes(token)
        self.piece_lengths = np.array([len(p) for p in pieces], np.int64)
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def _clear(self) -> None:
        self.flat = Growing(np.int32)

    def _fill(self, words: list[str]) -> list[np.ndarray]:
        before, lengths = self.flat.size, np.zeros(len(words), np.int64)
        for at in range(0, len(words), AT_ONCE):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(words[at : at + AT_ONCE], add_special_tokens=False)]
            lengths[at : at + len(found)] = [len(x) for x in found]
            self.flat.extend(np.fromiter((i for x in found for i in x), np.int32))
        return [before + np.cumsum(lengths) - lengths, lengths]

    def words(self, text: str) -> list[str]:
        """A text's words; one with a special token's string inside is one word, as splitting there depends on it."""
        return [text] if any(s in text for s in self.special) else _WORDS.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each."""
        codes, ends = self.table.lookup([self.words(t) for t in texts])
        starts, lengths = (x[codes] for x in self.table.arrays)
        return self.flat.all[expand(starts, lengths)], run_sums(lengths, ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts again: each id's piece, joined by id, in order."""
        lengths = self.piece_lengths[ids]
        raw = self.piece_bytes[expand(self.piece_starts[ids], lengths)].tobytes()
        ends = np.cumsum(run_sums(lengths, np.cumsum(counts))).tolist()
        return [raw[a:b].decode(errors="replace") for a, b in zip([0, *ends], ends, strict=False)]


def _bpe(path: str) -> WordBpe:
    """One for all tasks of a Python worker."""
    return kept(("word_bpe", path), lambda: WordBpe(path))


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """documents with ids (array of int) and decoded (text made from these ids) in place of any such columns.

    A null text is empty: no ids, and an empty decoded text. Other columns, repeated rows and rows
    without doc_id pass through; an empty table stays empty. Nothing shuffles: each Python worker has its
    own table of distinct words, which is bounded.
    """
    names = [c for c in documents.columns if c not in ("ids", "decoded")]
    schema = T.StructType([f for f in documents.schema if f.name in names]).add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer)
        for batch in slices(batches):
            ids, counts = bpe.encode([t or "" for t in batch["text"].to_pylist()])
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), lists, pa.array(bpe.decode(ids, counts), pa.string())], [*names, "ids", "decoded"])

    return documents.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
