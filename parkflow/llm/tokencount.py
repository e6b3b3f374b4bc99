"""Token counts by a map-side lookup in two tiers.

A text is split into pre-tokens (a run of spaces with the word after it, or a line break) that no piece of the
vocabulary crosses, so the counts of the pre-tokens add up to the count of the text. Lengths come from a broadcast
table of the corpus's frequent pre-tokens, else from a cache in the worker, else from the tokenizer. The table has a
fixed number of entries and is found by a first pass over all texts, in which a task keeps bounded counts and hands on
a bounded number of its most frequent words; no stream of pre-tokens is ever shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkflow.llm.common import task

PRETOKEN = re.compile(r" *[^ \n]+|\n| +")
CACHE_ENTRIES = 400_000
#: Entries of the broadcast table and their most letters, words that a task hands on, and that it counts at a time.
FREQUENT, LONGEST, FROM_A_TASK, COUNTED = 16_384, 64, 8_192, 200_000
_models: dict = {}


def _model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


class Lengths(dict):
    """Pre-token -> number of tokens: the broadcast tier first, then what this worker has encoded."""

    def __init__(self, model, frequent: dict[str, int]):
        super().__init__(frequent)
        self.model, self.frequent, self.line = model, frequent, len(model.encode("\n"))

    def __missing__(self, word: str) -> int:
        if word[0] == " " and word.strip(" "):
            n = len(self.model.encode(word[1:]))  # the tokenizer puts one space before each text itself
        else:
            n = len(self.model.encode("\n" + word)) - self.line
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.update(self.frequent)
        self[word] = n
        return n


def check_splittable(path: str) -> None:
    """Raise where a piece of the vocabulary could cross a pre-token boundary."""
    model = _model(path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).replace("▁", " ")
        if " " in piece.lstrip(" ") or "\n" in piece and piece != "\n":
            raise ValueError(f"piece {i} crosses words; this vocabulary can't be counted by pre-tokens")


def frequent_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent words of a task, and how often they occur; rare ones are dropped on the way where there are
    many, which can make a count too low but nothing wrong: the table only saves work."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text"):
            counts.update((text.as_py() or "").split())
            if len(counts) > COUNTED:
                counts = Counter(dict(counts.most_common(COUNTED // 2)))
    top = [(w, n) for w, n in counts.most_common(FROM_A_TASK) if len(w) <= LONGEST]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])


def frequent_words(docs: DataFrame, size: int = FREQUENT) -> list[str]:
    """The most frequent words of docs(text), at most `size`; ties by the word."""
    found = docs.select("text").mapInArrow(task("parkflow.llm.tokencount", "frequent_batches"), "word string, n long")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(size)
    return [r.word for r in top.select("word").collect()]


class LengthTable:
    """A compact table of pre-tokens (words with a space ahead) and their numbers of tokens: the words as one run of
    bytes in order, and a small number each."""

    def __init__(self, words: list[str], path: str):
        check_splittable(path)
        lengths = Lengths(_model(path), {})
        words = sorted({w for w in words if PRETOKEN.fullmatch(f" {w}") and "▁" not in w})
        self.words = "\n".join(words).encode()
        self.lengths = np.array([min(lengths[f" {w}"], 65_535) for w in words], np.uint16)

    def open(self) -> dict[str, int]:
        words = self.words.decode().split("\n") if self.words else []
        return {f" {w}": n for w, n in zip(words, self.lengths.tolist()) if n < 65_535}


_lengths: dict[str, Lengths] = {}


def count(text: str | None, lengths: Lengths) -> int:
    if not text:
        return 0
    return sum(map(lengths.__getitem__, PRETOKEN.findall(" " + text.replace("▁", " "))))


def count_batches(batches: Iterator[pa.RecordBatch], path: str, frequent: LengthTable, limit: int) -> Iterator[pa.RecordBatch]:
    if path not in _lengths or _lengths[path].tier_one != frequent.words:  # what a worker has encoded outlives its tasks
        _lengths[path] = Lengths(_model(path), frequent.open())
        _lengths[path].tier_one = frequent.words
    lengths = _lengths[path]
    for batch in batches:
        n = [count(t.as_py(), lengths) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of docs(doc_id, text).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each; other columns are ignored.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(LengthTable(frequent_words(docs), model_path))
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task("parkflow.llm.tokencount", "count_batches", path=model_path, frequent=frequent, limit=limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
