"""Language identification by unigrams over a public vocabulary, with the segmentation summed out.

Each language has a probability for every piece of the vocabulary. The probability of a word is the sum over all ways
to cut it into pieces, by a forward algorithm over its letters; a text's score is the product over its words. The
probabilities are learned the same way: forward and backward sums give how often each piece is expected in each word,
over all ways to cut it, under a prior that falls with the piece's rank in the vocabulary.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parkflow.llm.common import task

CACHE_ENTRIES, SMOOTHING, UNKNOWN = 120_000, 0.1, 1e-8
#: Expected counts are summed as whole millionths, so that sums don't depend on how the rows lie; words of more letters
#: than SHORT are summed as logarithms, and this many letters are worked on at a time.
MILLIONTHS, SHORT, TOGETHER = 1_000_000, 15, 100_000
#: What a letter usually costs is learned as if so many pieces of unknown letters had been seen besides.
PRIOR_PIECES = 200
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
_state: dict = {}


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, of any length."""
    return WORD.findall(text.lower())


def _pieces(path: str) -> dict[str, int]:
    if ("pieces", path) not in _state:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _state["pieces", path] = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
        _state["model", path] = model
    return _state["pieces", path]


def rank_prior(pieces: dict[str, int]) -> np.ndarray:
    """Probability of each piece (and of an unknown letter, last) before anything is learned: falling with its rank."""
    prior = np.zeros(max(pieces.values()) + 2)
    at = np.array(sorted(pieces.values()))
    prior[at] = 1 / (np.arange(len(at)) + 10)
    prior /= prior.sum()
    prior[-1] = UNKNOWN
    return prior


def count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """How often each piece is expected in each language, in millionths; at most languages x vocabulary rows a task."""
    pieces = _pieces(path)
    if ("prior", path) not in _state:
        _state["prior", path] = Lookup(pieces), rank_prior(pieces)
    lookup, prior = _state["prior", path]
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(prior) - 1, np.int64))

    def add(words: dict[str, Counter]) -> None:
        every = sorted(set().union(*words.values()))
        number = {w: i for i, w in enumerate(every)}
        times = {lang: np.zeros(len(every), np.int64) for lang in words}
        for lang, c in words.items():
            times[lang][[number[w] for w in c]] = list(c.values())
        for group in _by_length(every):
            which, piece, share = expected_pieces(group, lookup, prior)
            which = np.array([number[w] for w in group])[which]
            for lang, n in times.items():
                counts[lang] += np.bincount(piece, share * n[which], len(prior) - 1).astype(np.int64)

    words: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            words[lang].update(words_of(text.as_py()))
            if sum(map(len, words.values())) > CACHE_ENTRIES:
                add(words)
                words.clear()
    if words:
        add(words)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "piece", "n"])


def train(labelled: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of each piece (rows) in each of them (columns), from labelled(lang, text).

    All rows count. What comes to the driver is a table of languages x vocabulary entries, whatever the input's size.
    """
    rows = labelled.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(task("parkflow.llm.langid", "count_batches", path=path), "lang string, piece int, n long")
    counts = rows.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique().tolist())
    table = np.zeros((max(_pieces(path).values()) + 1, len(langs)))
    for j, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        table[own["piece"].to_numpy(), j] = own["n"].to_numpy() / MILLIONTHS
    table += SMOOTHING
    return langs, table / table.sum(axis=0)


def usual_surprise(path: str, table: np.ndarray) -> np.ndarray:
    """What a letter of each language's own text costs on average: the entropy of its pieces over their length, pooled
    with PRIOR_PIECES pieces at the cost of an unknown letter. So little is expected of a language that little was learned
    of, and the more there was, the less the prior counts."""
    learned = np.maximum(0, SMOOTHING / table.min(axis=0, initial=1.0) - SMOOTHING * len(table))
    length = np.ones(len(table))
    for piece, i in _pieces(path).items():
        length[i] = len(piece)
    usual = -(table * np.log(table)).sum(axis=0) / (table * length[:, None]).sum(axis=0)
    return (learned * usual - PRIOR_PIECES * np.log(UNKNOWN)) / (learned + PRIOR_PIECES)


_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Lookup:
    """Numbers of pieces by a hash of their letters, for whole arrays at a time.

    A piece has its place in the first table, or in a later one where its place is taken."""

    def __init__(self, pieces: dict[str, int], bits: int = 20):
        self.longest, self.tables = max(map(len, pieces)), []
        hashes = {self.hash_of(p): i for p, i in pieces.items()}
        if len(hashes) < len(pieces):
            raise ValueError("two pieces have one hash")
        while hashes:
            keys, numbers, left = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), {}
            for h, i in hashes.items():
                at = self.places(np.array([h], np.uint64), bits)[0]
                if numbers[at] < 0:
                    keys[at], numbers[at] = h, i
                else:
                    left[h] = i
            self.tables.append((bits, keys, numbers))
            hashes, bits = left, max(8, bits - 4)

    @staticmethod
    def places(h: np.ndarray, bits: int) -> np.ndarray:
        return (((h ^ (h >> np.uint64(31))) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_STEP) + ord(c) + 1) % 2**64
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash's piece, -1 for none."""
        out = np.full(len(h), -1, np.int32)
        for bits, keys, numbers in self.tables:
            at = self.places(h, bits)
            out = np.where(keys[at] == h, numbers[at], out)
        return out


def _by_length(words: list[str]) -> Iterator[list[str]]:
    """Groups of words of one length, of at most TOGETHER letters where they are more than one."""
    by_length: dict[int, list[str]] = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for n, group in by_length.items():
        each = max(1, TOGETHER // n)
        for at in range(0, len(group), each):
            yield group[at : at + each]


def _pieces_at(words: list[str], lookup: Lookup) -> list[np.ndarray]:
    """For words of one length, with the mark of a word's start ahead: number of the piece of 1, 2, ... letters at each
    place (rows) of each word (columns), -1 for none."""
    n = len(words[0]) + 1
    letters = np.empty((n, len(words)), np.uint64)
    letters[0] = ord("▁")
    letters[1:] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n - 1).T
    letters += np.uint64(1)
    found, h = [], np.zeros((n, len(words)), np.uint64)
    with np.errstate(over="ignore"):
        for size in range(1, min(n, lookup.longest) + 1):
            h = h[: n - size + 1] * _STEP + letters[size - 1 :]
            found.append(lookup.find(h.ravel()).reshape(h.shape))
    return found


def _sums(pieces: list[np.ndarray], probability: np.ndarray, log: bool, back: bool = False) -> np.ndarray:
    """alpha[j]: the probability of the first j letters of each word in each language, all cuts summed; back: of those
    from j on. probability: by piece, unknown letters last; logarithms in and out where log."""
    n, words = pieces[0].shape
    alpha = np.full((n + 1, words, probability.shape[1]), -np.inf if log else 0.0)
    alpha[n if back else 0] = 0.0 if log else 1.0
    some = [(p >= 0).any(axis=1).tolist() for p in pieces]
    for j in range(n - 1, -1, -1) if back else range(1, n + 1):
        for size, piece in enumerate(pieces, 1):
            start = j if back else j - size
            if start < 0 or start + size > n or size > 1 and not some[size - 1][start]:
                continue
            before = alpha[j + size if back else start]
            own = piece[start]
            at = slice(None) if size == 1 else np.flatnonzero(own >= 0)
            if log:
                alpha[j, at] = np.logaddexp(alpha[j, at], before[at] + probability[own[at]])
            else:
                alpha[j, at] += before[at] * probability[own[at]]
    return alpha


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def forward(words: list[str], lookup: Lookup, table: np.ndarray) -> np.ndarray:
    """Log probability of words of one length in each language, all segmentations summed."""
    pieces, probability = _pieces_at(words, lookup), np.vstack([table, np.full(table.shape[1], UNKNOWN)])
    if len(words[0]) > SHORT:
        return _sums(pieces, _log(probability), True)[-1]
    return np.log(_sums(pieces, probability, False)[-1])


def expected_pieces(words: list[str], lookup: Lookup, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, piece, millionths): how often each piece is expected in words of one length over all ways to cut them."""
    pieces, log = _pieces_at(words, lookup), len(words[0]) > SHORT
    p = _log(prior)[:, None] if log else prior[:, None]
    ahead, behind = (_sums(pieces, p, log, back)[..., 0] for back in (False, True))
    out = []
    for size, piece in enumerate(pieces, 1):
        at, word = np.nonzero(piece >= 0)
        own = piece[at, word]
        if log:
            share = np.exp(ahead[at, word] + p[own, 0] + behind[at + size, word] - ahead[-1, word])
        else:
            share = ahead[at, word] * p[own, 0] * behind[at + size, word] / ahead[-1, word]
        out.append((word, own, np.rint(share * MILLIONTHS)))
    return tuple(np.concatenate(x) for x in zip(*out))


class Scorer:
    """Log probabilities of words, kept for as long as there is room."""

    def __init__(self, path: str, table: np.ndarray):
        self.lookup, self.table, self.usual = Lookup(_pieces(path)), table, usual_surprise(path, table)
        self.index: dict[str, int] = {}
        self.rows = np.zeros((CACHE_ENTRIES * 2, table.shape[1]))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > len(self.rows):
            self.index.clear()
            new = list(words)
            if len(new) > len(self.rows):
                self.rows = np.zeros((2 * len(new), self.table.shape[1]))
        for group in _by_length(new):
            at = len(self.index)
            self.rows[at : at + len(group)] = forward(group, self.lookup, self.table)
            self.index.update(zip(group, range(at, at + len(group))))

    def score(self, words: list[str]) -> np.ndarray:
        return self.rows[list(map(self.index.__getitem__, words))].sum(axis=0)


def _scorer(path: str, model: tuple[list[str], np.ndarray], key: str) -> Scorer:
    if ("scorer", key) not in _state:
        for old in [k for k in _state if k[0] == "scorer"]:
            del _state[old]
        _state["scorer", key] = Scorer(path, model[1])
    return _state["scorer", key]


def judged(texts: list[str | None], langs: list[str], scorer: Scorer) -> tuple[list, list, list]:
    """lang_pred, score and surprise of each text."""
    words = [words_of(t) if t and langs and any(map(str.isalpha, t)) else [] for t in texts]
    scorer.learn(set().union(*words))
    pred, score, surprise = [], [], []
    for w in words:
        if not w:
            pred.append(UNDETERMINED)
            score.append(0.0)
            surprise.append(None)
            continue
        log = scorer.score(w)
        p = np.exp(log - log.max())
        best = int(p.argmax())
        pred.append(langs[best])
        score.append(float(p[best] / p.sum()))
        surprise.append(float(-log[best] / (len(w) + sum(map(len, w))) / scorer.usual[best]))
    return pred, score, surprise


def predict_batches(batches: Iterator[pa.RecordBatch], path: str, model: tuple[list[str], np.ndarray], key: str) -> Iterator[pa.RecordBatch]:
    scorer = _scorer(path, model, key)
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            found = judged([t.as_py() for t in batch.column("text")], model[0], scorer)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(x, t) for x, t in zip(found, (pa.string(), pa.float64(), pa.float64()))]], [*keep, "lang_pred", "score", "surprise"])


def predict_series(texts: pd.Series, path: str, model: tuple[list[str], np.ndarray], key: str) -> pd.DataFrame:
    scorer, parts = _scorer(path, model, key), []
    for at in range(0, len(texts), 1024):
        parts.append(judged(texts.iloc[at : at + 1024].tolist(), model[0], scorer))
    return pd.DataFrame({c: [x for p in parts for x in p[k]] for k, c in enumerate(("lang_pred", "score", "surprise"))})


def held_out():
    """The documents that nothing is learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def _shared(spark: SparkSession, model: tuple[list[str], np.ndarray], path: str) -> dict:
    import hashlib

    return {"path": path, "model": spark.sparkContext.broadcast(model), "key": hashlib.sha256(model[1].tobytes() + repr(model[0]).encode()).hexdigest()}


def annotate(rows: DataFrame, model: tuple[list[str], np.ndarray], path: str) -> DataFrame:
    """rows(text, ...) with lang_pred, score and surprise in place of the text."""
    kept = rows.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "surprise": F.lit(None).cast("double")}).schema
    return rows.mapInArrow(task("parkflow.llm.langid", "predict_batches", **_shared(rows.sparkSession, model, path)), kept)


def language_of(spark: SparkSession, text: str, model: tuple[list[str], np.ndarray], path: str) -> Column:
    """lang_pred, score and surprise of a column of texts, as a struct: only the texts go to Python, the rows that they
    are of stay with the JVM."""
    run = task("parkflow.llm.langid", "predict_series", **_shared(spark, model, path))

    def judge(texts: pd.Series) -> pd.DataFrame:
        return run(texts)

    return F.pandas_udf(judge, "lang_pred string, score double, surprise double")(F.col(text))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and surprise for every row of docs(doc_id, text).

    score is the posterior of the predicted language under equal priors. surprise is what a letter of the text costs
    (its negative log probability) over what one costs on average in that language: about 1 for its own texts, more for
    what no learned language fits; null for `und`. A text that is null or has no letter, or any text where no language
    was learned, is `und` with score 0. A null doc_id isn't held out. Repeated rows are
    predicted each; other columns, language and source among them, aren't read.
    """
    return annotate(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model, path)


def identify_languages(docs: DataFrame, path: str) -> DataFrame:
    """Learn from the documents that aren't held out, and predict all."""
    return identify(docs, train(docs.filter(~F.coalesce(held_out(), F.lit(False))), path), path)
