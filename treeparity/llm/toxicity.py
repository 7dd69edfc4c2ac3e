"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length.

Folding maps look-alike letters of other scripts, accents, full-width and mathematical letters,
digits and signs that stand for letters to one letter, and everything else to one space; i, l and
1 are one letter. The lexicon is learned: words and word beginnings whose documents are toxic far
more often than chance allows, and those that many more of the words of toxic documents have than
of clean ones, which now and then do by chance. Occurrences inside exception phrases (words with a neighbour that
mostly occur in clean documents, and those given) do not count. No text is shuffled.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import columns, words
from .language import held_out

#: Bound of what is learned from: labelled rows, those with the smallest hash of their id.
SAMPLE_ROWS = 8_000
#: Word beginnings that are entries, in letters.
PREFIXES = (4, 5, 6)
#: Least lower bound of the share of toxic documents among those with an entry, and greatest upper bound for an exception.
SURE, CLEAN = 0.6, 0.4
Z = 1.64
#: An entry that is not sure: its share of toxic documents' different words against that of clean ones', and
#: the least lower bound (with deviations of its own) of its share of toxic documents against that of all.
RATE, Z_RATE, SHARE = 6.0, 4.5, 1.0
# Letters of other scripts by the Latin letter they look like.
LOOK_ALIKES = {
    "a": "аɑαａ", "b": "Ьвβ", "c": "сϲⅽ", "d": "ԁɗдđ", "e": "еєεҽэ", "g": "ɡԍ", "h": "һнհħ", "i": "іιıɩїɪ", "j": "јϳ", "k": "кκ", "l": "łⅼӏ", "m": "мⅿ",
    "n": "пηո", "o": "оοσօøө", "p": "рρ", "q": "ԛզ", "r": "гⲅ", "s": "ѕꜱ", "t": "тτ", "u": "υսц", "v": "ѵν", "w": "ԝωшщ", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
# Digits and signs by the letter they stand for.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
# Characters of no width.
NO_WIDTH = "­​‌‍⁠﻿"
#: Code points that are folded by a table; the few beyond it one by one.
_TABLE = 0x20000
_DROP = 0xFFFFFFFF


def _fold_one(c: str) -> int:
    if c in NO_WIDTH or unicodedata.combining(c):
        return _DROP
    for x in unicodedata.normalize("NFKD", c).lower():
        x = _ALIKE.get(x, x)
        x = DIGITS.get(x, x)
        if x.isalnum():
            return ord("i" if x == "l" else x)
        break
    return 32


_ALIKE = {x: latin for latin, all_of in LOOK_ALIKES.items() for x in all_of}


@functools.cache
def _folds() -> np.ndarray:
    return np.array([32 if 0xD800 <= c < 0xE000 else _fold_one(chr(c)) for c in range(_TABLE)], np.uint32)


def fold(text: bytes) -> str:
    """Folded words, one space before, between and after them."""
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    table = _folds()
    out = np.full(len(codes) + 2, 32, np.uint32)
    out[1:-1] = table[np.minimum(codes, _TABLE - 1)]
    if len(codes) and codes.max() >= _TABLE:
        far = np.flatnonzero(codes >= _TABLE)
        values, at = np.unique(codes[far], return_inverse=True)
        out[far + 1] = np.array([_fold_one(chr(c)) for c in values.tolist()], np.uint32)[at]
    for sign, letter in SIGNS.items():
        at = np.flatnonzero(codes == ord(sign)) + 1
        if len(at):
            inside = at[(out[at - 1] > 32) & (out[at + 1] > 32) & (out[at - 1] < _DROP) & (out[at + 1] < _DROP)]
            out[inside] = ord(letter)
    out = out[out != _DROP]
    out = out[(out != 32) | np.concatenate([[True], out[:-1] != 32])]
    return out.astype("<u4").tobytes().decode("utf-32-le")


def fold_term(term: str) -> str:
    return fold(term.encode()).strip()


class Lexicon:
    """Entries ' word ' or ' beginning' with weights, and exception phrases ' word word '.

    Those of the entries that are named in ``often`` tell by their number only.
    """

    def __init__(self, weights: dict[str, float], exceptions: list[str], often: frozenset[str] = frozenset()):
        self.matcher = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.matcher.add_word(term, (len(term), (term not in often, weight)))
        for phrase in exceptions:
            self.matcher.add_word(phrase, (len(phrase), None))
        self.empty = not len(self.matcher)
        if not self.empty:
            self.matcher.make_automaton()

    def features(self, text: str) -> tuple[float, float, int, int]:
        """Sums of the weights of sure entries and of the others, occurrences and words.

        At each word one entry counts, the heaviest sure one or else the heaviest.        Where an entry is not sure, the weight of a word that a text repeats grows with the logarithm
        of its occurrences, so that a phrase said over and over is no evidence.
        """
        n = text.count(" ") - 1 if len(text) > 1 else 0
        if self.empty:
            return 0.0, 0.0, 0, n
        at: dict[int, tuple[bool, float]] = {}
        free: list[tuple[int, int]] = []
        for end, (size, weight) in self.matcher.iter(text):
            start = end - size + 1
            if weight is None:
                free.append((start, end))
            elif weight > at.get(start, (False, 0.0)):
                at[start] = weight
        for a, b in free:
            for start in [s for s in at if a <= s < b]:
                del at[start]
        repeats = Counter((text[start : text.find(" ", start + 1)], weight) for start, (is_sure, weight) in at.items() if not is_sure)
        often = math.fsum(weight * math.log2(1 + k) for (_, weight), k in repeats.items())
        return math.fsum(weight for is_sure, weight in at.values() if is_sure), often, len(at), n


def inputs(total: float, often: float, hits: int, n: int) -> list[float]:
    """What the score is made of: of both sums the weight and that for the length, and whether there is any sure entry."""
    return [1.0, float(total > 0), math.log1p(total), math.log1p(100.0 * total / (n + 20)), math.log1p(often), math.log1p(100.0 * often / (n + 20))]


def _terms(text: str) -> Counter:
    """How many different words of a text have each term; the empty term stands for all of them."""
    every = set(text.split())
    found = Counter({"": len(every)})
    for w in every:
        if len(w) > 2 and not w.isdigit():
            found[f" {w} "] += 1
            found.update(f" {w[:k]}" for k in PREFIXES if len(w) >= k)
    return found


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term and their different words with it, by label; columns label, text."""
    for batch in batches:
        counts = Counter(), Counter(), Counter(), Counter()
        for label, text in zip(batch.column(0).to_pylist(), words.text_bytes(batch.column(1)), strict=True):
            found, of = _terms(fold(text)), 0 if label else 1
            counts[of].update(found.keys())
            counts[of + 2].update(found)
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], names=["term", "t", "c", "times_t", "times_c"])


def _count_phrases(weights: dict[str, float]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights, [])
        for batch in batches:
            found: Counter = Counter()
            for label, text in zip(batch.column(0).to_pylist(), words.text_bytes(batch.column(1)), strict=True):
                folded, mine = fold(text), set()
                for end, (size, _) in lexicon.matcher.iter(folded) if not lexicon.empty else ():
                    start = end - size + 1
                    stop = folded.find(" ", start + 1)
                    before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
                    mine |= {folded[before : stop + 1]} if before >= 0 else set()
                    mine |= {folded[start : after + 1]} if after > 0 else set()
                found.update((p, int(bool(label))) for p in mine)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n * y for (_, y), n in found.items()], pa.int64()), pa.array([n * (1 - y) for (_, y), n in found.items()], pa.int64())], names=["term", "t", "c"])

    return count


def _bound(sign: str, z: float = Z) -> F.Column:
    """Wilson's bound of the share t / (t + c), as SQL."""
    z2 = z * z
    return F.expr(f"((t / (t + c)) + {z2 / 2} / (t + c) {sign} {z} * sqrt((t / (t + c)) * (c / (t + c)) / (t + c) + {z2 / 4} / ((t + c) * (t + c)))) / (1 + {z2} / (t + c))")


def _features(weights: dict[str, float], exceptions: list[str], often: frozenset[str], text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights, exceptions, often)
        for batch in batches:
            found = [lexicon.features(fold(t)) for t in words.text_bytes(batch.column(text_at))]
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "total", "often", "hits", "n_words"])

    return features


def _fit(rows: list[tuple]) -> list[float]:
    """Logistic regression with a small penalty, by Newton's steps, on the label and the features."""
    x = np.array([inputs(*r[1:]) for r in rows])
    y = np.array([float(bool(r[0])) for r in rows])
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta)), x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


class Model:
    """Weights by entry, exception phrases, the coefficients of the score, and the entries that are not sure."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], beta: list[float], often: frozenset[str] = frozenset()):
        self.weights, self.exceptions, self.beta, self.often = weights, exceptions, beta, often


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Model:
    """From a bounded sample of the labelled rows that are not held out.

    A label is toxic if it is above 0 as a whole number; null labels and ids teach nothing, and of
    several labels of an id the greatest counts. Of several texts of an id, that of the smallest
    hash is learned from. Without labelled rows every score is the same.
    """
    label = (F.col("toxic").cast("int") > 0).cast("int")
    chosen = labels.where(~held_out() & label.isNotNull()).groupBy("doc_id").agg(F.max(label).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    scratch = Scratch(spark, "toxicity")
    chosen = F.broadcast(scratch.table(chosen, "chosen"))  # at most SAMPLE_ROWS rows of two numbers
    one = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = scratch.table(one.select("toxic", F.col("t.text").alias("text")).repartition(spark.sparkContext.defaultParallelism), "sample")
    counts = ["t", "c", "times_t", "times_c"]
    counted = scratch.table(rows.mapInArrow(_count_terms, "term string, t long, c long, times_t long, times_c long").groupBy("term").agg(*[F.sum(c).alias(c) for c in counts]), "terms")
    n = counted.where("term = ''").first() or dict.fromkeys(counts, 0)
    weight = lambda t, c: F.log((F.col(t) + 0.5) / (n[t] + 1)) - F.log((F.col(c) + 0.5) / (n[c] + 1))
    sure, rate = F.col("low") >= SURE, weight("times_t", "times_c")
    often = (rate >= math.log(RATE)) & (_bound("-", Z_RATE) >= SHARE * n["t"] / max(n["t"] + n["c"], 1))
    known = counted.where("term <> '' and t > 2").withColumn("low", _bound("-")).where(sure | often)
    entries = known.select("term", "low", F.when(sure, weight("t", "c")).otherwise(rate).alias("weight")).collect()  # of the sample's words
    weights: dict[str, float] = {}
    low: dict[str, float] = {}
    for r in sorted(entries, key=lambda r: (len(r["term"].rstrip()), r["term"])):
        term = r["term"]
        if not any(low.get(term[:k], 0.0) >= r["low"] - 0.05 for k in range(len(term))):
            low[term] = r["low"]
            weights[term] = r["weight"]
    vague = frozenset(t for t in weights if low[t] < SURE)
    phrases = rows.mapInArrow(_count_phrases(weights), "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    free = [r["term"] for r in phrases.withColumn("high", _bound("+")).where(f"c > 2 and high <= {CLEAN}").collect()]
    free += [f" {fold_term(p)} " for p in exceptions]
    seen = rows.mapInArrow(_features(weights, free, vague, 1), "toxic int, text string, total double, often double, hits long, n_words long").select(F.col("toxic").cast("int"), "total", "often", "hits", "n_words").collect()
    scratch.drop()
    return Model(weights, free, _fit([tuple(r) for r in seen]) if seen else [-2.0] + [0.0] * 5, vague)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with total, often, hits, n_words and score (columns of these names are replaced).

    Null and empty texts have no words and get the score of a text without any hit.
    """
    own = columns.others(docs, "total", "often", "hits", "n_words", "score")
    found = columns.mapped(docs, own, _features(model.weights, model.exceptions, model.often, own.index(text_col)), "total double, often double, hits long, n_words long")
    b = model.beta
    x = F.lit(b[0]) + F.lit(b[1]) * (F.col("total") > 0).cast("double")
    for i, c in ((2, "total"), (4, "often")):
        x += F.lit(b[i]) * F.log1p(c) + F.lit(b[i + 1]) * F.log1p(100.0 * F.col(c) / (F.col("n_words") + 20))
    return found.withColumn("score", 1 / (1 + F.exp(-x)))


def op3_query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows by a model of the labels; rows are scored one by one, those with null ids are held out."""
    model = learn(spark, docs, labels)
    found = score_toxicity(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "hits")
