"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text yields longest-match lengths; parsing a text
greedily into longest matches, the language that needs the fewest phrases, weighted by the bits a
phrase costs, wins. Each language has an alphabet of its own, that of its text. Many segments of
text are parsed at once, one symbol a step, in numpy; a segment that did not begin where the one
before ends is parsed again from there until both ways meet, so that the result is that of one
parse from beginning to end. No text is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import columns, words

#: Bounds of what is learned from: whole rows of each language (fewer if there are many languages),
#: those with the smallest hashes, until they have so many characters.
SAMPLE_DOCS = 96
SAMPLE_DOCS_ALL = 4096
SYMBOLS = 32_000
SYMBOLS_ALL = 1_000_000
#: Longer rows are learned from only where a language has too few others; one that is longer than all SYMBOLS, only up to that.
LONG = 4_000
SEGMENT = 256
#: Entries of a table of transitions; beyond, with a large alphabet, transitions are hashed.
DENSE = 1 << 23
_BMP = 1 << 16


@functools.cache
def _lowered() -> np.ndarray:
    """Lower-case code point of each letter below 2**16, 0 for all that is no letter."""
    out = np.zeros(_BMP, np.uint32)
    for c in range(_BMP):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(x.lower()[0])
    return out


def letters(text: bytes) -> np.ndarray:
    """Lower-case letters as code points, 0 for each run of anything else."""
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    if len(codes) and codes.max() >= _BMP:
        far = codes >= _BMP
        low = _lowered()[np.where(far, 0, codes)]
        known = {c: ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in np.unique(codes[far]).tolist()}
        low[far] = [known[c] for c in codes[far].tolist()]
    else:
        low = _lowered()[codes]
    return low[(low != 0) | np.concatenate([[True], low[:-1] != 0])] if len(low) else low


def suffix_automaton(sequence: np.ndarray) -> list[dict[int, int]]:
    """Transitions by state and symbol of all substrings of ``sequence``; 0 is the root."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sequence.tolist():
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p != -1:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return following


class Dense:
    """Steps of an automaton that begins again at the root, as one table; states are row starts."""

    def __init__(self, following: list[dict[int, int]], width: int):
        pad, between = width - 1, len(following)  # between: where a phrase is over, the next symbol begins one, whatever it is
        restart = np.full(width, between * width, np.int32)
        restart[list(following[0])] = [x * width for x in following[0].values()]
        table = np.empty((between + 1, width), np.int32)
        table[:] = ~restart
        for s, t in enumerate(following):
            table[s, list(t)] = [x * width for x in t.values()]
        table[:, pad] = between * width
        self.between, self.table = between * width, table.reshape(-1)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and -1 where a phrase begins, else 0."""
        v = self.table[state + symbol]
        begins = v >> 31
        return v ^ begins, begins


class Hashed:
    """The same steps by open addressing, for alphabets of thousands of letters."""

    def __init__(self, following: list[dict[int, int]], width: int):
        self.width, self.between = width, len(following)
        keys = np.array([s * width + c for s, t in enumerate(following) for c in t], np.int64)
        to = np.array([x for t in following for x in t.values()], np.int32)
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.to[at[placed]] = keys[placed], to[placed]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask
        self.root = np.full(width, self.between, np.int32)
        for c, x in following[0].items():
            self.root[c] = x

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = state.astype(np.int64) * self.width + symbol
        at, out, begins = self._slot(keys), self.root[symbol], np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            here = self.keys[at[left]]
            found = left[here == keys[left]]
            out[found], begins[found] = self.to[at[found]], 0
            left = left[(here != keys[left]) & (here >= 0)]
            at[left] = (at[left] + 1) & self.mask
        pad = symbol == self.width - 1
        out[pad], begins[pad] = self.between, 0
        return out, begins


class Model:
    """Automata by language, each with its own symbols: 0 no letter, its letters, any other letter, and padding."""

    def __init__(self, samples: dict[str, np.ndarray]):
        self.langs = sorted(samples)
        known = np.unique(np.concatenate([np.zeros(1, np.uint32), *(samples[k] for k in self.langs)]))
        self.letter = np.full(_BMP, len(known), np.int32)  # a number for each known letter
        near = known < _BMP
        self.letter[known[near]] = np.flatnonzero(near)
        self.known, self.other, self.pad = known, len(known), len(known) + 1
        self.local, self.steps, self.bits = [], [], []
        for lang in self.langs:
            mine = np.unique(np.concatenate([[0], self.numbers(samples[lang])]))
            local = np.full(self.pad + 1, len(mine), np.int32)
            local[mine] = np.arange(len(mine))
            local[self.pad] = len(mine) + 1
            following, width = suffix_automaton(local[self.numbers(samples[lang])]), len(mine) + 2
            self.steps.append((Dense if (len(following) + 1) * width <= DENSE else Hashed)(following, width))
            self.local.append(local)
            self.bits.append(np.log2(len(samples[lang]) + 2))

    def numbers(self, low: np.ndarray) -> np.ndarray:
        """Known letters by number, any other as one."""
        out = self.letter[np.minimum(low, _BMP - 1)]
        far = np.flatnonzero(low >= _BMP)
        if len(far):
            at = np.minimum(np.searchsorted(self.known, low[far]), len(self.known) - 1)
            out[far] = np.where(self.known[at] == low[far], at, self.other)
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text, as numbers of letters, by language."""
        counts = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        grid = np.full((int(counts.sum()), SEGMENT), self.pad, np.int32)
        row = 0
        for t, n in zip(texts, counts, strict=True):
            grid[row : row + n].ravel()[: len(t)] = t
            row += n
        follows = np.concatenate([[False], owner[1:] == owner[:-1]]) if len(owner) else np.zeros(0, bool)
        size = (grid != self.pad).sum(axis=1)
        order = np.lexsort((-size, ~follows))  # those that follow first, in each part the longest
        n_follow = int(follows.sum())
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = place[order[:n_follow] - 1]  # where the segment before each of those is
        steps_ = np.ascontiguousarray(grid[order].T)
        live = [[k - int(np.searchsorted(size[part][::-1], t, side="right")) for t in range(SEGMENT)] for part, k in ((order[:n_follow], n_follow), (order[n_follow:], len(order) - n_follow))]
        out = np.zeros((len(texts), len(self.langs)))
        for k, (local, step) in enumerate(zip(self.local, self.steps, strict=True)):
            symbols = local[steps_]
            state = np.full(len(order), step.between, np.int32)
            n = np.zeros(len(order), np.int32)
            states, sums = (np.zeros((SEGMENT, n_follow), x) for x in (np.int32, np.int16))
            for t in range(SEGMENT):
                a, b = live[0][t], n_follow + live[1][t]
                for i, j in ((0, a), (n_follow, b)):
                    if i < j:
                        state[i:j], begins = step(state[i:j], symbols[t, i:j])
                        n[i:j] -= begins
                states[t], sums[t] = state[:n_follow], n[:n_follow]
            self._join(step, symbols, size[order], before, state, n, states, sums)
            out[:, k] = np.bincount(owner[order], n, len(texts)) if len(order) else 0
        return out

    def _join(self, step, symbols, size, before, state, n, states, sums) -> None:
        """Parse segments again that the one before does not end in front of a new phrase, until no end changes.

        ``states`` and ``sums`` are each segment's first way; where another meets it, the rest is known.
        """
        k = len(before)
        entry, end, total = np.full(k, step.between, np.int32), state[:k].copy(), n[:k].copy()
        while len(again := np.flatnonzero(state[before] != entry)):
            entry[again] = state[before[again]]
            now, count = entry[again], np.zeros(len(again), np.int32)
            for t in range(len(states)):
                over = size[again] <= t
                if over.any():
                    state[again[over]], n[again[over]] = now[over], count[over]
                    again, now, count = again[~over], now[~over], count[~over]
                if not len(again):
                    break
                now, begins = step(now, symbols[t, again])
                count = count - begins
                apart = now != states[t, again]
                gone = again[~apart]
                state[gone], n[gone] = end[gone], count[~apart] + total[gone] - sums[t, gone]
                again, now, count = again[apart], now[apart], count[apart]
            state[again], n[again] = now, count

    def unknown(self, texts: list[np.ndarray]) -> np.ndarray:
        """Letters of each text that a language's text does not have, by language; each costs a phrase more."""
        ends = np.cumsum([0] + [len(t) for t in texts])
        whole = np.concatenate([np.zeros(0, np.int32), *texts])
        strange = [np.where(np.arange(len(local)) < self.pad, local == local[self.other], False) for local in self.local]
        sums = [np.concatenate([[0], np.cumsum(x[whole], dtype=np.int64)]) for x in strange]
        return np.stack([np.diff(x[ends]) for x in sums], axis=1) if texts else np.zeros((0, len(self.langs)))

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """The language, ``und`` for texts without a letter, and a weight of evidence from 0 to 1."""
        low = [letters(t) for t in texts]
        has = np.array([bool(x.any()) for x in low], bool)
        numbers = [self.numbers(x) for x in low]
        n = (self.phrases(numbers) + self.unknown(numbers)) * np.array(self.bits)
        best = n.argmin(axis=1)
        share = np.exp(-np.minimum(n - n.min(axis=1, keepdims=True), 600.0) / 20)
        score = 1 / share.sum(axis=1)
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], [float(s) if h else 0.0 for s, h in zip(score, has, strict=True)]


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for rows that nothing may be learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame) -> dict[str, str]:
    """Text by language of a bounded number of rows (doc_id, text, lang), whole texts one after another.

    Rows are drawn by hashes of id and text, each text of an id once; short ones come first. The
    first one of a language is taken whatever its length, up to the bound of all.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("g"), F.length("text").alias("n"), "text")
    keys = rows.select("lang", "h", "g", "n").distinct()
    n_langs = rows.select("lang").distinct().count()
    if not n_langs:
        return {}
    most, symbols = max(4, min(SAMPLE_DOCS, SAMPLE_DOCS_ALL // n_langs)), min(SYMBOLS, SYMBOLS_ALL // n_langs)
    at = Window.partitionBy("lang").orderBy(F.col("n") > LONG, "h", "g")
    first = keys.withColumn("r", F.row_number().over(at)).where(f"r <= {most}")
    sums = F.sum("n").over(Window.partitionBy("lang").orderBy("r"))
    chosen = first.withColumn("s", sums).where(f"s <= {symbols} or r = 1").select("lang", "h", "g", "r")
    picked = rows.join(F.broadcast(chosen), ["lang", "h", "g"])  # at most SAMPLE_DOCS_ALL rows of four numbers
    found = picked.groupBy("lang", "r").agg(F.min(F.substring("text", 1, symbols)).alias("text")).orderBy("lang", "r").collect()
    out: dict[str, str] = {}
    for r in found:
        out[r["lang"]] = out.get(r["lang"], "") + " " + r["text"]
    return out


_held: dict[tuple[tuple[str, str], ...], Model] = {}


def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    """The model of ``samples``, made once in a worker, which holds one at a time."""
    if samples not in _held:
        _held.clear()
        _held[samples] = Model({lang: letters(text.encode()) for lang, text in samples})
    return _held[samples]


def _identify(samples: tuple[tuple[str, str], ...], text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.text_bytes(batch.column(text_at))
            langs, scores = [], []
            for i, j in words.blocks(texts):
                a, b = _model(samples).predict(texts[i:j]) if samples else (["und"] * (j - i), [0.0] * (j - i))
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return identify


def identify_language(spark: SparkSession, docs: DataFrame, learn_from: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with lang_pred and score (columns of these names are replaced).

    Learns from ``learn_from`` (doc_id, text, lang; ``docs`` itself by default): a bounded sample
    of rows that are not held out and have a language. A text that is null, empty or has no letter
    is ``und`` with score 0, and so is every text if there is nothing to learn from. Ties go to
    the first language by code point.
    """
    learned = sample(docs if learn_from is None else learn_from)
    own = columns.others(docs, "lang_pred", "score")
    return columns.mapped(docs, own, _identify(tuple(sorted(learned.items())), own.index(text_col)), "lang_pred string, score double")


def op10_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = identify_language(spark, docs.select("doc_id", "text"), docs.select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
