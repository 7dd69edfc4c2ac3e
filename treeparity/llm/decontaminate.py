"""Benchmark decontamination: training words inside any occurrence of a benchmark n-gram.

The benchmark's n-grams are hashed over normalised words; every document window is looked up in
that set, each hit is verified on the words themselves, and spans or documents are removed. No
document is shuffled. The benchmark is broadcast only in blocks of at most ``BLOCK_BYTES`` text;
a larger benchmark takes several passes, each written to the shared folder.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import columns, words

WINDOW = 10
#: Benchmark text that one broadcast holds at most; a longer single item is a block of its own.
BLOCK_BYTES = 16 << 20
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_DELIMITERS_TO_SPACE = bytes(32 if d else int(c) for d, c in zip(words.ALNUM.delim, words.ALNUM.lower, strict=True))


def _words(text: bytes) -> list[bytes]:
    return text.translate(_DELIMITERS_TO_SPACE).split()


class Index:
    """Windows of items by their length in words, in arrays: some 30 bytes for each word of the items.

    A window is a hash, the number of its first word among all words and its item; the words
    themselves lie in one buffer, in which every hit is verified.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = [item for item, _ in items]
        texts = [b" ".join(_words(text)) for _, text in items]
        self.buffer = b"\n".join(texts)
        raw = np.frombuffer(b"\n" + self.buffer + b"\n", np.uint8)
        edges = np.flatnonzero(np.diff(((raw == 32) | (raw == 10)).astype(np.int8)))
        self.start, self.end = edges[0::2].astype(np.int64), edges[1::2].astype(np.int64)
        h, counts = words.hash_words(texts, words.ALNUM)
        begins = np.cumsum(counts) - counts
        self.by_length = {}
        for k in sorted(set(np.minimum(counts, window).tolist()) - {0}):
            mine = np.flatnonzero(np.minimum(counts, window) == k)
            n = counts[mine] - k + 1
            item = np.repeat(mine, n).astype(np.int32)
            first = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + begins[item]
            hashes = words.windows(h, k)[first]
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            shift = np.uint64(64 - min(22, max(10, len(hashes).bit_length() + 3)))
            seen = np.zeros(1 << (64 - int(shift)), bool)
            seen[hashes >> shift] = True
            self.by_length[k] = (hashes, seen, shift, first[order], item[order])

    def holders(self, k: int, at: int, to: int) -> dict[bytes, set[str]]:
        """Items by window, of the windows ``at`` to ``to``, which have one hash."""
        first, item = self.by_length[k][3:]
        found: dict[bytes, set[str]] = {}
        for f, i in zip(first[at:to].tolist(), item[at:to].tolist(), strict=True):
            found.setdefault(self.buffer[self.start[f] : self.end[f + k - 1]], set()).add(self.names[i])
        return found

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, int, dict[int, int], set[str]]]:
        """For each text: its words, hits as first word -> words, and items; positions are word indexes."""
        h, counts = words.hash_words(texts, words.ALNUM)
        ends = np.cumsum(counts)
        owner_end = np.repeat(ends, counts)
        hits: dict[int, list[tuple[int, int, int]]] = {}
        known: dict[tuple[int, int], dict[bytes, set[str]]] = {}
        for k, (hashes, seen, shift, _, _) in self.by_length.items():
            w = words.windows(h, k)
            at = np.flatnonzero(seen[w >> shift])
            at = at[at + k <= owner_end[at]]
            low = np.searchsorted(hashes, w[at])
            same = hashes[np.minimum(low, len(hashes) - 1)] == w[at]
            at, low = at[same], low[same]
            for pos, value in zip(*np.unique(low, return_index=True), strict=True):
                known[k, int(pos)] = self.holders(k, int(pos), int(np.searchsorted(hashes, w[at[value]], side="right")))
            for doc, first, pos in zip(np.searchsorted(ends, at, side="right").tolist(), at.tolist(), low.tolist(), strict=True):
                hits.setdefault(doc, []).append((first - int(ends[doc] - counts[doc]), k, pos))
        for i, n in enumerate(counts):
            good: dict[int, int] = {}
            items: set[str] = set()
            if i in hits:
                w = _words(texts[i])
                for first, k, pos in hits[i]:
                    if holders := known[k, pos].get(b" ".join(w[first : first + k])):
                        good[first] = max(k, good.get(first, 0))
                        items |= holders
            yield i, int(n), good, items


_indexes: dict[str, Index] = {}


def _index(token: str, block, window: int) -> Index:
    """The index of a broadcast block, made once in a worker."""
    if token not in _indexes:
        _indexes.clear()
        _indexes[token] = Index(block.value, window)
    return _indexes[token]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans (first, last), both included."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _scanner(token: str, block, window: int, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds a block's hits to the last three columns: words, spans and items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(token, block, window)
        for batch in batches:
            texts = words.text_bytes(batch.column(text_at))
            own = batch.num_columns - 3
            old_spans, old_items = batch.column(own + 1), batch.column(own + 2)
            n_words, spans, items = [], [], []
            for i, j in words.blocks(texts):
                for k, n, good, found in index.scan(texts[i:j]):
                    n_words.append(n)
                    before = [(s["first"], s["last"]) for s in old_spans[i + k].as_py()]
                    spans.append([{"first": a, "last": b} for a, b in _merge(before + [(a, a + w - 1) for a, w in good.items()])] if good else old_spans[i + k].as_py())
                    items.append(sorted({*old_items[i + k].as_py(), *found}))
            new = [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *new], names=batch.schema.names)

    return scan


def find_hits(spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with n_words, spans (struct first, last: word indexes, merged) and items (sorted).

    Null and empty texts have no words. An item without words has no window; one of fewer words
    than ``window`` is one window; a null item id counts as the empty string; equal ids are one
    item. Columns of ``docs`` named n_words, spans or items are replaced, all others kept.
    """
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-total // BLOCK_BYTES) or 1
    own = columns.others(docs, "n_words", "spans", "items")
    none = F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items")
    now = columns.numbered(docs, own, *none)
    scratch = Scratch(spark, "decontaminate") if n_blocks > 1 else None
    for b in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == b).collect()
        block = spark.sparkContext.broadcast([(r[0], r[1].encode()) for r in rows])
        now = now.mapInArrow(words.lean(_scanner(uuid.uuid4().hex, block, window, own.index(text_col))), now.schema)
        if scratch and b < n_blocks - 1:
            now = scratch.table(now, f"block-{b}")
            if b:
                scratch.drop(f"block-{b - 1}")
    return now.toDF(*own, "n_words", "spans", "items")


def n_hit(spans: str = "spans") -> Column:
    """Words inside spans, which do not overlap."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def _cutter(text_at: int, spans_at: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            for i, spans in enumerate(batch.column(spans_at).to_pylist()):
                if spans:
                    raw = texts[i].encode()
                    at = [m.span() for m in word.finditer(raw.translate(words.ALNUM.lower))]
                    keep, last = [], 0
                    for s in spans:
                        keep.append(raw[last : at[s["first"]][0]])
                        last = at[s["last"]][1]
                    texts[i] = b"".join([*keep, raw[last:]]).decode()
            new = [*batch.columns[:text_at], pa.array(texts, pa.string()), *batch.columns[text_at + 1 :]]
            yield pa.RecordBatch.from_arrays(new, names=batch.schema.names)

    return cut


def remove_hits(spark: SparkSession, docs: DataFrame, items: DataFrame, remove: str = "documents", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit words.

    Rows are judged one by one: each of several equal rows stays or goes, and one with a null or
    empty text or a null id stays. All columns are kept as they are, also those that
    ``find_hits`` would replace.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = find_hits(spark, docs.toDF(*names), items, text_col=names[docs.columns.index(text_col)])
    if remove == "documents":
        return found.where(F.size("spans") == 0).select(*names).toDF(*docs.columns)
    at = docs.columns.index(text_col), len(names) + 1
    return found.mapInArrow(words.lean(_cutter(*at)), found.schema).select(*names).toDF(*docs.columns)


def op6_query(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    found = find_hits(spark, docs.select("doc_id", "text"), items).withColumn("n_hit", n_hit())
    ids = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """The definition, word by word; for tests."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = []
    for item, text in items:
        w = cut(text)
        grams += [(str(item), w[i : i + min(window, len(w))]) for i in range(max(1, len(w) - window + 1)) if w]
    out = {}
    for doc, text in docs:
        w, hit, ids = cut(text), set(), set()
        for item, g in grams:
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    ids.add(item)
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out
