"""Document fingerprints: MinHash signatures in vectorised numpy, bands joined in Spark.

A signature has ``HASHES`` values of 16 bits, minima of universal hash functions over 5-word
shingles; the fraction of equal values estimates the Jaccard likeness. ``similar_classes`` joins
signature bands and verifies the likeness on the sets themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import columns, near_dedup, words

HASHES = 128
SHINGLE = 5
#: Bytes of input that one group of neighbouring documents is dealt, unless there would be more than MOST_GROUPS.
GROUP_BYTES = 8 << 20
MOST_GROUPS = 1 << 16
#: Rows that are looked at for each cut between groups.
ROWS_PER_CUT = 16
#: Bytes of text that are worked on at once.
BLOCK_BYTES = 1 << 21
#: A pair at the threshold shares one of the bands but for a chance of 1.2e-3, one at 0.8 of 5e-5.
BANDS, BAND_ROWS = 25, 5
SKETCH = near_dedup.Sketch((("<u2", HASHES),), least=74, sure=105)


def signatures(texts: list[bytes]) -> np.ndarray:
    """A row of 16-bit minima for each text; without words all are 65535."""
    minhash = words.MinHash(HASHES, seed=29)
    out = np.empty((len(texts), HASHES), np.uint16)
    for i, j in words.blocks(texts):
        out[i:j] = minhash(*words.shingles(texts[i:j], SHINGLE)) & np.uint32(0xFFFF)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(axis=1) if len(x) else np.zeros(0)


def as_text(x: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in x]


def _fingerprint(text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = as_text(signatures(words.text_bytes(batch.column(text_at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "fingerprint"])

    return fingerprint


def fingerprint_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its fingerprint (a column of that name is replaced); null is empty."""
    own = columns.others(docs, "fingerprint")
    return columns.mapped(docs, own, _fingerprint(own.index(text_col)), "fingerprint string")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text_key, text) to (doc_id, text_key, sketch); null without words."""
    for batch in batches:
        found = signatures(words.text_bytes(batch.column(2)))
        some = (found != 0xFFFF).any(axis=1)
        sketch = [x.tobytes() if ok else None for x, ok in zip(found, some, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sketch, pa.binary())], names=["doc_id", "text_key", "sketch"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, sketch) to (key, node), one for each band; a key is a hash of the band's number and values."""
    for batch in batches:
        sketch = SKETCH.rows(batch.column(1))[0][:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sketch.shape[:2])
        for k in range(BAND_ROWS):
            key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, :, k])
        node = np.repeat(np.asarray(batch.column(0)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])


def similar_classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_key, class_id) of the texts that are like others: signature bands joined, Jaccard verified on full sets.

    text_key is xxhash64 of the text, class_id the smallest id of any row in the class. Equal texts
    are one node. Nodes that share a band meet, by leaders first and then all those that are still
    in different classes, as in ``near_dedup``: no link inside a bucket is lost, and a bucket of
    copies costs a comparison or two per node and not per pair. Texts without words, and those
    without a partner whose row is alone, are not in the result; null ids come last in a class.
    """
    scratch = Scratch(spark, "fingerprints")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    signed = scratch.table(own.mapInArrow(words.lean(_sign), "doc_id long, text_key long, sketch binary"), "signed").where("sketch is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("f")
    nodes = signed.groupBy(F.col("text_key").alias("node")).agg(first, F.count("*").alias("copies"), F.min("sketch").alias("sketch"))
    nodes = scratch.table(nodes.select("node", F.col("f.doc_id").alias("first_id"), F.col("node").alias("text_key"), "copies", "sketch"), "nodes")
    bands = nodes.select("node", "sketch").mapInArrow(words.lean(_bands), "key long, node long")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.table(bands.join(shared, "key").select("key", "node", "n"), "met")
    texts = scratch.table(near_dedup.first_texts(own, nodes.join(met.select("node").distinct(), "node", "left_semi")), "texts")
    roots = near_dedup.join_members(met, nodes, texts, scratch, SKETCH)
    ids = nodes.select("node", "first_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = ids.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("members")).where("members > 1")
    found = scratch.table(ids.join(least, "root").select(F.col("node").alias("text_key"), "class_id"), "classes")
    scratch.keep_only("classes")
    return found


def _sort_keys(ids: pa.Array, crc: pa.Array) -> np.ndarray:
    """Thirteen bytes a row that sort as (id, nulls first, then checksum)."""
    out = np.zeros((len(ids), 13), np.uint8)
    out[:, 0] = ~np.asarray(ids.is_null())
    values = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1:9] = np.where(out[:, :1], values.astype(">u8").view(np.uint8).reshape(-1, 8), 0)
    out[:, 9:] = np.asarray(crc).astype(">u4").view(np.uint8).reshape(-1, 4)
    return out.view("S13").ravel()


def _deal(cuts: np.ndarray, least: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, crc, text) to (grp, guest, doc_id, crc, text as zstd).

    A cut is a row's key, so that it is the first of its group; that row visits the group before
    too, and the first of all the last group. Of equal ones, a batch sends the first.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, crc = batch.column(0), batch.column(1)
            keys = _sort_keys(ids, crc)
            grp = np.searchsorted(cuts, keys, side="right")
            opens = np.flatnonzero((grp > 0) & (cuts[np.maximum(grp, 1) - 1] == keys)) if len(cuts) else np.zeros(0, np.int64)
            null = np.asarray(ids.is_null())
            begins = np.flatnonzero(null if least is None else ~null & (np.asarray(ids.fill_null(0)) == least))
            packed = [squeeze.compress(t) for t in words.text_bytes(batch.column(2))]
            visits: dict[int, int] = {}
            for rows, to in ((opens, grp[opens] - 1), (begins, np.full(len(begins), len(cuts)))):
                for r, g in zip(rows.tolist(), to.tolist(), strict=True):
                    if g not in visits or (keys[r], packed[r]) < (keys[visits[g]], packed[visits[g]]):
                        visits[g] = r
            rows = pa.array([*range(len(grp)), *visits.values()], pa.int64())
            to = pa.array([*grp.tolist(), *visits], pa.int32())
            guest = pa.array([False] * len(grp) + [True] * len(visits))
            yield pa.RecordBatch.from_arrays([to, guest, ids.take(rows), crc.take(rows), pa.array(packed, pa.binary()).take(rows)], names=["grp", "guest", "doc_id", "crc", "packed"])

    return deal


_DEALT = "grp int, guest boolean, doc_id long, crc long, packed binary"
_EDITED = "doc_id long, text_key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group's own rows in order, then its guests, as a stream: every text, its edited text and the next."""
    open_up = zstandard.ZstdDecompressor()
    own: list[tuple[int | None, bytes]] = []
    size, grp, done = 0, None, False
    for batch in batches:
        for g, guest, i, packed in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 4)], strict=True):
            text = open_up.decompress(packed)
            if g != grp:
                if own:
                    yield _compare(own, own[-1][1])
                own, size, grp, done = [], 0, g, False
            if guest:
                if own and not done:
                    yield _compare(own, text)
                    own = []
                done = True
                continue
            if size > BLOCK_BYTES:
                yield _compare(own, text)
                own, size = [], 0
            own.append((i, text))
            size += len(text)
    if own:
        yield _compare(own, own[-1][1])


def _compare(rows: list[tuple[int | None, bytes]], follow: bytes) -> pa.RecordBatch:
    """Rows in order, the last of which is followed by ``follow``."""
    raw = [t for _, t in rows] + [follow]
    chars = [t.decode("utf-8", "replace") for t in raw]
    edited = []
    for k in range(len(rows)):
        cut = len(chars[k]) // 4
        edited.append((chars[k][: len(chars[k]) - cut] + chars[k + 1][:cut]).encode())
    own, changed = signatures(raw), signatures(edited)
    columns = {
        "doc_id": pa.array([i for i, _ in rows], pa.int64()),
        "text_key": pa.array(np.array([xxhash.xxh64_intdigest(t, 42) for t in raw[:-1]], np.uint64).view(np.int64)),
        "n_chars": pa.array([len(c) for c in chars[:-1]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        "fingerprint": pa.array(as_text(own[:-1]), pa.string()),
        "edited_fingerprint": pa.array(as_text(changed), pa.string()),
        "near_edited": pa.array(likeness(own[:-1], changed), pa.float64()),
        "near_next": pa.array(likeness(own[:-1], own[1:]), pa.float64()),
    }
    return pa.RecordBatch.from_pydict(columns)


def edited_likeness(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; see ``_EDITED``.

    The edited text has its last quarter replaced by the beginning of the next document by id;
    after the last comes the first, and a single document follows itself. Documents go to groups
    of neighbouring ids, compressed, in one shuffle; the first of a group visits the group before.
    Cuts between groups are rows of a sample, whose size is bounded by the number of groups; the
    result does not depend on them. Groups are sorted by Spark and streamed, whatever their size.
    Null ids come first; rows of one id are in order of their texts' CRC-32, so that a repeated id
    is cut into groups too, and rows equal in both are interchangeable but for their order. Null
    texts are empty, also for text_key, xxhash64 of the text. Extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.crc32(text.cast("binary")).alias("crc"), text.alias("text"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).agg(F.count("*").alias("n"), F.count("doc_id").alias("m"), F.min("doc_id").alias("least")).first()
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n_groups = max(1, min(-(-size // GROUP_BYTES), -(-ids["n"] // 16), MOST_GROUPS))
    cuts = np.zeros(0, "S13")
    if n_groups > 1:
        share = min(1.0, ROWS_PER_CUT * n_groups / ids["n"])
        seen = (own.sample(share, 5) if share < 1 else own).select("doc_id", "crc").toArrow()
        keys = np.sort(_sort_keys(*[seen.column(k).combine_chunks() for k in range(2)]))
        cuts = np.unique(keys[[len(keys) * i // n_groups for i in range(1, n_groups)]]) if len(keys) else cuts
    least = ids["least"] if ids["m"] == ids["n"] else None
    dealt = own.mapInArrow(words.lean(_deal(cuts, least)), _DEALT).repartitionById(len(cuts) + 1, "grp")
    return dealt.sortWithinPartitions("grp", "guest", "doc_id", "crc", "packed").mapInArrow(words.lean(_neighbours), _EDITED)


def op5_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``edited_likeness`` with class_id, the smallest id of the texts that are like a document's (its own if none is)."""
    classes = similar_classes(spark, docs)
    found = edited_likeness(spark, docs).join(classes, "text_key", "left")
    return found.withColumn("class_id", F.coalesce("class_id", "doc_id")).drop("text_key")
