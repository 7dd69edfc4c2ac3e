"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of 5-word shingles. Equal sets collapse to one node first. Each node has a
MinHash sketch; in every tree a node's sets branch by one or two selected sketch coordinates, four
thirds on average, so that two sets of the threshold's similarity meet in one child on average and
closer ones in more. A child of at most ``LEAF`` members is compared exhaustively, a larger one
branches again along a path of its own. The ``TREES`` trees are dealt over ``POOLS`` pools of
coordinates that have none in common. By the exact sum over the coordinates of each pool that agree,
all trees miss a pair at the threshold with a probability of 1.1e-3 if its paths go on to ten
coordinates, 1.3e-4 after seven and 1.4e-6 after four, and one at 0.8 with 3.7e-5, 3.7e-6 and 3.2e-8.

A child that keeps ``SETTLED`` of a large parent's members, or is large at the deepest level, is
not split further; it is compared in blocks instead, so that no cap drops a link. Links are
confirmed on full sets. First each node's best candidate among a few leaders of its children, which
costs a comparison or two a node; once more, with other leaders, in children of ``CROWD`` members of
several components, so that a large group of near copies, of which any two are linked with some
probability, is one component but for a few. Then, in children with members of different
components, all members whose sketches allow for a link to another component are compared in one
task, which gives a forest of their links. So a group of copies that is one component already
costs no comparison, and no step writes a row for each pair of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch
from . import words
from .components import components

SHINGLE = 5
#: Link where 100 * intersection >= 75 * union.
PERCENT = 75
TREES = 20
LEAF = 8
#: The first pass takes one coordinate, each further one ``STEPS``; no child of the first is a leaf.
PASSES = 4
STEPS = 3
#: Share of a parent's members from which a child's are near copies: three coordinates at the threshold keep 0.42.
SETTLED = 0.5
LEADERS = 2
#: Children of so many members or more get new leaders, ``ROUNDS`` times in all.
CROWD = 16
ROUNDS = 2
#: Members of a block that is compared with another in one task.
BLOCK = 512
#: A sketch has minima of 32 bits, by which the roots branch, and more of 8 bits.
WIDE, NARROW = 40, 160
#: Bytes of hashes of one block's texts that are worked on at once.
SET_BYTES = 64 << 20
#: A pool has every ``POOLS``-th coordinate. Fewer than 40 in a pool would let paths repeat them and split worse.
POOLS = 5
SIGNED = "doc_id long, text_key long, node long, n_shingles long, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash = words.MinHash(WIDE + NARROW)
    for batch in batches:
        texts = words.text_bytes(batch.column(2))
        for i, j in words.blocks(texts):
            h, n_of = words.shingles(texts[i:j], SHINGLE)
            minima = minhash(h, n_of)
            wide, narrow = minima[:, :WIDE], (minima[:, WIDE:] & np.uint32(255)).astype(np.uint8)
            nodes, sizes, at = [], [], 0
            for n in n_of:
                a = np.sort(h[at : at + n])
                at += n
                a = a[np.concatenate([[True], a[1:] != a[:-1]])] if n else a
                sizes.append(len(a))
                nodes.append(int.from_bytes(hashlib.md5(a.tobytes()).digest()[:8], "little", signed=True))
            sketch = [x.tobytes() + y.tobytes() for x, y in zip(wide, narrow, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketch, pa.binary())],
                names=["doc_id", "text_key", "node", "n_shingles", "sketch"],
            )


@dataclass(frozen=True)
class Sketch:
    """Minima as they are stored: numpy types and how many of each.

    Two sketches agree on ``least`` coordinates at least: 4.5 standard deviations below the
    threshold. From ``sure`` on, all of a node's candidates are as good, and one that others choose
    too is taken.
    """

    parts: tuple[tuple[str, int], ...]
    least: int
    sure: int

    def rows(self, column: pa.Array) -> list[np.ndarray]:
        widths = [np.dtype(t).itemsize * n for t, n in self.parts]
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, sum(widths))
        ends = np.cumsum(widths)
        return [np.ascontiguousarray(raw[:, e - w : e]).view(t) for (t, _), w, e in zip(self.parts, widths, ends, strict=True)]

    def agreeing(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates (a, b, sa, sb) whose sketches agree on enough coordinates."""
        for batch in batches:
            if batch.num_rows:
                agree = sum((x == y).sum(axis=1) for x, y in zip(self.rows(batch.column(2)), self.rows(batch.column(3)), strict=True))
                keep = np.flatnonzero(agree >= self.least)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(agree[keep], pa.int32())], names=["a", "b", "agree"])

    def candidates_in_block(self, group: pa.Table) -> pa.Table:
        """Rows (key, block, node, c) of one group that may link to another component's.

        Rows of role 0 are compared with each other; otherwise those of role 1 with those of role 2.
        """
        group = group.combine_chunks()
        column = lambda name: np.asarray(group.column(name))
        node, c, role = column("node"), column("c"), column("role")
        parts = self.rows(group.column("sketch"))
        right = np.flatnonzero(role != 1)
        found = np.zeros(len(node), bool)
        for i in np.flatnonzero(role != 2):
            other = right[c[right] != c[i]]
            good = other[sum((x[other] == x[i]).sum(axis=1) for x in parts) >= self.least]
            found[good] = True
            found[i] |= len(good) > 0
        return group.select(["key", "block", "node", "c"]).filter(pa.array(found))


SKETCH = Sketch((("<u4", WIDE), ("u1", NARROW)), least=122, sure=164)


def _hash_slices(packed: list[bytes]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Set sizes of packed texts, and slices (owner, hash) of all sets by the hash's range.

    One text is opened at a time, again for each slice, so that memory is bounded by ``SET_BYTES``
    and a few times the longest text beside the packed texts, whatever their lengths.
    """
    open_up = zstandard.ZstdDecompressor()

    def every() -> Iterator[np.ndarray]:
        for i, j in words.blocks(packed, 1 << 19):
            yield from words.sets([open_up.decompress(x) for x in packed[i:j]], SHINGLE)

    sizes = np.array([len(x) for x in every()], np.int64)
    n_slices = 1 + int(sizes.sum()) * 8 // SET_BYTES

    def slices() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(n_slices):
            low, high = (np.uint64(min((1 << 64) - 1, ((1 << 64) // n_slices) * m)) for m in (k, k + 1))
            parts = [x[np.searchsorted(x, low) : np.searchsorted(x, high) if k + 1 < n_slices else len(x)] for x in every()]
            yield np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.concatenate([*parts, np.zeros(0, np.uint64)])

    return sizes, slices()


def _links_in_block(group: pa.Table) -> pa.Table:
    """A forest (a, b) of the links between the components c of one group's texts, all compared on their full sets.

    Shingles of one text alone are in no intersection; intersections of the others are products of
    0/1 matrices, some columns at a time, exact as a slice has less than 2**24 hashes.
    """
    node = np.asarray(group.column("node").combine_chunks())
    node, first = np.unique(node, return_index=True)
    c = np.asarray(group.column("c").combine_chunks())[first]
    n, slices = _hash_slices(group.column("packed").take(pa.array(first)).to_pylist())
    both = np.zeros((len(n), len(n)))
    for owner, hashes in slices:
        _, at, count = np.unique(hashes, return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        shared = count[at] > 1
        if len(hashes) == n.sum():  # the only slice: a text with too many shingles of its own has no link
            shared &= (100 * np.bincount(owner[shared], minlength=len(n)) >= PERCENT * n)[owner]
        row, col = owner[shared], column[at[shared]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for start in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            i, j = np.searchsorted(col, [start, start + 4096])
            part = np.zeros((len(n), 4096), np.float32)
            part[row[i:j], col[i:j] - start] = 1
            both += part @ part.T
    link = (both > 0) & (100 * both >= PERCENT * (n[:, None] + n[None, :] - both))
    free, pairs = np.ones(len(n), bool), []
    for seed in range(len(n)):
        reached = np.flatnonzero(free & (c == c[seed])).tolist() if free[seed] else []
        free[reached] = False
        while reached:
            x = reached.pop()
            for y in np.flatnonzero(link[x] & free).tolist():
                if free[y]:  # with y come all of its component
                    new = np.flatnonzero(free & (c == c[y]))
                    free[new] = False
                    pairs.append((int(node[x]), int(node[y])))
                    reached += new.tolist()
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) with the text as zstd."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [squeeze.compress(t) for t in words.text_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], names=["doc_id", "text_key", "packed"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, pa, pb) whose packed texts reach the similarity on their full sets."""
    open_up = zstandard.ZstdDecompressor()
    for batch in batches:
        left, right = ([open_up.decompress(x) for x in batch.column(k).to_pylist()] for k in (2, 3))
        good = []
        for i, j in words.blocks([x + y for x, y in zip(left, right, strict=True)]):
            for k, (x, y) in enumerate(zip(words.sets(left[i:j], SHINGLE), words.sets(right[i:j], SHINGLE), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= PERCENT * (len(x) + len(y) - both):
                    good.append(i + k)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), batch.column(1).take(pa.array(good, pa.int64()))], names=["a", "b"])


def _key(tree: str, *parts: str) -> str:
    """SQL for a child's key, whose low five bits are its tree."""
    return f"shiftleft(xxhash64({', '.join(parts)}), 5) | cast({tree} as bigint)"


def _roots() -> list[F.Column]:
    """The children of the trees' roots: wide coordinates of each tree, the same for every node."""
    keys = []
    for tree in range(TREES):
        for i in range(2 if tree % 3 == 0 else 1):
            c = tree + i * TREES
            keys.append(F.expr(_key(str(tree), str(c), f"substring(sketch, {4 * c + 1}, 4)")))
    return keys


def _children(key: str) -> str:
    """SQL for the array of a node's children: one coordinate of the tree's pool, and with probability 1/3 a second, drawn by the path."""
    child = []
    for k in (1, 2):
        c = f"({key} & 31) % {POOLS} + {POOLS} * pmod(xxhash64({key}, {k}), {(WIDE + NARROW) // POOLS})"
        value = f"if({c} < {WIDE}, substring(sketch, cast(4 * ({c}) + 1 as int), 4), substring(sketch, cast({c} + {3 * WIDE + 1} as int), 1))"
        child.append(_key(f"{key} & 31", key, str(k), value))
    return f"if(pmod(xxhash64({key}, 3), 3) = 0, array({', '.join(child)}), array({child[0]}))"


def _children_after(steps: int) -> str:
    """SQL for the array of a node's children after so many coordinates."""
    out = _children("key")
    for i in range(1, steps):
        out = f"flatten(transform({out}, k{i} -> {_children(f'k{i}')}))"
    return out


def chosen_paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, n) of all children that are not split further and have two members at least."""
    ended: list[DataFrame] = []
    entries = nodes.select("node", F.explode(F.array(*_roots())).alias("key"), F.lit(None).cast("long").alias("above"))
    for depth in range(PASSES):
        size = entries.groupBy("key").agg(F.count("*").alias("n"), F.max("above").alias("above")).where("n > 1")
        deepest = depth + 1 == PASSES
        ends = "false" if depth == 0 else f"n <= {LEAF} or n >= {SETTLED} * above or {str(deepest).lower()}"
        met = scratch.table(entries.drop("above").join(size.withColumn("ends", F.expr(ends)), "key").select("key", "node", "n", "ends"), f"met-{depth}")
        if depth:
            ended.append(met.where("ends").select("key", "node", "n"))
        if not deepest:
            deeper = met.where("not ends").join(nodes.select("node", "sketch"), "node")
            entries = deeper.select("node", F.explode(F.expr(_children_after(STEPS))).alias("key"), F.col("n").alias("above"))
    found = ended[0]
    for e in ended[1:]:
        found = found.unionByName(e)
    return found


def _with_leaders(members: DataFrame, draw: int) -> DataFrame:
    """Each member (key, node, c) of a child with those of its leaders that are of another component c, as pairs (a, b).

    Leaders are those of the smallest hash of this draw, the same ones in every tree.
    """
    by_key = Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(draw)), "node")
    first = members.withColumn("r", F.row_number().over(by_key)).where(f"r <= {LEADERS}")
    leaders = first.select("key", F.col("node").alias("leader"), F.col("c").alias("of"))
    pairs = members.join(leaders, "key").where("c <> of")
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _screen(pairs: DataFrame, nodes: DataFrame, sketch: Sketch) -> DataFrame:
    """The pairs whose sketches agree, with the number of coordinates."""
    x = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    y = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(words.lean(sketch.agreeing), "a long, b long, agree int")


def _best(pairs: DataFrame, sure: int) -> DataFrame:
    """A candidate (a, b) of each node: the surest, among sure ones that of the greatest hash, so that near copies choose the same."""
    ends = [pairs.select(F.col(x).alias("node"), F.struct(F.least("agree", F.lit(sure)).alias("sure"), F.xxhash64(y).alias("h"), "a", "b").alias("p")) for x, y in (("a", "b"), ("b", "a"))]
    return ends[0].union(ends[1]).groupBy("node").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()


def _between(met: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, sketch: Sketch) -> DataFrame:
    """Links (a, b) between members of one child that are in different components, enough to join them.

    Small children are groups of their own. Of a large one, the members outside its most frequent
    component are compared with all members, in blocks; the rest is one component.
    """

    def candidates_in_block(group: pa.Table) -> pa.Table:
        return sketch.candidates_in_block(group)

    rows = _blocks_between(met, roots, scratch).join(nodes.select("node", "sketch"), "node")
    able = scratch.table(rows.groupBy("key", "block").applyInArrow(candidates_in_block, "key long, block int, node long, c long"), "able")
    return able.join(texts, "node").select("key", "block", "node", "c", "packed").groupBy("key", "block").applyInArrow(_links_in_block, "a long, b long")


def _blocks_between(met: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, block, node, c, role) of the blocks in which members of different components c meet; see ``_between``."""
    labelled = met.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("c"))
    counts = labelled.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "c")).alias("main"), F.count("*").alias("k"))
    split = scratch.table(labelled.join(counts.where("k > 1").select("key", F.col("main.c").alias("main"), F.col("main.n").alias("most")), "key"), "between")
    few = split.where(f"n <= {BLOCK}").select("key", F.lit(0).alias("block"), "node", "c", F.lit(0).alias("role"))
    many = split.where(f"n > {BLOCK}").withColumns({"outside": F.col("c") != F.col("main"), "blocks": F.expr(f"cast(ceil(n / {BLOCK}) as int)"), "against": F.expr(f"cast(ceil((n - most) / {BLOCK}) as int)")})
    meet = F.expr("transform(sequence(0, against - 1), i -> cast(i * blocks + pmod(xxhash64(node), blocks) as int))")
    visit = F.expr("transform(sequence(0, blocks - 1), i -> cast(pmod(xxhash64(node, 1), against) * blocks + i as int))")
    all_of = many.select("key", F.explode(meet).alias("block"), "node", "c", F.lit(2).alias("role"))
    some = many.where("outside").select("key", F.explode(visit).alias("block"), "node", "c", F.lit(1).alias("role"))
    return few.unionByName(all_of).unionByName(some)


def first_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed) of the first document of each node; rows that repeat its id and text are one.

    Texts are packed before they are shuffled.
    """
    first = nodes.select("node", "first_id", F.col("text_key").alias("first_key"), (F.col("copies") > 1).alias("many"))
    rows = docs.select("doc_id", "text_key", "text").mapInArrow(words.lean(_pack), "doc_id long, text_key long, packed binary")
    found = rows.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key")))
    return found.where("not many").select("node", "packed").unionByName(found.where("many").groupBy("node").agg(F.min("packed").alias("packed")))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are links; texts: (node, packed). The side with more partners is joined last."""
    x = texts.select(F.col("node").alias("b"), F.col("packed").alias("pb"))
    y = texts.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
    return pairs.select("a", "b").join(x, "b").join(y, "a").select("a", "b", "pa", "pb").mapInArrow(words.lean(_confirm), "a long, b long")


def _contract(links: DataFrame, roots: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Roots after more links; only components that the links join are worked on."""
    ends = links
    for x in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    merged = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch, name)
    moved = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return scratch.table(moved.unionByName(merged.join(roots, "node", "left_anti")), f"{name}-all")


def join_members(met: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, sketch: Sketch) -> DataFrame:
    """(node, root) of the components of all links between nodes that are members (key, node, n) of one group.

    nodes: (node, sketch); texts: (node, packed), one row for each member. Every pair of members of
    different components whose sketches allow for a link is compared on its full sets.
    """
    pairs = scratch.table(_screen(_with_leaders(met.withColumn("c", F.col("node")), 0), nodes, sketch), "pairs-0")
    links = scratch.table(_confirmed(_best(pairs, sketch.sure), texts), "links-0")
    roots = components(links, scratch, "roots-0")
    for r in range(1, ROUNDS):
        crowds = met.where(f"n >= {CROWD}").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("c"))
        pairs = scratch.table(_screen(_with_leaders(crowds, r), nodes, sketch), f"pairs-{r}")
        links = scratch.table(_confirmed(_best(pairs, sketch.sure), texts), f"links-{r}")
        roots = _contract(links, roots, scratch, f"roots-{r}")
    more = scratch.table(_between(met, roots, nodes, texts, scratch, sketch), "links-last")
    return _contract(more, roots, scratch, "roots-last")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Null and empty texts have no shingles and stand alone; equal sets are one component; a text of
    fewer than five words is one shingle. Rows that share a doc_id are rows of their own. Ties
    fall to the smallest doc_id; a null doc_id stands alone unless its text has a partner, and is
    no component's first unless all of its ids are null. Extra columns are ignored. An empty table
    gives an empty result. Nodes carry 64 bits of an MD5 of their sorted set.
    """
    return near_duplicate_rows(spark, docs, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def near_duplicate_rows(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` (see there) with text_key, xxhash64 of the text, and component, unlike in different components; null without shingles."""
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    signed = scratch.table(docs.mapInArrow(words.lean(_sign), SIGNED), "signed")
    filled = signed.where("n_shingles > 0")
    by_id = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "sketch")
    first = filled.groupBy("node").agg(F.min(by_id).alias("f"), F.count("*").alias("copies"))
    nodes = scratch.table(first.select("node", F.col("f.doc_id").alias("first_id"), F.col("f.text_key").alias("text_key"), "copies", F.col("f.sketch").alias("sketch")), "nodes")

    met = chosen_paths(nodes, scratch)
    texts = scratch.table(first_texts(docs, nodes.join(met.select("node").distinct(), "node", "left_semi")), "texts")
    roots = join_members(met, nodes, texts, scratch, SKETCH)

    ids = nodes.select("node", "first_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = ids.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("members"))
    of = scratch.table(ids.join(least.where("members > 1"), "root").select("node", "component_id", "root"), "classes")
    scratch.keep_only("signed", "classes")
    out = signed.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(of, "node", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept, "text_key", F.coalesce("root", "node").alias("component"))
