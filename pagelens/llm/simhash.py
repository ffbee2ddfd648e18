"""Near-duplicate documents: SimHash fingerprints in a Gray-order hierarchical index.

Different fingerprints are entered in ten tables. A table keys them by two of five bit
blocks: three differing bits leave two blocks equal, so linked fingerprints share a key
in some table. Inside a key the other bits are indexed as a hierarchy:

* entries are sorted by Gray rank, so neighbours share long bit patterns;
* ``NODE`` neighbours form a node, ``LEAF`` a leaf, ``UPPER`` leaves an upper node; each
  level keeps the bits that all its fingerprints share as a mask and a pattern;
* two groups whose shared bits differ in more than three places are skipped whole;
  else their differences go down and only the remaining bits are compared.

The Gray rank is part of the range partitioning, so a key with very many fingerprints is
spread over tasks as leaves. Pairs of its leaves are found over the masks alone and then
compared one pair of leaves a row. A task hands on a spanning forest of the links that it
finds, never all pairs. Components of the forests are found by star contraction, each
round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.words import as_bytes, blank_words, narrow_batches, rows_of, small_batches, written

SHINGLE, SEED, BITS, MAX_BITS = 3, 42, 64, 3
BLOCKS = (13, 13, 13, 13, 12)
NODE, LEAF, UPPER = 16, 512, 64
# Hashes whose bits are counted at once.
CHUNK = 1 << 16


def _key_masks() -> list[int]:
    ends = np.cumsum(BLOCKS).tolist()
    blocks = [((1 << n) - 1) << (end - n) for end, n in zip(ends, BLOCKS, strict=True)]
    return [a | b for a, b in combinations(blocks, len(BLOCKS) - MAX_BITS)]


KEY_MASKS = np.array(_key_masks(), dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    """SimHash of the text's word shingles; 0 without words."""
    words = blank_words(text.lower())
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the named bigint columns for every row."""

    def scan(batches):
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype="<u8")
            columns = [batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", *keys])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes("text"), *(F.col(f"`{k}`") for k in keys))
    return small_batches(texts).mapInArrow(scan, ", ".join(["doc_id bigint, fp bigint", *(f"{k} bigint" for k in keys)]))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def entries(prints: DataFrame) -> DataFrame:
    """A row for each fingerprint and table: the key and the Gray rank of the other bits."""

    def enter(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for slot, mask in enumerate(KEY_MASKS):
                # The sign bit is turned, so that signed order is the order of the rank.
                rank = gray_rank(fp & ~mask) ^ np.uint64(1 << 63)
                columns = [np.full(len(fp), slot, np.int32), (fp & mask).view(np.int64), rank.view(np.int64), fp.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "key", "rank", "fp"])

    return narrow_batches(prints.select("fp")).mapInArrow(enter, "slot int, key bigint, rank bigint, fp bigint")


def _nodes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of each node (the last one filled up with its last member), shared pattern, shared mask."""
    fill = -len(fps) % NODE
    members = np.concatenate([fps, np.repeat(fps[-1:], fill)]).reshape(-1, NODE)
    both, any_ = np.bitwise_and.reduce(members, axis=1), np.bitwise_or.reduce(members, axis=1)
    return members, both, ~(both ^ any_)


def linked(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked fingerprints, of ``a`` among themselves or of ``a`` and ``b``."""
    members_a, pattern_a, mask_a = _nodes(a)
    members_b, pattern_b, mask_b = (members_a, pattern_a, mask_a) if b is None else _nodes(b)
    shared = mask_a[:, None] & mask_b[None, :]
    above = np.bitwise_count((pattern_a[:, None] ^ pattern_b[None, :]) & shared)
    i, j = np.nonzero(above <= MAX_BITS)
    if b is None:
        i, j = i[i <= j], j[i <= j]
    found = [], []
    for at in range(0, len(i), 1024):
        p, q = i[at : at + 1024], j[at : at + 1024]
        differing = members_a[p][:, :, None] ^ members_b[q][:, None, :]
        below = np.bitwise_count(differing & ~shared[p, q][:, None, None])
        pair, x, y = np.nonzero(above[p, q][:, None, None] + below <= MAX_BITS)
        found[0].append(p[pair] * NODE + x)
        found[1].append(q[pair] * NODE + y)
    x = np.concatenate([*found[0], np.empty(0, np.int64)]).astype(np.int64)
    y = np.concatenate([*found[1], np.empty(0, np.int64)]).astype(np.int64)
    # Places that only fill up a node stand for its last member.
    return np.minimum(x, len(a) - 1), np.minimum(y, len(a if b is None else b) - 1)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest linked place of each of n places."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _edges(fps: np.ndarray, label: np.ndarray) -> tuple[list[int], list[int]]:
    moved = np.flatnonzero(label != np.arange(len(fps)))
    signed = fps.view(np.int64)
    return signed[moved].tolist(), signed[label[moved]].tolist()


LEAF_ROW = "slot int, key bigint, upper bigint, leaf bigint, every bigint, any bigint, fps array<bigint>"
_LEAF_TYPE = pa.struct(
    [("slot", pa.int32()), ("key", pa.int64()), ("upper", pa.int64()), ("leaf", pa.int64()), ("every", pa.int64()),
     ("any", pa.int64()), ("fps", pa.list_(pa.int64()))]
)


class _Task:
    """Runs of entries with one key, in order: links inside a leaf, and leaves that may have links outside."""

    def __init__(self, task: int, leaf: int, upper: int):
        self.leaf_size, self.upper_size = leaf, upper
        self.next_leaf = task << 32
        self.identity: tuple | None = None
        self.first = True  # the group may go on in the task before
        self.parts: list[np.ndarray] = []
        self.held = self.leaves = 0
        self.edges: tuple[list[int], list[int]] = [], []
        self.rows: list[dict] = []

    def add(self, identity: tuple, fps: np.ndarray) -> None:
        if identity != self.identity:
            self.end_group(False)
            self.first = self.identity is None
            self.identity = identity
        while self.held + len(fps) > self.leaf_size:
            room = self.leaf_size - self.held
            self.parts.append(fps[:room])
            self.end_leaf(True)
            fps = fps[room:]
        if len(fps):
            self.parts.append(fps)
            self.held += len(fps)

    def end_leaf(self, outside: bool) -> None:
        fps = np.concatenate(self.parts)
        self.parts, self.held = [], 0
        if len(fps) > 1:
            a, b = _edges(fps, forest(len(fps), *linked(fps)))
            self.edges[0].extend(a)
            self.edges[1].extend(b)
        if outside:
            if self.leaves % self.upper_size == 0:
                self.upper = self.next_leaf
            every, any_ = np.bitwise_and.reduce(fps), np.bitwise_or.reduce(fps)
            self.rows.append(
                {"slot": self.identity[0], "key": self.identity[1], "upper": self.upper, "leaf": self.next_leaf,
                 "every": int(every.view(np.int64)), "any": int(any_.view(np.int64)), "fps": fps.view(np.int64).tolist()}
            )
            self.next_leaf += 1
        self.leaves += 1

    def end_group(self, last: bool) -> None:
        """A group of one leaf that neither begins nor ends the task lies in it whole."""
        if self.parts:
            self.end_leaf(self.first or last or self.leaves > 0)
        self.leaves = 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        a, b, rows = *self.edges, self.rows
        self.edges, self.rows = ([], []), []
        if a or rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([*a, *[None] * len(rows)], pa.int64()), pa.array([*b, *[None] * len(rows)], pa.int64()),
                 pa.array([*[None] * len(a), *rows], _LEAF_TYPE)],
                names=["a", "b", "node"],
            )


def index_rows(sorted_entries: DataFrame, leaf: int = LEAF, upper: int = UPPER) -> DataFrame:
    """Spanning links inside leaves (a, b), and the leaves (node) of keys with more than one."""

    def build(batches):
        task = _Task(TaskContext.get().partitionId(), leaf, upper)
        for batch in batches:
            slot, key, fp = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("slot", "key", "fp"))
            if not len(fp):
                continue
            starts = np.concatenate([[0], np.flatnonzero((np.diff(slot) != 0) | (np.diff(key) != 0)) + 1, [len(fp)]])
            sizes = np.diff(starts)
            # Keys with one entry have no links, but for those that may go on in another batch.
            runs = np.flatnonzero(sizes > 1).tolist()
            for run in sorted({0, len(sizes) - 1, *runs}):
                at = starts[run]
                task.add((int(slot[at]), int(key[at])), fp[at : starts[run + 1]].view(np.uint64))
            if len(task.edges[0]) > 50_000 or len(task.rows) > 64:
                yield from task.batches()
        task.end_group(True)
        yield from task.batches()

    return sorted_entries.mapInArrow(build, f"a bigint, b bigint, node struct<{LEAF_ROW}>")


def _near(a: str, b: str):
    """Shared bits of two groups differ in at most MAX_BITS places."""
    return F.expr(f"bit_count(({a}.every ^ {b}.every) & ~({a}.every ^ {a}.any) & ~({b}.every ^ {b}.any)) <= {MAX_BITS}")


def leaf_links(leaves: DataFrame) -> DataFrame:
    """Spanning links (a, b) between different leaves of one key, found from the top of the hierarchy down."""
    shared = leaves.drop("fps")
    uppers = shared.groupBy("slot", "key", "upper").agg(F.expr("bit_and(every)").alias("every"), F.expr("bit_or(any)").alias("any"))
    x, y = uppers.alias("x"), uppers.alias("y")
    top = x.join(
        y, (F.col("x.slot") == F.col("y.slot")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.upper") <= F.col("y.upper"))
        & _near("x", "y"),
    ).select(F.col("x.upper").alias("upper_x"), F.col("y.upper").alias("upper_y"))
    x, y = shared.alias("x"), shared.alias("y")
    pairs = (
        top.join(x, F.col("upper_x") == F.col("x.upper"))
        .join(y, (F.col("upper_y") == F.col("y.upper")) & (F.col("x.leaf") < F.col("y.leaf")) & _near("x", "y"))
        .select(F.col("x.leaf").alias("leaf_x"), F.col("y.leaf").alias("leaf_y"))
    )
    left = leaves.select(F.col("leaf").alias("leaf_x"), F.col("fps").alias("fps_x"))
    right = leaves.select(F.col("leaf").alias("leaf_y"), F.col("fps").alias("fps_y"))
    both = pairs.join(left, "leaf_x").join(right, "leaf_y").select("fps_x", "fps_y")

    def compare(batches):
        for x, y in rows_of(batches, "fps_x", "fps_y"):
            a, b = np.array(x, np.int64).view(np.uint64), np.array(y, np.int64).view(np.uint64)
            i, j = linked(a, b)
            if len(i):
                fps = np.concatenate([a, b])
                p, q = _edges(fps, forest(len(fps), i, j + len(a)))
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], names=["a", "b"])

    return small_batches(both).mapInArrow(compare, "a bigint, b bigint")


def links(prints: DataFrame, leaf: int = LEAF, upper: int = UPPER) -> DataFrame:
    """Links (a, b) that join all fingerprints of a component; prints: different values fp."""
    order = ["slot", "key", "rank"]
    placed = entries(prints).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(index_rows(narrow_batches(placed), leaf, upper), "gray-index")
    inner = rows.filter("node is null").select("a", "b")
    leaves = rows.filter("node is not null").select("node.*")
    many = leaves.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    leaves = leaves.join(many, ["slot", "key"])
    return inner.unionByName(leaf_links(leaves)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each value of a link and the smallest value it is joined with, by alternating stars."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    state = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return edges
        state = seen
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")


def members(rows: DataFrame, least: Column) -> DataFrame:
    """fp, least (an aggregate over its rows) and root of every fingerprint; a root is the smallest fp of a component."""
    prints = written(rows.groupBy("fp").agg(least.alias("least")), "prints")
    roots = components(links(prints)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return prints.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id.

    docs: doc_id, text; other columns are not read. A null text is empty; empty texts have
    fingerprint 0 and are linked like others. component_id is the smallest doc_id of the
    component; null only if all its doc_ids are null. Rows that repeat a doc_id are rows of
    their own with the fingerprint of their text. No rows, no result rows.
    """
    rows = written(fingerprints(docs), "fingerprints")
    prints = members(rows, F.min("doc_id"))
    smallest = prints.groupBy("root").agg(F.min("least").alias("component_id"))
    found = prints.join(smallest, "root").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, with all columns of docs.

    A component keeps one row, whatever its doc_ids: of rows that share the smallest one any,
    and one without doc_id only if it has no other. So a doc_id that names texts of several
    components stays in each of them whose smallest one it is.
    """
    names = docs.columns
    key = "row_key"
    while key.lower() in (n.lower() for n in names):
        key += "_"
    # Read from the written table only: a key made anew in another scan could name another row.
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    rows = written(fingerprints(keyed, key), "fingerprints")
    prints = members(rows, F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", key)))
    kept = prints.groupBy("root").agg(F.min("least").alias("least")).select(F.col(f"least.{key}").alias(key))
    return keyed.join(kept, key, "left_semi").select(*[F.col(f"`{n}`") for n in names])
