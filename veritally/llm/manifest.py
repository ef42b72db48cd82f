"""Merkle manifest of a dataset, grown by aligned appends that keep every leaf's witness up to date.

Leaves are digests of rows; per group they ascend by id and every two consecutive nodes become the
digest of their joined hex texts, a last one alone the digest of its own, until one is left: the
subroot. Subroots in the order of their groups become the root in the same way.

`OpenTree` takes nodes one after another. It holds the complete subtrees that still wait for a
sibling, the highest first. A node that is appended completes subtrees; as two siblings meet, the
witnesses of the left one's leaves get the right one's digest and the other way round. Leaves are
dealt into aligned blocks of 4,096, a task appends a block, and the blocks' roots are appended to
trees of the next level like leaves, until each group has one node. A leaf's witness is its own
within the block, then its block's, and so on; so each task holds one block, whatever the input.

Defined cases: null values count as `-`; a null group is a group of its own and the first; null ids
come first, equal ids by their leaves; equal rows are leaves of their own. A group of one leaf has
that leaf as subroot. Texts are hashed whole. Without rows there is no root and no row. Columns that
are not named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm.components import kept
from veritally.llm.ranked import numbered

#: Levels of a block: 4,096 nodes.
BITS = 12
#: A level of a witness: where the sibling stands (0: there is none), then its digest.
STEP = 33
LEFT, RIGHT = 1, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*hexes: str) -> str:
    """The hex digest of joined hex texts."""
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


class OpenTree:
    """A hash tree that grows by appends; each of its leaves has a witness that grows with it."""

    def __init__(self, most: int, height: int) -> None:
        """For at most so many leaves, to be closed at this height."""
        self.nodes: list[str] = []
        self.siblings = np.full((most, height), -1, np.int32)
        self.size = 0
        # Complete subtrees without a sibling yet: height, number of its node, first leaf, leaf after its last.
        self.open: list[tuple[int, int, int, int]] = []

    def append(self, node: str) -> None:
        self.open.append((0, self._new(node), self.size, self.size + 1))
        self.size += 1
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            self._join()

    def close(self, height: int) -> str:
        """The root at this height: what has no sibling rises alone."""
        while len(self.open) > 1 or self.open[0][0] < height:
            if len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
                self._join()
            else:
                at, node, first, stop = self.open[-1]
                self.open[-1] = (at + 1, self._new(digest(self.nodes[node])), first, stop)
        return self.nodes[self.open[0][1]]

    def witnesses(self, height: int) -> list[bytes]:
        """Per leaf, the levels up to this height: side and digest of the sibling."""
        out = np.zeros((self.size, height, STEP), np.uint8)
        if height:
            found = self.siblings[: self.size, :height]
            there = found >= 0
            odd = np.arange(self.size)[:, None] >> np.arange(height) & 1
            out[:, :, 0] = np.where(there, np.where(odd, LEFT, RIGHT), 0)
            known = np.frombuffer(bytes.fromhex("".join(self.nodes)), np.uint8).reshape(-1, 32)
            out[:, :, 1:][there] = known[found[there]]
        return [row.tobytes() for row in out]

    def _new(self, node: str) -> int:
        self.nodes.append(node)
        return len(self.nodes) - 1

    def _join(self) -> None:
        height, right, middle, stop = self.open.pop()
        _, left, first, _ = self.open.pop()
        self.siblings[first:middle, height] = right
        self.siblings[middle:stop, height] = left
        self.open.append((height + 1, self._new(digest(self.nodes[left], self.nodes[right])), first, stop))


def leaf(columns: dict[str, Column]) -> Column:
    """The digest, as bytes, of the columns' values: `-` if null, else byte count, `:` and the value."""
    parts = []
    for value in columns.values():
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered(column: str) -> Column:
    """The number plus one, exact beyond 64 bits."""
    return F.col(column).cast("decimal(20,0)") + 1


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the group as text that sorts as the groups do), doc_id, leaf, and the tampered leaf or null.

    Rows whose id's crc32 seven divides are tampered with; a null id has none, a null number stays.
    """
    values = {name: F.col(name) for name in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = F.when(hit & F.col("n_chars").isNotNull(), leaf(values | {"n_chars": tampered("n_chars")}))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), "doc_id", leaf(values).alias("node"), other.alias("tampered"))


def _appended(frame: pd.DataFrame, bits: int) -> pd.DataFrame:
    """The nodes of a block, in order, with their witnesses within it and its root."""
    frame = frame.sort_values("place", ignore_index=True)
    # Blocks of a tree of several all rise to the same height, the last one too.
    height = min(bits, (int(frame["total"].iloc[0]) - 1).bit_length())
    tree = OpenTree(len(frame), height)
    for node in frame["node"]:
        tree.append(bytes(node).hex())
    root = bytes.fromhex(tree.close(height))
    return frame.assign(root=[root] * len(frame), witness=tree.witnesses(height))


def _level(nodes: DataFrame) -> DataFrame:
    """nodes of (tree, place, total, node, ...) with block, witness in the block and root of it; kept."""
    nodes = nodes.withColumn("block", F.shiftright("place", BITS))
    schema = nodes.withColumns({"root": F.lit(b""), "witness": F.lit(b"")}).schema
    bits = BITS
    return kept(nodes.groupBy("tree", "block").applyInPandas(lambda frame: _appended(frame, bits), schema))


def grown(nodes: DataFrame) -> list[DataFrame]:
    """The levels over nodes of (tree, place, total, node, ...): blocks of nodes, then of blocks, up to a block a tree."""
    levels = [_level(nodes)]
    most = levels[0].agg(F.max("total")).first()[0] or 0
    while most > 1 << BITS:
        most = -(-most >> BITS)
        above = F.ceil(F.col("total") / (1 << BITS)).cast("bigint")
        roots = levels[-1].filter(F.col("place") % (1 << BITS) == 0)
        levels.append(_level(roots.select("tree", F.col("block").alias("place"), above.alias("total"), F.col("root").alias("node"))))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, top): each tree's root."""
    return levels[-1].filter("place = 0").select("tree", F.col("root").alias("top"))


def lowered(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level's nodes with path, their witness up to the root of all, and the columns of above.

    above has a row a tree: tree, path and more. It goes to the highest level, where a tree has one block; below that a
    node gets what its block's root has.
    """
    more = [name for name in above.columns if name != "tree"]
    upper, key = above.withColumnRenamed("path", "_upper"), ["tree"]
    for level in reversed(levels):
        done = level.join(upper, key).withColumn("path", F.concat("witness", "_upper")).drop("_upper")
        upper, key = done.select("tree", F.col("place").alias("block"), *more).withColumnRenamed("path", "_upper"), ["tree", "block"]
    return done.drop("block", "witness", "root")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = lambda name: [None if v is None else v.hex() for v in batch.column(name).to_pylist()]
        nodes, others, subroots, roots = map(column, ("node", "tampered", "top", "whole"))
        proofs, folded = [], []
        for node, other, path in zip(nodes, others, batch.column("path").to_pylist()):
            siblings, now = [], other or node
            for at in range(0, len(path), STEP):
                side, sibling = path[at], path[at + 1 : at + STEP].hex()
                siblings += [sibling] if side else []
                now = digest(sibling, now) if side == LEFT else digest(now, sibling) if side else digest(now)
            proofs.append(digest(*siblings))
            folded.append(now)
        verified = [now == root for now, root in zip(folded, roots)]
        arrays = [batch.column("doc_id"), *map(pa.array, (nodes, subroots, roots, proofs, folded)), pa.array(verified)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def witnessed(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, node, tampered, top (subroot), whole (root) and path: its siblings up to the root."""
    levels = grown(numbered(leaves(docs), "tree", F.col("doc_id"), F.col("node")))
    subroots = tops(levels).select(F.lit("").alias("all"), "tree", F.col("top").alias("node"))
    over = grown(numbered(subroots, "all", F.col("tree")).withColumnsRenamed({"tree": "group", "all": "tree"}))
    root = tops(over).select("tree", F.col("top").alias("whole"), F.lit(b"").alias("path"))
    above = lowered(over, root).select(F.col("group").alias("tree"), "path", F.col("node").alias("top"), "whole")
    return lowered(levels, above)


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, a row for each of docs."""
    rows = witnessed(docs).select("doc_id", "node", "tampered", "path", "top", "whole")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.mapInArrow(_folded, schema)
