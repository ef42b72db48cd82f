"""Approximate nearest neighbours: a robust-pruned graph for each shard, searched by a beam from each query.

Equal vectors are one node, with the smallest of their ids: no list of the nearest can hold more of
them. So copies cost nothing and do not crowd out other edges. Nodes are dealt by a hash into shards of
about `SHARD_ROWS`; a task builds a shard's graph (`graph.build`) and the index is a table with a row for
each node: vector, ids, edges. Queries come in blocks; a task searches a block in a shard's graph, works
out exact products in double precision for what the beam holds, and returns the best. The lists
of all shards are merged by query. A task holds one shard and one block.

Defined cases: rows without id take no part, nor do vectors that are null, empty, all zero or hold nulls or
values that are not finite. Vectors of different lengths are in no relation: only those of the query's
length are candidates. Rows that share an id are rows of their own; equal rows see each other, and
each repeated query row has a list of its own. Ties go to the smaller id. Without rows, none. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm import graph
from veritally.llm.components import kept

SHARD_ROWS = 8192
QUERY_ROWS = 16384


@dataclass(frozen=True)
class Settings:
    """Edges of a node, beam while building, factor of pruning, beam of a query, rows of a shard and of a block of queries."""

    degree: int = 40
    build_beam: int = 80
    relax: float = 1.2
    beam: int = 128
    shard_rows: int = SHARD_ROWS
    query_rows: int = QUERY_ROWS


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    values = F.col(vector)
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(values, lambda x: x != 0), F.lit(False))


def keyed(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding, dims, key): the rows that take part; key names the vector."""
    key = F.md5(F.concat_ws(",", F.col("embedding").cast("array<string>")))
    fit = rows.filter(F.col("vec_id").isNotNull() & usable("embedding"))
    return fit.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.size("embedding").alias("dims"), key.alias("key"))


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """A row for each different vector: key, dims, embedding and its k + 1 smallest ids (one may be the query's own)."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = rows.withColumn("_place", place).filter(F.col("_place") <= k + 1)
    return few.groupBy("key").agg(F.first("dims").alias("dims"), F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _shard(name: str, count: int, salt: int) -> Column:
    return F.pmod(F.xxhash64(name, F.lit(salt)), F.lit(count)).cast("int")


def index(points: DataFrame, shards: int, settings: Settings) -> DataFrame:
    """The graphs as a table: dims, shard, node, entry, key, embedding, ids, edges."""
    dealt = points.withColumn("shard", _shard("key", shards, 0))
    kinds = dict(points.dtypes)
    schema = f"dims int, shard int, node int, entry boolean, key string, embedding {kinds['embedding']}, ids array<bigint>, edges array<int>"

    def built(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", ignore_index=True)
        points = graph.levelled(np.stack(frame["embedding"]).astype(np.float64))
        edges, entry = graph.build(points, settings.degree, settings.build_beam, settings.relax)
        numbers = np.arange(len(frame), dtype=np.int32)
        rows = frame.assign(node=numbers, entry=numbers == entry, edges=[row[row >= 0] for row in edges])
        return rows[["dims", "shard", "node", "entry", "key", "embedding", "ids", "edges"]].astype({"key": object})

    return kept(dealt.groupBy("dims", "shard").applyInPandas(built, schema))


def _found(part: pd.DataFrame, queries: pd.DataFrame, settings: Settings, k: int) -> pd.DataFrame:
    """Per query of the block the best k + 1 rows of the shard, by exact products."""
    part = part.sort_values("node", ignore_index=True)
    vectors = np.stack(part["embedding"]).astype(np.float64)
    points = graph.levelled(vectors)
    sizes = part["edges"].map(len).to_numpy()
    edges = np.full((len(part), max(1, sizes.max())), -1, np.int32)
    edges[np.arange(edges.shape[1]) < sizes[:, None]] = np.concatenate(list(part["edges"]))
    entry = int(part["entry"].to_numpy().argmax())
    first = part["ids"].map(lambda ids: ids[0]).to_numpy()
    own = part["key"].to_numpy(object)
    out = []
    for start in range(0, len(queries), graph.BATCH):
        block = queries.iloc[start : start + graph.BATCH]
        exact = np.stack(block["embedding"]).astype(np.float64)
        long = np.column_stack([exact / np.abs(exact).max(axis=1, keepdims=True), np.zeros(len(exact))]).astype(np.float32)
        beam = graph.search(points, edges, entry, long, settings.beam)
        score = np.where(beam < 0, -np.inf, np.einsum("qkd,qd->qk", vectors[beam], exact))
        # Nodes by score and smallest id: each gives a row at least, so k + 1 of them are enough.
        best = np.lexsort((first[beam], -score), axis=1)[:, : k + 1]
        chosen, score = np.take_along_axis(beam, best, 1).ravel(), np.take_along_axis(score, best, 1).ravel()
        keys = np.repeat(block["key"].to_numpy(object), best.shape[1])
        real = np.isfinite(score)
        frame = pd.DataFrame({"key": keys[real], "vec_id": part["ids"].to_numpy()[chosen[real]], "score": score[real], "own": keys[real] == own[chosen[real]]})
        frame = frame.explode("vec_id").astype({"vec_id": np.int64}).sort_values(["key", "score", "vec_id"], ascending=[True, False, True])
        out.append(frame[frame.groupby("key").cumcount() <= k])
    # As objects: text columns put together from several have several Arrow chunks, which a group may not return.
    return pd.concat(out, ignore_index=True).astype({"key": object})


def nearest(rows: DataFrame, queries: Column | str, k: int, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row that `queries` picks, by inner product."""
    rows = keyed(rows)
    asked = rows.filter(queries).select(F.col("vec_id").alias("query_id"), "key")
    points = kept(nodes(rows, k))
    shards = max(1, -(-points.count() // settings.shard_rows))
    graphs = index(points, shards, settings)
    wanted = kept(points.join(asked.select("key").distinct(), "key", "left_semi").select("key", "dims", "embedding"))
    blocks = max(1, -(-wanted.count() // settings.query_rows))
    each_block = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each_shard = wanted.withColumn("block", _shard("key", blocks, 1)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    schema = "key string, vec_id bigint, score double, own boolean"

    def searched(part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if part.empty or block.empty:
            return pd.DataFrame({"key": [], "vec_id": [], "score": [], "own": []}).astype({"key": object, "vec_id": np.int64, "own": bool})
        return _found(part, block, settings, k)

    together = ["dims", "shard", "block"]
    found = each_block.groupBy(*together).cogroup(each_shard.groupBy(*together)).applyInPandas(searched, schema)
    # The shards' lists in one, with a row more than asked for, as the query's own row may be among them.
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("place", place).filter(F.col("place") <= k + 1)
    lists = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "own"))).alias("found"))
    mine = F.array_position(F.transform("found", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), True).cast("int")
    others = F.filter("found", lambda x, i: (i + 1) != mine)
    listed = asked.join(lists, "key").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
