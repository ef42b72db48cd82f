from collections import defaultdict
from zlib import crc32

import numpy as np
from common import TEXTS, edge_docs
from pyspark.sql import functions as F

from tests.conftest import FOLDER
from veritally.llm import queries, sharding


def test_permutation_is_a_bijection_and_can_be_undone():
    for size in (0, 1, 2, 3, 15, 16, 17, 1000, 4097):
        p = sharding.Permutation(size)
        to = p.apply(np.arange(size))
        assert sorted(to.tolist()) == list(range(size))
        assert (p.apply(to, back=True) == np.arange(size)).all()
    assert (sharding.Permutation(1000, 1).apply(np.arange(1000)) != sharding.Permutation(1000, 2).apply(np.arange(1000))).any()
    far = np.array([0, 10**13 - 1, 123456789])
    p = sharding.Permutation(10**13)
    assert (p.apply(p.apply(far), back=True) == far).all() and (p.apply(far) < 10**13).all()


def test_neighbours_are_spread():
    to = sharding.Permutation(100_000).apply(np.arange(100_000))
    assert abs(np.corrcoef(to[:-1], to[1:])[0, 1]) < 0.02
    assert np.bincount(to[:1600] % 16, minlength=16).min() > 60


def test_query_keeps_its_law(spark):
    rows = queries.feistel_shards(spark, FOLDER).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(docs) and sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_numbers_do_not_depend_on_how_files_are_split(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "t"))
    first = {r.id: r.row for r in sharding.numbered(spark, str(tmp_path / "t")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    again = {r.id: r.row for r in sharding.numbered(spark, str(tmp_path / "t")).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == again and sorted(first.values()) == list(range(1000))
    out = {r.row: (r.shard, r.slot) for r in sharding.assign(sharding.numbered(spark, str(tmp_path / "t")), 1000, 7).collect()}
    assert all(sharding.row_of(*place, 1000, 7) == row for row, place in list(out.items())[:50])


def test_edge_rows(spark, tmp_path):
    """Columns of the names that the operator uses itself do not disturb it."""
    clashes = {name: F.lit(f"own {name}") for name in ("_file", "__at", "_at", "_offset", "_to", "a.b", "_metadata", "slot")}
    edge_docs(spark).withColumns(clashes).write.parquet(str(tmp_path / "e"))
    rows = sharding.numbered(spark, str(tmp_path / "e"))
    placed = sharding.assign(rows, sharding.total(rows), 4)
    assert {row["_file"] + row["_to"] + row["a.b"] for row in placed.collect()} == {"own _fileown _toown a.b"}
    found = sharding.described(placed).collect()
    assert len(found) == len(TEXTS) and len({(r.shard, r.slot) for r in found}) == len(TEXTS)
    empty = spark.createDataFrame([], "doc_id bigint, text string, row bigint")
    assert sharding.total(empty) == 0 and sharding.described(sharding.assign(empty, 0, 4)).count() == 0


def test_rows_go_where_a_plain_permutation_sends_them(spark):
    """The same network in whole numbers without numpy, a row at a time."""
    size, seed, shards = 1000, 2024, 16
    half = next(h for h in range(1, 64) if 4**h >= size)
    mask, word = 2**half - 1, 2**64 - 1

    def mixed(value, turn):
        x = (value + seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & word
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & word
        x = (x ^ x >> 27) * 0x94D049BB133111EB & word
        return (x ^ x >> 31) & mask

    def permuted(number):
        while True:
            left, right = number >> half, number & mask
            for turn in range(sharding.ROUNDS):
                left, right = right, left ^ mixed(right, turn)
            number = left << half | right
            if number < size:
                return number

    rows = sharding.assign(spark.range(size).withColumnRenamed("id", "row"), size, shards).collect()
    assert {r.row: (r.slot, r.shard) for r in rows} == {i: divmod(permuted(i), shards) for i in range(size)}
