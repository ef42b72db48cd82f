"""Collocations: frequent phrases of up to five words, scored by how much oftener they stand together than apart.

Texts are cut into chunks of bounded numbers of words, with a dictionary each; a chunk belongs to one language.
Words are counted in lists dealt by a hash and the frequent ones numbered by rank of frequency. A place in a chunk then holds the
number of its word, and phrases grow by one word a round: the phrase that starts at a place and the last word of
the one that starts a place later make a pair of numbers. Pairs are counted by tiles of the plane of ranks: tiles
of frequent phrases and words have a dense table that `bincount` adds to at the pair's own address; all other
tiles are sorted lists of pairs and counts (COO), dealt by a hash. What a chunk has is added up before it is
shuffled, and the chunks' tables are merged a bounded number at a time. Frequent pairs are ranked anew and become the
next round's phrases; a merge by tile tells each chunk the new numbers. A phrase is frequent only if its parts are, so nothing is lost.

Every table grows with the input and none is broadcast whole or collected; counts, products and quotients are exact.

Defined cases: a null language counts as `und`; null and empty texts have no words; repeated rows count as often as
they stand there; ties are ordered by the phrase's bytes; a long text spreads over chunks at its separators, and
only a single piece is never cut. Without frequent phrases there are no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally.llm import text
from veritally.llm.components import kept
from veritally.llm.ranked import numbered
from veritally.session import shared_dir

#: A pair is one number: the phrase's rank above so many bits, the word's below.
WORD_BITS = 29
#: Ranks to a side of a tile, and what (tile row + 1) * (tile column + 1) may be for a dense one.
SIDE, DENSE = 512, 128
#: Entries that a task holds of a list of pairs before it adds up equal ones.
PENDING = 1 << 20


@dataclass(frozen=True)
class Settings:
    longest: int = 5
    least: int = 100
    #: Words of a chunk, about; chunks whose tables one task merges; chunks that share a copy of a tile's new numbers.
    chunk_words: int = 1_000_000
    merged: int = 64
    told: int = 1024
    #: Words of the corpus for each list of words or of sparse pairs, and for each task that merges tables.
    strip_words: int = 4_000_000
    task_words: int = 1_000_000


_CLASS = np.zeros(256, np.uint8)  # 1: space, 2: separator of pieces
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, as bytes, and whether a piece begins with each."""
    offsets, data = text.raw(pc.fill_null(texts, ""))
    kind = _CLASS[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] |= inside[offsets[:-1][offsets[:-1] < len(data)]]
    starts = np.flatnonzero(begins)
    lengths = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    # Pieces: how many separators lie before a word, and which text it is in.
    separators = np.cumsum(kind == 2, dtype=np.int64)[starts]
    owner = np.searchsorted(offsets, starts, side="right")
    first = np.ones(len(starts), bool)
    first[1:] = (separators[1:] != separators[:-1]) | (owner[1:] != owner[:-1])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]])])
    return words, first


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """chunk, lang, n, words, counts, codes: about `size` words of one language; codes are places in words, -1 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        waiting: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        held: dict[str, int] = {}
        number = 0

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            parts = waiting.pop(lang)
            del held[lang]
            coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
            first = np.concatenate([p[1] for p in parts])
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int64)
            at = np.arange(len(codes)) + np.cumsum(first)
            spread = np.full(at[-1] + 1, -1, np.int32)
            spread[at] = codes
            yield pa.RecordBatch.from_arrays([
                pa.array([(task << 33) + number]), pa.array([lang], pa.string()), pa.array([len(codes)]), pa.array([coded.dictionary.cast(pa.string())], pa.list_(pa.string())),
                pa.array([counts], pa.list_(pa.int64())), pa.array([_blob(spread, np.int32)], pa.binary()),
            ], names=["chunk", "lang", "n", "words", "counts", "codes"])
            number += 1

        for batch in text.pieces(batches, "text"):
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                words, first = split(batch.column("text").filter(pc.equal(langs.indices, code)))
                # Cut where the first piece begins after so many words.
                begins = np.append(np.flatnonzero(first), len(words))
                cuts = np.unique(begins[np.searchsorted(begins, np.arange(0, len(words), size))])
                cuts = cuts[cuts < len(words)]
                for start, stop in zip(cuts, np.append(cuts[1:], len(words))):
                    waiting.setdefault(lang, []).append((words[start:stop], first[start:stop]))
                    held[lang] = held.get(lang, 0) + stop - start
                    if held[lang] >= size:
                        yield from flush(lang)
            while sum(held.values()) >= 4 * size:
                yield from flush(max(held, key=held.get))
        for lang in list(waiting):
            yield from flush(lang)

    schema = "chunk bigint, lang string, n bigint, words array<string>, counts array<bigint>, codes binary"
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), "text").mapInArrow(run, schema)


def _packed(raw: bytes) -> bytes:
    """The size if compressed, else 0, and the bytes."""
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True) if len(raw) > 512 else struct.pack("<q", 0) + raw


def _unpacked(blob) -> pa.Buffer:
    packed = blob.as_buffer()
    size = struct.unpack("<q", packed[:8])[0]
    return pa.decompress(packed[8:], size, codec="zstd") if size else packed[8:]


def _blob(values: np.ndarray, kind) -> bytes:
    """Packed numbers."""
    return _packed(np.ascontiguousarray(values, kind).tobytes())


def _read(blob, kind) -> np.ndarray:
    return np.frombuffer(_unpacked(blob), kind)


def _word_blob(words: list[str]) -> bytes:
    """Packed words; none holds a space."""
    return _packed(" ".join(words).encode())


def _read_words(blob) -> pa.Array:
    return pa.array(_unpacked(blob).to_pybytes().decode().split(" "), pa.string())


def _sorted_blob(keys: np.ndarray) -> bytes:
    """Packed ascending numbers, as differences."""
    return _blob(np.diff(keys, prepend=0), np.int64)


def _read_sorted(blob) -> np.ndarray:
    return np.cumsum(_read(blob, np.int64))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def word_tables(cut: DataFrame, strips: int) -> DataFrame:
    """What each chunk adds to each list of words: chunk, lang, route, keys (its words there), codes, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, words, counts in zip(*(batch.column(c) for c in ("chunk", "lang", "words", "counts"))):
                words, counts = words.as_py(), counts.values.to_numpy()
                route = np.fromiter((zlib.crc32(w.encode()) % strips for w in words), np.int64, len(words))
                order = np.argsort(route, kind="stable")
                starts = np.flatnonzero(np.diff(route[order], prepend=-1))
                stops = np.append(starts[1:], len(order))
                keys = pa.array([_word_blob([words[i] for i in order[x:y].tolist()]) for x, y in zip(starts, stops)], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(starts), chunk.as_py())), pa.array([lang.as_py()] * len(starts), pa.string()), pa.array(route[order][starts]), keys,
                    pa.array([_blob(order[x:y], np.int64) for x, y in zip(starts, stops)], pa.binary()),
                    pa.array([_blob(counts[order[x:y]], np.int64) for x, y in zip(starts, stops)], pa.binary()),
                ], names=["chunk", "lang", "route", "keys", "codes", "counts"])

    return cut.select("chunk", "lang", "words", "counts").mapInArrow(run, "chunk bigint, lang string, route bigint, keys binary, codes binary, counts binary")


def first_state(cut: DataFrame, news: DataFrame) -> DataFrame:
    """State of the first round: where frequent words stand in each chunk, from what each was told.

    A state has chunk, lang and, for places where a frequent phrase starts: linked (whether the one before starts a place
    earlier), ids (numbers of the phrases; words have none of their own) and last (numbers of their last words).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, blob, found, new in zip(*(batch.column(c) for c in ("chunk", "lang", "codes", "found", "new"))):
                codes = _read(blob, np.int32)
                known, numbers = (np.concatenate([_read(part, np.int64) for part in x]) for x in (found, new))
                ranks = np.full(codes.max() + 2, -1, np.int64)  # the last is for -1, between pieces
                ranks[known] = numbers
                here = ranks[codes]
                yield _state(chunk, lang, np.flatnonzero(here >= 0), here[here >= 0], None)

    return cut.select("chunk", "lang", "codes").join(_by_chunk(news), "chunk").select("chunk", "lang", "codes", "found", "new").mapInArrow(run, STATE)


def _by_chunk(news: DataFrame) -> DataFrame:
    return news.groupBy("chunk").agg(F.collect_list("found").alias("found"), F.collect_list("ids").alias("new"))


STATE = "chunk bigint, lang string, linked binary, ids binary, last binary"


def _state(chunk, lang, places, ids, last) -> pa.RecordBatch:
    """last None: the phrases are words. Only what has a neighbour can grow, and only whether it follows the one before matters."""
    linked = np.diff(places, prepend=-2) == 1
    useful = linked | np.append(linked[1:], False)
    last = ids if last is None else last
    blobs = [_blob(np.packbits(linked[useful]), np.uint8), b"" if last is ids else _blob(ids[useful], np.int64), _blob(last[useful], np.int32)]
    return pa.RecordBatch.from_arrays([pa.array([chunk.as_py()]), pa.array([lang.as_py()], pa.string()), *[pa.array([b], pa.binary()) for b in blobs]], names=["chunk", "lang", "linked", "ids", "last"])


def _longer(linked, ids, last) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a phrase and the one a place later could make a longer one: place, pair, its last word."""
    last = _read(last, np.int32).astype(np.int64)
    ids = _read(ids, np.int64) if len(ids.as_buffer()) else last
    linked = np.unpackbits(_read(linked, np.uint8), count=len(last)).astype(bool)
    places = np.cumsum(np.where(linked, 1, 2))
    head = np.flatnonzero(linked[1:])
    return places[head], ids[head] << WORD_BITS | last[head + 1], last[head + 1]


def _routes(keys: np.ndarray, strips: int) -> tuple[np.ndarray, np.ndarray]:
    """Which table a pair belongs to: a dense tile (0 and on) or a list of sparse pairs (below 0); and its key there."""
    ids, words = keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1)
    row, column = ids // SIDE, words // SIDE
    dense = (row + 1) * (column + 1) <= DENSE
    mixed = (keys * np.int64(0x9E3779B97F4A7C1)).astype(np.uint64) >> np.uint64(20)
    route = np.where(dense, row * DENSE + column, -1 - (mixed % np.uint64(strips)).astype(np.int64))
    return route, np.where(dense, ids % SIDE * SIDE + words % SIDE, keys)


def whole_keys(route: int, keys: np.ndarray) -> np.ndarray:
    """The pairs again, of the keys of a table."""
    if route < 0:
        return keys
    row, column = divmod(route, DENSE)
    return row * SIDE + keys // SIDE << WORD_BITS | column * SIDE + keys % SIDE


TABLE = "chunk bigint, lang string, route bigint, keys binary, counts binary"


def pairs(state: DataFrame, strips: int) -> DataFrame:
    """What each chunk adds to each table: different keys and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, linked, ids, last in zip(*(batch.column(c) for c in ("chunk", "lang", "linked", "ids", "last"))):
                _, found, _ = _longer(linked, ids, last)
                found, counts = _summed(found, np.ones(len(found), np.int64))
                route, keys = _routes(found, strips)
                order = np.argsort(route, kind="stable")
                route, keys, counts = route[order], keys[order], counts[order]
                starts = np.flatnonzero(np.diff(route, prepend=-1 << 62))
                parts = list(zip(starts, np.append(starts[1:], len(route))))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(parts), chunk.as_py())), pa.array([lang.as_py()] * len(parts), pa.string()), pa.array(route[starts]),
                    pa.array([_sorted_blob(keys[a:b]) for a, b in parts], pa.binary()),
                    pa.array([_blob(counts[a:b], np.int64) for a, b in parts], pa.binary()),
                ], names=["chunk", "lang", "route", "keys", "counts"])

    return state.mapInArrow(run, TABLE)


class _WordCounts:
    """The words of one list as parts of it arrive."""

    KEY = "string"

    def __init__(self, route: int) -> None:
        self.words, self.counts = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.parts: list[tuple[pa.Array, np.ndarray]] = []
        self.pending = 0

    def add(self, keys, counts) -> None:
        self.parts.append((_read_words(keys), _read(counts, np.int64)))
        self.pending += len(self.parts[-1][0])
        if self.pending > PENDING + len(self.words):
            self._shrink()

    def _shrink(self) -> None:
        coded = pa.concat_arrays([self.words, *(words for words, _ in self.parts)]).dictionary_encode()
        counts = np.concatenate([self.counts, *(counts for _, counts in self.parts)])
        self.words = coded.dictionary
        # Sums of whole numbers far below 2^53, so exact as doubles.
        self.counts = np.bincount(coded.indices.to_numpy(), counts, len(self.words)).astype(np.int64)
        self.parts, self.pending = [], 0

    def packed(self) -> tuple[pa.Array, bytes]:
        self._shrink()
        return pa.array([_word_blob(self.words.to_pylist())], pa.binary()), _blob(self.counts, np.int64)

    def frequent(self, least: int) -> tuple[pa.Array, np.ndarray]:
        self._shrink()
        return self.words.filter(pa.array(self.counts >= least)), self.counts[self.counts >= least]


class _PairCounts:
    """The table of one route as parts of it arrive."""

    KEY = "bigint"

    def __init__(self, route: int) -> None:
        self.route = route
        self.dense = np.zeros(SIDE * SIDE if route >= 0 else 0, np.int64)
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, keys, counts) -> None:
        counts = _read(counts, np.int64)
        if self.route >= 0:
            # Sums of whole numbers far below 2^53, so exact as doubles.
            self.dense += np.bincount(_read_sorted(keys), counts, SIDE * SIDE).astype(np.int64)
            return
        self.lists.append((_read_sorted(keys), counts))
        self.pending += len(counts)
        if self.pending > 2 * PENDING + 2 * len(self.lists[0][0]):
            self._shrink()

    def _shrink(self) -> None:
        self.lists = [_summed(*map(np.concatenate, zip(*self.lists)))]
        self.pending = len(self.lists[0][0])

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        if self.route >= 0:
            return np.flatnonzero(self.dense), self.dense[self.dense > 0]
        self._shrink()
        return self.lists[0]

    def packed(self) -> tuple[pa.Array, bytes]:
        keys, counts = self._table()
        return pa.array([_sorted_blob(keys)], pa.binary()), _blob(counts, np.int64)

    def frequent(self, least: int) -> tuple[pa.Array, np.ndarray]:
        keys, counts = self._table()
        return pa.array(whole_keys(self.route, keys[counts >= least])), counts[counts >= least]


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that follow each other with equal values, as (values, row by row), across batches."""
    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in zip(*batch.columns):
                yield dict(zip(batch.schema.names, row))

    return groupby(rows(), key=lambda row: tuple(row[n].as_py() for n in names))


def merged(tables: DataFrame, groups: int, tasks: int, settings: Settings, kind: type) -> DataFrame:
    """lang, route, key (the word or the whole pair) and a of what is frequent; chunks' tables are merged so many at a time."""
    salt = F.pmod(F.xxhash64("chunk"), F.lit(groups).cast("bigint")).alias("salt")
    salted = tables.select("lang", "route", salt, "keys", "counts")
    while True:
        last, group = groups == 1, ("lang", "route", "salt")
        least = settings.least

        def run(batches: Iterator[pa.RecordBatch], last=last, group=group) -> Iterator[pa.RecordBatch]:
            for (lang, route, salt), rows in _runs(batches, group):
                total = kind(route)
                for row in rows:
                    total.add(row["keys"], row["counts"])
                if last:
                    keys, counts = total.frequent(least)
                    arrays, names = [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), route)), keys, pa.array(counts)], ["lang", "route", "key", "a"]
                else:
                    keys, counts = total.packed()
                    arrays, names = [pa.array([lang], pa.string()), pa.array([route]), pa.array([salt]), keys, pa.array([counts], pa.binary())], ["lang", "route", "salt", "keys", "counts"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        dealt = salted.repartition(tasks, *group).sortWithinPartitions(*group)
        if last:
            return dealt.mapInArrow(run, f"lang string, route bigint, key {kind.KEY}, a bigint")
        groups = -(-groups // settings.merged)
        salted = dealt.mapInArrow(run, f"lang string, route bigint, salt bigint, keys binary, counts binary").withColumn("salt", F.pmod("salt", F.lit(groups).cast("bigint")))


def told(tables: DataFrame, ranked: DataFrame, groups: int, tasks: int, kind: type) -> DataFrame:
    """chunk, found, ids: what is frequent in each chunk (codes of words, whole pairs) and its new numbers, merged table by table."""
    nothing = lambda ddl, name: F.lit(None).cast(ddl).alias(name)
    salt = F.pmod(F.xxhash64("chunk"), F.lit(groups).cast("bigint")).alias("salt")
    codes = "codes" if "codes" in tables.columns else nothing("binary", "codes")
    tables = tables.select("lang", "route", salt, "chunk", "keys", codes, nothing(kind.KEY, "key"), nothing("bigint", "place"))
    each = ranked.select("lang", "route", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("salt"), nothing("bigint", "chunk"), nothing("binary", "keys"), nothing("binary", "codes"), "key", "place")
    group = ("lang", "route", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, route, _), rows in _runs(batches, group):
            known, places, keys = [], [], None
            for row in rows:
                if row["key"].is_valid:  # these come first, by key
                    known.append(row["key"].as_py())
                    places.append(row["place"].as_py())
                    continue
                if not known:
                    break
                if keys is None:
                    keys, numbers = pa.array(known), np.array(places, np.int64)
                if kind is _WordCounts:
                    mine, theirs = _read(row["codes"], np.int64), _read_words(row["keys"])
                else:
                    mine = whole_keys(route, _read_sorted(row["keys"]))
                    theirs = pa.array(mine)
                at = pc.fill_null(pc.index_in(theirs, keys), -1).to_numpy(zero_copy_only=False)
                if (at >= 0).any():
                    blobs = [_blob(mine[at >= 0], np.int64), _blob(numbers[at[at >= 0]], np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["chunk"].as_py()]), *[pa.array([b], pa.binary()) for b in blobs]], names=["chunk", "found", "ids"])

    together = tables.unionByName(each).repartition(tasks, *group).sortWithinPartitions(*group, F.col("key").asc_nulls_last())
    return together.mapInArrow(run, "chunk bigint, found binary, ids binary")


def next_state(state: DataFrame, news: DataFrame) -> DataFrame:
    """The state of phrases one word longer, from what each chunk was told."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, linked, ids, last, found, new in zip(*(batch.column(c) for c in ("chunk", "lang", "linked", "ids", "last", "found", "new"))):
                known, numbers = (np.concatenate([_read(part, np.int64) for part in x]) for x in (found, new))
                order = np.argsort(known, kind="stable")
                known, numbers = known[order], numbers[order]
                places, keys, words = _longer(linked, ids, last)
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                same = known[at] == keys
                yield _state(chunk, lang, places[same], numbers[at[same]], words[same])

    return state.join(_by_chunk(news), "chunk").select("chunk", "lang", "linked", "ids", "last", "found", "new").mapInArrow(run, STATE)


class _Folder:
    """Tables of one run in the folder that all executors share."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex}"

    def kept(self, name: str, df: DataFrame) -> DataFrame:
        """df written once; small row groups, as a row may be some megabytes."""
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")


def counted(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, m (words), a of every frequent phrase of 1 to `longest` words; and lang, n of all words."""
    folder = _Folder(docs.sparkSession)
    cut = folder.kept("chunks", chunks(docs, settings.chunk_words))
    totals = kept(cut.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("chunks")))
    sums = totals.agg(F.sum("n"), F.sum("chunks")).first()
    words, parts = sums[0] or 0, sums[1] or 0
    strips, tasks = 1 + words // settings.strip_words, 1 + words // settings.task_words
    merging, telling = max(1, -(-parts // settings.merged)), max(1, -(-parts // settings.told))
    tables = word_tables(cut, strips)
    ranked = numbered(merged(tables, merging, tasks, settings, _WordCounts), "lang", F.desc("a"), F.col("key"))
    names = ranked.select("lang", F.col("place").alias("id"), F.col("key").alias("phrase"), "a")
    found = [names.withColumn("m", F.lit(1))]
    state = folder.kept("state-1", first_state(cut, told(tables, ranked, telling, tasks, _WordCounts)))
    for m in range(2, settings.longest + 1):
        tables = folder.kept(f"pairs-{m}", pairs(state, strips))
        often = numbered(merged(tables, merging, tasks, settings, _PairCounts), "lang", F.desc("a"), F.col("key"))
        head = found[-1].select("lang", F.col("id").alias("head"), F.col("phrase").alias("_head"))
        tail = names.select("lang", F.col("id").alias("tail"), F.col("phrase").alias("_tail"))
        cutting = often.select("lang", F.col("place").alias("id"), "a", F.shiftright("key", WORD_BITS).alias("head"), F.col("key").bitwiseAND((1 << WORD_BITS) - 1).alias("tail"))
        named = cutting.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
        found.append(kept(named.select("lang", "id", F.concat_ws(" ", "_head", "_tail").alias("phrase"), "a", F.lit(m).alias("m"))))
        if m < settings.longest:
            state = folder.kept(f"state-{m}", next_state(state, told(tables, often, telling, tasks, _PairCounts)))
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    return everything.drop("id"), totals.select("lang", "n")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase of several words at its lowest cut, the earliest among equal ones."""
    cuts = phrases.filter("m > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    each = F.split("phrase", " ")
    cuts = cuts.withColumns({"_head": F.concat_ws(" ", F.slice(each, F.lit(1), F.col("k"))), "_tail": F.concat_ws(" ", F.slice(each, F.col("k") + 1, F.col("m") - F.col("k")))})
    parts = phrases.select("lang", "phrase", "a")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("_head"), F.col("a").alias("l")), ["lang", "_head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("_tail"), F.col("a").alias("r")), ["lang", "_tail"]).join(totals, "lang")
    # 38 digits hold the products; div gives whole quotients.
    wide = {c: F.col(c).cast("decimal(38,0)") for c in "alrn"}
    cuts = cuts.withColumns({"_up": F.lit(1000).cast("decimal(38,0)") * wide["a"] * wide["n"], "_down": wide["l"] * wide["r"]})
    lowest = F.min(F.struct(F.expr("_up div _down").alias("score"), "k", "l", "r")).alias("x")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def independent(phrases: DataFrame) -> DataFrame:
    """Phrases that stand outside any longer frequent one at least once.

    Whatever holds a phrase is at most as frequent, and so is all between them; so one word more decides.
    """
    each, size = F.split("phrase", " "), F.col("m")
    shorter = F.explode(F.array(F.concat_ws(" ", F.slice(each, F.lit(1), size - 1)), F.concat_ws(" ", F.slice(each, F.lit(2), size - 1))))
    inside = phrases.filter("m > 2").select("lang", shorter.alias("phrase"), "a")
    return phrases.join(inside, ["lang", "phrase", "a"], "left_anti")


def mine(docs: DataFrame, most: int, settings: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, frequency and bytes."""
    phrases, totals = counted(docs, settings)
    best = scored(phrases, totals).join(independent(phrases.filter("m > 1")).select("lang", "phrase"), ["lang", "phrase"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
