"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct shingles of five words, as 64-bit hashes; two documents link at
a similarity of 0.8 or more. Documents of equal sets are one node from the start.

1. Of each distinct set, all shingles or a fixed part of them meet by ranges of the hash, with a digest of the set; those that two sets
   have are counted for each. A set of which too few are shared links with nothing and goes no further. What is known of the others is
   one bit for one row of each, however many shingles there are. Of these rows, near copies for the most part, the shingles that
   occur twice are marked in a bit for each hash slot (a bit too many does no harm), and the marked ones are shipped.
2. Shingles of a node are ordered from rare to frequent. Its prefix is so many that two nodes that
   link must share one. Nodes of identical prefix and size form a group; groups that share
   prefix shingles, directly or through others, form a hub.
3. In a hub group pairs are filtered by size and prefix, then expanded, and members verified on
   their whole sets. Pairs already connected are skipped. A hub too large for one task is cut
   by size, and then into chunks, each of which also meets the most central nodes of its size.
   Then, for each prefix shingle, what is outside the largest component that has it meets all that have it,
   unless sizes or the shingle's place in the order rule a link out. Every pair that could add a connection is thus met.

Any order of shingles gives right results, so the table of frequent ones may be bounded.

Null texts and texts without words have an empty set and link with nothing. Rows of equal ids
are rows of their own; a null id never names a component unless all its members have none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm import text
from veritally.llm.components import components, kept

WORDS = 5
#: Similarity in percent.
PERCENT = 80
#: Slots that tell which hashes may repeat, or which rows may link, as a power of two: 8 MB in each worker.
SLOT_BITS = 26
#: Of eight shingles so many are looked up, but all of sets of at most WHOLE.
LOOKED_UP, WHOLE = 4, 64
#: Bits of a set's digest that go with its shingles.
DIGEST_BITS = 40
#: A shingle in more nodes than this is frequent; so many frequent ones are known by number.
FREQUENT, MOST_FREQUENT = 64, 100_000
#: Shingles of the nodes of one chunk, and central nodes that each chunk of a hub meets.
CHUNK, CENTRAL = 300_000, 32
#: Hashes of one range, the most ranges, the bits below a range's that tell hashes apart, and characters of a word with its space.
RANGE_HASHES, MOST_RANGES, LOW_BITS, WORD_CHARS = 700_000, 65_536, 24, 6


def needed(size: int, percent: int) -> int:
    """Shingles that a set must share with any set that it links with."""
    return -(-percent * size // 100)


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and distinct hashes, ascending, of each text's shingles; fewer words make one shingle."""
    offsets, ids, distinct = text.words(texts, lower=True)
    if not len(ids):
        return offsets, np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, map(str.encode, distinct.to_pylist())), np.uint64, len(distinct))[ids]
    sizes = np.diff(offsets)
    count = np.where(sizes > 0, np.maximum(1, sizes - words + 1), 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][owner]
    stop = offsets[1:][owner]
    hashes = np.zeros(len(owner), np.uint64)
    for k in range(words):
        here = first + k < stop
        code = np.where(here, codes[np.where(here, first + k, 0)], np.uint64(k + 1))
        hashes = (hashes ^ code) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    bounds = np.concatenate([[0], np.cumsum(count)])
    parts = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return np.concatenate([[0], np.cumsum([len(part) for part in parts])]), np.concatenate(parts)


def ranges_for(hashes: int) -> int:
    """Ranges, a power of two, that so many hashes are dealt by."""
    return 1 << min(MOST_RANGES.bit_length() - 1, max(6, (hashes // RANGE_HASHES).bit_length()))


def by_range(rows: DataFrame, hashes_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], ranges: int) -> DataFrame:
    """range and hashes (packed, sorted) of all hashes that the function gives, each range in one task.

    The range holds the upper bits; the 24 below tell hashes apart well enough where a hash taken for another does no harm.
    """
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def blocks() -> pa.RecordBatch:
            hashes = np.sort(np.concatenate(waiting))
            waiting.clear()
            low = (hashes >> (shift - np.uint64(LOW_BITS))).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            return _blocks((hashes >> shift).astype(np.int64), low, ranges)

        for hashes in hashes_of(batches):
            waiting.append(hashes)
            if sum(map(len, waiting)) > 1_000_000:
                yield blocks()
        if waiting:
            yield blocks()

    return _met(rows.mapInArrow(cut, BLOCKS))


#: Hashes, packed, that go to one task.
BLOCKS = "range int, hashes binary"


def _met(blocks: DataFrame) -> DataFrame:
    """Each range in one task, its rows together."""
    return blocks.repartition("range").sortWithinPartitions("range")


def _blocks(numbers: np.ndarray, values: np.ndarray, ranges: int) -> pa.RecordBatch:
    """BLOCKS of values, which are in the order of their ranges' numbers."""
    parts = np.split(values, np.searchsorted(numbers, np.arange(1, ranges)))
    real = [i for i, part in enumerate(parts) if len(part)]
    return pa.RecordBatch.from_arrays([pa.array(real, pa.int32()), pa.array([parts[i].tobytes() for i in real], pa.binary())], names=["range", "hashes"])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Of each range, its hashes, ascending: the range's number and the 24 bits below."""
    for (number,), parts in by_key(batches, ["range"]):
        low = np.frombuffer(b"".join(part["hashes"] for part in parts), np.uint8).reshape(-1, 3).astype(np.int64)
        yield np.sort(low[:, 0] | low[:, 1] << 8 | low[:, 2] << 16 | number << LOW_BITS)


def _slots(found: DataFrame, marked: Callable[[np.ndarray], np.ndarray], ranges: int) -> np.ndarray:
    """Bits of the hash slots of the marked ones among hashes dealt by_range. Its size does not depend on the data.

    A range is a block of these bits; it comes to the driver as numbers of slots or as bits, whichever is shorter, all ranges in one job.
    """
    drop = LOW_BITS + ranges.bit_length() - 1 - SLOT_BITS
    block = (1 << SLOT_BITS) // ranges

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes in merged(batches):
            number = int(hashes[0]) >> LOW_BITS
            slots = (np.unique(marked(hashes) >> drop) - number * block).astype(np.int32)
            sent = slots if 32 * len(slots) < block else np.packbits(np.isin(np.arange(block, dtype=np.int32), slots))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([sent.tobytes()], pa.binary())], names=["range", "slots"])

    sent_by_range = found.mapInArrow(count, "range int, slots binary").toArrow()
    packed = np.zeros((ranges, block >> 3), np.uint8)
    for number, sent in zip(sent_by_range["range"].to_pylist(), sent_by_range["slots"]):
        sent = np.frombuffer(sent.as_py(), np.uint8)
        if len(sent) == block >> 3:
            packed[number] = sent
        else:
            slots = sent.view(np.int32)
            np.bitwise_or.at(packed[number], slots >> 3, (128 >> (slots & 7)).astype(np.uint8))
    return packed.reshape(-1)


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the slots of hashes have their bits."""
    slot = hashes >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[slot >> np.uint64(3)] >> (7 - (slot & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def _hashes(docs: DataFrame, column: str) -> int:
    """About how many shingles the texts have."""
    return docs.select(F.coalesce(F.sum(F.length(column)), F.lit(0))).first()[0] // WORD_CHARS


def repeated_slots(docs: DataFrame, column: str, words: int, hashes: int | None = None) -> np.ndarray:
    """Bits of the hash slots that hold a hash of two or more rows; of about so many hashes, if that is known."""
    ranges = ranges_for(_hashes(docs, column) if hashes is None else hashes)

    def hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (shingles(batch.column(column), words)[1] for batch in text.pieces(batches, column))

    return _slots(by_range(docs.select(column), hashes_of, ranges), lambda found: found[1:][found[1:] == found[:-1]], ranges)


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A hash of each row's id and text."""
    offsets, data = text.raw(batch.column(column).fill_null(""))
    hashes = np.fromiter((xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])), np.uint64, batch.num_rows)
    ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    hashes = (hashes ^ ids * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x9E3779B97F4A7C15)
    return hashes ^ hashes >> np.uint64(32)


#: Rows of documents among BLOCKS, under ranges below 0: what joins need, and how many looked up shingles a set must share.
WITH_ROWS = f"{BLOCKS}, doc_id bigint, n_shingles bigint, key binary, need bigint, digest bigint, row bigint"


def looked_up(docs: DataFrame, column: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, key (of the set), need, digest and row of all documents; digest and shared, the looked up shingles that another set has.

    Sets that link share all shingles but n - needed of either, so as many of the looked up ones. A partner of a set of
    WHOLE shingles may be larger; all of its shingles are there too. Sets of equal digests are taken for one in `shared`,
    which then is too large.
    """
    hashes = _hashes(docs, column)
    ranges, fewer = ranges_for(hashes), ranges_for(hashes // 4)
    shift, kept_bits = np.uint64(64 - (ranges.bit_length() - 1)), LOW_BITS + fewer.bit_length() - 1
    names = [field.split()[0] for field in WITH_ROWS.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, sent, seen = [], set(), 0  # sent: a set's shingles leave the task once

        def blocks() -> pa.RecordBatch:
            hashes, owners = (np.concatenate(parts) for parts in zip(*waiting))
            waiting.clear()
            numbers = (hashes >> shift).astype(np.uint16)
            order = np.argsort(numbers, kind="stable")
            low = (hashes << (np.uint64(64) - shift) >> np.uint64(64 - LOW_BITS)) << np.uint64(DIGEST_BITS) | owners
            return _filled(_blocks(numbers[order].astype(np.int64), low[order], ranges))

        for batch in text.pieces(batches, column, text.STEP_BYTES // 2):
            offsets, hashes = shingles(batch.column(column), words)
            sizes, keys, n = np.diff(offsets), [None] * batch.num_rows, batch.num_rows
            digests, new = np.zeros(n, np.uint64), np.zeros(n, bool)
            for i in np.flatnonzero(sizes).tolist():
                keys[i] = hashlib.blake2b(hashes[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest()
                digests[i] = int.from_bytes(keys[i][:8]) >> (64 - DIGEST_BITS)
                new[i] = keys[i] not in sent
                sent.add(keys[i])
            owner = text.owners(offsets)
            part = (hashes & np.uint64(7)) < LOOKED_UP
            of_part = np.bincount(owner[part], minlength=n)
            need = np.where(sizes <= WHOLE, sizes, of_part) - (sizes - -(-percent * sizes // 100))
            goes = (part | (percent * sizes <= 100 * WHOLE)[owner]) & new[owner]
            waiting.append((hashes[goes], digests[owner[goes]]))
            numbers = -1 - (seen + np.arange(n)) % MOST_RANGES
            seen += n
            arrays = [numbers, sizes, need, digests.astype(np.int64), _rows(batch, column).view(np.int64)]
            yield _filled(pa.RecordBatch.from_arrays(
                [*map(pa.array, arrays), batch.column("doc_id"), pa.array(keys, pa.binary())], names=["range", "n_shingles", "need", "digest", "row", "doc_id", "key"]
            ))
            if sum(len(part) for part, _ in waiting) > 1_000_000:
                yield blocks()
        if waiting:
            yield blocks()

    def _filled(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = {"range": pa.int32(), "hashes": pa.binary(), "key": pa.binary()}
        have = batch.schema.names
        arrays = [batch.column(name).cast(kinds.get(name, pa.int64())) if name in have else pa.nulls(batch.num_rows, kinds.get(name, pa.int64())) for name in names]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents as they are; of each range, the digests of sets that share shingles, once for each shingle."""
        waiting, rows = [], []

        def blocks_of() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first = int(np.searchsorted(batch.column("range").to_numpy(), 0))
                if first:
                    rows.append(batch.slice(0, first))
                if first < batch.num_rows:
                    yield batch.slice(first).select(["range", "hashes"])

        def blocks() -> pa.RecordBatch:
            digests = np.sort(np.concatenate(waiting))
            waiting.clear()
            short = digests >> np.uint64(DIGEST_BITS - kept_bits)
            low = (short & np.uint64((1 << LOW_BITS) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            return _filled(_blocks((short >> np.uint64(LOW_BITS)).astype(np.int64), low, fewer))

        for _, parts in by_key(blocks_of(), ["range"]):
            found = np.unique(np.frombuffer(b"".join(part["hashes"] for part in parts), np.uint64))
            low = found >> np.uint64(DIGEST_BITS)
            same = np.concatenate([[False], low[1:] == low[:-1], [False]])
            waiting.append(found[same[1:] | same[:-1]] & np.uint64((1 << DIGEST_BITS) - 1))
            if sum(map(len, waiting)) > 1_000_000:
                yield blocks()
        yield from rows
        if waiting:
            yield blocks()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests in merged(batches):
            found, count = np.unique(digests, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(count, pa.int64())], names=["digest", "shared"])

    rows = kept(_met(docs.select(F.col("doc_id").cast("bigint"), column).mapInArrow(cut, WITH_ROWS)).mapInArrow(met, WITH_ROWS))
    shared = _met(rows.filter("range >= 0").select("range", "hashes")).mapInArrow(sums, "digest bigint, shared bigint")
    made = rows.filter("range < 0").withColumn("digest", F.shiftright("digest", DIGEST_BITS - kept_bits))
    return made.select("doc_id", "n_shingles", "key", "need", "digest", "row"), shared


def candidates(docs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """doc_id and text of the given rows of docs, by their hashes; a few more do no harm."""
    least = ranges_for(0)

    def hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (np.asarray(batch.column(0)).view(np.uint64) for batch in batches if batch.num_rows)

    shared = docs.sparkSession.sparkContext.broadcast(_slots(by_range(rows.select("row"), hashes_of, least), lambda found: found, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.pieces(batches, column):
            yield batch.filter(pa.array(_marked(shared.value, _rows(batch, column))))

    picked = docs.select(F.col("doc_id").cast("bigint"), F.col(column).cast("string").alias(column))
    return picked.mapInArrow(run, picked.schema)


def by_key(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal keys in sorted batches; one run's rows are held at a time."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            flat = [_arrays(c) if pa.types.is_list(c.type) else c.to_pylist() for c in columns]
            for values in zip(*flat):
                yield dict(zip(batch.schema.names, values))

    return ((key, list(run)) for key, run in groupby(rows(), key=lambda row: tuple(row[n] for n in names)))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def sets(docs: DataFrame, slots: np.ndarray, column: str, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, and for a document that may link: key (of the set) and, once in each task, hashes.

    Hashes that no other document can have are in no intersection: they count in n_shingles and key alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = shared.value, set()
        for batch in text.pieces(batches, column):
            offsets, hashes = shingles(batch.column(column), words)
            again = _marked(bits, hashes)
            seen = np.concatenate([[0], np.cumsum(again, dtype=np.int64)])
            sizes = np.diff(offsets)
            may = (sizes > 0) & (seen[offsets[1:]] - seen[offsets[:-1]] >= -(-percent * sizes // 100))
            keys, values = [None] * len(sizes), [None] * len(sizes)
            for i in np.flatnonzero(may).tolist():
                part = hashes[offsets[i] : offsets[i + 1]]
                keys[i] = hashlib.blake2b(part.tobytes(), digest_size=16).digest()
                if keys[i] not in sent:
                    sent.add(keys[i])
                    values[i] = part[again[offsets[i] : offsets[i + 1]]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "key", "hashes"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), column).mapInArrow(run, "doc_id bigint, n_shingles bigint, key binary, hashes array<bigint>")


def prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """key, n, prefix (the rarest shingles, of which linked nodes share one), skip, central (the share of frequent ones).

    The n - size(hashes) shingles that no other node has come first in every order: they are skipped, not listed.
    """
    spark = nodes.sparkSession
    ranges = ranges_for(nodes.select(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    drop = np.uint64(64 - LOW_BITS - (ranges.bit_length() - 1))

    def hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (np.asarray(batch.column(0).flatten()).view(np.uint64) for batch in batches)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes in merged(batches):
            found, count = np.unique(hashes, return_counts=True)
            many = count > FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(found[many], pa.int64()), pa.array(count[many], pa.int64())], names=["hash", "count"])

    counts = by_range(nodes.select("hashes"), hashes_of, ranges).mapInArrow(often, "hash bigint, count bigint")
    frequent = counts.orderBy(F.desc("count"), "hash").limit(MOST_FREQUENT).collect()
    shared = spark.sparkContext.broadcast(tuple(np.array(sorted(map(tuple, frequent)), np.int64).reshape(-1, 2).T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for batch in batches:
            out, central, skip = [], [], []
            for part, n in zip(_arrays(batch.column(batch.schema.names.index("hashes"))), batch.column("n").to_pylist()):
                count = np.zeros(len(part), np.int64)
                if len(known):
                    short = (part.view(np.uint64) >> drop).astype(np.int64)
                    at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                    count = np.where(known[at] == short, often[at], 0)
                out.append(part[np.lexsort((part, count))[: len(part) - needed(n, percent) + 1]])
                skip.append(n - len(part))
                central.append(np.count_nonzero(count) / len(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n"), pa.array(out, pa.list_(pa.int64())), pa.array(skip, pa.int64()), pa.array(central, pa.float64())],
                names=["key", "n", "prefix", "skip", "central"],
            )

    return nodes.select("key", "n", "hashes").mapInArrow(run, "key binary, n bigint, prefix array<bigint>, skip bigint, central double")


class _Union:
    """Which members are connected; the smallest key stands for all."""

    def __init__(self, keys):
        self.up = {key: key for key in keys}

    def root(self, key):
        while self.up[key] != key:
            self.up[key] = key = self.up[self.up[key]]
        return key

    def join(self, a, b) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def _groups(rows: list[dict]) -> list[tuple[int, frozenset, list[tuple[bytes, frozenset]]]]:
    """Rows of identical prefix and size: size, prefix, and the members' keys and sets; by size."""
    found: dict[tuple, list] = {}
    for row in rows:
        found.setdefault((row["n"], row["prefix"].tobytes()), []).append(row)
    groups = [(n, frozenset(members[0]["prefix"].tolist()), [(m["key"], frozenset(m["hashes"].tolist())) for m in members]) for (n, _), members in found.items()]
    return sorted(groups, key=lambda group: group[0])


def connect(left: list[dict], right: list[dict] | None, known: _Union, percent: int) -> list[tuple[bytes, bytes]]:
    """Join what links between two lists of rows (or within one): filter group pairs, expand, verify.

    Returns the roots that were joined.
    """
    made = []
    a_groups = _groups(left)
    b_groups = a_groups if right is None else _groups(right)
    sizes = np.array([group[0] for group in b_groups])
    for i, (n, prefix, members) in enumerate(a_groups):
        low = np.searchsorted(sizes, needed(n, percent), "left") if right is not None else i
        high = np.searchsorted(sizes, 100 * n // percent, "right")
        for m, other_prefix, others in b_groups[low:high]:
            if other_prefix is not prefix and prefix.isdisjoint(other_prefix):
                continue
            for key, items in members:
                for other, other_items in others:
                    if key != other and known.root(key) != known.root(other) and linked(len(items & other_items), n, m, percent):
                        made.append((known.root(key), known.root(other)))
                        known.join(key, other)
    return made


def _solve(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Chunks of hubs, sorted: key and the smallest key its chunk connects it with. Central nodes come first."""
    for _, rows in by_key(batches, ["hub", "chunk"]):
        known = _Union({row["key"] for row in rows})
        own = [row for row in rows if not row["guest"]]
        guests = [row for row in rows if row["guest"]]
        if guests:
            connect(guests, None, known, percent)
            connect(guests, own, known, percent)
        connect(own, None, known, percent)
        keys = list(known.up)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(map(known.root, keys), pa.binary())], names=["key", "root"])


def _dealt(rows: DataFrame, solve, percent: int) -> DataFrame:
    """Each chunk in one task, its rows together."""
    parts = rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk")
    return parts.mapInArrow(lambda batches: solve(batches, percent), "key binary, root binary")


def roots(nodes: DataFrame, percent: int) -> DataFrame:
    """key and root for each node (key, n, hashes) that links with another; equal roots are one component.

    Sets are joined in only where they are compared.
    """
    light = kept(prefixes(nodes, percent).withColumn("member", F.xxhash64("prefix", "n")))
    # Groups of identical prefix and size, and the prefix shingles that two groups share. Shingles
    # that the very same groups share say the same: the first in the common order stands for all.
    pairs = light.select("member", "prefix", "skip").dropDuplicates(["member"]).select("member", "skip", F.posexplode("prefix").alias("at", "via"))
    pairs = pairs.select("member", (F.col("at") + F.col("skip")).alias("pos"), "via")
    same = [F.bit_xor(F.xxhash64(F.lit(k), "member")).alias(f"x{k}") for k in (1, 2)]
    shared = pairs.groupBy("via").agg(F.count("*").alias("c"), F.min("pos").alias("low"), *same).filter("c > 1")
    shared = shared.groupBy("c", "x1", "x2").agg(F.min_by("via", "low").alias("via")).select("via")
    pairs = kept(pairs.join(shared, "via"))
    # A group that shares no shingle is a hub of its own members.
    placed = light.join(components(pairs), "member", "left").withColumn("hub", F.coalesce("root", "member")).drop("root")
    hubs = placed.groupBy("hub").agg((F.sum("n") > CHUNK).alias("large"), F.count("*").alias("c")).filter("c > 1").drop("c")
    # A large hub is split by size first, as near copies are of about one size, then by chance.
    by_size = F.xxhash64("hub", F.floor(F.log("n") / F.log(F.lit(1.02))))
    placed = placed.join(hubs, "hub").withColumn("hub", F.when(F.col("large"), by_size).otherwise(F.col("hub")))
    chunks = placed.groupBy("hub").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    placed = kept(placed.join(chunks, "hub").withColumn("chunk", F.expr("cast(pmod(xxhash64(key), chunks) as int)")))
    hashes = nodes.select("key", "hashes")
    columns = ("hub", "chunk", "key", "n", "hashes", "prefix")
    guest, own = F.lit(True).alias("guest"), F.lit(False).alias("guest")
    centre = F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("central"), F.desc("n"), "key"))
    central = kept(placed.filter("chunks > 1").withColumn("turn", centre).filter(F.col("turn") <= CENTRAL))
    every_chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    visits = central.join(hashes, "key").drop("chunk").select("*", every_chunk).select(*columns, guest)
    others = placed.join(central.select("key"), "key", "left_anti").join(hashes, "key").select(*columns, own)
    first = kept(_dealt(others.unionByName(visits), _solve, percent))
    large = placed.filter("large")
    if large.isEmpty():
        return first
    # Where no chunk met guests, every node is in one chunk alone and has one root.
    found = first.select(F.col("key").alias("member"), "root")
    if not central.isEmpty():
        found = components(found.select("member", F.col("root").alias("via")))
    linked_pairs = _across(large.join(found.select(F.col("member").alias("key"), "root"), "key"), pairs, hashes, percent)
    if linked_pairs.isEmpty():
        return found.select(F.col("member").alias("key"), "root")
    edges = found.select("member", F.col("root").alias("via")).unionByName(linked_pairs).unionByName(linked_pairs.select(F.col("via").alias("member"), "via"))
    return components(edges).select(F.col("member").alias("key"), "root")


def _across(rooted: DataFrame, pairs: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """member and via: links between nodes of large hubs whose roots still differ.

    What is outside the largest component that shares a shingle meets all that share it, where
    that shingle is early enough in both orders: sets that link share one among the first
    n - overlap + 1 of either, with the overlap that their two sizes ask for.
    """
    own = rooted.select("member", F.col("member").alias("via"), F.lit(0).cast("bigint").alias("pos")).distinct()
    rows = kept(pairs.select("member", "via", "pos").unionByName(own).join(rooted.select("member", "key", "n", "root"), "member").drop("member"))
    main = rows.groupBy("via", "root").agg(F.count("*").alias("c")).groupBy("via").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"))
    rows = rows.join(kept(main.filter("roots > 1").drop("roots")), "via")
    outside = rows.filter("root <> main").select("via", *[F.col(c).alias(f"{c}2") for c in ("key", "n", "root", "pos")])
    fits = (F.col("root") != F.col("root2")) & ((F.col("root") == F.col("main")) | (F.col("key") < F.col("key2")))
    fits &= (100 * F.col("n") >= percent * F.col("n2")) & (100 * F.col("n2") >= percent * F.col("n"))
    overlap = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))
    fits &= (F.col("pos") <= F.col("n") - overlap) & (F.col("pos2") <= F.col("n2") - overlap)
    met = rows.join(outside, "via").filter(fits).select("key", "key2", (F.col("n") + F.col("n2")).alias("all"))
    met = kept(met.distinct())
    # The sets under the same names on both sides, so that they cross the network once for the two joins.
    one = met.alias("met").join(hashes.alias("one"), F.col("met.key") == F.col("one.key"))
    both = one.join(hashes.alias("two"), F.col("met.key2") == F.col("two.key"))
    shared = F.size(F.array_intersect("one.hashes", "two.hashes"))
    return kept(both.filter(100 * shared >= percent * (F.col("all") - shared)).select(F.col("met.key").alias("member"), F.col("met.key2").alias("via")))


def join(docs: DataFrame, column: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, its own included)."""
    made, shared = looked_up(docs, column, words, percent)
    firsts = [F.first(name).alias(name) for name in ("n_shingles", "need", "digest")]
    distinct = made.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("label"), F.min("row").alias("row"), *firsts)
    distinct = kept(distinct.join(shared, "digest", "left").withColumn("may", F.coalesce("shared", F.lit(0)) >= F.col("need")).select("key", "label", "n_shingles", "row", "may"))
    may = distinct.filter("may")
    hashes = may.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    rows = candidates(docs, may, column)
    shipped = sets(rows, repeated_slots(rows, column, words, hashes), column, words, percent).filter(F.col("key").isNotNull())
    nodes = kept(shipped.groupBy("key").agg(F.first("n_shingles").alias("n"), F.first("hashes", ignorenulls=True).alias("hashes")))
    found = roots(nodes, percent)
    labels = distinct.select("key", "label").join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = labels.groupBy("root").agg(F.min("label").alias("component_id"))
    by_set = kept(labels.join(named, "root").select("key", "component_id"))
    return made.join(by_set, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def survivors(docs: DataFrame, column: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: the row whose id names it. Rows without words, and without an id, all stay."""
    names = docs.columns
    found = join(docs, column, words, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs["doc_id"] == found["_gone"], "left_anti").select(*names)
