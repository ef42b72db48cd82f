"""Byte-level BPE by a lazily determinised transducer, and streaming decode.

The merges are compiled on the fly. A configuration of the non-deterministic machine is a token
that ended somewhere in the last few bytes together with the bytes read since, which must begin
a token. Two tokens may follow each other only where the merges leave their joined bytes as
these two tokens; with that rule every prefix of a text has exactly one last token, so reading
a byte closes at most one token. A deterministic state is the set of live configurations, each
with the tokens it still owes; what all owe in common is emitted at once. The longest token bounds the
number of configurations and so the lookahead. States and arcs are made when first met and kept.

Null text counts as empty: no ids, the digest of no bytes. Any text is accepted.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veritally.llm import text

#: States of the transducer that a worker keeps before it starts anew (about a kilobyte each), and four times as many pairs of tokens.
MOST_STATES = 200_000
TWO_WHITE = re.compile(r"\s\s")
ADDED = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file's content."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Arcs:
    """The arcs made so far, by state and byte, in one open-addressed table: where each leads and what it emits."""

    ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.size = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.next = np.zeros(1 << bits, np.int32)
        self.emits = np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key without an arc, an empty one."""
        mask = len(self.keys) - 1
        slots = (keys.astype(np.uint64) * self.ODD >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slots]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slots[open_] = slots[open_] + 1 & mask
            there = self.keys[slots[open_]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return slots

    def add(self, key: int, following: int, emitted: int) -> None:
        if 2 * (self.size + 1) > len(self.keys):
            old, full = self, self.keys >= 0
            keys, nexts, emits = old.keys[full], old.next[full], old.emits[full]
            self.__init__(self.bits + 1)
            for row in zip(keys.tolist(), nexts.tolist(), emits.tolist()):
                self._put(*row)
        self._put(key, following, emitted)

    def _put(self, key: int, following: int, emitted: int) -> None:
        mask = len(self.keys) - 1
        slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
        while self.keys[slot] >= 0:
            slot = slot + 1 & mask
        self.keys[slot], self.next[slot], self.emits[slot] = key, following, emitted
        self.size += 1


class Transducer:
    """Token ids of a byte string, read byte by byte."""

    def __init__(self, ranks: dict[bytes, int], most_states: int | None = None):
        self.most_states = most_states
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.prefixes = {token[:n] for token in ranks for n in range(1, len(token))}
        self.pairs: dict[tuple[int | None, int], bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[bytes, int, int]]] = {}
        self._reset()

    def _reset(self) -> None:
        start = (((), None, b""),)
        self.states = [start]
        self.numbers = {start: 0}
        self.arcs = Arcs()  # by state and byte; their emissions are numbers of outputs, 0: nothing
        self.ends = np.full(1024, -1, np.int32)  # number of what a state emits at the end of a piece
        self.outputs: list[tuple[int, ...]] = [()]
        self.output_numbers: dict[tuple[int, ...], int] = {(): 0}

    def _output(self, tokens: tuple[int, ...]) -> int:
        number = self.output_numbers.setdefault(tokens, len(self.outputs))
        if number == len(self.outputs):
            self.outputs.append(tokens)
        return number

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """The parts that touch a token's right (or left) end while it is merged, largest first.

        Each with its bytes, the rank that makes it (-1 for a byte) and the rank that absorbs it.
        """
        known = self.spines.get((token, right))
        if known is None:
            whole, made, known = self.tokens[token], token, []
            absorbed = 1 << 40
            while len(whole) > 1:
                halves = self._merged(whole, made)
                if len(halves) != 2:
                    break  # the merges never make this token
                known.append((whole, made, absorbed))
                whole, absorbed = halves[right], made
                made = self.ranks[whole]
            known.append((whole, -1 if len(whole) == 1 else 1 << 40, absorbed))
            self.spines[token, right] = known
        return known

    def _merged(self, data: bytes, below: int) -> list[bytes]:
        """A few bytes merged by ranks below a bound only: the lowest rank first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, last: int | None, token: int) -> bool:
        """Whether the merges leave the joined bytes of two tokens as these two.

        They do unless some part at the end of the first and some part at the start of the second
        stand side by side when the rank of their union is due. At equal ranks the leftmost goes first.
        """
        known = self.pairs.get((last, token))
        if known is None:
            if len(self.pairs) > 4 * (self.most_states or MOST_STATES):
                self.pairs.clear()
            right = self._spine(token, False)
            known = right[0][1] != 1 << 40  # a token that merges never make stands for whole pieces only
            for a, made_a, gone_a in self._spine(last, True) if known and last is not None else ():
                for b, made_b, gone_b in right:
                    rank = self.ranks.get(a + b)
                    if rank is not None and made_a < rank and made_b < rank and rank < gone_a and rank <= gone_b:
                        known = False
            self.pairs[last, token] = known
        return known

    def _arc(self, number: int, byte: int) -> None:
        """Make the arc of a state for a byte: the next state and the tokens it emits."""
        live, closed = [], None
        for owed, last, part in self.states[number]:
            part += bytes((byte,))
            if part in self.prefixes:
                live.append((owed, last, part))
            token = self.ranks.get(part)
            if closed is None and token is not None and self.may_follow(last, token):
                closed = (owed + (token,), token, b"")
        if closed:
            live.append(closed)
        if not live:
            raise ValueError("the ranks do not cover every byte")
        first, common = live[0][0], 0
        while common < len(first) and all(len(owed) > common and owed[common] == first[common] for owed, _, _ in live):
            common += 1
        state = tuple((owed[common:], last, part) for owed, last, part in live)
        following = self.numbers.setdefault(state, len(self.states))
        if following == len(self.states):
            self.states.append(state)
            if following == len(self.ends):
                self.ends = np.pad(self.ends, (0, following), constant_values=-1)
        self.arcs.add(number << 8 | byte, following, self._output(first[:common]))

    def _end(self, number: int) -> None:
        """What a state still owes at the end: the tokens of the configuration that has just closed one."""
        for owed, _, part in self.states[number]:
            if not part:
                self.ends[number] = self._output(owed)
                return
        raise ValueError("the ranks do not cover every byte")

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, as offsets and flat ids: all pieces move on by one byte at a time.

        A piece that is a token is that token, as the public library has it.
        """
        if len(self.states) > (self.most_states or MOST_STATES):
            self._reset()
        whole = np.array([self.ranks.get(piece, -1) for piece in pieces], np.int64)
        sizes = np.array([len(piece) for piece in pieces], np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(pieces), np.uint8)
        order = np.flatnonzero(whole < 0)
        order = order[np.argsort(-sizes[order], kind="stable")]
        sizes, starts = sizes[order], starts[order]
        state = np.zeros(len(order), np.int64)
        who, what = [], []
        for step in range(int(sizes[0]) if len(order) else 0):
            n = np.searchsorted(-sizes, -step)  # pieces with more than `step` bytes come first
            keys = state[:n] << 8 | data[starts[:n] + step]
            slots = self.arcs.find(keys)
            missing = np.flatnonzero(self.arcs.keys[slots] < 0)
            if len(missing):
                for key in np.unique(keys[missing]).tolist():
                    self._arc(key >> 8, key & 255)
                slots = self.arcs.find(keys)
            emitted, following = self.arcs.emits[slots], self.arcs.next[slots]
            speak = np.flatnonzero(emitted)
            who.append(order[speak])
            what.append(emitted[speak])
            state[:n] = following
        for number in np.unique(state[self.ends[state] < 0]).tolist():
            self._end(number)
        who.append(order)
        what.append(self.ends[state])
        owner = np.concatenate(who)
        turn = np.argsort(owner, kind="stable")
        out_sizes = np.array([len(x) for x in self.outputs], np.int64)
        out_offsets = np.concatenate([[0], np.cumsum(out_sizes)])
        out_ids = np.array([token for x in self.outputs for token in x], np.uint32)
        said = np.concatenate(what)[turn]
        _, ids = text.gather(out_offsets, out_ids, said)
        counts = np.bincount(owner[turn], weights=out_sizes[said], minlength=len(pieces)).astype(np.int64) + (whole >= 0)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(offsets[-1], np.uint32)
        single = np.zeros(offsets[-1], bool)
        single[offsets[:-1][whole >= 0]] = True
        flat[single] = whole[whole >= 0]
        flat[~single] = ids
        return offsets, flat


class Merges:
    """Token ids of many short pieces, as Transducer gives them: each merges its lowest rank, leftmost first, all pieces at once.

    For pieces that hardly come twice, as words of an open vocabulary do: there is no state to make for each.
    """

    #: Longer pieces go through the transducer; places of one table of pieces.
    LONGEST, PLACES = 48, 1 << 20
    NEVER = np.int64(1) << 40

    def __init__(self, machine: Transducer):
        self.machine = machine
        ranks = machine.ranks
        pairs = [(left << 32 | right, rank) for token, rank in ranks.items() for n in range(1, len(token)) if (left := ranks.get(token[:n], -1)) >= 0 and (right := ranks.get(token[n:], -1)) >= 0]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.made = np.append(table[:, 0], np.iinfo(np.int64).max), np.append(table[:, 1], self.NEVER)
        self.bytes = np.array([ranks.get(bytes((byte,)), -1) for byte in range(256)], np.int64)
        # What two bytes make; nearly all pairs looked up are of bytes.
        both = np.arange(1 << 16)
        self.of_bytes = self._made(self.bytes[both >> 8], self.bytes[both & 255])

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair makes; NEVER where it makes none or a place is empty (-1)."""
        keys = left << 32 | np.maximum(right, 0)
        at = np.searchsorted(self.keys, keys)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.made[at], self.NEVER)

    def _merge(self, ids: np.ndarray, due: np.ndarray) -> None:
        """Merge each row of ids in place; -1 at places that are merged or beyond a piece. due: what each place makes with the next one.

        Nothing is moved: a place knows the places before and after it that are left.
        """
        n, width = ids.shape
        flat = np.full(n * width + 1, -1, np.int64)  # one place more, for none
        flat[:-1] = ids.reshape(-1)
        place = np.arange(n * width)
        after, before = place + 1, place - 1
        after[width - 1 :: width], before[::width] = n * width, n * width
        after, before = np.append(after, n * width), np.append(before, n * width)
        due = np.concatenate([due, np.full((n, 1), self.NEVER)], axis=1)
        rows = np.arange(n)
        while len(rows):
            here = due if len(rows) == n else due[rows]
            at = here.argmin(1)
            best = here[np.arange(len(rows)), at]
            if not (go := best < self.NEVER).all():
                rows, at, best = rows[go], at[go], best[go]
            left = rows * width + at
            gone = after[left]
            right = after[gone]
            flat[left], flat[gone] = best, -1
            after[left], before[right] = right, left
            wide = due.reshape(-1)
            wide[gone] = self.NEVER
            wide[left] = self._made(best, flat[right])
            back = before[left]
            some = np.flatnonzero(back < n * width)
            wide[back[some]] = self._made(flat[back[some]], best[some])
        ids[:] = flat[:-1].reshape(n, width)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As Transducer.encode, which also has the pieces where the ranks do not cover every byte."""
        if (self.bytes < 0).any():
            return self.machine.encode(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = np.fromiter((self.machine.ranks.get(piece, -1) for piece in pieces), np.int64, len(pieces))
        starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(pieces), np.uint8)
        counts = np.where(whole >= 0, 1, 0)
        found = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        short = np.flatnonzero((whole < 0) & (sizes > 0) & (sizes <= self.LONGEST))
        short = short[np.argsort(sizes[short], kind="stable")]
        while len(short):
            # Pieces of like size, so that few places are empty.
            first = int(sizes[short[0]])
            n = int(np.searchsorted(sizes[short], first + max(2, first // 4), "right"))
            part, short = short[: min(n, self.PLACES // first)], short[min(n, self.PLACES // first) :]
            place = np.arange(max(2, int(sizes[part[-1]])))
            real = place < sizes[part][:, None]
            letters = data[np.minimum(starts[part][:, None] + place, len(data) - 1)]
            ids = np.where(real, self.bytes[letters], -1)
            self._merge(ids, np.where(real[:, 1:], self.of_bytes[letters[:, :-1].astype(np.int64) << 8 | letters[:, 1:]], self.NEVER))
            left = ids >= 0
            counts[part] = left.sum(1)
            found.append((np.repeat(part, counts[part]), ids[left]))
        if len(long := np.flatnonzero((whole < 0) & (sizes > self.LONGEST))):
            offsets, ids = self.machine.encode([pieces[i] for i in long.tolist()])
            counts[long] = np.diff(offsets)
            found.append((np.repeat(long, counts[long]), ids.astype(np.int64)))
        owner = np.concatenate([o for o, _ in found])
        return np.append(0, np.cumsum(counts)), np.concatenate([i for _, i in found])[np.argsort(owner, kind="stable")].astype(np.uint32)


class Encoder:
    """Ids of whole texts: each match of the pattern separately.

    Where a text has no two white characters in a row, no match of the public pattern reaches
    over the start of a space, so the parts from space to space are encoded once in each batch.
    Other texts are matched as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.find = regex.compile(pattern).findall

    def encode(self, values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts and their ids, one after the other."""
        parts: dict[str, int] = {}
        numbered = _numbered(parts)
        sequence, counts = [], []
        for value in values:
            value = value or ""
            whole = "\0" in value or TWO_WHITE.search(value)
            split = [value] if whole else value.replace(" ", "\0 ").split("\0")
            sequence.append(np.fromiter(map(numbered, split), np.int64, len(split)))
            counts.append(len(split))
        pieces: dict[str, int] = {}
        number = _numbered(pieces)
        matched, matches = [], []
        for part in parts:
            found = [part] if part[1:].isalpha() and part[0] == " " else self.find(part)
            matched += map(number, found)
            matches.append(len(found))
        piece_offsets, piece_ids = self.machine.encode([piece.encode() for piece in pieces])
        part_offsets, part_ids = text.nested(matches, np.array(matched, np.int64), piece_offsets, piece_ids)
        return text.nested(counts, np.concatenate([*sequence, np.zeros(0, np.int64)]), part_offsets, part_ids)


def _numbered(known: dict[str, int]) -> Callable[[str], int]:
    """Numbers for keys in the order they are met."""

    def number(key: str) -> int:
        found = known.get(key)
        if found is None:
            found = known[key] = len(known)
        return found

    return number


def utf8_table() -> np.ndarray:
    """The state machine of UTF-8, (state, byte) to state: 0 between characters, 1 to 3 so many bytes to come.

    4 to 7 are places after E0, ED, F0 and F4, where fewer second bytes are allowed; 8 is wrong.
    """
    table = np.full((9, 256), 8, np.uint8)
    table[0, :0x80] = 0
    for first, stop, state in ((0xC2, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF5, 3)):
        table[0, first:stop] = state
    for byte, state, first, stop, then in ((0xE0, 4, 0xA0, 0xC0, 1), (0xED, 5, 0x80, 0xA0, 1), (0xF0, 6, 0x90, 0xC0, 2), (0xF4, 7, 0x80, 0x90, 2)):
        table[0, byte] = state
        table[state, first:stop] = then
    for state in (1, 2, 3):
        table[state, 0x80:0xC0] = state - 1
    return table


class Utf8Stream:
    """Incremental UTF-8: bytes in, text out; an unfinished character waits for the next bytes.

    The state is the machine's and the unfinished character's bytes, three at most. Characters do not
    overlap, so the machine need only run from the last byte that can begin one: what lies before is
    finished or wrong whatever follows. Wrong bytes become U+FFFD.
    """

    TABLE = utf8_table()

    def __init__(self) -> None:
        self.waiting = b""

    def _unfinished(self, data: bytes) -> int:
        """Bytes at the end in which the machine is on its way through a character."""
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                state = 0
                for byte in data[-back:]:
                    state = self.TABLE[state, byte]
                return back if 0 < state < 8 else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data) - self._unfinished(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Bytes or text of ids, some thousands at a time."""

    def __init__(self, ranks: dict[bytes, int], step: int = 1 << 16):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.offsets = np.concatenate([[0], np.cumsum([len(token) for token in tokens])])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.step = step

    def parts(self, ids: np.ndarray) -> Iterator[bytes]:
        for start in range(0, len(ids), self.step):
            yield text.gather(self.offsets, self.data, ids[start : start + self.step].astype(np.int64))[1].tobytes()

    def text(self, parts: Iterable[bytes]) -> Iterator[str]:
        stream = Utf8Stream()
        for part in parts:
            yield stream.feed(part)
        yield stream.finish()


#: Made once in each worker process and used by all its tasks, by the rank file and the pattern.
_MACHINES: dict[tuple[bytes, str], tuple[Encoder, Decoder]] = {}


def _machines(ranks_file: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    key = hashlib.sha256(ranks_file).digest(), pattern
    if key not in _MACHINES:
        _MACHINES.clear()
        ranks = parse_ranks(ranks_file)
        _MACHINES[key] = Encoder(ranks, pattern), Decoder(ranks)
    return _MACHINES[key]


def digests(docs: DataFrame, ranks_file: bytes, pattern: str, column: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, the last over the bytes that decoding the ids gives."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks_file)

    def step(texts: pa.Array) -> list[pa.Array]:
        encoder, decoder = _machines(shared.value, pattern)
        offsets, ids = encoder.encode(texts.to_pylist())
        ids_hex, back_hex = [], []
        for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            back = hashlib.sha256()
            for part in decoder.text(decoder.parts(ids[start:stop])):
                back.update(part.encode())
            ids_hex.append(hashlib.sha256(ids[start:stop].astype("<u4").tobytes()).hexdigest())
            back_hex.append(back.hexdigest())
        return [pa.array(np.diff(offsets), pa.int64()), pa.array(ids_hex, pa.string()), pa.array(back_hex, pa.string())]

    return text.map_texts(docs, column, ADDED, step)


def encode(docs: DataFrame, ranks_file: bytes, pattern: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of each text as an array of integers."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks_file)

    def step(texts: pa.Array) -> list[pa.Array]:
        encoder, _ = _machines(shared.value, pattern)
        offsets, flat = encoder.encode(texts.to_pylist())
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))]

    return text.map_texts(docs, column, f"{ids} array<int>", step)


def round_trip(docs: DataFrame, ranks_file: bytes, pattern: str, column: str = "text", ids: str = "ids", same: str = "round_trip") -> DataFrame:
    """docs with the ids of each text and whether decoding them as a stream gives the text again; a null one counts as empty.

    One pass: the machines are held once by a task, which drops them at its end, as the worker goes on
    to other stages; and no decoded text leaves it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks_file)
    held: list[Encoder | Decoder] = []  # each task has a copy of its own

    def step(texts: pa.Array) -> list[pa.Array]:
        if not held:
            ranks = parse_ranks(shared.value)
            held.extend((Encoder(ranks, pattern), Decoder(ranks)))
        encoder, decoder = held
        values = texts.to_pylist()
        offsets, flat = encoder.encode(values)
        equal = []
        for value, start, stop in zip(values, offsets[:-1].tolist(), offsets[1:].tolist()):
            equal.append("".join(decoder.text(decoder.parts(flat[start:stop]))) == (value or ""))
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32))), pa.array(equal)]

    def end() -> None:
        held.clear()
        gc.collect()

    return text.map_texts(docs, column, f"{ids} array<int>, {same} boolean", step, end=end)


def decode(coded: DataFrame, ranks_file: bytes, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """coded with the text of each row's ids, decoded as a stream; null ids give the empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(ranks_file)
    kept = coded.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(parse_ranks(shared.value))
        for batch in batches:
            at = batch.schema.names.index(ids)
            values = []
            for row in batch.column(at):
                numbers = np.asarray(row.values if row.is_valid else [], np.int64)
                values.append("".join(decoder.text(decoder.parts(numbers))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], names=[*batch.schema.names, column])

    return kept.mapInArrow(run, text.wider(kept, f"{column} string"))


def read_ranks(path: str) -> bytes:
    """A rank file's content, under a megabyte; read by the driver, which has the public files."""
    with open(path, "rb") as file:
        return file.read()
