"""Repetition inside a text by a suffix array over its words.

Suffixes of all texts of a batch are ranked together by prefix doubling, where a suffix never
reaches over the end of its text. Neighbours in the order of suffixes give the longest common
prefixes; these intervals are the maximal repeated runs of words. Their spans are united, and
a text is kept while the covered share of its words and its longest repeat stay within limits.

A null text counts as empty; an empty text has no words, no repeats, and fails the base rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from veritally.llm import text

SYMBOLS = frozenset(b"#*$%&|<>")
ADDED = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, covered_words bigint, longest_repeat bigint"
)


@dataclass(frozen=True)
class Limits:
    """Repeats of at least `shortest` words count; a text is refused beyond the share or the length."""

    shortest: int = 4
    most_covered: float = 0.4
    longest: int = 100


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys from 0, equal keys alike."""
    order = np.argsort(keys)
    ordered = keys[order]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    return ranks


def _in_company(ranks: np.ndarray) -> np.ndarray:
    """Which items share their rank with another item."""
    return (np.bincount(ranks) > 1)[ranks] if len(ranks) else np.zeros(0, bool)


def suffix_levels(owner: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ranks of the runs of 1, 2, 4, ... words that are repeated within a text.

    Each level holds the positions that still share such a run with another one, ascending, and
    the run's rank; positions drop out once their run is unique or passes the end of the text.
    """
    at = np.arange(len(ids))
    ranks = _dense(owner * (ids.max(initial=0) + 1) + ids)
    levels, length = [], 1
    while True:
        keep = _in_company(ranks)
        at, ranks = at[keep], ranks[keep]
        if not len(at):
            return levels
        levels.append((at, ranks))
        # The second half must be repeated as well, or the whole is not.
        second = np.searchsorted(at, at + length)
        second[second == len(at)] = 0
        whole = (at[second] == at + length) & (at + 2 * length <= ends[at])
        keys = ranks[whole] * (ranks.max() + 1) + ranks[second[whole]]
        at, ranks, length = at[whole], _dense(keys), 2 * length


def longest_matches(levels: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """For each position, the longest run from it that its text repeats elsewhere.

    The order of suffixes follows from the levels: ranks of the longest runs first decide among
    positions that agree on the shorter ones. The longest common prefix of two neighbours is
    found by halving steps over the levels.
    """
    out = np.zeros(n, np.int64)
    if not levels:
        return out
    at = levels[0][0]
    dense = np.full((len(levels), n), -1, np.int64)
    for k, (where, ranks) in enumerate(levels):
        dense[k, where] = ranks

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + size, b + size
            inside = (x < n) & (y < n)
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            size += np.where(inside & (dense[k, x] >= 0) & (dense[k, x] == dense[k, y]), 1 << k, 0)
        return size

    order = suffix_order(levels, dense, at, n)
    shared = common(order[:-1], order[1:])
    np.maximum.at(out, order[:-1], shared)
    np.maximum.at(out, order[1:], shared)
    return out


def suffix_order(levels, dense: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Positions with a repeated first word, in the order of their suffixes.

    Refined from the shortest runs on: within equal runs of 2^k words, the rank of the run that
    follows decides; nothing repeated there comes first, as there is nothing left to share.
    """
    rank = np.full(n, -1, np.int64)
    rank[at] = dense[0, at]
    order = at[np.argsort(rank[at], kind="stable")]
    for k in range(len(levels)):
        step = 1 << k
        ahead = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        keys = rank[at] * (rank.max() + 2) + ahead + 1
        sort = np.argsort(keys, kind="stable")
        ordered = keys[sort]
        order = at[sort]
        rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        if rank[order[-1]] == len(order) - 1:
            break
    return order


def measure(texts: pa.Array, limits: Limits) -> list[pa.Array]:
    """The columns of ADDED for each text."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    n_texts = len(texts)
    offsets, ids, distinct = text.words(texts, lower=False)
    owner, n = text.owners(offsets), len(ids)
    n_words = np.diff(offsets)
    sizes = pc.utf8_length(distinct).to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, np.int64)
    word_chars = np.bincount(owner, weights=sizes[ids] if n else None, minlength=n_texts)
    symbols = _symbols(texts)
    ends = np.repeat(offsets[1:], n_words)
    levels = suffix_levels(owner, ids, ends)
    # Windows of three words: their first two and their last two words, each repeated as a pair.
    triple = np.zeros(n + 1, np.int64)
    if len(levels) > 1:
        at, ranks = levels[1]
        second = np.searchsorted(at, at + 1)
        second[second == len(at)] = 0
        whole = (at[second] == at + 1) & (at + 3 <= ends[at])
        again = at[whole][_in_company(_dense(ranks[whole] * (ranks.max() + 1) + ranks[second[whole]]))]
        np.add.at(triple, again, 1)
        np.add.at(triple, again + 3, -1)
    n_repeat = np.bincount(owner, weights=np.cumsum(triple)[:n] > 0, minlength=n_texts)
    longest = longest_matches(levels, n)
    longest = np.minimum(longest, ends - np.arange(n))
    spans = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(longest >= limits.shortest)
    np.add.at(spans, starts, 1)
    np.add.at(spans, starts + longest[starts], -1)
    covered = np.bincount(owner, weights=np.cumsum(spans)[:n] > 0, minlength=n_texts)
    longest_of = np.zeros(n_texts, np.int64)
    np.maximum.at(longest_of, owner[starts], longest[starts])
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    kept = ~failed & (covered <= limits.most_covered * n_words) & (longest_of <= limits.longest)
    whole = (n_words, word_chars, symbols, _repeated_lines(texts), n_repeat)
    return [
        *(pa.array(np.asarray(x).astype(np.int64)) for x in whole),
        pa.array(failed),
        pa.array(kept),
        pa.array(covered.astype(np.int64)),
        pa.array(longest_of),
    ]


def _symbols(texts: pa.Array) -> np.ndarray:
    offsets, data = text.raw(texts)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    counted = np.concatenate([[0], np.cumsum(is_symbol[data], dtype=np.int64)])
    return counted[offsets[1:]] - counted[offsets[:-1]]


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lines = pc.split_pattern(texts, "\n")
    offsets = np.asarray(lines.offsets).astype(np.int64)
    offsets -= offsets[0]
    flat = lines.flatten()
    trimmed = pc.binary_length(pc.ascii_trim(flat, " \t\n\v\f\r"))
    real = pc.greater(trimmed, 0).to_numpy(zero_copy_only=False)
    owner = text.owners(offsets)[real]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.sort(owner * (ids.max(initial=0) + 1) + ids)
    later = pairs[1:][pairs[1:] == pairs[:-1]] // (ids.max(initial=0) + 1)
    return np.bincount(later, minlength=len(texts))


def judge(docs: DataFrame, limits: Limits = Limits(), column: str = "text") -> DataFrame:
    """docs with word, symbol and repetition counts, the base rule, and the verdict of the limits."""
    return text.map_texts(docs, column, ADDED, lambda texts: measure(texts, limits))
