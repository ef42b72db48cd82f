"""Language by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams (one to three characters of lower-cased words
between blanks), most frequent first. A document's own ranking is compared to each profile by
out-of-place distance: the sum over its n-grams of how far their ranks differ, and the
profile's length for an n-gram the profile lacks. The nearest profile wins.

Counting for profiles covers all training documents: each task sums n-grams by language, Spark
adds the sums. Only the profiles, some hundred rows for each language, reach the driver.

Ties: n-grams of equal counts rank by their characters, equal distances by the language's name.
A null text and a text without a letter give `und` and score 0, as all do where no language is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm import text

LENGTH = 400
UNKNOWN = "und"
ADDED = "lang_pred string, score double"
#: Code points fit in 21 bits, three of them in a signed 64-bit number.
BITS = 21
#: Stands for a blank in packed n-grams; it is no letter, and not 0, so that sizes differ.
BLANK = 1
#: Entries of a counting table; beyond it keys are sorted instead.
TABLE = 1 << 23
#: Bytes of text counted at once, so that the counting table serves.
STEP = 1 << 20


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner text and code of every n-gram of 1 to 3 characters, and what each code stands for (packed, ascending).

    What is not a letter becomes a blank; runs of blanks count as one, and every text begins
    and ends with one. N-grams of blanks alone, and with a blank inside, are left out.
    """
    joined = pc.utf8_lower(pc.fill_null(texts, ""))
    joined = pc.binary_join_element_wise("\n", joined, "\n", "")
    sizes = pc.utf8_length(joined).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(joined.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.zeros(int(chars.max(initial=0)) + 1, np.int64)
    letters = [char for char in np.flatnonzero(np.bincount(chars, minlength=1)).tolist() if chr(char).isalpha()]
    code[letters] = np.arange(1, len(letters) + 1)
    alphabet = np.array([BLANK, *letters], np.int64)
    chars = code[chars]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 0) | (chars[:-1] != 0) | (owner[1:] != owner[:-1])
    chars, owner = chars[keep], owner[keep]
    many = len(alphabet)
    owners, grams, base = [], [], 0
    for n in (1, 2, 3):
        parts = [chars[i : len(chars) - n + 1 + i] for i in range(n)]
        real = owner[: len(chars) - n + 1] == owner[n - 1 :]
        real &= (parts[0] != 0) | (parts[-1] != 0)
        if n == 3:
            real &= parts[1] != 0
        mixed = parts[0]
        for part in parts[1:]:
            mixed = mixed * many + part
        owners.append(owner[: len(chars) - n + 1][real])
        grams.append(mixed[real] + base)
        base += many**n
    owner, grams = np.concatenate(owners), np.concatenate(grams)
    if base <= TABLE:
        distinct = np.flatnonzero(np.bincount(grams, minlength=base))
        number = np.zeros(base, np.int32)
        number[distinct] = np.arange(len(distinct))
        grams = number[grams]
    else:
        distinct, grams = np.unique(grams, return_inverse=True)
    return owner, grams, _packed(distinct, alphabet)


def _packed(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Code points of n-grams in one number, in the same order as the codes."""
    many = len(alphabet)
    size = 1 + (codes >= many) + (codes >= many + many**2)
    rest = codes - np.where(size > 1, many, 0) - np.where(size > 2, many**2, 0)
    packed = np.zeros(len(codes), np.int64)
    for turn in (3, 2, 1):
        digit = rest // many ** (turn - 1)
        packed = np.where(size >= turn, packed << BITS | alphabet[np.where(size >= turn, digit, 0)], packed)
        rest = np.where(size >= turn, rest - digit * many ** (turn - 1), rest)
    return packed


def _counted(owner: np.ndarray, codes: np.ndarray, owners: int, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct owner and code pairs with counts, in that order."""
    keys = owner * max(1, distinct) + codes
    if owners * distinct <= TABLE:
        counts = np.bincount(keys, minlength=owners * distinct)
        keys = np.flatnonzero(counts)
        counts = counts[keys]
    else:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts, keys = np.diff(np.append(first, len(keys))), keys[first]
    return keys // max(1, distinct), keys % max(1, distinct), counts


def learn(docs: DataFrame, lang: str = "lang", column: str = "text", length: int = LENGTH) -> DataFrame:
    """Profiles: lang, gram (packed), rank from 0. Rows without a language teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.pieces(batches, column):
            coded = batch.column(lang).dictionary_encode()
            owner, codes, packed = _grams(batch.column(column))
            which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            langs, codes, counts = _counted(which[owner], codes, len(coded.dictionary), len(packed))
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(langs)), pa.array(packed[codes]), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"]
            )

    labelled = docs.select(F.col(lang).cast("string").alias(lang), F.col(column)).filter(F.col(lang).isNotNull())
    counts = labelled.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.select("lang", "gram", ranked.alias("rank")).filter(F.col("rank") < length)


@dataclass(frozen=True)
class Profiles:
    """Ranks of n-grams by language: one row per known n-gram, one column per language."""

    langs: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    length: int

    @staticmethod
    def of(rows, length: int = LENGTH) -> Profiles:
        langs = tuple(sorted({row["lang"] for row in rows}))
        grams = np.unique(np.array([row["gram"] for row in rows], np.int64))
        ranks = np.full((len(grams) + 1, len(langs)), -1, np.int64)
        for row in rows:
            ranks[np.searchsorted(grams, row["gram"]), langs.index(row["lang"])] = row["rank"]
        return Profiles(langs, grams, ranks, length)

    def predict(self, texts: pa.Array) -> list[pa.Array]:
        n = len(texts)
        owner, codes, packed = _grams(texts)
        owner, codes, counts = _counted(owner, codes, n, len(packed))
        order = np.lexsort((codes, -counts, owner))
        owner, grams = owner[order], packed[codes[order]]
        starts = np.searchsorted(owner, np.arange(n))
        rank = np.arange(len(owner)) - starts[owner]
        top = rank < self.length
        owner, grams, rank = owner[top], grams[top], rank[top]
        at = np.minimum(np.searchsorted(self.grams, grams), max(0, len(self.grams) - 1))
        row = np.where(self.grams[at] == grams, at, len(self.grams)) if len(self.grams) else np.zeros(len(grams), np.int64)
        total = np.zeros((n, len(self.langs)))
        for k in range(len(self.langs)):
            known = self.ranks[row, k]
            apart = np.where(known >= 0, np.minimum(np.abs(known - rank), self.length), self.length)
            total[:, k] = np.bincount(owner, weights=apart, minlength=n)
        size = np.bincount(owner, minlength=n)
        if not self.langs:
            return [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n))]
        best = np.argmin(total, axis=1)
        score = np.where(size > 0, 1 - total[np.arange(n), best] / np.maximum(1, size * self.length), 0.0)
        names = np.where(size > 0, np.array(self.langs, object)[best], UNKNOWN)
        return [pa.array(names, pa.string()), pa.array(np.clip(score, 0.0, 1.0))]


def predict(docs: DataFrame, profiles: Profiles, column: str = "text") -> DataFrame:
    """docs with lang_pred and score; the profiles are a few kilobytes and travel with the tasks."""
    return text.map_texts(docs, column, ADDED, profiles.predict, STEP)
