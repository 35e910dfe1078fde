"""Language identification with language-bitmask n-gram filters.

Training takes the character n-grams that stand in several different texts of a language (in one, where there is but
one), over a bounded sample of labelled texts. They are stored in a bit-sliced Bloom filter: a row of machine words for each
slot, one bit of it for each language, so the few probes of an n-gram return all languages that hold it at once. The
cluster sets the bits, so the driver sees the filter and no n-grams. A text's n-grams give a popcount for each language; the count that chance alone would give is taken
off, and the largest remainder decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: n-gram lengths, slots of the filter as a power of two, probes.
LENGTHS, SLOT_BITS, PROBES = (3,), 20, 3
#: Texts that must hold an n-gram: so many, or this share of the sampled texts of the language, whichever is more. As the
#: sample is bounded, so is the number: 80 texts at any size. It keeps out what passages in a foreign language bring in.
LEAST_TEXTS, LEAST_SHARE = 2, 0.02
#: Different texts of a language that training looks at.
SAMPLE_ROWS = 4000
_MIX = np.uint64(0x9E3779B97F4A7C15)
UNDETERMINED = "und"
#: Bytes that hold each bit.
_HOLDS = [np.flatnonzero(np.arange(256) >> k & 1) for k in range(8)]


def _fold() -> np.ndarray:
    """Code point to folded code point; 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Folded letters; each run of other characters is a single 1, and so are both ends."""
    if not _TABLE:
        _TABLE.append(_fold())
    c = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    c = np.concatenate([[0], c, [0]]).astype(np.uint64)
    keep = np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]
    c = c[keep]
    c[c == 0] = 1
    return c


def ngrams(c: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams of each length that hold a letter."""
    out, gap = [], c == 1
    for n in LENGTHS:
        if len(c) < n:
            out.append(np.array([], np.uint64))
            continue
        h, bare = np.full(len(c) - n + 1, n, np.uint64), np.ones(len(c) - n + 1, bool)
        for i in range(n):
            h = (h ^ c[i : len(c) - n + 1 + i]) * _MIX
            h ^= h >> np.uint64(29)
            bare &= gap[i : len(c) - n + 1 + i]
        out.append(h[~bare])
    return out


def text_ngrams(docs: DataFrame, text: str, k: str) -> DataFrame:
    """k (place of the language), h and c: n-grams and the number of texts that hold them, summed over some texts."""
    df = docs.select(F.col(f"`{k}`").alias("k"), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[int, list[np.ndarray]] = {}
            for at, (k, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True), 1):
                parts.setdefault(k, []).append(np.unique(np.concatenate(ngrams(letters(text.as_py())))))
                if at % 256 and at < len(batch):
                    continue
                for k, found in parts.items():
                    h, c = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.view("<i8")), pa.array(c, pa.int64())], names=["k", "h", "c"])
                parts.clear()

    return df.mapInArrow(run, "k int, h bigint, c bigint")


def slots_of(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The slot of each n-gram under every probe."""
    for _ in range(PROBES):
        h = (h ^ (h >> np.uint64(31))) * _MIX
        yield (h >> np.uint64(64 - bits)).astype(np.int64)


class LanguageFilter:
    """``words``: a row of machine words for each slot; bit k of a row belongs to language k."""

    def __init__(self, languages: list[str], bits: int = SLOT_BITS):
        self.languages, self.bits = languages, bits
        self.dtype = np.dtype(np.uint8 if len(languages) <= 8 else np.uint64)
        self.width = 8 * self.dtype.itemsize
        self.words = np.zeros((1 << bits, max(1, -(-len(languages) // self.width))), self.dtype)

    def put(self, slots: np.ndarray, word: np.ndarray, mask: np.ndarray) -> None:
        """Set the bits ``mask`` of the given words; a word is named once."""
        self.words[slots, word] |= mask.view("<u8").astype(self.dtype)

    def _bit(self, words: np.ndarray, k: int) -> np.ndarray:
        return words[:, k // self.width] >> self.dtype.type(k % self.width) & self.dtype.type(1)

    def seal(self) -> LanguageFilter:
        """Share of unrelated n-grams that a language's bit answers for."""
        self.chance = np.array([self._bit(self.words, k).mean() ** PROBES for k in range(len(self.languages))])
        return self

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram, the bit mask of the languages that hold it."""
        out = None
        for slots in slots_of(h, self.bits):
            out = self.words[slots] if out is None else out & self.words[slots]
        return out

    def shares(self, h: np.ndarray) -> np.ndarray:
        """Share of the n-grams that each language holds, corrected for false positives."""
        masks = self.masks(h)
        if self.width == 8:
            by_mask = np.bincount(masks[:, 0], minlength=256)
            hits = np.array([by_mask[_HOLDS[k]].sum() for k in range(len(self.languages))])
        else:
            hits = np.array([self._bit(masks, k).sum() for k in range(len(self.languages))])
        return np.clip((hits / len(h) - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)

    def decide(self, text: str | None) -> tuple[str, float]:
        h = np.concatenate(ngrams(letters(text))) if text else ()
        if not len(h) or not self.languages:
            return UNDETERMINED, 0.0
        s = self.shares(h)
        k = int(np.argmax(s))
        others = np.delete(s, k)
        rest = float(others.max()) if len(others) else 0.0
        return self.languages[k], float(s[k] / (s[k] + rest)) if s[k] > 0 else 0.0


def train(docs: DataFrame, text: str = "text", lang: str = "lang", least_texts: int = LEAST_TEXTS, least_share: float = LEAST_SHARE, sample_rows: int = SAMPLE_ROWS) -> LanguageFilter:
    """Fit on about ``sample_rows`` different texts of each language at most, chosen by a hash of the text; all of them
    where there are fewer. Copies of a text count once. Languages stand in order of their names, so ties go to the
    first; a filter has as many words a slot as the languages need. Null and empty texts and null languages are left
    out; without any, every text is undetermined. The driver sees the names of the languages and the filter."""
    known = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("t")).filter("lang is not null and length(t) > 0")
    sizes = sorted((r[0], r[1]) for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("t"))).collect())
    made = LanguageFilter([name for name, _ in sizes])
    if not sizes:
        return made.seal()
    spread = 1 << 30
    rates = [(name, k, int(min(1.0, sample_rows / max(1, n)) * spread), min(n, max(least_texts, int(least_share * min(n, sample_rows))))) for k, (name, n) in enumerate(sizes)]
    rates = known.sparkSession.createDataFrame(rates, "lang string, k int, rate bigint, least bigint")  # a row for each language
    drawn = known.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("t"), F.lit(spread)) < F.col("rate"))
    once = drawn.groupBy("k", F.xxhash64("t").alias("x")).agg(F.first("t").alias("t"))
    counts = text_ngrams(once, "t", "k").groupBy("k", "h").agg(F.sum("c").alias("c"))
    kept = counts.join(F.broadcast(rates.select("k", "least")), "k").filter(F.col("c") >= F.col("least")).select("k", "h")
    bits, width = made.bits, made.width

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view("<u8")
            for slots in slots_of(h, bits):
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array((k // width).astype(np.int32)), pa.array((np.uint64(1) << (k % width).astype(np.uint64)).view("<i8"))], names=["slot", "word", "mask"])

    filled = kept.mapInArrow(place, "slot bigint, word int, mask bigint").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    made.put(filled.column("slot").to_numpy(), filled.column("word").to_numpy(), filled.column("mask").to_numpy())
    return made.seal()


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (the winner's share against it and the runner-up).

    Null texts and texts without a letter: ``und``, 0. Where no language holds any n-gram the first is returned at 0.
    """
    named = [f"k{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, named, strict=True)], F.col(f"`{text}`").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**SLOT_BITS words, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            made = [own.decide(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=[*named, "o_l", "o_s"])

    schema = T.StructType([*(df.schema[k] for k in named), T.StructField("o_l", T.StringType()), T.StructField("o_s", T.DoubleType())])
    return df.mapInArrow(run, schema).select(*[F.col(k).alias(c) for c, k in zip(keep, named, strict=True)], F.col("o_l").alias("lang_pred"), F.col("o_s").alias("score"))
