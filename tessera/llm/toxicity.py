"""Toxicity by compression distance.

Two zstandard dictionaries are trained, each by zstandard's own trainer: the ordinary one on windows of ordinary text,
the toxic one on segments of toxic text, the stretches made of byte strings that far more toxic than ordinary texts
hold. A text is cut into windows at spaces, all of it, and each window is compressed twice: with the ordinary content
alone, and with the toxic content beside it, nearest to the text. What the second saves is about zero on ordinary
windows, as both know those, and several bytes where toxic wording stands. A logistic curve, fitted on labelled texts
that the dictionaries have not seen, turns the savings of all windows into a score.

The toxic dictionary alone against the ordinary one alone is the plainer comparison; ordinary windows then differ by
several bytes either way, which hides what a toxic word saves (README has the figures).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, forget

#: Labelled rows that training looks at, chosen by a hash of the id: at most about this many of either label.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 1500, 2400
#: The dictionaries see this many passages of so many characters of a sampled text at most, from all over the text.
PASSAGES, PASSAGE_CHARS = 10, 2000
#: Parts of the sample that the curve is fitted over in turn.
FOLDS = 3
#: Bytes of a window, compression level, sizes of the dictionaries, and the trainer's segment and string lengths.
WINDOW, LEVEL, ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, MER = 40, 3, 24_000, 2_048, 16, 6
#: Lengths of the byte strings that are counted. One counts as toxic where this many toxic texts hold it, and this many
#: times the share of ordinary texts. LEAST_TEXTS: at least, and as a share of the sampled toxic texts, which with
#: SAMPLE_TOXIC is about 30 texts however large the corpus is; fewer would let in what a group of near copies shares.
MERS, LEAST_TEXTS, LEAST_RATIO = (5, 7, 9), (6, 0.02), 15.0
#: Savings in bytes from which windows are counted.
FROM = (2, 4, 6, 8)


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The whole text, A-Z lower-cased, cut at the first space after ``size`` bytes (without one, at twice as many)."""
    b = (text or "").encode().lower()
    out, i, n = [], 0, len(b)
    while i < n:
        j = b.find(b" ", i + size, i + 2 * size) if i + size < n else n
        if j < 0:
            j = min(n, i + 2 * size)
        out.append(b[i:j])
        i = j
    return out


def _mers(b: bytes, length: int) -> np.ndarray:
    """A number for the byte string of ``length`` at each place; up to eight bytes it is the string itself."""
    a = np.frombuffer(b, np.uint8).astype(np.uint64)
    n = len(a) - length + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(length if n > 0 else 0):
        h = (h << np.uint64(8) | h >> np.uint64(56)) ^ a[i : i + n]
    return h


def _in_texts(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings and the number of texts that hold each."""
    parts = [np.unique(_mers(t, length)) for t in texts]
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.array([], np.uint64), np.array([], np.int64))


def toxic_segments(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Every stretch of the toxic texts that is covered by strings which set them apart, with a byte on either side.
    Equal texts count once."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    n_t, n_o = max(1, len(toxic)), max(1, len(ordinary))
    covers = [np.zeros(len(b) + 1, np.int8) for b in toxic]
    for length in MERS:
        (ut, ct), (uo, co) = _in_texts(toxic, length), _in_texts(ordinary, length)
        at = np.searchsorted(uo, ut)
        at[at == len(uo)] = 0
        other = np.where(uo[at] == ut, co[at], 0) if len(uo) else np.zeros(len(ut))
        good = ut[(ct >= max(LEAST_TEXTS[0], LEAST_TEXTS[1] * n_t)) & (ct / n_t > LEAST_RATIO * (other + 1) / n_o)]
        for b, cover in zip(toxic, covers, strict=True):
            hit = np.isin(_mers(b, length), good)
            for i in range(length if hit.any() else 0):
                cover[i : i + len(hit)] |= hit
    found: list[bytes] = []
    for b, cover in zip(toxic, covers, strict=True):
        ends = np.flatnonzero(np.diff(np.r_[0, cover]))
        found += [b[max(0, i - 1) : j + 1] for i, j in zip(ends[::2], ends[1::2], strict=True)]
    return found


def trained(samples: list[bytes], size: int, **how) -> bytes:
    """The last ``size`` bytes of what zstandard's trainer picks from the samples; empty where it finds too few."""
    try:
        return zstandard.train_dictionary(size + 8192, samples, **how).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b""


class CompressionDistance:
    """Dictionaries as bytes and the fitted curve; compressors are made where they are used."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.weights, self.shift, self.scale = np.zeros(1), 0.0, 1.0

    @classmethod
    def constant(cls, score: float) -> CompressionDistance:
        """What gives every text the same score."""
        made = cls(b"", b"")
        made.weights = np.array([score])
        return made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compress"}

    @cached_property
    def _compress(self):
        def made(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        return made(self.ordinary), made(self.ordinary + self.toxic)

    def features(self, text: str | None) -> list[float]:
        """Of the bytes saved in each window: largest, mean of the three largest, mean, mean gain, share and logarithm of
        the number of windows from each of FROM on, and logarithm of the number of windows."""
        plain, marked = self._compress
        saved = np.array([len(plain(w)) - len(marked(w)) for w in windows(text)] or [0])
        top, n = -np.sort(-saved)[:3], len(saved)
        over = [int((saved >= least).sum()) for least in FROM]
        whole = [min(float(top[0]), 16.0), min(float(top.mean()), 16.0), float(saved.mean()), float(np.maximum(saved, 0).mean())]
        return [*whole, *(k / n for k in over), *(float(np.log1p(k)) for k in over), float(np.log(n))]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> None:
        """Logistic curve by Newton steps."""
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.shift) / self.scale]
        b = np.zeros(z.shape[1])
        penalty = np.r_[1e-6, np.full(z.shape[1] - 1, ridge)]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * b)
            b += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = b

    def score(self, text: str | None) -> float:
        if len(self.weights) == 1:
            return float(self.weights[0])
        z = (np.array(self.features(text)) - self.shift) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30))))


def dictionaries(rows: list[dict]) -> CompressionDistance:
    """From rows with t (list of passages) and y (label)."""
    toxic, plain = (["".join(r["t"]).encode().lower() for r in rows if r["y"] == y] for y in (1, 0))
    ordinary = trained([w for t in plain for w in windows(t.decode(errors="ignore"), 256)], ORDINARY_BYTES)
    return CompressionDistance(ordinary, trained(toxic_segments(toxic, plain), TOXIC_BYTES, k=SEGMENT, d=MER))


def _passages(text, seed):
    """PASSAGES passages of a text, by a hash of their places, in their order."""
    places = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / PASSAGE_CHARS)), lambda i: F.struct(F.xxhash64(seed, i).alias("h"), i.alias("i")))
    chosen = F.sort_array(F.transform(F.slice(F.sort_array(places), 1, PASSAGES), lambda p: p["i"]))
    return F.transform(chosen, lambda i: F.substring(text, (i * PASSAGE_CHARS + 1).cast("int"), F.lit(PASSAGE_CHARS)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> CompressionDistance:
    """``labels``: ids and 0/1 labels; other labels, null ids and null or empty texts are left out.

    The labels are sampled before they meet the texts: about SAMPLE_TOXIC + SAMPLE_ORDINARY rows by a hash of the id, a
    bound that lets them be broadcast, so the texts are not shuffled. An id that stands in several labels counts as its
    largest, one that stands in several documents as one of them. Texts of any length take part: a task for each part of
    the sample trains the dictionaries of the other FOLDS - 1 parts on passages, one more those of all, and the whole
    texts are measured with the dictionaries that have not seen them. The driver gets the dictionaries and the
    measurements, a row for each sampled text. The curve is weighted to the labels' frequencies; the dictionaries in use
    are those of the whole sample. Without labels of both kinds the score is the share of toxic ones.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{toxic}`").cast("int").alias("y")).filter("y in (0, 1) and id is not null")
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return CompressionDistance.constant(1.0 if 1 in sizes else 0.0)
    spread = 1 << 30
    limit = F.when(F.col("y") == 1, int(min(1.0, SAMPLE_TOXIC / sizes[1]) * spread)).otherwise(int(min(1.0, SAMPLE_ORDINARY / sizes[0]) * spread))
    sample = known.filter(F.pmod(F.xxhash64("id"), F.lit(spread)) < limit).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).filter(F.length("t") > 0)
    joined = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("y").alias("y"), F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = cut(joined.select("t", "y", F.pmod(F.xxhash64("t"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    models = F.explode(F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda m: m != F.col("fold"))).alias("model")  # FOLDS: of the whole sample

    def fit(seen: pa.Table) -> pa.Table:
        known = sorted(seen.select(["y", "t"]).to_pylist(), key=lambda r: (r["y"], r["t"]))
        made = dictionaries(known)
        return pa.table({"model": pa.array(seen.column("model").to_pylist()[:1], pa.int32()), "ordinary": [made.ordinary], "toxic": [made.toxic]})

    seen = rows.select(_passages(F.col("t"), F.xxhash64("t")).alias("t"), "y", "fold").select("t", "y", models)
    found = {r["model"]: r for r in seen.groupBy("model").applyInArrow(fit, "model int, ordinary binary, toxic binary").collect()}
    by_fold = [CompressionDistance(*((bytes(found[m]["ordinary"]), bytes(found[m]["toxic"])) if m in found else (b"", b""))) for m in range(FOLDS + 1)]
    own = rows.sparkSession.sparkContext.broadcast(by_fold[:FOLDS])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [own.value[fold].features(t.as_py()) for t, fold in zip(batch.column(0), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.list_(pa.float64()))], names=["y", "x"])

    cores = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    measured = rows.repartition(4 * cores).mapInArrow(measure, "y int, x array<double>").toArrow()
    forget(rows)
    y, x = np.array(measured.column("y").to_pylist()), np.array(measured.column("x").to_pylist())
    if len(set(y.tolist())) < 2:  # no texts for one of the labels
        return CompressionDistance.constant(sizes[1] / (sizes[0] + sizes[1]))
    order = np.lexsort((*x.T, y))
    y, x = y[order], x[order]
    made = by_fold[FOLDS]
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    made.fit(x, y, weight * len(y) / weight.sum())
    return made


def score_texts(docs: DataFrame, model: CompressionDistance, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns and ``name``, the score (0 to 1) of each whole text; null counts as empty. Rows are independent."""
    named = [f"k{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, named, strict=True)], F.col(f"`{text}`").alias("t"))
    kinds = dict(df.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            made = [own.score(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.float64())], names=[*named, "o_s"])

    made = df.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in named), "o_s double"]))
    return made.select(*[F.col(k).alias(c) for c, k in zip(keep, named, strict=True)], F.col("o_s").alias(name))
