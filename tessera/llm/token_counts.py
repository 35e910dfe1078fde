"""Token counts under a unigram vocabulary without building the tokens.

Aho-Corasick enumerates the vocabulary pieces that end at each place of a text; dynamic programming carries the best
score and its piece count. Ties follow the unigram tokenizer: among equal scores the piece that starts first stays, and
a character that is no piece by itself counts as unknown, last in line, at ten below the least score; it falls back to
one piece a byte. Scores are added exactly (as doubles), so the result does not depend on where a text begins.

The public vocabularies hold no unigram model, and tokenizers are not trained here. ``load`` makes one by rule from the
pieces of a sentencepiece model in the order of their merges: by Zipf's law the piece of rank r has the probability
1 / (r H), H the sum of 1 / r over all pieces, and its logarithm is the score. The unigram models of the tokenizers and
sentencepiece libraries, given these pieces and scores, count the same tokens.

The text is written with the meta symbol for spaces and one in front. No piece holds that symbol after another
character, so the best path passes every place where a run of symbols begins, and each word is solved for itself; solved
words are remembered in a table of bounded size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import ChunkMemo

#: Fixed values of the tokenizer: the meta symbol for a space, and what an unknown character costs below the least score.
META, UNKNOWN_PENALTY = "▁", 10.0
_WORD = re.compile(f"{META}+[^{META}]*")


def zipf_pieces(path: str) -> list[tuple[str, float]]:
    """Normal and user-defined pieces of a sentencepiece model, best first, with log-probabilities by Zipf's law."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ids.sort(key=lambda i: (-sp.get_score(i), i))
    total = math.log(sum(1 / r for r in range(1, len(ids) + 1)))
    return [(sp.id_to_piece(i), -math.log(r) - total) for r, i in enumerate(ids, 1)]


class UnigramCounter:
    """``pieces``: (text, score) of the vocabulary. They may hold the meta symbol only as a leading run."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.trie = ahocorasick.Automaton()
        for piece, score in pieces:
            if META in piece.lstrip(META):
                raise ValueError(f"the meta symbol stands inside {piece!r}")
            self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.memo = ChunkMemo(self.word)

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> UnigramCounter:
        """The unigram model made by rule from the pieces of a sentencepiece model."""
        return UnigramCounter(zipf_pieces(path))

    def word(self, s: str) -> tuple[int, float]:
        """Pieces and score of the best path."""
        n = len(s)
        score: list = [0.0] + [None] * n
        count = [0] * (n + 1)
        single, unknown, done = self.single, self.unknown, 0

        def fall_back(i: int) -> None:
            """No piece but the unknown one may end after character i; it is last in line."""
            if s[i] not in single:
                made = score[i] + unknown
                if score[i + 1] is None or made > score[i + 1]:
                    score[i + 1], count[i + 1] = made, count[i] + len(s[i].encode())

        for end, (length, value) in self.trie.iter(s):  # by end; at one end the longest, which starts first, leads
            while done < end:
                fall_back(done)
                done += 1
            start = end + 1 - length
            made = score[start] + value
            if score[end + 1] is None or made > score[end + 1]:
                score[end + 1], count[end + 1] = made, count[start] + 1
        while done < n:
            fall_back(done)
            done += 1
        return count[n], score[n]

    def __call__(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        memo = self.memo
        made = [memo[w] for w in _WORD.findall(META + text.replace(" ", META))]
        return sum([m[0] for m in made]), sum([m[1] for m in made])


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens`` (long) and ``score`` (double) of each whole text's best path.

    Null and empty texts: 0 tokens, score 0. Rows are independent; other columns are not read.
    """
    named = [f"k{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, named, strict=True)], F.col(f"`{text}`").alias("t"))
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter.load(path)
        for batch in batches:
            made = [counter(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.float64())], names=[*named, "o_n", "o_s"])

    made = df.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in named), "o_n bigint, o_s double"]))
    return made.select(*[F.col(k).alias(c) for c, k in zip(keep, named, strict=True)], F.col("o_n").alias("n_tokens"), F.col("o_s").alias("score"))
