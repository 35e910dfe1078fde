"""Quality rules by host: a document's own rules, and how often its host's documents break them.

DataFrame functions only. A text's repeated windows are found inside its row: hashes of the windows are sorted with
their places, neighbours that agree mark repeated ones, and the words they cover are counted from the gaps between
their places. A row costs O(n log n) of its own words and nothing is shuffled but the counts by host.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, columns_of, cut, free_name, words_of

SYMBOLS = "[#*$%&|<>]"
#: Own rules: least words, and most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: A host whose shrunk failure rate is above this is rejected as a whole.
MOST_HOST_RATE = 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more, the first one included."""

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda x, y: x["h"] == y["h"])
            return let(same, lambda eq: F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(F.coalesce(F.get(eq, k), F.lit(False)) | F.coalesce(F.get(eq, k - 1), F.lit(False)), x["i"])), lambda p: p.isNotNull())))

        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
        step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total"))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.aggregate(let(order, places), start, step, lambda a: a["total"]))

    windows = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, covered))


def features(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def host_verdicts(judged: DataFrame, most_rate: float = MOST_HOST_RATE) -> DataFrame:
    """``judged``: host, base_failed. A row for each host that is not null: host, n, failed, rate, host_kept.

    rate = (failed + a) / (n + a + b), the mean of the posterior under a beta prior of the hosts' overall rate m and of
    the variance between hosts. The spread of the observed rates holds the binomial noise of small hosts as well; its
    expectation, m (1 - m) (hosts - 1) + variance (N - sum n^2 / N - hosts + 1) for the sum of n (rate - m)^2, is solved
    for the variance between hosts. Hosts that do not differ beyond that noise give the strongest prior allowed.
    """
    hosts = judged.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("base_failed"), 1)).alias("failed"))
    n_, k_ = F.col("n").cast("double"), F.col("failed").cast("double")
    total = hosts.agg(F.sum(n_).alias("n"), F.sum(n_ * n_).alias("nn"), F.count("*").alias("c"), F.sum(k_).alias("f"), F.sum(k_ * k_ / n_).alias("q")).first()
    n, nn, c, f, q = (float(total[x] or 0) for x in ("n", "nn", "c", "f", "q"))
    mean = f / n if n else 0.0
    weight = n - nn / n - (c - 1) if n else 0.0
    between = (q - n * mean * mean - (c - 1) * mean * (1 - mean)) / weight if weight > 1e-9 else 0.0
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 1e-12 else 1e6
    rate = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") <= most_rate)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """A document's own rules."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", most_rate: float = MOST_HOST_RATE) -> DataFrame:
    """doc_id, host, the five counts, base_failed, host_rate, kept.

    Null and empty texts have no words and fail. A null host has no verdict: its documents stand on their own rules.
    Repeated rows are judged and counted each. Counts are cut off in the shared folder, so the texts are read once; the
    verdicts are joined by host, one row a host, so a hot host is split like any skewed join.
    """
    made = cut(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), features(F.col(f"`{text}`")).alias("f")).select("doc_id", "host", "f.*"), "quality")
    judged = made.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    verdicts = host_verdicts(judged, most_rate).select("host", F.col("rate").alias("host_rate"), "host_kept")
    return judged.join(verdicts, "host", "left").select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", most_rate: float = MOST_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that ``judge`` would keep, with all their columns. Rows are written down once with their
    counts, so none is looked up again."""
    name, key, verdict = free_name(docs, "counts"), free_name(docs, "host_key"), free_name(docs, "host_verdict")
    made = cut(docs.select(*columns_of(docs), features(F.col(f"`{text}`")).alias(name), F.col(f"`{host}`").cast("string").alias(key)), "quality")
    failed = base_failed(F.col(f"{name}.n_words"), F.col(f"{name}.n_repeat_words"))
    verdicts = host_verdicts(made.select(F.col(key).alias("host"), failed.alias("base_failed")), most_rate).select(F.col("host").alias(key), F.col("host_kept").alias(verdict))
    return made.join(verdicts, key, "left").filter(~failed & F.coalesce(F.col(verdict), F.lit(True))).select(*columns_of(docs))
