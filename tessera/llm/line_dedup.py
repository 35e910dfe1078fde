"""Line deduplication over a suffix array of line ids, built by distributed prefix doubling.

DataFrame functions only. A document is the sequence of its lines that hold a word. Lines that occur once end every
repeated run, so only the stretches between them are kept. Doubling ranks all suffixes of these stretches by their first
1, 2, 4, ... lines: the pair of ranks at i and i + 2^k, sorted over the cluster, gives the rank for 2^(k+1) lines. A
pair that occurs once is settled and leaves.

Suffixes that share their first m lines stand side by side in the suffix array: an interval of longest common prefix m
or more. Two overlapping ranks of the largest power of two within m name it, so an interval is a group of (m, rank at
its begin, rank where the last power of two begins), and its first member in the order of documents is the copy that
stays. Other members that do not overlap it are later copies; overlapping and adjoining ones in a row are joined to
maximal repeated runs, which are deleted.

It is enough to look, from each line on, at the shortest stretch that holds ``least_words`` words, forward and backward:
any line of a repeated run that holds as many lies in such a stretch of the run, and each such stretch is a repeated run
itself. So the prefix length needed is bounded by ``least_words`` lines, and the doubling ends after log2 of it whatever
the corpus holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, SPACE_CLASS, columns_of, cut, forget, free_name
from tessera.llm.quality import let

LEAST_WORDS = 50


def _ranked(pairs: DataFrame, *keys: str) -> DataFrame:
    """Distinct ``keys`` that occur twice or more, with ``rank`` in their sort order over all partitions.

    Counts are summed before the shuffle. The ranks are written down before anything reads them."""
    kept = pairs.groupBy(*keys).count().filter("count > 1").select(*keys)
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(kept.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _words(line: Column) -> Column:
    trimmed = F.trim(line, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE_CLASS)))


def _stretches(a: Column, least: int) -> Column:
    """``a``: a document's repeated lines (k, w, c), c the words up to and with the line. An array of (a, m): place of the
    first line, and lines, of the shortest consecutive stretches with ``least`` words."""
    last = F.size(a) - 1

    def enough(s: Column, e: Column) -> Column:
        return (a[e]["c"] - a[s]["c"] + a[s]["w"] >= least) & (a[e]["k"] - a[s]["k"] == e - s)

    def stretch(s: Column, e: Column) -> Column:
        return F.when(s.isNotNull() & e.isNotNull(), F.struct(a[s]["k"].alias("a"), (e - s + 1).alias("m")))

    forward = lambda i: let(F.when(a[i]["w"] >= least, i).otherwise(F.get(F.filter(F.sequence(i, F.least(i + least - 1, last)), lambda e: enough(i, e)), F.lit(0))), lambda e: stretch(i, e))
    backward = lambda i: F.when(a[i]["w"] < least, let(F.get(F.filter(F.sequence(i, F.greatest(i - least + 1, F.lit(0))), lambda s: enough(s, i)), F.lit(0)), lambda s: stretch(s, i)))
    places = F.sequence(F.lit(0), last)
    return F.array_distinct(F.filter(F.concat(F.transform(places, forward), F.transform(places, backward)), lambda x: x.isNotNull()))


def later_copies(lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``lines``: row (unique id), doc_id, k (0, 1, ... in the row), w (words), h, g (two hashes of the line).
    Columns row, a, m: the stretches of lines that are later copies, in the order of doc_id, row and place."""
    names = _ranked(lines, "h", "g")
    now = cut(lines.join(names, ["h", "g"]).select("row", "doc_id", "k", "w", "rank"), "suffixes")
    in_row = Window.partitionBy("row").orderBy("k")
    rows = now.withColumn("c", F.sum("w").over(in_row)).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "w", "c"))).alias("l"))
    made = cut(rows.select("row", "doc_id", F.explode(let(F.col("l"), lambda a: _stretches(a, least_words))).alias("s")).select("row", "doc_id", "s.*"), "stretches")
    deepest = made.agg(F.max("m")).first()[0] or 0
    suffixes, span, found = now.select("row", "k", "rank"), 1, []
    while span <= deepest:
        here = made.filter((F.col("m") >= span) & (F.col("m") < 2 * span)).withColumn("b", F.col("a") + F.col("m") - span)
        left = suffixes.select("row", F.col("k").alias("a"), F.col("rank").alias("ra"))
        right = suffixes.select("row", F.col("k").alias("b"), F.col("rank").alias("rb"))
        named = cut(here.join(left, ["row", "a"]).join(right, ["row", "b"]).select("row", "doc_id", "a", "m", "ra", "rb"), "members")
        place = F.struct("doc_id", "row", "a")
        intervals = named.groupBy("m", "ra", "rb").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        apart = (F.col("row") != F.col("first.row")) | (F.col("a") >= F.col("first.a") + F.col("m"))
        found.append(named.join(intervals, ["m", "ra", "rb"]).filter(apart).select("row", "a", "m"))
        if 2 * span <= deepest:
            ahead = F.max("rank").over(in_row.rangeBetween(span, span))
            pairs = cut(suffixes.withColumn("next", ahead).filter("next is not null").select("row", F.col("k"), F.col("rank").alias("r1"), F.col("next").alias("r2")), "pairs")
            deeper = _ranked(pairs, "r1", "r2")
            before, suffixes = suffixes, cut(pairs.join(deeper, ["r1", "r2"]).select("row", "k", "rank"), "suffixes")
            for done in (pairs, deeper, before):
                forget(done)
        span *= 2
    for done in (names, now, suffixes, made if found else None):
        forget(done)
    out = found[0] if found else made.select("row", "a", "m").limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def maximal_runs(copies: DataFrame) -> DataFrame:
    """``copies``: row, a, m. A row for each row with any: row and runs, an array of (a, e): the places of the first line
    and after the last line of its maximal repeated runs, in order."""
    each = F.sort_array(F.collect_list(F.struct("a", (F.col("a") + F.col("m")).alias("e"))))
    none = F.array().cast("array<struct<a:int,e:int>>")

    def join(runs: Column, x: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        grown = F.struct(last["a"].alias("a"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when(x["a"] <= last["e"], F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(runs, F.array(x)))

    return copies.groupBy("row").agg(each.alias("s")).select("row", F.aggregate("s", none, join).alias("runs"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, removed: str = "lines_removed") -> DataFrame:
    """The documents with later copies of repeated line runs deleted from ``text``, and ``removed``, the number of lines (long).

    The first copy, by doc_id (null first) and then by row, stays; so of repeated rows one stays whole, and where a run
    repeats itself without a gap its first copy stays and what overlaps that is no copy. Lines without a word neither
    count nor break a run. Lines are compared whole, by 128 bits of hash. Null texts stay null, a text that goes entirely
    becomes empty (or its blank lines), and every row and other column is returned, but for one that is called ``removed``
    already. Empty table: no rows. The rows are numbered and written down once.
    """
    row, runs = free_name(docs, "row_"), free_name(docs, "runs_")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    body = F.col(f"`{text}`")
    each = F.filter(F.transform(F.split(body, "\n"), lambda x: F.struct(_words(x).alias("w"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"))), lambda x: x["w"] > 0)
    lines = cut(numbered.select(F.col(row).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.posexplode(each).alias("k", "l")).select("row", "doc_id", "k", "l.*"), "lines")
    copies = later_copies(lines, least_words)
    forget(lines)
    marks = maximal_runs(copies).select(F.col("row").alias(row), F.col("runs").alias(runs))
    joined = numbered.join(marks, row, "left")

    def without(x: Column) -> Column:
        """The lines ``x`` of a text without those of its runs; places count lines with a word only."""
        worded = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.trim(x[i], F.lit(SPACE_CHARS)) != "")
        gone = let(worded, lambda at: F.flatten(F.transform(F.col(runs), lambda r: F.slice(at, r["a"] + 1, r["e"] - r["a"]))))
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: x[i]), "\n")

    rest = F.when(F.col(runs).isNull(), body).otherwise(let(F.split(body, "\n"), without))
    n_gone = F.coalesce(F.aggregate(F.col(runs), F.lit(0), lambda n, r: n + r["e"] - r["a"]), F.lit(0)).cast("long")
    return joined.select(*[rest.alias(c) if c == text else col for c, col in zip(docs.columns, columns_of(docs), strict=True) if c.lower() != removed.lower()], n_gone.alias(removed))
