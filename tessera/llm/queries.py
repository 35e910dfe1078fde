"""One query for each text operator, with its production parameters, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, bpe, jaccard, language, line_dedup, packing, quality, search, simhash, token_counts, toxicity, urls, vector_codes
from tessera.llm.common import crc_mod, table


#: Scores from here on count as toxic.
TOXIC_FROM = 0.7


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "lines_removed", F.length("text").cast("long").alias("chars_kept"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_mod(F.col("doc_id"), 3) != 1)
    model = toxicity.train(docs, labels)
    scored = toxicity.score_texts(docs, model, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """byte_bpe_50k.tiktoken holds the ranks of byte_bpe_50k.json; ids are the same."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = language.train(docs.filter(~F.col("held_out")))
    return language.identify(docs, model, keep=("doc_id", "held_out"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    return vector_codes.summed(codes, "label", "error", "label_error").select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


_WORD = r"[^\x20\x09-\x0D]+"

_LINE_DEDUP_SQL = rf"""
WITH doc AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
split AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM doc),
worded AS (SELECT r, no, line, len(regexp_extract_all(line, '{_WORD}')) AS w FROM split),
l AS (SELECT *, row_number() OVER o AS k, sum(w) OVER o AS c FROM worded WHERE w > 0 WINDOW o AS (PARTITION BY r ORDER BY no)),
runs AS (
  SELECT a.r, a.k AS s, min(b.k) AS e FROM l a JOIN l b ON a.r = b.r AND b.k BETWEEN a.k AND a.k + 49 AND b.c - a.c + a.w >= 50 GROUP BY a.r, a.k
  UNION
  SELECT b.r, max(a.k) AS s, b.k AS e FROM l a JOIN l b ON a.r = b.r AND a.k BETWEEN b.k - 49 AND b.k AND b.c - a.c + a.w >= 50 GROUP BY b.r, b.k
),
body AS (SELECT u.r, u.s, u.e, string_agg(l.line, chr(10) ORDER BY l.k) AS lines FROM runs u JOIN l ON l.r = u.r AND l.k BETWEEN u.s AND u.e GROUP BY u.r, u.s, u.e),
seen AS (SELECT *, first_value(r) OVER f AS r0, first_value(e) OVER f AS e0 FROM body WINDOW f AS (PARTITION BY lines ORDER BY r, s)),
gone AS (SELECT DISTINCT l.r, l.no FROM seen x JOIN l ON l.r = x.r AND l.k BETWEEN x.s AND x.e WHERE x.r <> x.r0 OR x.s > x.e0),
kept AS (SELECT s.r, count(g.no) AS lines_removed, coalesce(string_agg(s.line, chr(10) ORDER BY s.no) FILTER (WHERE g.no IS NULL), '') AS rest FROM split s LEFT JOIN gone g USING (r, no) GROUP BY s.r)
SELECT doc_id, coalesce(lines_removed, 0)::BIGINT AS lines_removed, length(rest)::BIGINT AS chars_kept, md5(rest) AS text_md5 FROM doc LEFT JOIN kept USING (r)
"""

_QUALITY_SQL = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
n AS (SELECT row_number() OVER () AS r, *, len(words) AS n_words FROM w),
g AS (SELECT r, i, words[i:i + 2] AS tri FROM (SELECT r, words, unnest(range(1, n_words - 1)) AS i FROM n)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, tri) AS c FROM g) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM n),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{_WORD}') GROUP BY r),
f AS (
  SELECT doc_id, source, n_words::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM n LEFT JOIN cover USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, count_if(base_failed)::DOUBLE AS k FROM b WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT sum(n) AS n, sum(n * n) AS nn, count(*) AS c, sum(k) / sum(n) AS m, sum(k * k / n) AS q FROM h),
p AS (SELECT m, CASE WHEN n - nn / n - (c - 1) > 1e-9 THEN (q - n * m * m - (c - 1) * m * (1 - m)) / (n - nn / n - (c - 1)) END AS v FROM t),
s AS (SELECT m, CASE WHEN v > 1e-12 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS z FROM p),
verdict AS (SELECT source, (k + m * z) / (n + z) <= 0.5 AS host_kept FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_kept, TRUE) AS kept FROM b LEFT JOIN verdict USING (source)
"""

_LINK = r"""regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*[\"'']?canonical\b[^>]*>')"""
_META = r"""regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"'']?refresh\b[^>]*>')"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _node_sql(url: str) -> str:
    """Host (A-Z lower-cased), path and query of a url; ``/`` where nothing follows the host; null without a host."""
    after = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    host, rest = f"regexp_extract({after}, '^[^/?#]*')", f"regexp_extract({after}, '(?s)^[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN {host} <> '' THEN {_LOWER.format(host)} || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END"


#: Aliases are found by a walk over all links, which only suits the small tables that SQL is run on.
_URLS_SQL = rf"""
WITH RECURSIVE page AS (SELECT page_id, url, html, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest,
  coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, 1, instr(url, '://') - 1) END, '') AS scheme, {_node_sql("url")} AS node FROM pages),
seen AS (SELECT row_number() OVER () AS r, *, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM page),
tag AS (
  SELECT node, scheme, host, path, regexp_extract(t, '(?is)\bhref\s*=\s*[\"'']?([^\"''\s>]+)', 1) AS href FROM (SELECT node, scheme, host, path, unnest({_LINK}) AS t FROM seen)
  UNION ALL
  SELECT node, scheme, host, path, regexp_extract(t, '(?is)\burl\s*=\s*[\"'']?([^\"''\s>]+)', 1) FROM (SELECT node, scheme, host, path, unnest({_META}) AS t FROM seen)),
dst AS (SELECT node AS a, CASE WHEN contains(href, '://') THEN href WHEN starts_with(href, '//') THEN scheme || ':' || href WHEN starts_with(href, '/') THEN scheme || '://' || host || href
  WHEN path = '' THEN scheme || '://' || host || '/' || href ELSE scheme || '://' || host || regexp_replace(path, '[^/]*$', '') || href END AS url FROM tag WHERE href <> ''),
edge AS (SELECT a, {_node_sql("url")} AS b FROM dst),
both_ways AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
fits AS (SELECT h || p AS rule, act, h, p FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('allow', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) v(act, h, p)),
other AS (SELECT DISTINCT b, regexp_extract(b, '^[^/?#]*') AS host, regexp_extract(b, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM reach),
other_act AS (SELECT b, arg_max(act, length(rule)) AS act FROM other JOIN fits ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY b),
alias AS (SELECT a, min(act) AS act FROM reach JOIN other_act USING (b) GROUP BY a),
own AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(act, length(rule)) AS act FROM seen JOIN fits ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, own.rule, coalesce(own.act, alias.act, 'allow') AS verdict FROM seen LEFT JOIN own USING (r) LEFT JOIN alias ON alias.a = seen.node
"""

_TOP_K_SQL = """
WITH fine AS (SELECT vec_id, [floor(x::DOUBLE * 64) for x in embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
  AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pair AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM fine q JOIN fine x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pair)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def _round_sql(k: int) -> str:
    """Assignment of every part to the entries of round ``k``, and the entries of the round after it."""
    return f"""
a{k} AS (SELECT r, p, s, min(d * 64 + e) // 64 AS d, min(d * 64 + e) % 64 AS e FROM (
  SELECT r, part.p, s, e, list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(s, c)])::HUGEINT AS d FROM part JOIN b{k} ON part.p = b{k}.p) GROUP BY r, p, s),
m{k} AS (SELECT p, e, list(v ORDER BY i) AS c FROM (SELECT p, e, i, ((sum(s[i]) - (sum(s[i]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS v FROM (SELECT p, e, s, unnest(generate_series(1, len(s))) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))"""


_CODES_SQL = f"""
WITH kept AS (SELECT vec_id, label, [floor(x::DOUBLE * 256)::BIGINT for x in embedding] AS v, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
part AS (SELECT r, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS s FROM kept, range(16) t(p)),
b0 AS (SELECT p, r - 1 AS e, s AS c FROM part WHERE r <= 64),{_round_sql(0)},{_round_sql(1)},{_round_sql(2).split("m2 AS")[0].rstrip().rstrip(",")},
coded AS (SELECT r, string_agg(lower(printf('%02x', e::BIGINT)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), book
"""

QUERIES = {
    q.__name__: q
    for q in (op1_line_dedup, op2_simhash, op3_bpe, op4_quality, op5_toxicity, op6_urls, op7_packing, op8_token_counts, op9_top_k, op10_language, op11_vector_codes, op12_jaccard_join, op13_alignment)
}
ORACLE_SQL = {"op1_line_dedup": _LINE_DEDUP_SQL, "op4_quality": _QUALITY_SQL, "op6_urls": _URLS_SQL, "op9_top_k": _TOP_K_SQL, "op11_vector_codes": _CODES_SQL}
