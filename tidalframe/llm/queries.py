"""One thin query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules as quality_rules_module
from .embed_dedup import embedding_components
from .exponion import ROUNDS, SCALE, STARTS, WIDTH, centroid_clusters
from .hidden_markov import hidden_markov_scores
from .line_dedup import PASSAGE_RUN, PASSAGE_UNIT, without_repeats
from .mixing import mix_plan
from .ngram_join import ngram_jaccard_components
from .orc_tokens import encode_to_orc
from .packing import pack
from .quality_rules import quality_rules
from .rule_ensemble import quality_scores
from .spelling import LEAST_COUNT, LEAST_LENGTH, SLIP, TIMES, spelling_variants
from .text_stats import SPACES
from .toxicity import toxicity
from .url_templates import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Folder of the public tokenizers' files; None asks the public_tokenizers module.
TOKENIZER_FOLDER: str | None = None


def tokenizer_file(name: str, folder: str | None = None) -> str:
    if folder or TOKENIZER_FOLDER:
        return f"{folder or TOKENIZER_FOLDER}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"), 0.93)


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"), (5, 2, 1), 1.5, 2)


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose a passage: doc_id, removed (start, end, words) and the text that stays."""
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), True, PASSAGE_UNIT, PASSAGE_RUN).select("doc_id", "removed", "text")


@query
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method of op7 without parameters: every repeated unit goes, stock sentences too. Words removed, and a digest of those that stay."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACES), "")
    return out.select("doc_id", F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("removed_words"), F.md5(F.array_join(words, " ")).alias("kept_md5"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 2048, 0)


@query
def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_to_orc(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 1)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov_scores(table(spark, sf_dir, "documents"))


@query
def op12_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: The words of texts and the sizes of documents, as DuckDB counts them.
ORACLES["op3_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix1:' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             (source_size * 2)::DOUBLE AS cap FROM src),
lv AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
         - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
fin AS (SELECT *, (SELECT arg_min(level, cap / weight) FROM lv WHERE level * weight <= cap) AS f FROM lv),
goal AS (SELECT source, source_size, coalesce(least(cap, weight * f), cap) AS target FROM fin),
g2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goal),
g3 AS (SELECT *, target - whole * source_size AS rest FROM g2),
keys AS (SELECT source, place, sum(size)::BIGINT AS size FROM sized GROUP BY source, place),
run AS (SELECT k.source, k.place, k.size, g.rest, sum(k.size) OVER (PARTITION BY k.source ORDER BY k.place) AS total
        FROM keys k JOIN g3 g ON k.source IS NOT DISTINCT FROM g.source WHERE g.rest > 0),
cut AS (SELECT source, rest, max(CASE WHEN total <= rest THEN place END) AS upto, rest - coalesce(max(CASE WHEN total <= rest THEN total END), 0) AS gap
        FROM run GROUP BY source, rest HAVING max(total) > rest),
fill AS (SELECT r.source, arg_min(r.place, abs(r.size - c.gap)) AS filler FROM run r JOIN cut c ON r.source IS NOT DISTINCT FROM c.source
         WHERE (c.upto IS NULL OR r.place > c.upto) AND abs(r.size - c.gap) < c.gap
           AND abs(r.size - c.gap) = (SELECT min(abs(q.size - c.gap)) FROM run q WHERE q.source IS NOT DISTINCT FROM r.source AND (c.upto IS NULL OR q.place > c.upto))
           AND r.place = (SELECT min(p.place) FROM run p WHERE p.source IS NOT DISTINCT FROM r.source AND (c.upto IS NULL OR p.place > c.upto) AND abs(p.size - c.gap)
             = (SELECT min(abs(q.size - c.gap)) FROM run q WHERE q.source IS NOT DISTINCT FROM r.source AND (c.upto IS NULL OR q.place > c.upto)))
         GROUP BY r.source)
SELECT s.doc_id, s.size, g.source_size, g.target,
       s.size * (g.whole + CASE WHEN coalesce(s.place <= c.upto, false) OR coalesce(s.place = f.filler, false) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM sized s JOIN g3 g ON s.source IS NOT DISTINCT FROM g.source
LEFT JOIN cut c ON s.source IS NOT DISTINCT FROM c.source LEFT JOIN fill f ON s.source IS NOT DISTINCT FROM f.source
"""


def _quality_sql() -> str:
    """op1 in DuckDB: exact counts, sketches as bucket counts, fences by group, language and all."""
    parts = quality_rules_module.FENCED
    ratio, zero, least = quality_rules_module.RATIO, quality_rules_module.ZERO, quality_rules_module.LEAST_ROWS
    named = ", ".join(f"'{name}'" for name in parts)
    value = lambda b: f"CASE WHEN {b} > {zero} THEN pow({ratio!r}::DOUBLE, {b}) * {2 / (ratio + 1)!r}::DOUBLE ELSE 0.0 END"
    spread = "CASE statistic " + " ".join(f"WHEN '{name}' THEN greatest(high - low, {low!r}::DOUBLE)" for name, (low, _) in parts.items()) + f" END * {quality_rules_module.RANGES!r}::DOUBLE"
    floor = "CASE WHEN statistic IN (" + ", ".join(f"'{name}'" for name, (_, both) in parts.items() if both) + ") THEN low - spread ELSE '-infinity'::DOUBLE END"
    level = lambda name, keys: f"""
{name}_m AS (SELECT {keys}statistic, bucket, sum(n)::BIGINT AS n FROM sk GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {keys}statistic ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}statistic) AS rows FROM {name}_m),
{name}_b AS (SELECT {keys}statistic, max(rows) AS rows, min(CASE WHEN upto * 4 >= rows THEN bucket END) AS b1, min(CASE WHEN upto * 4 >= rows * 3 THEN bucket END) AS b3 FROM {name}_r GROUP BY ALL),
{name}_q AS (SELECT *, {value("b1")} AS low, {value("b3")} AS high FROM {name}_b),
{name}_s AS (SELECT *, {spread} AS spread FROM {name}_q),
{name}_f AS (SELECT *, high + spread AS top, {floor} AS bottom FROM {name}_s)"""  # noqa: E731
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
p AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT rid, i, a, lead(a) OVER (PARTITION BY rid ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY rid ORDER BY i) AS c FROM p),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
base AS (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
                coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '[A-Z\x{{C0}}-\x{{DE}}]')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_bangs
         FROM w LEFT JOIN rep USING (rid)),
st AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed, coalesce(n_symbols / nullif(word_chars, 0), 0.0)::DOUBLE AS symbol_share,
              coalesce(n_dup_lines / nullif(n_lines, 0), 0.0)::DOUBLE AS dup_line_share, coalesce(n_repeat_words / nullif(n_words, 0), 0.0)::DOUBLE AS repeat_share,
              coalesce(n_upper / nullif(word_chars, 0), 0.0)::DOUBLE AS upper_share, coalesce(n_bangs / nullif(word_chars, 0), 0.0)::DOUBLE AS bang_share,
              coalesce(word_chars / nullif(n_words, 0), 0.0)::DOUBLE AS word_length FROM base),
long AS (SELECT rid, lang, source, base_failed, unnest([{named}]) AS statistic, unnest([{", ".join(parts)}]) AS v FROM st),
sk AS (SELECT lang, source, statistic, CASE WHEN v > 0 THEN ceil(ln(v) / {math.log(ratio)!r}::DOUBLE)::INT ELSE {zero} END AS bucket, count(*) AS n FROM long WHERE NOT base_failed GROUP BY ALL),
{level("g", "lang, source, ")}, {level("l", "lang, ")}, {level("e", "")},
met AS (SELECT x.rid, bool_and(CASE WHEN g.rows >= {least} THEN v <= g.top AND v >= g.bottom WHEN l.rows >= {least} THEN v <= l.top AND v >= l.bottom ELSE v <= e.top AND v >= e.bottom END) AS inside
        FROM long x JOIN g_f g ON x.statistic = g.statistic AND x.lang IS NOT DISTINCT FROM g.lang AND x.source IS NOT DISTINCT FROM g.source
        JOIN l_f l ON x.statistic = l.statistic AND x.lang IS NOT DISTINCT FROM l.lang JOIN e_f e ON x.statistic = e.statistic GROUP BY x.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, true) AS kept, {", ".join(parts)}
FROM st LEFT JOIN met USING (rid)
"""


ORACLES["op1_quality_rules"] = _quality_sql()


def _clusters_sql() -> str:
    """op12 in DuckDB: every distance in every round, in whole numbers."""
    distance = "list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    rounds = ""
    for i in range(ROUNDS + 1):
        rounds += f"""
a{i} AS MATERIALIZED (SELECT rid, (min([d, c]))[2] AS c, min(d) AS d FROM (SELECT v.rid, c.c, {distance} AS d FROM v CROSS JOIN c{i} c) GROUP BY rid),"""
        if i < ROUNDS:
            rounds += f"""
s{i} AS (SELECT c, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(v.p) AS x, generate_subscripts(v.p, 1) AS pos FROM a{i} a JOIN v USING (rid)) GROUP BY c, pos),
m{i} AS (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY pos) AS p FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.p, c.p) AS p FROM c{i} c LEFT JOIN m{i} m USING (c)),"""
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), p) - 1 AS c, p FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id), p LIMIT {STARTS}),{rounds}
i AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY c)
SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, i.cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(list_aggregate(e.p, 'string_agg', ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (rid) JOIN i USING (c) JOIN c{ROUNDS} e USING (c)
"""


ORACLES["op12_exponion_clusters"] = _clusters_sql()


#: op13 in DuckDB: crc32 by a table made from its rule, near words by the words with one place left out.
ORACLES["op13_spelling_variants"] = rf"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n, length(run) AS len FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
coded AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::UBIGINT]
    ELSE [(192 + unicode(x) // 64)::UBIGINT, (128 + unicode(x) % 64)::UBIGINT] END)) AS bytes FROM own),
hashed AS (SELECT run, n, len, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::INT])), 4294967295::UBIGINT) AS h FROM coded, crc),
slipped AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, (h % len)::INT) || substr(run, (h % len)::INT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
pat AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
one AS (SELECT p.word, q.word AS near, q.n FROM pat p JOIN pat q ON p.i = q.i AND p.a = q.a AND p.b = q.b AND p.word <> q.word),
cut AS (SELECT DISTINCT p.word AS long, p.n AS long_n, w.word AS short, w.n AS short_n FROM pat p JOIN words w ON w.word = p.a || p.b),
near AS (SELECT word, near, n FROM one UNION ALL SELECT long, short, short_n FROM cut UNION ALL SELECT short, long, long_n FROM cut),
best AS (SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place FROM near),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= {TIMES} * w.n THEN b.near END AS form, CASE WHEN b.n >= {TIMES} * w.n THEN b.n END::BIGINT AS form_n
  FROM words w LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (word)),
walk AS (SELECT word, word AS root FROM formed UNION SELECT k.word, f.form FROM walk k JOIN formed f ON k.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk k USING (word) JOIN formed e ON k.root = e.word WHERE e.form IS NULL
"""


#: repeated_lines in DuckDB: units are the words of a line up to one that ends in . ! ? , ; or :, told by their lower-cased words.
ORACLES["repeated_lines"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln FROM documents),
w AS (SELECT doc_id, ln, unnest(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), 1) AS k FROM l),
o AS (SELECT *, coalesce(k = 1 OR regexp_matches(lag(word) OVER (PARTITION BY doc_id, ln ORDER BY k), '[.!?,;:]$'), true) AS opens FROM w),
u AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY ln, k) AS unit FROM o),
g AS (SELECT doc_id, unit, string_agg(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' ORDER BY ln, k) AS own, string_agg(word, ' ' ORDER BY ln, k) AS shown, count(*) AS n
      FROM u GROUP BY doc_id, unit),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY doc_id, unit) > 1 AS gone FROM g),
t AS (SELECT doc_id, coalesce(sum(n) FILTER (gone), 0) AS removed_words, coalesce(string_agg(shown, ' ' ORDER BY unit) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.removed_words, 0)::BIGINT AS removed_words, md5(coalesce(t.kept, '')) AS kept_md5 FROM documents d LEFT JOIN t USING (doc_id)
"""
