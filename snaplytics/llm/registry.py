"""Registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from snaplytics.llm import credential_links, exact_mph, importance_resampling, online_packing, pu_classifier, quality_divergence
from snaplytics.llm import simhash_variants, suffix_dedup, token_alignment, token_files, url_filter, warc_segments, weighted_mix
from snaplytics.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return quality_divergence.judge_documents(table(spark, folder, "documents")).drop("class_distance", "word_distance")


def op2_digest_array(spark: SparkSession, folder: str) -> DataFrame:
    entries = url_filter.rule_entries(spark).unionByName(url_filter.label_entries(spark))
    return url_filter.judge_urls(table(spark, folder, "pages"), entries)


def op3_simhash_variants(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_variants.near_duplicates(table(spark, folder, "documents")).drop("row")


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_passages(table(spark, folder, "documents"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_exact_mph(spark: SparkSession, folder: str) -> DataFrame:
    return exact_mph.exact_duplicates(table(spark, folder, "documents")).drop("row")


def op7_pu_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return pu_classifier.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_online_packing(spark: SparkSession, folder: str) -> DataFrame:
    return online_packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_weighted_mix(spark: SparkSession, folder: str) -> DataFrame:
    return weighted_mix.mix(table(spark, folder, "documents")).drop("row")


def op10_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    return warc_segments.archive_round_trip(table(spark, folder, "pages"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    byte_level, pieces = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.align_tokenizers(table(spark, folder, "documents"), byte_level, pieces)


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance_resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_credential_links(spark: SparkSession, folder: str) -> DataFrame:
    return credential_links.find_credentials(table(spark, folder, "documents"))


OPERATORS = (
    op1_quality_divergence,
    op2_digest_array,
    op3_simhash_variants,
    op4_suffix_dedup,
    op5_token_files,
    op6_exact_mph,
    op7_pu_classifier,
    op8_online_packing,
    op9_weighted_mix,
    op10_warc_segments,
    op11_token_alignment,
    op12_importance_resampling,
    op13_credential_links,
)


def queries() -> dict[str, Query]:
    import corpus_pipeline  # it imports the operators, so it is imported late

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in OPERATORS}


# The ten character classes; every language of the tables has words enough for a reference of its own.
CLASS_PATTERNS = (
    "[a-z]", "[A-Z]", "[0-9]", r"[ \t]", r"[\n\r]", r"[.,;:!?'\-]", r"[()\[\]{}\"]", r"[#$%&*+/<=>@\\^_`|~]",
    r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", r"[^\x00-\x7f]",
)
CELLS = ", ".join(f"len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'))" for p in CLASS_PATTERNS)


def _distance(a: str, b: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    share = f"list_transform(list_zip({a}, {b}), lambda x: [x[1] / list_sum({a}), x[2] / list_sum({b})])"
    part = "CASE WHEN x[{i}] > 0 THEN x[{i}] * log2(x[{i}] / ((x[1] + x[2]) / 2)) ELSE 0 END"
    terms = f"list_transform({share}, lambda x: {part.format(i=1)} + {part.format(i=2)})"
    return f"sqrt(greatest(0, list_sum({terms}) / 2))"


OP1 = f"""
WITH t AS (
  SELECT row_number() OVER () AS nr, doc_id, lang, text, [{CELLS}]::double[] AS cells,
         regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words
  FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)),
windows AS (
  SELECT nr, i, count(*) OVER (PARTITION BY nr, array_to_string(words[i:i + 4], ' ')) AS times
  FROM (SELECT nr, words, unnest(range(1, len(words) - 3)) AS i FROM t WHERE len(words) > 4)),
repeated AS (
  SELECT nr, count(DISTINCT spot) AS n FROM (SELECT nr, unnest(range(i, i + 5)) AS spot FROM windows WHERE times > 1) GROUP BY nr),
own AS (SELECT nr, lang, unnest(words) AS word FROM t),
top AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place
  FROM (SELECT lang, word, count(*) AS n FROM own GROUP BY lang, word) QUALIFY place <= 50),
counted AS (
  SELECT nr, list(n ORDER BY place) AS common
  FROM (SELECT t.nr, top.place, count(own.word) AS n FROM t JOIN top USING (lang) LEFT JOIN own ON own.nr = t.nr AND own.word = top.word
        GROUP BY t.nr, top.place) GROUP BY nr),
reference AS (
  SELECT lang, class_cells, list_append(common, n_words - list_sum(common))::double[] AS word_cells
  FROM (SELECT lang, [{", ".join(f"sum(cells[{i + 1}])" for i in range(10))}] AS class_cells, sum(len(words)) AS n_words FROM t GROUP BY lang)
  JOIN (SELECT lang, list(n ORDER BY place) AS common FROM top GROUP BY lang) USING (lang)),
measured AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
           - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words,
         CASE WHEN length(text) >= 150 THEN {_distance("cells", "class_cells")} ELSE 0 END AS by_class,
         CASE WHEN len(words) >= 45
              THEN {_distance("list_append(common, len(words) - list_sum(common))::double[]", "word_cells")} ELSE 0 END AS by_word
  FROM t JOIN counted USING (nr) JOIN reference USING (lang) LEFT JOIN repeated USING (nr))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND by_class <= 0.19 AND by_word <= 0.37 AS kept
FROM measured
"""

def _names(words: tuple[str, ...]) -> str:
    return f"(SELECT unnest({list(words)!r}) AS w)"


OP2 = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
b AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) JOIN r
       ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path),
pairs(a, b) AS (
  SELECT x.w, y.w FROM {_names(url_filter.SUBJECTS)} x, {_names(url_filter.TRADES)} y WHERE x.w <> y.w
  UNION SELECT x.w, y.w FROM {_names(url_filter.BAITS)} x, {_names(url_filter.GOODS)} y WHERE x.w <> y.w),
blocked AS (SELECT a || '-' || b AS label FROM pairs UNION SELECT a || b FROM pairs),
l AS (
  SELECT host, arg_max('*.' || label || '.*', (length(label), label)) AS listed
  FROM (SELECT host, unnest(string_split(host, '.')) AS label FROM (SELECT DISTINCT host FROM u)) JOIN blocked USING (label)
  GROUP BY host)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed
FROM u LEFT JOIN b USING (host, path) LEFT JOIN l USING (host)
"""

OP6 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


OP9 = r"""
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         -ln((('0x' || md5('1:' || doc_id)[1:12])::bigint + 0.5) / 281474976710656.0)
         / (1.05 - len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::bigint AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM t GROUP BY source),
-- Share out again and again: a source over three times its size keeps that, the others share the rest.
f AS (
  WITH RECURSIVE r(round, source, source_size, weight, is_full) AS (
    SELECT 0, source, source_size, weight, false FROM s
    UNION ALL
    SELECT round + 1, source, source_size, weight,
           is_full OR (words - coalesce(sum(3 * source_size) FILTER (is_full) OVER (), 0)) * weight
                      > 3 * source_size * sum(weight) FILTER (NOT is_full) OVER ()
    FROM r, (SELECT sum(source_size) AS words FROM s)
    WHERE round < (SELECT count(*) FROM s))
  SELECT source, source_size, weight, is_full FROM r WHERE round = (SELECT count(*) FROM s)),
g AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN (3 * source_size)::double
              ELSE ((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (is_full) OVER (), 0)) * weight)::double
                   / (sum(weight) FILTER (NOT is_full) OVER ())::double END AS target
  FROM f),
p AS (
  SELECT t.doc_id, t.size, g.source_size, g.target, floor(g.target)::bigint AS budget,
         sum(t.size) OVER (PARTITION BY t.source ORDER BY t.key, t.doc_id ROWS UNBOUNDED PRECEDING) - t.size AS ahead
  FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
             + greatest(0, least(size, budget % source_size - ahead)) END)::bigint AS taken
FROM p
"""


OP10 = r"""
WITH t AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
SELECT page_id, strlen(html)::bigint AS payload_bytes,
       -- Base 32: five hex digits are four letters.
       list_aggregate(list_transform(range(0, 40, 5), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0x' || sha1(html)[i + 1:i + 5])::int >> s & 31) + 1]), 'string_agg', '')), 'string_agg', '')
         AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM t
"""


# CRC-32 as bit operations, from a table that is itself computed; every distinct feature once.
OP12 = r"""
WITH RECURSIVE byte AS (SELECT unnest(range(256))::uinteger AS b),
steps(b, c, step) AS (
  SELECT b, b, 0 FROM byte
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::uinteger) ELSE c >> 1 END, step + 1 FROM steps WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE step = 8),
given AS (
  SELECT row_number() OVER () AS nr, false AS is_target, doc_id, text FROM documents
  UNION ALL
  SELECT row_number() OVER (), true, NULL, text FROM benchmark),
worded AS (
  SELECT nr, is_target, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM given),
feature AS (
  SELECT nr, is_target, array_to_string(words[i:i + k - 1], ' ') AS f
  FROM (SELECT nr, is_target, words, unnest(range(1, len(words) + 1)) AS i FROM worded), (VALUES (1), (2), (3)) AS n(k)
  WHERE i + k - 1 <= len(words)),
distinct_feature AS (SELECT f, hex(encode(f)) AS bytes FROM (SELECT DISTINCT f FROM feature)),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(1, length(bytes), 2), lambda i: ('0x' || bytes[i:i + 1])::uinteger),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::uinteger), 4294967295::uinteger) % 10000 AS bucket
  FROM distinct_feature, crc_table),
counted AS (SELECT nr, is_target, bucket, count(*) AS n FROM feature JOIN hashed USING (f) GROUP BY ALL),
totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (NOT is_target), 0) AS s, coalesce(sum(n) FILTER (is_target), 0) AS t FROM counted GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::double / ((s + 1) * (sum(t) OVER () + 10000))::double))::bigint AS gain
  FROM totals),
weighed AS (SELECT nr, sum(n * gain)::bigint AS weight FROM counted JOIN gain USING (bucket) WHERE NOT is_target GROUP BY nr),
scored AS (
  SELECT nr, doc_id, len(words) AS n_words,
         greatest(len(words), 0) + greatest(len(words) - 1, 0) + greatest(len(words) - 2, 0) AS n_features,
         coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::varchar, 'null'))[1:8])::bigint + 0.5) / 4294967296)))::bigint
           AS score
  FROM worded LEFT JOIN weighed USING (nr) WHERE NOT is_target),
placed AS (
  SELECT nr, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (nr)
"""


GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
SPAN_PATTERNS = (
    rf"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]){GIVEN}([A-Za-z0-9+/_.=-]+)",
    "(AKIA[A-Z0-9]+)()",
    "([0-9a-f]+)()",
    "([Aa][Cc][Cc][Ee][Ss][Ss]_[Kk][Ee][Yy]_[Ii][Dd]|[Cc][Ll][Ii][Ee][Nn][Tt]_[Ii][Dd]|[Uu][Ss][Ee][Rr]_?[Nn][Aa][Mm][Ee]|[Uu][Ss][Ee][Rr]"
    rf"|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]){GIVEN}([A-Za-z0-9@._+-]+)",
    "([A-Za-z0-9+/_-]{20,})()",
    r"""([A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>\x7F]+)()""",
    r"(\n[\x20\t\r]*\n)()",
)


def _found(source: int, pattern: str) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT nr, {source} AS source, unnest(range(len(m))) AS pos, unnest(list_transform(gaps[:len(m)], lambda g: length(g))) AS gap,
         unnest(m) AS match, unnest(v) AS value
  FROM (SELECT nr, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, 2) AS v
        FROM t WHERE regexp_matches(text, {p}))"""


OP13 = f"""
WITH t AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  {" UNION ALL ".join(_found(i, p) for i, p in enumerate(SPAN_PATTERNS))}),
span AS (
  SELECT nr, ends - length(match) AS a, ends AS b, kind FROM (
    SELECT nr, match, sum(gap + length(match)) OVER (PARTITION BY nr, source ORDER BY pos) AS ends,
           CASE source WHEN 0 THEN CASE WHEN length(value) >= 12 THEN 0 WHEN length(value) >= 6 THEN 4 END
                       WHEN 1 THEN CASE WHEN length(match) >= 18 THEN 1 END
                       WHEN 2 THEN CASE WHEN length(match) >= 16 THEN 2 END
                       WHEN 4 THEN CASE WHEN regexp_matches(match, '[a-z]') AND regexp_matches(match, '[A-Z]') AND regexp_matches(match, '[0-9]') THEN 4 END
                       ELSE source END AS kind
    FROM found) WHERE kind IS NOT NULL),
base AS (SELECT * FROM span WHERE kind <= 2),
part AS (
  SELECT s.nr, s.a, s.b, s.kind, (SELECT count(*) FROM span x WHERE x.nr = s.nr AND x.kind = 6 AND x.a <= s.a) AS section
  FROM span s
  WHERE kind <> 6 AND NOT (kind = 4 AND EXISTS (SELECT 1 FROM base x WHERE x.nr = s.nr AND x.a < s.b AND s.a < x.b))),
linked AS (
  SELECT c.nr, c.a, c.b, c.kind
  FROM part c JOIN part n ON c.nr = n.nr AND c.section = n.section AND n.a <= c.b + 200 AND n.b >= c.a - 200
  WHERE c.kind > 2 GROUP BY ALL
  HAVING CASE c.kind WHEN 3 THEN bool_or(n.kind IN (0, 2, 4)) WHEN 4 THEN bool_or(n.kind IN (1, 3, 5))
              ELSE bool_or(n.kind IN (0, 2, 4)) AND bool_or(n.kind IN (1, 3)) END),
per AS (
  SELECT nr, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name, ',' ORDER BY a, kind) FILTER (kind <= 2) AS base_spans, string_agg(name, ',' ORDER BY a, kind) AS all_spans
  FROM (SELECT *, ['assign', 'access', 'hex', 'login', 'key', 'endpoint'][kind + 1] || ':' || a || ':' || b AS name
        FROM (SELECT nr, a, b, kind FROM base UNION ALL SELECT * FROM linked)) GROUP BY nr)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(all_spans, '') AS spans
FROM t LEFT JOIN per USING (nr)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_divergence": OP1,
        "op2_digest_array": OP2,
        "op6_exact_mph": OP6,
        "op9_weighted_mix": OP9,
        "op10_warc_segments": OP10,
        "op12_importance_resampling": OP12,
        "op13_credential_links": OP13,
    }
