"""The registered queries of this subpackage, by their contracts, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from loamline.llm import bpe, decontaminate, line_dedup, merkle, ngram_join, pii, quality, suffix_dedup, time_partitions, token_counts, toxicity, url_filter, vector_graph
from loamline.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")), "n_repeated")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.remove_lines(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    early = F.col("arrived_at") < F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    return time_partitions.rewritten(clicks, time_partitions.moved(F.col("ts"), F.col("click_id")), early, 1 + clicks.count() // 650, ["arrived_at", "click_id"], "click_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.digests(merkle.documents_manifest(table(spark, sf_dir, "documents"), tampered=tampered))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pii": op1_pii, "op2_toxicity": op2_toxicity, "op3_bpe": op3_bpe, "op4_suffix_dedup": op4_suffix_dedup, "op5_token_counts": op5_token_counts, "op6_decontamination": op6_decontamination, "op7_ngram_join": op7_ngram_join, "op8_url_filter": op8_url_filter, "op9_line_dedup": op9_line_dedup, "op10_quality_rules": op10_quality_rules, "op11_embedding_dedup": op11_embedding_dedup, "op12_time_partitions": op12_time_partitions, "op13_merkle_manifest": op13_merkle_manifest, "pipeline": corpus_pipeline.run}


#: The passages of d(doc_id, text), as chosen places i of windows.
PASSAGES_SQL = r"""tokens AS (
  SELECT doc_id, j, x, sum(strlen(x) + 1) OVER (PARTITION BY doc_id ORDER BY j) - 1 AS stop
  FROM (SELECT doc_id, string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' ') AS parts FROM d), unnest(parts) WITH ORDINALITY AS u(x, j)
), words AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS i, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, stop - strlen(x) AS a, stop AS b
  FROM tokens WHERE x <> ''
), named AS (
  SELECT *, ('0x' || left(md5(word), 8))::BIGINT AS k FROM words
), windows AS (
  SELECT doc_id, i, a, lead(b, 24) OVER w AS b, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS words, (k + 3 * lead(k) OVER w) * 268435456 + i AS ranked
  FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), chosen AS (
  SELECT DISTINCT doc_id, least % 268435456 AS i
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n, min(ranked) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 25 FOLLOWING) AS least FROM windows WHERE b IS NOT NULL) WHERE i < greatest(n - 25, 1)
)"""

#: Lines and passages are told apart by their words, and occurrences of equal ones ranked by id and place; bytes as pairs of hexadecimal digits.
LINES_SQL = (
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
placed AS (
  SELECT doc_id, no, bytes, sum(bytes) OVER (PARTITION BY doc_id ORDER BY no) AS stop,
         regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\f\r]+') AS words
  FROM (SELECT doc_id, no, x AS line, strlen(x) + (no < len(parts))::INT AS bytes FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM d), unnest(parts) WITH ORDINALITY AS u(x, no))
), @,
units AS (
  SELECT doc_id, stop - bytes AS a, stop AS b, words, false AS passage FROM placed WHERE len(words) >= 10
  UNION ALL SELECT doc_id, a, b, words, true FROM windows JOIN chosen USING (doc_id, i)
), told AS (
  SELECT doc_id, a, b, passage, row_number() OVER (PARTITION BY passage, words ORDER BY doc_id, a) > 1 AS gone, count(*) OVER (PARTITION BY passage, words) > 1 AS again FROM units
), opened AS (
  SELECT doc_id, a, b, a > coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opens FROM told WHERE gone
), runs AS (
  SELECT doc_id, min(a)::BIGINT AS a, max(b)::BIGINT AS b FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM opened) GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM runs
), spans AS (
  SELECT cuts.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(a || ':' || b, ',' ORDER BY a) AS spans,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || max(CASE WHEN after IS NULL THEN substr(h, 2 * b + 1) ELSE '' END) AS kept
  FROM cuts JOIN d ON cuts.doc_id = d.doc_id GROUP BY cuts.doc_id
), shared AS (
  SELECT doc_id, count(*) AS n_passages FROM told WHERE passage AND again GROUP BY doc_id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256,
       coalesce(spans, '') AS spans, coalesce(n_passages, 0)::BIGINT AS n_passages
FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id LEFT JOIN shared ON shared.doc_id = d.doc_id
"""
).replace("@", PASSAGES_SQL)


#: Windows of eight words that a text holds twice or more give their words; the rules follow in any order.
QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), grams AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), often AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM grams
), covered AS (
  SELECT doc_id, count(DISTINCT pos)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM often WHERE times > 1) GROUP BY doc_id
), f AS (
  SELECT doc_id, text, words, lines, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), r AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS capitals, greatest(n_words, 1) AS n FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols * 100 > n * 20 OR n_dup_lines * 100 > len(lines) * 50 OR word_chars < n * 2 OR word_chars > n * 20 OR capitals * 100 > greatest(letters, 1) * 60 OR letters * 100 < length(text) * 40
    OR len(list_distinct(words)) * 100 < least(n, 2000) * 5 OR len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) * 100 > n * 30 OR len(regexp_extract_all(text, '!!')) * 100 > n * 30) AS kept
FROM r
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION_SQL = (
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(@, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(@, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS phrase FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
c AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, c.n, item_id FROM c JOIN p ON c.n = p.n AND c.phrase = p.phrase),
words AS (SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
).replace("@", _LOWERED)

JACCARD_SQL = (
    r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(@, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(4, len(w)) - 1], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a)
SELECT doc_id, any_value(coalesce(n, 0))::BIGINT AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
).replace("@", _LOWERED)

#: Bytes as pairs of hexadecimal digits; a window is told by its digest.
SUFFIX_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
v AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 480)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 239)) AS i FROM d WHERE length(h) >= 480)),
shared AS (SELECT doc_id, sum(bytes)::BIGINT AS n_repeated FROM (SELECT doc_id, least(240, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 240)) AS bytes FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS times FROM v) WHERE times > 1) GROUP BY doc_id),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS times FROM w) WHERE times > 1),
o AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, -1) AS opens FROM t),
r AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o) GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM r),
s AS (SELECT k.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || max(CASE WHEN after IS NULL THEN substr(h, 2 * b + 1) ELSE '' END) AS kept FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, coalesce(n_repeated, 0)::BIGINT AS n_repeated
FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN shared ON shared.doc_id = d.doc_id
"""
#: Trees level by level; the checksum is CRC-32 bit by bit.
MANIFEST_SQL = r"""
WITH RECURSIVE c AS (
  SELECT *, coalesce(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length(doc_id::VARCHAR)), lambda s: CASE WHEN s % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, s // 8 + 1, 1))::BIGINT ELSE 0::BIGINT END)),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 0) AS crc FROM documents
), e AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM c
), r AS (
  SELECT lang, doc_id, leaf, probe, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT lang, doc_id, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
          sha256(head || coalesce(strlen(m::VARCHAR) || ':' || m::VARCHAR, '-') || tail) AS probe FROM (SELECT *, n_chars + (xor(crc, 4294967295) % 7 = 0 AND doc_id IS NOT NULL)::INT AS m FROM e))
), tree AS (
  SELECT lang, 0 AS lvl, rank AS idx, n, leaf AS h FROM r
  UNION ALL SELECT lang, lvl + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lang, lvl, idx // 2
), tops AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM tree WHERE n = 1
), upper AS (
  SELECT 0 AS lvl, rank AS idx, n, subroot AS h FROM tops
  UNION ALL SELECT lvl + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY lvl, idx // 2
), steps AS (
  SELECT r.lang, r.rank, k.lvl, a.idx < (r.rank >> k.lvl) AS before, a.h FROM r JOIN (SELECT DISTINCT lang, lvl FROM tree WHERE n > 1) k ON r.lang IS NOT DISTINCT FROM k.lang
    LEFT JOIN tree a ON a.lang IS NOT DISTINCT FROM r.lang AND a.lvl = k.lvl AND a.idx = xor(r.rank >> k.lvl, 1)
  UNION ALL SELECT r.lang, r.rank, 1000 + k.lvl, a.idx < (t.rank >> k.lvl), a.h FROM r JOIN tops t ON r.lang IS NOT DISTINCT FROM t.lang CROSS JOIN (SELECT DISTINCT lvl FROM upper WHERE n > 1) k
    LEFT JOIN upper a ON a.lvl = k.lvl AND a.idx = xor(t.rank >> k.lvl, 1)
), proofs AS (
  SELECT lang, rank, coalesce(string_agg(h, '' ORDER BY lvl), '') AS beside, list(CASE WHEN h IS NULL THEN '-' WHEN before THEN 'l' || h ELSE 'r' || h END ORDER BY lvl) AS told FROM steps GROUP BY lang, rank
), folded AS (
  SELECT r.*, t.subroot, coalesce(p.beside, '') AS beside, (SELECT h FROM upper WHERE n = 1) AS root,
    list_reduce(list_prepend(probe, coalesce(told, []::VARCHAR[])), lambda node, s: sha256(CASE WHEN s[1] = 'l' THEN s[2:] || node WHEN s[1] = 'r' THEN node || s[2:] ELSE node END)) AS folded_root
  FROM r JOIN tops t ON r.lang IS NOT DISTINCT FROM t.lang LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM r.lang AND p.rank = r.rank
)
SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def oracle_sql() -> dict[str, str]:
    """Segmentation, learning, encoding and overlapping pattern spans have none; tests hold those queries against plain Python."""
    return {"op4_suffix_dedup": SUFFIX_SQL, "op6_decontamination": CONTAMINATION_SQL, "op7_ngram_join": JACCARD_SQL, "op9_line_dedup": LINES_SQL, "op10_quality_rules": QUALITY_SQL, "op13_merkle_manifest": MANIFEST_SQL}
