"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, filter_audit, fingerprints, langid, mixing, ngram_join, packing, pii, quality, secrets, tokens, urls
from .shared import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(d.kind) for d in pii.BASE], F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda s: ~s["base"])).cast("long").alias("n_added"), pii.scores(F.col("pii")).alias("scores"),
        F.size("pii").cast("long").alias("n_spans"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_candidates", F.size("secrets").alias("n_secrets"), spans.alias("spans"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


# What SQL can say of an operator whose other columns it cannot: the same call, fewer columns.


def llm_pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii(spark, sf_dir).select("doc_id", *[f"n_{d.kind}" for d in pii.BASE], "base_sha256")


def llm_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def llm_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_pii, op2_quality, op3_fingerprints, op4_ngram_jaccard_join, op5_language_id, op6_secrets, op7_url_filter, op8_decontaminate, op9_token_ids, op10_mix_sources, op11_filter_audit, op12_best_fit_packing)
    return {f.__name__: f for f in (*numbered, llm_pii_base, llm_edited_texts, llm_url_rules)}


def _spans_sql(kind: str, order: int, pattern: str, valid: str) -> str:
    """Rows (doc_id, kind, start, stop, o) of one kind; m: the match, digits: its digits."""
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS o, stop - length(m) AS start, stop FROM (
  SELECT doc_id, ms[k] AS m, regexp_replace(ms[k], '[^0-9]', '', 'g') AS digits, list_sum(list_transform(ps[1:k], lambda x: length(x))) + list_sum(list_transform(ms[1:k], lambda x: length(x))) AS stop
  FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM d))) WHERE {valid}"""


_LUHN = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(digits[-i] AS INTEGER) WHEN CAST(digits[-i] AS INTEGER) > 4 THEN CAST(digits[-i] AS INTEGER) * 2 - 9 ELSE CAST(digits[-i] AS INTEGER) * 2 END)) % 10 = 0"
_PII = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (
{_spans_sql("email", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")} UNION ALL
{_spans_sql("ip", 1, "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "list_bool_and(list_transform(string_split(m, '.'), lambda x: coalesce(try_cast(x AS HUGEINT) <= 255, false)))")} UNION ALL
{_spans_sql("card", 2, "[0-9](?:[ -]?[0-9])+", f"length(digits) BETWEEN 14 AND 19 AND {_LUHN}")} UNION ALL
{_spans_sql("phone", 3, "[+][0-9][ ().0-9-]+[0-9]", "length(digits) BETWEEN 10 AND 15")})
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY start, o) FILTER (WHERE kind IS NOT NULL), '')) AS base_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""
_EDITED = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS follows FROM d)
SELECT doc_id, n AS n_chars, sha256(substr(text, 1, n - n // 3) || substr(follows, 1, n // 3)) AS edited_sha256 FROM x"""
#: Word sequences; of equal ones the least id; 5-grams; links of 80 % or more; classes by reach.
_JACCARD = r"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
k AS MATERIALIZED (SELECT doc_id, ws, CASE WHEN len(ws) > 0 THEN 'w' || array_to_string(ws, ' ') WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' THEN 't' || text ELSE 'i' || CAST(doc_id AS VARCHAR) END AS key FROM d),
r AS MATERIALIZED (SELECT key, min(doc_id) AS rid, first(ws) AS ws FROM k GROUP BY key),
g AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(list_slice(ws, i, i + 4), ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM r WHERE len(ws) > 0)),
z AS MATERIALIZED (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM g a JOIN g b ON a.gram = b.gram AND a.rid < b.rid JOIN z x ON a.rid = x.rid JOIN z y ON b.rid = y.rid GROUP BY a.rid, b.rid HAVING 10 * count(*) >= 8 * (any_value(x.n) + any_value(y.n) - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(a, b) AS (SELECT rid, rid FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS rid, min(b) AS class_id FROM reach GROUP BY a), l AS (SELECT a AS rid, count(*) AS n_links FROM e GROUP BY a)
SELECT k.doc_id, c.class_id, r.rid AS copy_of, coalesce(l.n_links, 0) AS n_links FROM k JOIN r ON k.key = r.key JOIN c ON r.rid = c.rid LEFT JOIN l ON r.rid = l.rid"""
_HOST = "CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)([^?#]*)', {}) ELSE '' END"
_FITS = "(host = '{0}' OR suffix(host, '.{0}')) AND starts_with(path, '{1}')"
_RULES = f"""WITH u AS (SELECT page_id, coalesce(translate({_HOST.format(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce({_HOST.format(2)}, '') AS path FROM pages),
x AS (SELECT *, CASE {" ".join(f"WHEN {_FITS.format(*text.replace('/', ' /', 1).split(' '))} THEN '{text}'" for _, text in sorted(urls.RULES, key=lambda r: -len(r[1])))} END AS rule FROM u)
SELECT page_id, host, path, rule, CASE rule {" ".join(f"WHEN '{text}' THEN '{said}'" for said, text in urls.RULES)} END AS verdict FROM x"""
_MIX = r"""WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':10:' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)
    / coalesce(greatest(0.05, 1 - 2 * (length(regexp_replace(text, '[\pL \t\n\x0B\f\r]+', '', 'g')) / greatest(length(text), 1)::DOUBLE)), 0.05) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS w, 3 * CAST(source_size AS DOUBLE) AS cap FROM r),
v AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev, row_number() OVER (ORDER BY cap / w, rank) AS place FROM w),
f AS (SELECT *, min(CASE WHEN cap > lev * w THEN place END) OVER () AS first FROM v),
y AS (SELECT *, first IS NULL OR place < first AS capped, max(CASE WHEN place = first THEN lev END) OVER () AS fair FROM f),
t AS (SELECT *, CASE WHEN capped THEN cap ELSE fair * w END AS target FROM y),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN capped THEN 3 ELSE CAST(floor(target / source_size) AS INTEGER) END AS epochs FROM t),
n AS (SELECT *, CASE WHEN capped THEN 0 ELSE target - epochs * source_size END AS rest FROM q),
o AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY source, key) AS own FROM d)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND upto - own < rest AND (upto <= rest OR upto - rest <= rest - (upto - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o JOIN n ON o.source IS NOT DISTINCT FROM n.source"""

#: Failed sets of each text; every order and step of the five filters; the Shapley sum over the orders themselves.
_AUDIT = r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY text) AS e FROM w),
m AS MATERIALIZED (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS failed,
  count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT v.x || w.x || y.x || z.x || u.x AS filter_order FROM l v, l w, l y, l z, l u WHERE len(list_distinct([v.x, w.x, y.x, z.x, u.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS prior FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, n, good, toxic, failed, contains(failed, own) AS fails, NOT regexp_matches(failed, '[' || prior || '-]') AS passed FROM m, s),
g AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT fails AND passed), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails AND passed), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE fails AND NOT passed), 0) AS redundant, coalesce(sum(n) FILTER (WHERE failed = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE fails AND passed), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND passed), 0) AS toxic_lost FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g"""


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can express; the models, fingerprints and tokens are tested against plain versions."""
    return {"op4_ngram_jaccard_join": _JACCARD, "op10_mix_sources": _MIX, "op11_filter_audit": _AUDIT, "llm_pii_base": _PII, "llm_edited_texts": _EDITED, "llm_url_rules": _RULES}
