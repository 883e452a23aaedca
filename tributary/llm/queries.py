"""Registered queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ctw, decontam, license_scan, line_dedup, packing, quality, simhash, toxicity, url_filter, warc
from .common import table


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.archived_history(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ctw": op2_ctw,
    "op5_toxicity": op5_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_decontam": op4_decontam,
    "op6_packing": op6_packing,
    "op9_warc": op9_warc,
    "op7_url_filter": op7_url_filter,
    "op10_quality": op10_quality,
    "op8_simhash": op8_simhash,
}

#: DuckDB: words of a text, after lower-casing A-Z only where asked.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op10_quality"] = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format('text')} AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, l, count(*) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
nl AS (SELECT DISTINCT host, text, line, sum(k) OVER (PARTITION BY doc_id, line) AS k FROM (SELECT doc_id, host, text, len(q) AS k,
       regexp_replace(array_to_string(q, ' '), '[0-9]+', '0', 'g') AS line FROM (SELECT doc_id, host, text, {_WORDS.format(_LOWER.format('l'))} AS q FROM ln) WHERE len(q) > 0)),
sz AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
common AS (SELECT host, line FROM nl JOIN sz USING (host) GROUP BY host, line, texts HAVING count(DISTINCT text) > {quality.LINE_LIMIT} AND count(DISTINCT text) * {quality.LINE_SHARE} > texts),
gone AS (SELECT nl.host, nl.text, sum(k) AS k FROM nl JOIN common USING (host, line) GROUP BY ALL),
f AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
      length(w.text) - length(translate(w.text, '#*$%&|<>', '')) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
      coalesce(cov.n, 0) AS n_repeat_words, CAST(coalesce(gone.k, 0) AS BIGINT) AS n_words_removed
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone ON gone.host = w.host AND gone.text = w.text)
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - n_words_removed) >= {quality.LEAST_LEFT} * n_words AS kept
FROM f"""


ORACLE_SQL["op7_url_filter"] = f"""
WITH p AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
q AS (SELECT *, host <> '' AND substr(md5(host), 1, 1) IN ('0', '1', '2', '3') AS listed,
  CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, listed,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM q"""


ORACLE_SQL["op9_warc"] = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM q"""


ORACLE_SQL["op4_decontam"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
n AS (SELECT *, least({decontam.WIDTH}, len(w)) AS k FROM b WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p FROM n)),
c AS (SELECT item_id, count(*) AS shingles FROM i GROUP BY item_id),
s AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
      FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p FROM d, (SELECT DISTINCT k FROM n)))
SELECT doc_id, item_id, count(*) AS matched, shingles
FROM s JOIN i USING (k, s) JOIN c USING (item_id)
GROUP BY doc_id, item_id, shingles HAVING count(*) >= {decontam.CONTAINMENT} * shingles"""

_LETTERS = "regexp_extract_all({}, '[a-z0-9]+')"
_TEMPLATES = ", ".join(f"('{a}', '{b}', {license_scan.size_class(t)}, '{' '.join(license_scan.words_of(t))}')" for a, b, t in license_scan.TEMPLATES)

ORACLE_SQL["op3_license_scan"] = f"""
WITH t AS (SELECT template, license, class, string_split(body, ' ') AS w FROM (VALUES {_TEMPLATES}) v(template, license, class, body)),
i AS (SELECT DISTINCT template, license, class, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT *, unnest(range(1, CAST(len(w) - 3 AS BIGINT))) AS p FROM t)),
c AS (SELECT template, count(*) AS shingles FROM i GROUP BY template),
r AS (SELECT a.template, b.template AS rival FROM i a JOIN i b USING (s) JOIN c ON c.template = a.template WHERE a.license <> b.license GROUP BY a.template, b.template, shingles HAVING 2 * count(*) >= shingles),
x AS (SELECT r.template, r.rival, i.s FROM r JOIN i USING (template) WHERE NOT EXISTS (SELECT 1 FROM i k WHERE k.template = r.rival AND k.s = i.s)),
o AS (SELECT template, rival, count(*) AS own FROM x GROUP BY template, rival),
d AS (SELECT doc_id, {_LETTERS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, p - 1 AS p, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT *, unnest(range(1, CAST(len(w) - 3 AS BIGINT))) AS p FROM d)),
h AS (SELECT doc_id, template, license, class, s, unnest([p - p % class, p - p % class - class]) AS start FROM s JOIN i USING (s)),
m AS (SELECT doc_id, template, license, start, count(DISTINCT s) AS matched FROM h WHERE start >= 0 GROUP BY ALL),
told AS (SELECT doc_id, template, start, rival, count(DISTINCT s) AS told FROM h JOIN x USING (template, s) GROUP BY ALL),
bad AS (SELECT doc_id, template, start FROM m JOIN o USING (template) LEFT JOIN told USING (doc_id, template, start, rival) WHERE 2 * coalesce(told, 0) < own)
SELECT doc_id, template, license, max(matched) AS matched, shingles, min(start) AS first_word
FROM m JOIN c USING (template) ANTI JOIN bad USING (doc_id, template, start) WHERE matched >= {license_scan.CONTAINMENT} * shingles
GROUP BY doc_id, template, license, shingles"""
