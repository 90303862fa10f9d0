"""The queries of the training-data operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import ann, decontam, htmltext, langid, licences, mixture, neardup, token_counts, url_rules, wavelet
from granary.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


#: host, path, verdict of the rules that op5 applies.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS rules(host, path, verdict)")
    judged = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_output(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=85)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.lookup(table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_main_text, op2_language, op3_wavelet_tokens, op4_permutation_index, op5_url_rules, op6_near_duplicates, op7_decontamination, op8_mixture, op9_licences, op10_token_counts)}
SQL: dict[str, str] = {
    "op5_url_rules": """
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS i
  FROM rest),
fit AS (
  SELECT p.*, r.*, row_number() OVER (PARTITION BY i ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path))
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict FROM fit WHERE k = 1
""",
    "op6_near_duplicates": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM sh a JOIN sh b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c) UNION ALL SELECT b, a FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
reach(doc_id, met) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.met = l.a)
SELECT s.doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(r.met) AS component_id, s.doc_id = min(r.met) AS kept
FROM s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id
""",
    # items of fewer than five words, of which the tables have none, are left to the tests
    "op7_decontamination": """
WITH words AS (SELECT doc_id AS d, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id AS i, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT d, list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) AS s FROM words WHERE len(w) >= 5),
its AS (SELECT i, list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) AS s FROM iw WHERE len(w) >= 5),
dx AS (SELECT d, unnest(s) AS sh FROM ds), ix AS (SELECT i, unnest(s) AS sh FROM its),
ic AS (SELECT i, sh, count(*) AS c FROM ix GROUP BY ALL),
near AS (SELECT DISTINCT d, i FROM dx JOIN ix USING (sh)),
win AS (SELECT d, i, its.s AS item, ds.s AS s, unnest(range(0, greatest(1, len(ds.s) - len(its.s) + 1))) AS st FROM near JOIN ds USING (d) JOIN its USING (i)),
wx AS (SELECT d, i, st, len(item) AS ni, len(s[st + 1:st + len(item)]) AS nw, unnest(s[st + 1:st + len(item)]) AS sh FROM win),
wc AS (SELECT d, i, st, ni, nw, sh, count(*) AS c FROM wx GROUP BY ALL),
hit AS (SELECT d, i, st, ni, nw, sum(least(wc.c, ic.c)) AS common FROM wc JOIN ic USING (i, sh) GROUP BY d, i, st, ni, nw),
best AS (SELECT d, i, max(common / (ni + nw - common)) AS similarity FROM hit WHERE 100 * common >= 80 * (ni + nw - common) GROUP BY d, i),
found AS (SELECT d, count(*) AS n, arg_max(i, (similarity, -i)) AS i FROM best GROUP BY d)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0) AS n_items, i AS item_id FROM documents LEFT JOIN found ON doc_id = d
""",
    "op9_licences": licences.sql(),
}
