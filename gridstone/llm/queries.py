"""Queries of the training-data operators, with the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm.common import shared_dir, table
from gridstone.llm.decontamination import decontaminate
from gridstone.llm.fill_in_middle import fill_in_middle, restored
from gridstone.llm.fingerprints import edited_fingerprints
from gridstone.llm.jaccard_join import jaccard_join
from gridstone.llm.line_dedup import line_dedup
from gridstone.llm.mixing import fit_domains, mix_sources
from gridstone.llm.pii import BASE_KINDS, find_pii
from gridstone.llm.secrets import scan_secrets
from gridstone.llm.simhash import simhash_dedup
from gridstone.llm.spelling import spelling_variants
from gridstone.llm.token_output import read_tokens, write_tokens
from gridstone.llm.toxicity import fit, toxicity
from gridstone.llm.url_filters import url_filters

#: Fixed values of the URL list: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

OP10_SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path,
       (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(rverdict, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM p
"""


OP5_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS win
        FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT DISTINCT doc_id, i, dwin.n, item_id FROM dwin JOIN win ON dwin.win = win.win AND dwin.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP11_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents),
g AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4, len(w) AS n FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT doc_id, text, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


OP8_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, pos, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
c AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM u WHERE line <> ''),
s AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words AS before FROM c),
t AS (SELECT *, before + words AS through FROM s),
w AS (SELECT doc_id, min(pos) OVER f AS a, max(pos) OVER f AS b, sum(words) OVER f AS n, list(line) OVER f AS content FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
      UNION ALL SELECT doc_id, min(pos) OVER f, max(pos) OVER f, sum(words) OVER f, list(line) OVER f FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY through RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
r AS (SELECT DISTINCT doc_id, a, b, content FROM w WHERE n >= 50),
later AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, a) AS k FROM r) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM later),
kept AS (SELECT l.doc_id, coalesce(string_agg(raw, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text, count(*) AS n_lines, count(g.pos) AS n_removed
         FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT doc_id, kept.text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed FROM documents LEFT JOIN kept USING (doc_id)
"""


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * i >= 90 * (na + nb - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE a = s.doc_id) AS component_id,
       CAST((SELECT count(*) FROM link WHERE a = s.doc_id) AS BIGINT) AS n_links FROM s
"""


def _spans_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans of some kinds, joined by commas, in the order that they have."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), path, vocabulary()), path)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, base = F.col("spans"), ("assign", "access", "hex")
    out = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[_count(spans, k) for k in base], F.sha2(_spans_text(spans, base), 256).alias("base_sha256"), _spans_text(spans).alias("spans"))


#: Domains and their shares of expected tokens.
MIX_TARGETS = {"de": 0.25, "en": 0.4, "es": 0.15, "fr": 0.2}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")
    domains = list(MIX_TARGETS)
    told: dict = {}
    mixed = mix_sources(docs.select("doc_id", "text"), fit_domains(docs, labels, domains), list(MIX_TARGETS.values()), keep=False, told=told)
    return mixed.select("doc_id", "n_tokens", *[F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)], "rate", "copies", F.lit(told["miss"]).alias("miss"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity(docs, fit(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    out = find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[_count(spans, k) for k in BASE_KINDS], F.sha2(_spans_text(spans, BASE_KINDS), 256).alias("base_sha256"), _spans_text(spans).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), width=3, threshold=0.9).select("doc_id", "n_shingles", "component_id", "n_links")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters(table(spark, sf_dir, "pages"), rules)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), slip=97)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": op1_token_output,
        "op2_secrets": op2_secrets,
        "op3_mixing": op3_mixing,
        "op4_toxicity": op4_toxicity,
        "op5_decontamination": op5_decontamination,
        "op6_fingerprints": op6_fingerprints,
        "op7_pii": op7_pii,
        "op8_line_dedup": op8_line_dedup,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_url_filters": op10_url_filters,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_simhash": op12_simhash,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_decontamination": OP5_SQL,
        "op8_line_dedup": OP8_SQL,
        "op9_jaccard_join": OP9_SQL,
        "op10_url_filters": OP10_SQL,
        "op11_fill_in_middle": OP11_SQL,
    }
