"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_trie import rebuilt_trie
from .decontaminate import contaminated, find_contamination
from .embedding_dedup import dedup_embeddings
from .fingerprints import edited_likeness
from .language import classify_language
from .line_dedup import dedup_lines
from .lm_score import score_documents
from .packing import pack_documents
from .pipeline import pack_digest
from .simhash import print_hex, simhash_dedup
from .spelling import spelling_variants
from .token_output import token_digests, write_to_stage
from .toxicity import classify_toxicity
from .url_filter import filter_urls

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {BLANKS}), {UPPER_LOWER}) AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
           GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id <> shared.keeper AS gone
           FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), added_tokens=True))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify_toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc.doc_id", "held_out", "score", "predicted")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UL}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, {UL}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN iw USING (n, g)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""".replace("{UL}", UPPER_LOWER)

#: The rules that the query's contract fixes: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("doc.page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP6_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {UPPER_LOWER}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rhost, rpath, verdict) AS (VALUES {_RULE_ROWS}),
fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, rule) AS n
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT parts.page_id, host, path, fits.rule AS rule, coalesce(fits.verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND fits.n = 1
"""

def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, max_bits=3)
    return out.select("doc_id", print_hex(F.col("print")).alias("fingerprint"), "component_id")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark, write_to_stage(table(spark, sf_dir, "documents").select("doc_id", "text"), added_tokens=True))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc.doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Rows of crc32's table by its rule, and the crc32 of a list of bytes; the SQL around it has ``tab`` in scope.
CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab"""


def crc_sql(byte_list: str) -> str:
    return (f"xor(list_reduce(list_concat([4294967295], {byte_list}), "
            "lambda a, x: xor(a // 256, tab[xor(a % 256, x) + 1])), 4294967295)")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = f"""
WITH crc AS ({CRC_TABLE}),
turns AS (
  SELECT conv_id, md5(length(r) || ':' || r || t) AS id, length(t) AS ch,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || t)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, {crc_sql("list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))")} % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turns), crc),
rebuilt AS (
  SELECT c, 0 AS side, pos, id, ch FROM convs JOIN turns ON conv_id = c - c % 100 AND pos <= h
  UNION ALL SELECT c, 1, pos, id, ch FROM convs JOIN turns ON conv_id = c AND pos > h),
placed AS (SELECT c, id, ch, row_number() OVER (PARTITION BY c ORDER BY side, pos) AS d FROM rebuilt),
paths AS (
  SELECT c, d, ch, string_agg(id, ',') OVER (PARTITION BY c ORDER BY d) AS path FROM placed
  UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (
  SELECT d, path, min(c) AS top, count(*) AS n, any_value(ch) AS ch,
         string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = deepest) AS ends
  FROM (SELECT *, max(d) OVER (PARTITION BY c) AS deepest FROM paths) GROUP BY d, path),
placed_nodes AS (
  SELECT n.*, p.path AS above FROM nodes n LEFT JOIN paths p ON p.c = n.top AND p.d = n.d - 1),
kids AS (SELECT d - 1 AS d, above AS path, count(*) AS n_children FROM placed_nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT placed_nodes.*, coalesce(n_children, 0) AS n_children FROM placed_nodes LEFT JOIN kids USING (d, path)),
trees AS (
  SELECT a.d, a.path, sum((v.n - 1) * v.ch) AS saved, count(*) FILTER (WHERE v.n_children = 0) AS leaves
  FROM full_nodes v JOIN paths a ON a.c = v.top AND a.d <= v.d GROUP BY 1, 2)
SELECT f.top AS conv_id, CAST(f.d AS BIGINT) AS depth, p.top AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs,
       CAST(f.n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_nodes f JOIN trees USING (d, path) LEFT JOIN nodes p ON p.d = f.d - 1 AND p.path = f.above
"""


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), delete_every=199)


_UTF8 = "[192 + ord(x) // 64, 128 + ord(x) % 64]"  # the letters beyond ASCII end at U+00FF
_UTF8_BYTES = ("flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), "
               f"lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE {_UTF8} END))")
OP13_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (
  SELECT doc_id, w, count(*) AS k
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), {UPPER_LOWER}) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY doc_id, w),
hashed AS (SELECT w, k, {crc_sql(_UTF8_BYTES)} AS h FROM runs, crc),
vocab AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN vocab b ON a.rest = b.word),
best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, n AS other_n,
         row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place FROM near),
forms AS (
  SELECT vocab.word, vocab.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * vocab.n THEN other END AS form,
         CASE WHEN other_n >= 5 * vocab.n THEN other_n END AS form_n
  FROM vocab LEFT JOIN best ON best.word = vocab.word AND place = 1),
chain AS (
  SELECT word, word AS here FROM forms
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.here WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, chain.here AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain ON chain.word = f.word JOIN forms e ON e.word = chain.here AND e.form IS NULL
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_packing, op3_toxicity, op4_embedding_dedup, op5_decontamination, op6_url_filters,
    op7_simhash_dedup, op8_token_output, op9_language_id, op10_lm_scoring, op11_conversation_trie,
    op12_fingerprints, op13_spelling_variants)}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op5_decontamination": OP5_SQL, "op6_url_filters": OP6_SQL,
                              "op11_conversation_trie": OP11_SQL, "op13_spelling_variants": OP13_SQL}
