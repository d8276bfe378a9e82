"""The thin queries over the synthetic tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract, language_model, licenses, mixing, perplexity, personal_data, phrase_index, quality_rules, simhash, suffix_dedup
from .shared import KEY, table


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Shares of tokens by domain, and tokens wanted per token there is, for the mixing query and the pipeline's last stage.
TARGETS, EPOCHS = {"clean": 0.97, "low": 0.01, "toxic": 0.02}, 1.25


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    found = mixing.mix(table(spark, sf_dir, "documents"), labelled, TARGETS, keep=("source",), epochs=EPOCHS)
    chances = (F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(TARGETS))
    return found.select("doc_id", "source", "n_tokens", *chances, "rate", "n_copies")


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop(KEY)


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS p FROM d)),
m AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM m),
n AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
s AS (SELECT doc_id, span, min(p) AS a, max(p) + 400 AS z FROM n GROUP BY doc_id, span),
c AS (SELECT doc_id, a AS z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a FROM s
  UNION ALL SELECT doc_id, len(h) // 2, coalesce((SELECT max(s.z) FROM s WHERE s.doc_id = d.doc_id), 0) FROM d),
t AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS kept FROM c JOIN d USING (doc_id) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN r USING (doc_id)
"""


#: Words by which each word of a window may be out of place in a near match.
SLOP = 1


def op4_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def phrase_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which all words of a window are near their places, though no exact copy need be: doc_id and the items."""
    found = phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.where(F.size("near_items") > 0).select("doc_id", F.array_join("items", ",").alias("items"), F.array_join("near_items", ",").alias("near_items"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM bk),
lens AS (SELECT DISTINCT n FROM win),
dk AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n),
hit AS (SELECT dk.doc_id, dk.k, dk.n, win.item FROM dk JOIN win ON dk.n = win.n AND array_to_string(dk.w[dk.k : dk.k + dk.n - 1], ' ') = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_spans(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *(count(k) for k in personal_data.KINDS), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(every).alias("spans"))


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "n_words", "perplexity", "threshold", "type_perplexity", "type_threshold", "kept")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, each in a folder of its own: nothing says that they belong together, so none could inherit from another, and inheritance is left out."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string"), F.lit("text.txt")).alias("path"), "text")
    return licenses.scan(files, keep=("doc_id",), inherit=False)


def op10_sql() -> str:
    """Weights are computed from the templates' texts anew."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({quoted(name)}, {k}, {quoted(text)})" for name, texts in licenses.TEMPLATES.items() for k, text in enumerate(texts))
    return rf"""
WITH templates(license, notice, text) AS (VALUES {listed}),
tt AS (SELECT license, notice, term, count(*) AS tf FROM (SELECT license, notice, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM templates) GROUP BY ALL),
total AS (SELECT count(*)::DOUBLE AS n FROM templates),
idf AS (SELECT term, ln((max(n) + 1) / (count(*) + 1)) + 1 AS idf FROM tt, total GROUP BY term),
tw AS (SELECT license, notice, term, (1 + ln(tf)) * idf AS w FROM tt JOIN idf USING (term)),
tn AS (SELECT license, notice, sqrt(sum(w * w)) AS norm FROM tw GROUP BY ALL),
tv AS (SELECT license, notice, term, w / norm AS weight FROM tw JOIN tn USING (license, notice)),
d AS (SELECT doc_id, coalesce(source, 'none') || '/' || doc_id || '/text.txt' AS path, text FROM documents),
l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '
?
')) AS q FROM d UNION ALL
  SELECT doc_id, q FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '
[ 	
]*
')) AS q FROM d) WHERE contains(q, chr(10))),
p AS (SELECT DISTINCT doc_id, trim(q) AS q FROM l WHERE regexp_matches(q, '{licenses.CUE}') AND NOT regexp_matches(q, '{licenses.DENIED}')),
u AS (SELECT q, unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS term FROM (SELECT DISTINCT q FROM p)),
f AS (SELECT q, term, count(*) AS tf FROM u GROUP BY q, term),
w AS (SELECT q, term, tf, (1 + ln(tf)) * coalesce(idf, ln(n + 1) + 1) AS w FROM f LEFT JOIN idf USING (term), total),
n AS (SELECT q, sqrt(sum(w * w)) AS norm FROM w GROUP BY q),
t AS (SELECT q, license, notice, sum(w * weight) AS dot FROM w JOIN tv USING (term) GROUP BY ALL),
g AS (SELECT q, license, round(max(dot), 9) AS dot FROM t GROUP BY ALL),
b AS (SELECT q, license, dot, row_number() OVER (PARTITION BY q ORDER BY dot DESC, license DESC) AS place FROM g),
c AS (SELECT b.q, b.license, round(b.dot / norm, 6) AS cosine, round(coalesce(s.dot, 0) / norm, 6) AS next FROM b JOIN n USING (q) LEFT JOIN b s ON s.q = b.q AND s.place = 2 WHERE b.place = 1),
o AS (SELECT doc_id, max({{'cosine': cosine, 'license': license}}) AS own FROM p JOIN c USING (q) WHERE cosine >= {licenses.LEAST_COSINE} AND round(cosine - next, 6) >= {licenses.LEAD} GROUP BY doc_id)
SELECT d.doc_id, path, own.license AS own_license, own.cosine AS cosine, own.license AS license, CAST(NULL AS VARCHAR) AS inherited_from
FROM d LEFT JOIN o USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_extract, op3_suffix_dedup, op4_phrase_index, op5_quality_rules, op6_simhash, op7_language_model, op8_personal_data, op9_perplexity, op10_licenses, phrase_proximity)}


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": OP3_SQL, "op4_phrase_index": OP4_SQL, "op10_licenses": op10_sql()}
