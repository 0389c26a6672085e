"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, line_templates, packing, pii, suffix_dedup, topk, toxicity, warc
from .jaccard import jaccard_components


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary() -> str:
    """The byte-level vocabulary's file; only its path is used, it is no part of the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, by its own lines or by the nearest directory above.

    The table has no paths, so a document's is /<source>/<lang>/<doc_id>.txt."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    return licenses.scan(docs.select("doc_id", "text", path.alias("path")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte runs of earlier ones."""
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector against all."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many recur across documents, and a digest of what is left."""
    out = line_templates.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.summary(pii.find(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 5-word-shingle Jaccard links of 0.8 and more."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half of a test item or more, in any order of its parts."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_suffix_dedup, op3_packing, op4_topk, op5_warc, op6_line_dedup, op7_pii, op8_toxicity, op9_jaccard_join, op10_decontamination)}


def _licence_sql() -> str:
    """The scan over documents: TF-IDF over lines and blocks with licence words, directories and their ancestors.

    No path of the query is named like a licence file, so whole files are no regions here."""
    vectors = ", ".join(f"('{name}', {k}, '{w}', {n})" for (name, k), t in licenses._forms().items() for w, n in t.items())
    terms = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' p, coalesce(text, '') t FROM documents),
tv(license, template, w, n) AS (VALUES {vectors}),
total AS (SELECT count(*) c FROM d),
cued AS (SELECT doc_id, p, len({terms.format('t')}) words, t FROM d WHERE regexp_matches(t, '{licenses.CUE}')),
l AS (SELECT doc_id, p, words, unnest(string_split(t, chr(10))) x, generate_subscripts(string_split(t, chr(10)), 1) - 1 i FROM cued
      UNION ALL SELECT doc_id, p, words, unnest(regexp_split_to_array(t, '\\n[ \\t\\r]*\\n')) x, -generate_subscripts(regexp_split_to_array(t, '\\n[ \\t\\r]*\\n'), 1) i FROM cued),
u AS (SELECT doc_id, p, words, i, w, count(*) n FROM (SELECT doc_id, p, words, i, unnest({terms.format('x')}) w FROM l
      WHERE regexp_matches(x, '{licenses.CUE}') AND (i >= 0 OR contains(x, chr(10)))) GROUP BY ALL),
df AS (SELECT w, count(*) c FROM (SELECT DISTINCT doc_id, unnest({terms.format('t')}) w FROM d) GROUP BY w),
idf AS (SELECT w, ln((1 + total.c) / (1 + coalesce(df.c, 0))) + 1 v FROM (SELECT w FROM tv UNION SELECT w FROM u) LEFT JOIN df USING (w), total),
tn AS (SELECT license, template, sqrt(sum((n * v) * (n * v))) norm FROM tv JOIN idf USING (w) GROUP BY ALL),
vec AS (SELECT license, template, w, n * v / norm tw FROM tv JOIN idf USING (w) JOIN tn USING (license, template)),
tf AS (SELECT u.*, u.n * v v FROM u JOIN idf USING (w)),
nm AS (SELECT doc_id, i, sqrt(sum(v * v)) norm, sum(n) in_line FROM tf GROUP BY ALL),
cs AS (SELECT doc_id, p, words, i, license, in_line, round(sum(v * tw) / norm, 6) score FROM tf JOIN vec USING (w) JOIN nm USING (doc_id, i) GROUP BY doc_id, p, words, i, license, template, in_line, norm),
bl AS (SELECT * FROM cs WHERE score >= {licenses.LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY score DESC, license) = 1),
lc AS (SELECT doc_id, greatest(coalesce(sum(in_line) FILTER (i >= 0), 0), coalesce(max(in_line) FILTER (i < 0), 0)) licensed FROM bl GROUP BY doc_id),
own AS (SELECT doc_id, p, license, score, CASE WHEN licensed >= {licenses.OWN_SHARE} * words THEN 'file' ELSE 'header' END origin FROM bl JOIN lc USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
here AS (SELECT regexp_replace(p, '/?[^/]*$', '') place, license, score FROM own WHERE origin = 'file' QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, license) = 1),
dirs AS (SELECT DISTINCT regexp_replace(p, '/?[^/]*$', '') dir FROM d),
up AS (SELECT dir, array_to_string(list_slice(string_split(dir, '/'), 1, k), '/') place FROM dirs, LATERAL (SELECT unnest(range(0, len(string_split(dir, '/')) + 1)) k)),
near AS (SELECT dir, place, license, score FROM up JOIN here USING (place) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(place) DESC) = 1)
SELECT d.doc_id, coalesce(own.license, near.license) license, coalesce(own.score, near.score) score,
       CASE WHEN own.license IS NULL AND near.license IS NOT NULL THEN 'inherited' ELSE own.origin END origin, CASE WHEN own.license IS NULL THEN near.place END directory
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN near ON near.dir = regexp_replace(d.p, '/?[^/]*$', '')"""


#: Quantised vectors, all scores of the query rows, the ten best of each.
_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) r FROM s) WHERE r <= 10"""
#: SHA-1 in base 32, five bits of the hexadecimal digest at a time; the largest page_id of equal payloads.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
b AS (SELECT page_id, h, array_to_string(list_transform(string_split(sha1(h), ''), lambda d: lpad(bin(instr('0123456789abcdef', d) - 1), 4, '0')), '') bits FROM p),
d AS (SELECT page_id, h, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda k: CAST(substr(bits, CAST(5 * i + k + 1 AS INT), 1) AS INT) * (16 >> CAST(k AS INT)))) AS INT), 1)), '') x FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) last FROM d)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) payload_bytes, x payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END record_type, CASE WHEN page_id < last THEN last END refers_to
FROM m"""
#: Every 50-byte string and the smallest document that has it; runs of removed bytes; what lies between.
_SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) n FROM documents),
p AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 100)) h FROM d, LATERAL (SELECT unnest(range(0, n - 49)) i)),
m AS (SELECT h, min(doc_id) m FROM p GROUP BY h),
r AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) gap FROM p JOIN m USING (h) WHERE m < doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) k FROM r),
s AS (SELECT doc_id, min(i) a, max(i) + 50 z FROM g GROUP BY doc_id, k),
t AS (SELECT doc_id, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) nx FROM s),
f AS (SELECT doc_id, sum(z - a) removed, count(*) spans, min(a) first FROM s GROUP BY doc_id),
k AS (SELECT t.doc_id, string_agg(substr(x, 2 * z + 1, 2 * (coalesce(nx, n) - z)), '' ORDER BY a) tail FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT d.doc_id, n n_bytes, CAST(coalesce(removed, 0) AS BIGINT) n_removed, coalesce(spans, 0) n_spans, sha256(unhex(CASE WHEN first IS NULL THEN x ELSE substr(x, 1, 2 * first) || tail END)) kept_sha256
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)"""
#: Lines, leaves, constants, candidates and the contexts of their runs, as in the operator; "0" stands for masked fields.
_LINES = """
WITH x AS (SELECT doc_id, unnest(l) l, generate_subscripts(l, 1) - 1 i, len(l) - 1 last
           FROM (SELECT doc_id, string_split(text, chr(10)) l FROM documents WHERE length(text) > 0)),
w AS (SELECT doc_id, i, list_transform(list_filter(regexp_split_to_array(l, '[\\x09-\\x0D ]+'), lambda t: t <> ''),
                                       lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '0' ELSE t END) w
      FROM x WHERE NOT (l = '' AND i = last)),
f AS (SELECT *, len(w) n, CASE WHEN len(w) > 50 THEN 2 ELSE 5 END least, len(w) || ' ' || array_to_string(w[1:2], ' ') leaf FROM w),
h AS (SELECT leaf FROM f WHERE n >= 4 GROUP BY leaf, least HAVING count(DISTINCT doc_id) >= least),
t AS (SELECT doc_id, i, leaf, least, n, pos, w[pos] tok FROM (SELECT *, unnest(range(1, n + 1)) pos FROM f JOIN h USING (leaf) WHERE n >= 4)),
k AS (SELECT leaf, pos, tok FROM t WHERE tok <> '0' GROUP BY leaf, pos, tok, least HAVING count(DISTINCT doc_id) >= least),
s AS (SELECT doc_id, i, least, leaf || '|' || string_agg(pos || ' ' || tok, ' ' ORDER BY pos) tpl
      FROM t JOIN k USING (leaf, pos, tok) GROUP BY doc_id, i, leaf, least, n HAVING count(*) >= 0.6 * n),
a AS (SELECT tpl, least, min(doc_id) first FROM s GROUP BY tpl, least HAVING count(DISTINCT doc_id) >= least),
c AS (SELECT doc_id, i, tpl, least, first FROM s JOIN a USING (tpl, least)),
o AS (SELECT f.doc_id, f.i, f.n, f.leaf, c.tpl, CASE WHEN c.tpl IS NULL AND f.n >= 4 THEN f.leaf END own
      FROM f LEFT JOIN c ON c.doc_id = f.doc_id AND c.i = f.i WHERE f.doc_id IN (SELECT doc_id FROM c)),
e AS (SELECT doc_id FROM o GROUP BY doc_id HAVING coalesce(sum(n) FILTER (own IS NOT NULL), 0) >= sum(n) / 3),
r AS (SELECT doc_id, i, tpl,
             coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' ||
             coalesce(first_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ctx
      FROM o),
v AS (SELECT tpl, count(DISTINCT d.text) texts, count(DISTINCT ctx) contexts
      FROM r JOIN e USING (doc_id) JOIN documents d USING (doc_id) WHERE tpl IS NOT NULL GROUP BY tpl),
g AS (SELECT DISTINCT doc_id, i FROM c JOIN v USING (tpl)
      WHERE least(texts, contexts) >= least AND contexts >= 0.5 * texts AND (least(texts, contexts) >= 5 OR doc_id <> first)),
z AS (SELECT x.doc_id, count(*) n_lines, count(g.i) n_dropped, string_agg(l, chr(10) ORDER BY x.i) FILTER (g.i IS NULL) kept
      FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_dropped, 0) n_dropped, sha256(coalesce(kept, '')) kept_sha256
FROM documents d LEFT JOIN z USING (doc_id)"""
#: Whole shingle sets, every pair that shares one, and reachability.
_JACCARD = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D ]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') g FROM w, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 4) + 1)) i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, min(r.c) component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query over whole tables in reasonable time."""
    return {"op1_license_scan": _licence_sql(), "op2_suffix_dedup": _SUFFIX, "op4_topk": _TOPK, "op5_warc": _WARC, "op6_line_dedup": _LINES, "op9_jaccard_join": _JACCARD}
