"""The registered queries of this subpackage: each applies its operator to a whole table; SQL oracles where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, line_dedup, media, mixing, ngram_join, ppm, prefix_trie, token_files, toxicity, vector_codes, warc
from .common import crc_mod, new_path


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_t(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 3) == 1)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(_t(spark, sf_dir, "documents"))


def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.ppm_score(_t(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_t(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_t(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(_t(spark, sf_dir, "documents"))


def op8_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = new_path(spark, "warc"), _t(spark, sf_dir, "pages")
    warc.write_warc(pages, path)
    return warc.page_digests(spark, path, pages.schema["page_id"].dataType.simpleString())


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(_t(spark, sf_dir, "documents"), new_path(spark, "media"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) == 1)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_t(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode_vectors(_t(spark, sf_dir, "embeddings"))
    sha = vector_codes.books_sha256(books)
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    token_files.write_token_files(_t(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.token_digests(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ppm_scoring": op1_ppm_scoring,
    "op2_license_scan": op2_license_scan,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_id": op6_language_id,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_warc_roundtrip": op8_warc_roundtrip,
    "op9_media_columns": op9_media_columns,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_files": op13_token_files,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _codes_sql() -> str:
    """Lloyd's rounds written out: assignments of each round against all entries, then means that go down."""
    squares = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"
    nearest = f"SELECT part.id, part.p, part.x, min({{'d': {squares}::BIGINT, 'e': e}}) AS best FROM part JOIN BOOKS USING (p) GROUP BY 1, 2, 3"
    means = """SELECT p, e, list(q ORDER BY i) AS y FROM (SELECT b.p, b.e, i, CASE WHEN s.n IS NULL THEN any_value(b.y[i]) ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS q
  FROM (SELECT *, unnest(range(1, len(y) + 1)) AS i FROM BOOKS) b LEFT JOIN (SELECT p, best.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM CODES) GROUP BY 1, 2, 3) s USING (p, e, i) GROUP BY b.p, b.e, i, s.s, s.n) GROUP BY 1, 2"""
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT id, vec_id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM (SELECT *, unnest(range(16)) AS p FROM kept)),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, x AS y FROM part WHERE id <= 64),
a0 AS MATERIALIZED ({nearest.replace("BOOKS", "b0")}), b1 AS MATERIALIZED ({means.replace("BOOKS", "b0").replace("CODES", "a0")}),
a1 AS MATERIALIZED ({nearest.replace("BOOKS", "b1")}), b2 AS MATERIALIZED ({means.replace("BOOKS", "b1").replace("CODES", "a1")}),
a2 AS MATERIALIZED ({nearest.replace("BOOKS", "b2")}),
c AS (SELECT id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS sha FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM kept JOIN c USING (id), h
"""


ORACLE: dict[str, str] = {
    "op2_license_scan": licenses.oracle_sql(),
    "op3_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM b),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1)
SELECT ds.doc_id, bs.item_id, n.n::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*) / n.n::DOUBLE AS containment
FROM ds JOIN bs USING (g) JOIN n ON n.item_id = bs.item_id GROUP BY 1, 2, n.n HAVING count(*) * 100 >= n.n * 75
""",
    "op4_line_dedup": r"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT coalesce(source, '') AS host, count(*) AS total FROM documents GROUP BY 1),
c AS (SELECT host, trim(line) AS line, count(DISTINCT doc_id) AS pages FROM l WHERE trim(line) <> '' GROUP BY 1, 2),
bad AS (SELECT c.host, c.line FROM c JOIN t USING (host) WHERE pages >= 2 AND pages > 0.1::DOUBLE * total),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY pos) FILTER (bad.line IS NULL) AS text, count(*) AS n_lines, count(bad.line) AS n_dropped
  FROM l LEFT JOIN bad ON bad.host = l.host AND bad.line = trim(l.line) GROUP BY 1)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN k USING (doc_id)
""",
    "op5_source_mixing": r"""
WITH RECURSIVE m AS (SELECT source, greatest(coalesce(sum(length(text)), 0), 1)::DOUBLE AS mass FROM documents GROUP BY 1),
r AS (SELECT source, (SELECT sum(mass) FROM m) * (pow(mass, 0.5) / (SELECT sum(pow(mass, 0.5)) FROM m)) / mass AS rate FROM m),
parts AS (SELECT source, rate, greatest(ceil(rate / 100.0), 1)::INTEGER AS parts FROM r),
q AS (SELECT source, parts, rate / parts AS rate, ceil(rate / parts + 12.0 * sqrt(rate / parts) + 20.0)::INTEGER AS last FROM parts),
c AS (SELECT source, parts, rate, last, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM q
  UNION ALL SELECT source, parts, rate, last, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < last),
cdf AS (SELECT source, parts, list(cdf ORDER BY k) AS cdf FROM c GROUP BY 1, 2),
n AS (SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cdf.cdf, lambda x: x <= ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE))))::INTEGER AS number
  FROM documents d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source),
x AS (SELECT n.* EXCLUDE (number), unnest(range(1, number + 1))::INTEGER AS replica FROM n)
SELECT x.*, md5('mix:order:' || coalesce(doc_id::VARCHAR, '') || ':' || replica) AS shuffle_key FROM x
""",
    "op7_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 75 * (p.n + q.n - m)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y)::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY 1, 2
""",
    "op8_warc_roundtrip": r"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
m AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(p.h, (1 + 5 * (i // 4))::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN m USING (h)
""",
    "op11_conversation_trie": r"""
WITH o AS (SELECT conv_id, list({'k': length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''), 'n': length(coalesce(text, ''))}
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT conv_id, t, (xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 6)::INTEGER AS h FROM o),
r AS (SELECT a.conv_id, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS t FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 100),
m AS (SELECT conv_id, len(t) AS turns, d, list_transform(t[1:d], lambda x: x.k) AS p, CASE WHEN d > 0 THEN t[d].n ELSE 0 END AS n FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM r)),
node AS (SELECT p, d, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = d), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
whole AS (SELECT node.*, coalesce(kids.n_children, 0) AS n_children FROM node LEFT JOIN kids USING (p)),
sub AS (SELECT p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM whole) GROUP BY 1)
SELECT w.conv_id, w.d::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children, sub.n_leaves::BIGINT AS n_leaves, sub.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN sub USING (p) LEFT JOIN node up ON w.d > 0 AND up.p = w.p[1:w.d - 1]
""",
    "op12_vector_codes": _codes_sql(),
}
