"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_tokenizer, filter_audit, jaccard_join, mixing, nn_descent, packing, personal_data, quality, scratch, secrets, substring, token_output, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(_table(spark, sf_dir, "pages")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), mixing.word_count(F.col("text")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, keep=["doc_id"])


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.remove_repeats(_table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.references(docs), keep=["doc_id"])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = scratch.folder(spark, "tokens")
    token_output.write_tokens(_table(spark, sf_dir, "documents"), path,
                              public_tokenizers.path("word_bpe_49k.json"), metadata=["source"])
    return token_output.read_back(spark, path)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents")).drop("class", "component")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return cross_tokenizer.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.report(personal_data.find(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_warc": op1_warc, "op2_packing": op2_packing, "op3_toxicity": op3_toxicity,
            "op4_near_vectors": op4_near_vectors, "op5_secrets": op5_secrets, "op6_mixing": op6_mixing,
            "op7_substring": op7_substring, "op8_quality": op8_quality, "op9_token_files": op9_token_files,
            "op10_jaccard_join": op10_jaccard_join, "op11_alignment": op11_alignment,
            "op12_filter_audit": op12_filter_audit, "op13_personal_data": op13_personal_data}


def oracle_sql() -> dict[str, str]:
    return {"op4_near_vectors": _NEAR_SQL, "op6_mixing": _MIX_SQL, "op7_substring": _REPEATS_SQL,
            "op10_jaccard_join": _JACCARD_SQL, "op12_filter_audit": _AUDIT_SQL}


_WORDS = r"len(list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> ''))"

_MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS k,
                  {_WORDS.format(t="coalesce(text, '')")}::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
l AS (SELECT *, 3.0::DOUBLE * source_size AS lim, 3.0::DOUBLE * source_size / weight AS level FROM w),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0.0::DOUBLE))::DOUBLE
                / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS water
      FROM l WINDOW b AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size,
             least(lim, coalesce((SELECT water FROM o WHERE level > water
                                   ORDER BY level, source NULLS LAST LIMIT 1) * weight, lim)) AS target FROM o),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0
             ELSE budget // source_size * size
                  + greatest(0, least(size, budget % source_size - before)) END)::BIGINT AS taken FROM p
"""

_NEAR_SQL = """
WITH RECURSIVE v AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT c.a AS r, min(v.vec_id) AS low FROM c JOIN v ON c.b = v.r GROUP BY c.a),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m.low, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(m.low, v.vec_id)) AS kept
FROM v LEFT JOIN m ON v.r = m.r LEFT JOIN n ON v.r = n.r
"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
             WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * c >= 80 * (na + nb - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id
FROM s LEFT JOIN m ON s.doc_id = m.doc_id
"""

_REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                      lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS x FROM p),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM v) WHERE k > 1),
c AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS gone FROM r GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
           list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]) END,
           ' ')) AS kept_sha256
FROM w LEFT JOIN c ON w.doc_id = c.doc_id
"""

_AUDIT_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, quality IS NOT DISTINCT FROM 1 AS good, toxic IS NOT DISTINCT FROM 1 AS toxic,
             [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
              100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t), regexp_matches(t, '[#$%&*|]'),
              coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
n AS (SELECT unnest(range(1, 6)) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM n a, n b, n c, n d, n e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, f AS step FROM o, n),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT part, filter_order, step, o[step] AS own, n, good, toxic, fails[o[step]] AS failed,
             len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 AS gone,
             len(list_filter(range(1, 6), lambda i: fails[i])) AS n_failed FROM g, s),
r AS (SELECT part, filter_order, step, any_value(own) AS own,
             coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (failed AND NOT gone), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (failed AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (failed AND n_failed = 1), 0)::BIGINT AS unique_fails,
             coalesce(sum(n) FILTER (failed AND NOT gone AND good), 0)::BIGINT AS good_lost,
             coalesce(sum(n) FILTER (failed AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
      FROM h GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
