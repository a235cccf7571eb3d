"""Queries of the operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import decontamination, embeddings, jaccard, langid, licenses, mixing, pii, quality, secrets, sharding
from ledgerfold.llm._store import fresh


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.curriculum(_table(spark, sf_dir, "documents"))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    return plan.select(
        "doc_id", "size", "source_size", "target",
        taken.alias("taken"), F.round(F.get("parts", 0)["moment"], 9).alias("first_moment"),
    ).orderBy(F.col("first_moment").asc_nulls_last(), "doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.score(docs, quality.fit(docs, ratings))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.run(docs, fresh(spark, "secrets-ledger")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.inherit(docs.select("doc_id", licenses.document_path().alias("path")), licenses.detect(docs))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs), declared=F.col("lang"), host=F.col("source"), stay=("doc_id",))
    return found.select("doc_id", "language", "probability", "accepted")


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over pages, where markup, addresses and hosts give evidence."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    pages = _table(spark, sf_dir, "pages").withColumn("text", bare)
    found = langid.identify(
        pages, langid.fit(_table(spark, sf_dir, "documents")),
        declared=langid.markup_language("html"), suffix=langid.address_suffix("url"),
        host=langid.host_of("url"), domain=langid.domain_of("url"), stay=("page_id",),
    )
    return found.select("page_id", "language", "probability", "accepted")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(_table(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs).drop("text")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"), k=4, num=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_langid": op6_langid,
    "langid_pages": langid_pages,
    "op7_pii": op7_pii,
    "op8_sharding": op8_sharding,
    "op9_embeddings": op9_embeddings,
    "op10_jaccard": op10_jaccard,
}

def _licences_sql() -> str:
    """Line by line and paragraph by paragraph, every one against every template."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(licenses.TEMPLATES))
    words = lambda x: f"list_filter(string_split_regex(translate(lower({x}), m.marks, repeat(' ', length(m.marks))), '[ \\n]+'), lambda w: w <> '')"
    parent = lambda x: f"CASE WHEN contains({x}, '/') THEN regexp_replace({x}, '/[^/]*$', '') ELSE '' END"
    return f"""WITH m AS (SELECT concat('.,;:()[]"''/-*#', chr(9), chr(13)) AS marks), t(template, licence, notice) AS (VALUES {rows}),
tw AS (SELECT template, licence, unnest({words('notice')}) AS word FROM t, m), v AS (SELECT DISTINCT word FROM tw),
d AS (SELECT doc_id, text, {words('text')} AS ws FROM documents, m WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM documents),
h AS (SELECT DISTINCT doc_id, unnest(ws) AS word FROM d), df AS (SELECT word, count(doc_id) AS df FROM v LEFT JOIN h USING (word) GROUP BY word),
i AS (SELECT word, ln((n + 1.0) / least(df + 1.0, n + 0.5)) AS idf FROM df, n),
tv AS (SELECT template, licence, word, count(*) * any_value(idf) AS y FROM tw JOIN i USING (word) GROUP BY template, licence, word), tn AS (SELECT template, sqrt(sum(y * y)) AS t_norm FROM tv GROUP BY template),
u AS (SELECT doc_id, len(ws) AS words, 'line' AS kind, unnest(string_split(text, chr(10))) AS content FROM d
  UNION ALL SELECT doc_id, len(ws), 'paragraph', unnest(list_filter(string_split_regex(text, '\n[ \t\r]*\n'), lambda p: contains(p, chr(10)))) FROM d),
un AS (SELECT row_number() OVER () AS unit, doc_id, words, kind, {words('content')} AS ws FROM u, m),
ut AS (SELECT unit, word, count(*) AS tf FROM (SELECT unit, unnest(ws) AS word FROM un) GROUP BY unit, word),
ux AS (SELECT unit, word, tf * coalesce(idf, (SELECT ln(n + 1.0) FROM n)) AS x FROM ut LEFT JOIN i USING (word)), ul AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM ux GROUP BY unit),
sc AS (SELECT unit, template, licence, round(sum(x * y) / any_value(norm * t_norm), 6) AS score FROM ux JOIN tv USING (word) JOIN ul USING (unit) JOIN tn USING (template) WHERE norm * t_norm > 0 GROUP BY unit, template, licence),
be AS (SELECT unit, licence, score FROM sc WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, licence) = 1),
bd AS (SELECT doc_id, words, kind, len(ws) AS length, licence, score FROM be JOIN un USING (unit)),
f AS (SELECT doc_id, least(greatest(sum(CASE kind WHEN 'line' THEN length ELSE 0 END), sum(CASE kind WHEN 'line' THEN 0 ELSE length END)) / any_value(words), 1.0) AS part FROM bd GROUP BY doc_id),
o AS (SELECT doc_id, licence, score FROM bd QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1),
p AS (SELECT doc_id, concat(source, '/', CASE WHEN doc_id % 8 <> 0 THEN concat('part-', doc_id % 61, '/') ELSE '' END, doc_id) AS path FROM documents),
w AS (SELECT p.doc_id, path, licence, score, part, {parent('path')} AS directory FROM p LEFT JOIN o USING (doc_id) LEFT JOIN f USING (doc_id)),
g AS (SELECT directory AS ancestor, licence AS given, score AS given_score FROM w WHERE part >= 0.1 QUALIFY row_number() OVER (PARTITION BY directory ORDER BY part DESC, path) = 1),
s AS (SELECT DISTINCT directory, string_split(directory, '/') AS names FROM w), a AS (SELECT directory, array_to_string(list_slice(names, 1, k), '/') AS ancestor FROM (SELECT *, unnest(range(1, len(names) + 1)) AS k FROM s) UNION SELECT directory, '' FROM s),
r AS (SELECT directory, given, given_score FROM a JOIN g USING (ancestor) QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(ancestor) DESC) = 1)
SELECT doc_id, path, coalesce(licence, given) AS licence, coalesce(score, given_score) AS score, CASE WHEN licence IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin FROM w LEFT JOIN r USING (directory)"""


ORACLE_SQL: dict[str, str] = {
    "op1_mixing": r"""WITH w AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key FROM documents),
s AS (SELECT source, coalesce('=' || source, '') AS skey, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS k FROM w GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, 1000000 * k AS weight, CAST(3 * source_size AS DOUBLE) / CAST(1000000 * k AS DOUBLE) AS ratio FROM s),
b AS (SELECT *, sum(cap) OVER (ORDER BY ratio, skey ROWS UNBOUNDED PRECEDING) - cap AS cap_before, sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio, skey ROWS UNBOUNDED PRECEDING) + weight AS weight_from,
  sum(source_size) OVER () AS total FROM r),
f AS (SELECT *, (total - cap_before) * weight >= cap * weight_from AS is_full FROM b),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS DOUBLE) * CAST(weight AS DOUBLE)
  / CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target, k * (1.5 - (k - 1) / 2.0)::DOUBLE AS w0, k * ((k - 2) * 1.0)::DOUBLE AS dw FROM f),
p AS (SELECT doc_id, size, source_size, target, w0, dw, sum(size) OVER (PARTITION BY w.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS start FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN start + e * source_size < target THEN least(size, ceil(target - (start + e * source_size))) ELSE 0 END) AS BIGINT) AS taken,
  any_value(CASE WHEN start < target THEN round(2 * (start / target * (w0 + dw / 2)) / (w0 + sqrt(greatest(w0 * w0 + 2 * dw * (start / target * (w0 + dw / 2)), 0))), 9) END) AS first_moment
FROM p, (VALUES (0), (1), (2)) v(e) GROUP BY doc_id, size, source_size, target, start""",
    "op5_licenses": _licences_sql(),
    "op9_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op10_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS pos FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, pos, pos + 3), ' ') AS shingle FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM w JOIN r ON r.a = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
}
