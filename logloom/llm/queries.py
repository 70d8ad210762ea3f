"""The registered queries of the training-text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, language, negatives, packing, pieces, quality, repeats, sharding, simhash, spots, token_counts, toxicity, vectors
from .common import learnable, table


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    found = repeats.without_repeats(docs).select("record.*", "kept", "spans")
    return found.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM n WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
x AS (SELECT doc_id, p FROM w JOIN m USING (s) WHERE doc_id > first_id),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM x),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
r AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, span),
k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM r GROUP BY doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE substr(h, 1, 2 * a[1]) || array_to_string(list_transform(range(1, len(a) + 1), lambda j: substr(h, 2 * z[j] + 1, 2 * (coalesce(a[j + 1], n.n) - z[j]))), '') END)) AS kept_sha256
FROM n LEFT JOIN k USING (doc_id)
"""


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(learnable(F.col("doc_id"))))
    found = docs.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), language.predicted(F.col("text"), model, spark).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM w q JOIN w x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs.where(learnable(F.col("doc_id"))), table(spark, sf_dir, "labels").where(learnable(F.col("doc_id"))))
    found = docs.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), quality.graded(F.col("text"), model, spark).alias("g"))
    return found.select("doc_id", "held_out", F.col("g.expected").alias("expected_grade"), F.col("g.tail").alias("score"), F.when(F.col("g.tail") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(learnable(F.col("doc_id"))), table(spark, sf_dir, "labels").where(learnable(F.col("doc_id"))))
    return model.scored(docs).select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    both = table(spark, sf_dir, "documents").select("doc_id", pieces.round_trip(F.col("text"), path).alias("p")).select("doc_id", "p.*")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.external_shuffle(table(spark, sf_dir, "documents")).select(
        F.col("record.doc_id").alias("doc_id"),
        "size",
        F.crc32(F.coalesce(F.col("record.text"), F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )



def op10_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, following = F.col("text"), F.col("next_text")
    rows = spots.with_next(table(spark, sf_dir, "documents")).select("doc_id", "text", "next_text", spots.edited(text, following).alias("edited"))
    sets = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *(spots.signatures(F.col(c)).alias(f"s_{c}") for c in ("text", "edited", "next_text")))
    return sets.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spots.digest(F.col("s_text")).alias("fingerprint"),
        spots.digest(F.col("s_edited")).alias("edited_fingerprint"),
        spots.likeness(F.col("s_text"), F.col("s_edited")).alias("near_edited"),
        spots.likeness(F.col("s_text"), F.col("s_next_text")).alias("near_next"),
    )


def spot_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus joined with itself by its fingerprints: each document's class of equal fingerprints, and the class's links."""
    members, links = spots.near_pairs(table(spark, sf_dir, "documents"))
    n = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(n, "class", "left").select("doc_id", F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _signatures_sql(text: str) -> str:
    common = ", ".join(f"'{w}'" for w in dict.fromkeys(spots.COMMON))
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""(SELECT CASE WHEN len(g) > 0 THEN list_sort(list_distinct(g)) ELSE [lower({text})] END FROM (
      SELECT list_transform(list_filter(a, lambda i, j: i - j + 2 < len(c)), lambda i, j: w[i + 1] || ' ' || c[i - j + 2] || ' ' || c[i - j + 3]) AS g FROM (
        SELECT w, list_filter(w, lambda x: x NOT IN ({common})) AS c, list_filter(range(len(w)), lambda i: w[i + 1] IN ({common})) AS a FROM (SELECT {words} AS w))))"""


def _op10_sql() -> str:
    like = "CAST(len(list_intersect({0}, {1})) AS DOUBLE) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n),
s AS (SELECT *, {_signatures_sql("text")} AS st, {_signatures_sql("edited")} AS se, {_signatures_sql("next_text")} AS sn FROM e)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, sha256(array_to_string(st, chr(10))) AS fingerprint,
  sha256(array_to_string(se, chr(10))) AS edited_fingerprint, {like.format("st", "se")} AS near_edited, {like.format("st", "sn")} AS near_next
FROM s
"""


def _links_sql() -> str:
    return f"""
WITH s AS MATERIALIZED (SELECT doc_id, {_signatures_sql("text")} AS s FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
m AS MATERIALIZED (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS class_id FROM s),
c AS MATERIALIZED (SELECT class_id, s, len(s) AS n FROM m WHERE doc_id = class_id),
p AS (SELECT a.class_id AS a, b.class_id AS b, len(list_intersect(a.s, b.s)) AS k, a.n + b.n AS n FROM c a JOIN c b ON a.class_id < b.class_id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM p WHERE k / (n - k)::DOUBLE >= 0.8)
SELECT doc_id, class_id, coalesce(k.links, 0) AS links FROM m LEFT JOIN (SELECT x AS class_id, count(*) AS links FROM (SELECT a AS x FROM l UNION ALL SELECT b FROM l) GROUP BY x) k USING (class_id)
"""


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


OP11_SQL = """
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT q.n AS a, q.vec_id AS anchor_id, q.label = x.label AS same, x.n AS b, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM w q JOIN w x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id AND len(x.v) = len(q.v)),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS r FROM s WHERE same),
g AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id, s.b) AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND p.r <= 5 AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 10
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    found = table(spark, sf_dir, "documents").select("doc_id", n_bytes.alias("n_bytes"), token_counts.counted(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _op13_sql() -> str:
    def near(t: str) -> str:
        return f"""(SELECT n, c AS cluster, distance FROM (SELECT n, c, distance, row_number() OVER (PARTITION BY n ORDER BY distance, c) AS r
          FROM (SELECT x.n, y.c, sum((x.x - y.x) * (x.x - y.x)) AS distance FROM e x JOIN {t} y USING (k) GROUP BY ALL)) WHERE r = 1)"""

    rounds = [
        f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, c{i}.k, CAST(coalesce(m.x, c{i}.x) AS BIGINT) AS x FROM c{i} LEFT JOIN (
      SELECT a.cluster AS c, k, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM {near(f"c{i}")} a JOIN e USING (n) GROUP BY ALL) m USING (c, k))"""
        for i in range(3)
    ]
    return f"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS n, vec_id, v
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
e AS MATERIALIZED (SELECT n, unnest(range(64)) AS k, CAST(unnest(v) AS HUGEINT) AS x FROM w),
c0 AS (SELECT n AS c, k, x FROM e WHERE n < 16),
{", ".join(rounds)},
a AS MATERIALIZED {near("c3")},
s AS (SELECT c AS cluster, sha256(array_to_string(list(x ORDER BY k), ',')) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT w.vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a JOIN s USING (cluster) JOIN w USING (n)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_repeats": op1_repeats, "op2_language": op2_language, "op3_vectors": op3_vectors, "op4_quality": op4_quality, "op5_packing": op5_packing, "op6_toxicity": op6_toxicity, "op7_pieces": op7_pieces, "op8_simhash": op8_simhash, "op9_sharding": op9_sharding, "op10_spots": op10_spots, "op11_negatives": op11_negatives, "op12_token_counts": op12_token_counts, "op13_centroids": op13_centroids, "spot_links": spot_links}
ORACLES: dict[str, str] = {"op1_repeats": OP1_SQL, "op3_vectors": OP3_SQL, "op10_spots": _op10_sql(), "op11_negatives": OP11_SQL, "op13_centroids": _op13_sql(), "spot_links": _links_sql()}
