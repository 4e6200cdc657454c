"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import packing

    return packing.round_trip(table(spark, sf_dir, "documents"), byte_bpe_ranks(), capacity=2048)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import substring

    docs = table(spark, sf_dir, "documents")
    return substring.report(docs, substring.repeated(docs))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import embed

    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import langid

    docs = table(spark, sf_dir, "documents")
    held = langid.fold("doc_id", 5) == 0
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import quality
    from quarry.llm._cluster import stored
    from quarry.llm.langid import fold

    stats = stored(quality.statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    rules = quality.fit(stats.join(labels, "doc_id"))
    scored = stats.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), rules.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import decontaminate

    return decontaminate.report(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import katz
    from quarry.llm.langid import fold

    scored = katz.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2, order=3)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe_ranks())


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import jaccard

    return jaccard.Join(table(spark, sf_dir, "documents"), k=3, percent=90).components()


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import hardneg

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), hardneg.integers(F.col("embedding")).alias("v"))
    return hardneg.mine(rows, F.col("id") % 50 == 0)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import resample

    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import pii

    return pii.report(pii.extract(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_packing": op1_token_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_katz_backoff": op8_katz_backoff,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_personal_data": op13_personal_data,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op10_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i:i + 2], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
o AS (SELECT a.doc_id a, b.doc_id b, count(*) o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT n_shingles, min(c) component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1""",
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) n FROM win) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT p) gone FROM (SELECT doc_id, unnest(range(i, i + 35)) p FROM rep) GROUP BY 1),
words AS (SELECT doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p FROM d),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) p FROM rep),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) t FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(len(gone), 0)::BIGINT n_removed, sha256(coalesce(t, '')) kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op3_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] x FROM embeddings
  WHERE len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
e AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) >= 0.95 * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))),
r AS (SELECT vec_id, vec_id c FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.c),
n AS (SELECT a, count(*) n FROM e GROUP BY 1)
SELECT vec_id, coalesce(any_value(n.n), 0)::BIGINT n_links, min(c) component_id, vec_id = min(c) kept FROM r LEFT JOIN n ON a = vec_id GROUP BY 1""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') h, strlen(coalesce(html, '')) n FROM pages),
m AS (SELECT h, max(page_id) kept FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, n::BIGINT payload_bytes, sha1(h) payload_digest,
  CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN kept <> page_id THEN kept END refers_to
FROM p LEFT JOIN m USING (h)""",
    "op7_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, s, array_to_string(w[i:i + s - 1], ' ') g
  FROM (SELECT item_id, w, least(10, len(w)) s, unnest(range(1, len(w) - least(10, len(w)) + 2)) i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT s FROM bw),
dw AS (SELECT doc_id, i, s, array_to_string(w[i:i + s - 1], ' ') g
  FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) i FROM d, sizes WHERE len(w) >= s)),
hit AS (SELECT DISTINCT doc_id, i, s, item_id FROM dw JOIN bw USING (s, g)),
pos AS (SELECT doc_id, count(*) n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + s)) p FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(*) n, string_agg(id, ',' ORDER BY id) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(pos.n, 0)::BIGINT n_hit, coalesce(found.n, 0)::BIGINT n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(pos.n, 0) > 0 contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END l, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)) x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT a.vec_id a, b.vec_id b, a.l = b.l same, list_dot_product(a.x, b.x)::BIGINT s FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p.b, p.s ps, s.b nb, s.s ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) k
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a anchor_id, b positive_id, k::INTEGER "rank", nb negative_id, ps positive_score, ns negative_score FROM n WHERE k <= 3""",
    "op12_importance_resampling": rf"""
WITH RECURSIVE bits AS (SELECT i v, i c, 0 k FROM range(256) r(i)
  UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT v, c FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
df AS (SELECT doc_id, g, count(*) n FROM (SELECT doc_id, unnest(w) g FROM d
  UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) i FROM d)) GROUP BY 1, 2),
bf AS (SELECT g, count(*) n FROM (SELECT unnest(w) g FROM b
  UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) i FROM b)) GROUP BY 1),
hx AS (SELECT g, hex(encode(g)) x FROM (SELECT g FROM df UNION SELECT g FROM bf)),
crc AS (SELECT g, x, 4294967295::BIGINT a, 1 k FROM hx
  UNION ALL SELECT g, x, xor(a >> 8, tab.c), k + 2 FROM crc
  JOIN tab ON tab.v = xor(a, (strpos('0123456789ABCDEF', x[k]) - 1) * 16 + strpos('0123456789ABCDEF', x[k + 1]) - 1) & 255 WHERE k < len(x)),
h AS (SELECT g, xor(a, 4294967295) % 10000 bucket FROM crc WHERE k > len(x)),
s AS (SELECT bucket, sum(n) n FROM df JOIN h USING (g) GROUP BY 1),
t AS (SELECT bucket, sum(n) n FROM bf JOIN h USING (g) GROUP BY 1),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000)
  / ((coalesce(s.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT doc_id, sum(n)::BIGINT n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT weight FROM df JOIN h USING (g) JOIN gains USING (bucket) GROUP BY 1),
v AS (SELECT doc_id, len(w) words, coalesce(m.n, 0)::BIGINT n_features, coalesce(weight, 0)::BIGINT weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT score FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) k FROM v WHERE words >= 20)
SELECT doc_id, n_features, weight, score::BIGINT score, CASE WHEN k <= 25 * (SELECT count(*) FROM r) // 100 THEN k END "rank" FROM v LEFT JOIN r USING (doc_id)""",
}
