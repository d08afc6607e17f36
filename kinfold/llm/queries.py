"""Queries of the operators, a thin one each, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embed_dedup, langid, lm, mixing, simhash, tokenids, toxicity, warc
from .common import id_remainder, table

TOXIC = "toxic"
#: Categories of the labels table in the order of the chain.
CATEGORIES = ["low_quality", TOXIC]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def toxicity_models(docs: DataFrame, labels: DataFrame) -> list[dict]:
    return toxicity.train(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), CATEGORIES)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of the documents that hold a benchmark item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mixing.copies(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p_low_quality, is_low_quality, p_toxic, is_toxic), a row per document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity_models(docs, table(spark, sf_dir, "labels")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = warc.round_trip(table(spark, sf_dir, "pages"))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "lang")
    held = id_remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held & F.col("lang").isNotNull()))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model, ("doc_id", "held_out"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_lm_score, op3_mix, op4_toxicity, op5_embedding_dedup, op6_warc, op7_token_ids, op8_simhash, op9_language, op10_chat)}

#: Words of a text as the operators cut them.
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH items AS (
  SELECT item_id, w, least(5, len(w)) AS k
  FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM (SELECT DISTINCT item_id, text FROM {{benchmark}} WHERE item_id IS NOT NULL))
  WHERE len(w) > 0),
item_shingles AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM items, unnest(range(1, len(w) - k + 2)) AS u(i)),
sizes AS (SELECT item_id, count(*) AS item_shingles FROM item_shingles GROUP BY item_id),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM {{documents}} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
doc_shingles AS (SELECT DISTINCT r, doc_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM docs, (SELECT DISTINCT k FROM items), unnest(range(1, len(w) - k + 2)) AS u(i)),
met AS (SELECT r, doc_id, item_id, count(*) AS shared FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles::DOUBLE AS containment
FROM met JOIN sizes USING (item_id) WHERE shared >= 0.8 * item_shingles
"""

OP3_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:{mixing.DIGITS}])::BIGINT AS h
  FROM {{documents}}),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, greatest(0.0::DOUBLE, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))) AS level
  FROM s WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, source_size * 2.0::DOUBLE / weight) AS final FROM l WHERE source_size * 2.0::DOUBLE / weight >= level),
t AS (
  SELECT source, source_size, n_rows, CASE WHEN coalesce(source_size * 2.0::DOUBLE / weight < final, true) THEN source_size * 2.0::DOUBLE ELSE final * weight END AS target,
    ('0x' || md5('{mixing.SEED}:offset:' || coalesce(source, ''))[1:{mixing.DIGITS}])::BIGINT / {float(16**mixing.DIGITS)}::DOUBLE AS u
  FROM l, f),
r AS (
  SELECT doc_id, size, h, t.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS r
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
big AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, h, doc_id NULLS FIRST) AS k FROM r WHERE size * {mixing.LARGE} > source_size),
walk AS (
  SELECT source, 0::BIGINT AS k, 0.0::DOUBLE AS owed, 0.0::DOUBLE AS took, 0.0::DOUBLE AS n FROM t
  UNION ALL
  SELECT walk.source, walk.k + 1, walk.owed + b.size * b.r,
    walk.took + b.size * greatest(floor(b.r), least(ceil(b.r), floor((walk.owed + b.size * b.r - walk.took) / b.size + b.u))),
    greatest(floor(b.r), least(ceil(b.r), floor((walk.owed + b.size * b.r - walk.took) / b.size + b.u)))
  FROM walk JOIN big b ON walk.source IS NOT DISTINCT FROM b.source AND b.k = walk.k + 1),
took AS (SELECT source, arg_max(took, k) AS took FROM walk GROUP BY source),
held AS (SELECT source, sum(size)::BIGINT AS words FROM big GROUP BY source),
p AS (
  SELECT doc_id, size, r.source_size, r.target, u, CASE WHEN r.source_size > coalesce(words, 0)
      THEN greatest(0.0::DOUBLE, least(2.0::DOUBLE, (r.target - took) / (r.source_size - coalesce(words, 0)))) ELSE 0.0::DOUBLE END AS ratio,
    row_number() OVER (PARTITION BY r.source ORDER BY h % strata, CASE WHEN h % strata % 2 = 0 THEN size ELSE -size END, h, doc_id NULLS FIRST) AS place
  FROM (SELECT *, least({mixing.STRATA}, 1 + n_rows // {mixing.STRATUM_ROWS}) AS strata FROM r WHERE size * {mixing.LARGE} <= source_size) r
  JOIN took ON r.source IS NOT DISTINCT FROM took.source LEFT JOIN held ON r.source IS NOT DISTINCT FROM held.source)
SELECT doc_id, size, source_size, target, (size * (floor(u + place * ratio) - floor(u + (place - 1) * ratio)))::BIGINT AS taken FROM p
UNION ALL
SELECT doc_id, size, source_size, target, (size * n)::BIGINT FROM big JOIN walk ON big.source IS NOT DISTINCT FROM walk.source AND big.k = walk.k
"""

OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM {embeddings}),
g AS (
  SELECT r, vec_id, len(e) AS d, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) AS e FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM g),
links AS (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM n a JOIN n b ON a.d = b.d AND a.r <> b.r WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (
  SELECT r, r AS at, vec_id AS id FROM v
  UNION
  SELECT reach.r, links.b, links.other FROM reach JOIN links ON reach.at = links.a),
c AS (SELECT r, min(id) AS component_id FROM reach GROUP BY r),
k AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM v JOIN c USING (r) LEFT JOIN k USING (r)
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM {pages}),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS sha FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM h),
bits AS (
  SELECT *, list_transform(range(0, 32), lambda i: (
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha || '0', (i * 5 // 4 + 1)::INT, 2))::INT >> (3 - i * 5 % 4)::INT) & 31)::INT, 1))) AS letters FROM f)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(letters, '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM bits
"""

OP10_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text, md5(coalesce(hex(encode(role)), '~') || '|' || coalesce(hex(encode(text)), '~')) AS m FROM {conversations} WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(m ORDER BY turn NULLS FIRST, m) AS ms, count(*) AS n_turns,
    string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<|' || chr(8203) || 'im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '<|' || chr(8203) || 'im_') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, m) AS text
  FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT list_slice(ms, 1, k) AS ms FROM c, unnest(range(1, n_turns)) AS u(k)),
u AS (SELECT ms, min(conv_id) AS conv_id FROM c GROUP BY ms)
SELECT conv_id, n_turns, text FROM c JOIN u USING (conv_id) WHERE u.ms NOT IN (SELECT ms FROM p)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL.format(documents="documents", benchmark="benchmark"),
    "op3_mix": OP3_SQL.format(documents="documents"),
    "op5_embedding_dedup": OP5_SQL.format(embeddings="embeddings"),
    "op6_warc": OP6_SQL.format(pages="pages"),
    "op10_chat": OP10_SQL.format(conversations="conversations"),
}
