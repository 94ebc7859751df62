"""The registered queries of the operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.llm import chat, decontamination, embedding_dedup, hard_negatives, html_text, merkle, packing, prefix_bpe, simhash, substring_dedup, token_count, toxicity, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked_vectors(_table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).drop("text")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    return chat.read_back(chat.format_turns(rows.unionByName(more)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.fingerprint_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(_table(spark, sf_dir, "pages"))
    page = lambda c: F.substring(c, 6, 30).cast("long")  # noqa: E731  after "page:"
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(warc.hex_digest(F.col("payload_digest")))
    return warc.read_archive(spark, path).select(page(F.col("record_id")).alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(_table(spark, sf_dir, "documents"), {"text": text}, proofs=False)


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    encoded = prefix_bpe.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return prefix_bpe.decode_ids(encoded, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_decontamination, op2_toxicity, op3_substring_dedup, op4_embedding_dedup, op5_packing, op6_html_text, op7_token_count, op8_chat_format, op9_simhash, op10_warc, op11_merkle, op12_prefix_bpe, op13_hard_negatives)
    return {f.__name__: f for f in every}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, i, s.n, array_to_string(list_slice(w, i, i + s.n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, sizes s WHERE len(w) >= s.n) x JOIN sizes s ON s.n = x.n),
hits AS (SELECT g.doc_id, g.i, g.n, v.item FROM grams g JOIN windows v ON v.gram = g.gram AND v.n = g.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS all_items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4_SQL = """
WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n_links, 0) AS BIGINT) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON r.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""

OP8_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
each AS (SELECT *, length(regexp_replace(role, '([\\#<:\n])', 'x\1', 'g')) + length(regexp_replace(text, '([\\#<])', 'x\1', 'g')) + 15 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM each GROUP BY conv_id
"""

OP10_SQL = """
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to FROM f
"""

#: crc32 of the decimal doc_id by its bits; the polynomial 0xEDB88320 and the start 0xFFFFFFFF are fixed values.
OP11_SQL = """
WITH RECURSIVE odd AS (SELECT *, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda s, b:
    list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), CAST(4294967295 AS BIGINT)) AS state FROM documents),
d AS (SELECT *, CASE WHEN xor(state, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS later FROM odd),
enc AS (SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS front, coalesce(strlen(text) || ':' || text, '-') AS back, coalesce(strlen(later) || ':' || later, '-') AS later FROM d),
leaves AS (SELECT doc_id, source, sha256(front || back) AS leaf, sha256(front || later) AS now FROM enc),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
low AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, level, pos // 3, n),
tops AS (SELECT tree, digest FROM low WHERE n = 1),
high AS (SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM tops) AS n, digest FROM tops
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 3, n),
nodes AS (SELECT tree, level, pos, n, digest FROM low UNION ALL SELECT -1, level, pos, n, digest FROM high),
sides AS (SELECT *, coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
  coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights FROM nodes WINDOW r AS (PARTITION BY tree, level, pos // 3 ORDER BY pos)),
walk AS (SELECT tree AS own, pos AS at, tree, 0 AS level, pos, n, '' AS path, now AS folded FROM placed
  UNION ALL SELECT w.own, w.at, CASE WHEN w.n = 1 THEN -1 ELSE w.tree END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 THEN w.tree ELSE w.pos // 3 END,
    CASE WHEN w.n = 1 THEN (SELECT count(*) FROM tops) ELSE (w.n + 2) // 3 END, CASE WHEN w.n = 1 THEN w.path ELSE w.path || s.lefts || s.rights END, CASE WHEN w.n = 1 THEN w.folded ELSE sha256(s.lefts || w.folded || s.rights) END
    FROM walk w JOIN sides s ON s.tree = w.tree AND s.level = w.level AND s.pos = w.pos WHERE NOT (w.tree = -1 AND w.n = 1))
SELECT p.doc_id, p.leaf, t.digest AS subroot, h.digest AS root, sha256(w.path) AS proof_sha256, w.folded AS folded_root, w.folded = h.digest AS verified
FROM placed p JOIN tops t USING (tree) JOIN walk w ON w.own = p.tree AND w.at = p.pos AND w.tree = -1 AND w.n = 1 CROSS JOIN (SELECT digest FROM high WHERE n = 1) h
"""

OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
x AS (SELECT p.anchor_id, p.other AS positive_id, p.score AS positive_score, s.other AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM x WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are held against brute force in tests/llm."""
    return {"op1_decontamination": OP1_SQL, "op4_embedding_dedup": OP4_SQL, "op8_chat_format": OP8_SQL, "op10_warc": OP10_SQL, "op11_merkle": OP11_SQL, "op13_hard_negatives": OP13_SQL}
