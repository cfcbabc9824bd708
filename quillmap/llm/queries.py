"""Queries over the operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmap.llm import chat, exponion, graphdedup, langid, lm, mixing, packing, quality, simhash, topk, toxicity, warc, whitening
from quillmap.llm.shared import remainder, table


def op1_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graphdedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held))
    found = langid.predicted(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def with_calls(turns: DataFrame) -> DataFrame:
    """``turns`` with tool markup behind their texts, as the given tables have none.

    An assistant's turn t searches for its own text as call ct, with a limit of t % 4, so
    that every fourth is invalid; from turn 3 on call ft fetches what c(t-2) found;
    turn 5 uses the identifier c3 again; in turn 6 the calls x6 and y6 wait for each
    other. A user's turn t answers c(t-1) with its own text, whether or not it was called.
    """
    t, text = F.col("turn"), F.coalesce("text", F.lit(""))
    named = lambda letter, k: F.concat(F.lit(letter), (t - k).cast("string"))
    ref = lambda x: F.struct(F.struct(x.alias("$result")).alias("url"))

    def call(i, tool: str, arguments):
        return F.concat(F.lit(chat.CALL[0]), F.to_json(F.struct(i.alias("id"), F.lit(tool).alias("name"), arguments.alias("arguments"))), F.lit(chat.CALL[1]))

    result = F.concat(F.lit(chat.RESULT[0]), F.to_json(F.struct(named("c", 1).alias("id"), text.alias("content"))), F.lit(chat.RESULT[1]))
    assistant = F.col("role") == "assistant"
    parts = [
        F.when(assistant, call(named("c", 0), "search", F.struct(text.alias("query"), (t % 4).alias("limit")))),
        F.when(assistant & (t >= 3), call(named("f", 0), "fetch", ref(named("c", 2)))),
        F.when(assistant & (t == 5), call(F.lit("c3"), "search", F.struct(F.lit("again").alias("query")))),
        F.when(assistant & (t == 6), F.concat(call(F.lit("x6"), "fetch", ref(F.lit("y6"))), call(F.lit("y6"), "fetch", ref(F.lit("x6"))))),
        F.when((F.col("role") == "user") & (t >= 1), result),
    ]
    return turns.withColumn("text", F.concat(text, *[F.coalesce(p, F.lit("")) for p in parts]))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.format_chats(with_calls(table(spark, sf_dir, "conversations")))
    # a cycle's calls have no level
    return found.withColumns({"errors": F.array_join("errors", "; "), "level": F.coalesce("level", F.lit(-1))})


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), F.coalesce(remainder("doc_id", 7) != 2, F.lit(True)))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.sign_code("embedding").alias("code"))
    found = topk.search(codes, codes.where("id % 100 = 0"), k=10)
    return found.select(F.col("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("int").alias("distance"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held))
    found = quality.scored(docs.select("doc_id", "text"), model)
    score = F.col("quality_score")
    return found.select("doc_id", held.alias("held_out"), score.alias("score"), F.when(score >= 0.3, 1).otherwise(0).alias("predicted"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exponion.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    found = toxicity.scored(docs.select("doc_id", "text", "lang"), model)
    score = F.col("toxicity_score")
    return found.select("doc_id", held.alias("held_out"), score.alias("score"), F.when(score >= 0.7, 1).otherwise(0).alias("predicted"), F.col("toxic").alias("by_language"))


def queries() -> dict:
    ops = (op1_graph_dedup, op2_language_id, op3_chat, op4_packing, op5_language_model, op6_warc, op7_simhash, op8_mixing, op9_topk, op10_quality, op11_codes, op12_whitening, op13_toxicity)
    return {f.__name__: f for f in ops}


WARC_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id, count(*) OVER (PARTITION BY payload_digest) AS n FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM g
"""

TOPK_SQL = """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(round(list_sum(q.bits) + list_sum(c.bits) - 2 * list_dot_product(q.bits, c.bits)) AS INTEGER) AS distance
  FROM c AS q JOIN c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d
)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


#: Links by brute force; components by spreading the smallest id along links.
GRAPH_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""


#: Turns with the markup of ``with_calls``, linked, ordered and checked.
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN 1 ELSE 0 END AS has FROM conversations
), a AS (SELECT * FROM t WHERE role = 'assistant'
), calls AS (
  SELECT conv_id, turn, role, has AS part, 'c' || turn AS id, 'search' AS tool, NULL AS needs, turn % 4 = 0 AS bad,
    '{"arguments":{"limit":' || turn % 4 || ',"query":' || CAST(to_json(text) AS VARCHAR) || '},"id":"c' || turn || '","name":"search"}' AS json FROM a
  UNION ALL SELECT conv_id, turn, role, has + 1, 'f' || turn, 'fetch', 'c' || (turn - 2), false, '{"arguments":{"url":{"$result":"c' || (turn - 2) || '"}},"id":"f' || turn || '","name":"fetch"}' FROM a WHERE turn >= 3
  UNION ALL SELECT conv_id, turn, role, has + 2, 'c3', 'search', NULL, false, '{"arguments":{"query":"again"},"id":"c3","name":"search"}' FROM a WHERE turn = 5
  UNION ALL SELECT conv_id, turn, role, has + 2, 'x6', 'fetch', 'y6', false, '{"arguments":{"url":{"$result":"y6"}},"id":"x6","name":"fetch"}' FROM a WHERE turn = 6
  UNION ALL SELECT conv_id, turn, role, has + 3, 'y6', 'fetch', 'x6', false, '{"arguments":{"url":{"$result":"x6"}},"id":"y6","name":"fetch"}' FROM a WHERE turn = 6
), answers AS (
  SELECT conv_id, turn, role, has AS part, 'c' || (turn - 1) AS id, '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"id":"c' || (turn - 1) || '"}' AS json FROM t WHERE role = 'user' AND turn >= 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, part) AS n,
    id IN ('x6', 'y6') AS cycle, needs IS NOT NULL AND EXISTS (SELECT 1 FROM calls AS o WHERE o.conv_id = calls.conv_id AND o.id = calls.needs) AS waits,
    EXISTS (SELECT 1 FROM answers AS r WHERE r.conv_id = calls.conv_id AND r.id = calls.id) AS answered FROM calls
)
SELECT conv_id, turn, CAST(part AS INTEGER) AS part, role, 'call' AS kind, id AS call_id, tool, CAST(CASE WHEN cycle THEN -1 WHEN waits THEN 1 ELSE 0 END AS INTEGER) AS level,
  CASE WHEN bad THEN 'invalid' WHEN n > 1 THEN 'duplicate' WHEN cycle THEN 'cycle' WHEN NOT answered THEN 'unanswered' ELSE 'ok' END AS status,
  CASE WHEN bad THEN '$.limit: below minimum' ELSE '' END AS errors, json FROM ranked
UNION ALL
SELECT conv_id, turn, CAST(part AS INTEGER), role, 'result', id, NULL, 0, CASE WHEN EXISTS (SELECT 1 FROM calls AS o WHERE o.conv_id = answers.conv_id AND o.id = answers.id) THEN 'ok' ELSE 'orphan' END, '', json FROM answers
UNION ALL
SELECT conv_id, turn, 0, role, 'message', NULL, NULL, 0, 'ok', '', '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' FROM t
WHERE has = 1 OR NOT (role = 'assistant' OR role = 'user' AND turn >= 1)
"""


def _codes_sql(rounds: int) -> str:
    """Every part against every entry of its position; vectors of 64 components, 64 entries."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT p.vec_id, p.part, min(((p.x0 - c.x0) ** 2 + (p.x1 - c.x1) ** 2 + (p.x2 - c.x2) ** 2 + (p.x3 - c.x3) ** 2)::BIGINT * 64 + c.entry) AS best
  FROM p JOIN c{k} AS c ON p.part = c.part GROUP BY p.vec_id, p.part
)""")
        if k < rounds:
            means = ", ".join(f"CASE WHEN m.n IS NULL THEN c.x{i} ELSE (m.x{i} - ((m.x{i} % m.n) + m.n) % m.n) // m.n END AS x{i}" for i in range(4))
            steps.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, {means} FROM c{k} AS c LEFT JOIN (
    SELECT p.part, a.best % 64 AS entry, count(*) AS n, sum(p.x0) AS x0, sum(p.x1) AS x1, sum(p.x2) AS x2, sum(p.x3) AS x3
    FROM p JOIN a{k} AS a ON p.vec_id = a.vec_id AND p.part = a.part GROUP BY p.part, a.best % 64
  ) AS m ON c.part = m.part AND c.entry = m.entry
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, i AS part, e[4 * i + 1] AS x0, e[4 * i + 2] AS x1, e[4 * i + 3] AS x2, e[4 * i + 4] AS x3 FROM v, range(16) AS r(i)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x0, x1, x2, x3 FROM p QUALIFY entry < 64
), {", ".join(steps)}, f AS (
  SELECT vec_id, string_agg(format('{{:02x}}', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
)
SELECT f.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(x0 || ',' || x1 || ',' || x2 || ',' || x3, ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM f JOIN v ON f.vec_id = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """Learned models, fingerprints, packing and eigenvectors have no SQL form; their tests use brute force."""
    return {"op1_graph_dedup": GRAPH_SQL, "op3_chat": CHAT_SQL, "op6_warc": WARC_SQL, "op9_topk": TOPK_SQL, "op11_codes": _codes_sql(2)}
