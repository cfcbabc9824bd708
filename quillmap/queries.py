"""Queries over the given tables, one for each operator that can be told by its rows, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmap.functions import geometry as G, text as T
from quillmap.operators import candidates as C, index as I
from quillmap.sources import corpora as S, payload as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Invoices in SQL: pg (pages), li (rows), tok (tokens), fld (fields).
INV = r"""
WITH pg AS (
  SELECT o_orderkey AS ord, o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page,
    CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS total FROM orders
), li0 AS (
  SELECT l_orderkey AS ord, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS line_index,
    l_partkey AS part, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(l_shipdate AS DATE) AS shipped FROM lineitem
), li AS (
  SELECT li0.*, pg.doc_id, pg.page, (ord + line_index) % 4 AS way,
    format('{:,}', price // 100) || '.' || lpad(CAST(price % 100 AS VARCHAR), 2, '0') AS comma,
    CAST(price // 100 AS VARCHAR) || '.' || lpad(CAST(price % 100 AS VARCHAR), 2, '0') AS bare
  FROM li0 JOIN pg USING (ord)
), raw AS (
  SELECT doc_id, page, 0 AS line_index, 0 AS token_idx, 'Order' AS text FROM pg
  UNION ALL SELECT doc_id, page, 0, 1, CAST(ord AS VARCHAR) FROM pg
  UNION ALL SELECT doc_id, page, 0, 2, strftime(day, '%Y-%m-%d') FROM pg
  UNION ALL SELECT doc_id, page, 0, 3, 'Total:' FROM pg
  UNION ALL SELECT doc_id, page, 0, 4, '$' || format('{:,}', total // 100) || '.' || lpad(CAST(total % 100 AS VARCHAR), 2, '0') FROM pg
  UNION ALL SELECT doc_id, page, line_index, 0, '#' || line_index FROM li
  UNION ALL SELECT doc_id, page, line_index, 1, CAST(part AS VARCHAR) FROM li
  UNION ALL SELECT doc_id, page, line_index, 2, CAST(quantity AS VARCHAR) FROM li
  UNION ALL SELECT doc_id, page, line_index, 3, CASE way WHEN 0 THEN comma WHEN 1 THEN '$' || comma WHEN 2 THEN replace(comma, '0', 'O') ELSE bare END FROM li
  UNION ALL SELECT doc_id, page, line_index, 4, CASE WHEN ord % 3 = 0 THEN strftime(shipped, '%Y-%m-%d') ELSE strftime(shipped, '%m/%d/%Y') END FROM li
), tok AS (
  SELECT doc_id, page, line_index, token_idx, text,
    CASE token_idx WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.20::DOUBLE WHEN 2 THEN 0.32::DOUBLE WHEN 3 THEN 0.50::DOUBLE ELSE 0.75::DOUBLE END AS x,
    CASE WHEN line_index = 0 THEN 0.05::DOUBLE ELSE 0.10::DOUBLE + line_index * 0.03::DOUBLE END AS y,
    length(text) * 0.008::DOUBLE AS w, 0.012::DOUBLE AS h FROM raw
), numtok AS (
  SELECT *, CAST(r AS DOUBLE) AS number FROM (
    SELECT *, CASE WHEN regexp_full_match(a, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') THEN a WHEN regexp_full_match(b, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') THEN b END AS r FROM (
      SELECT *, regexp_replace(text, '[$,]', '', 'g') AS a, translate(regexp_replace(text, '[$,]', '', 'g'), 'OolI', '0011') AS b FROM tok)) WHERE r IS NOT NULL
), fld AS (
  SELECT doc_id, 'orders[' || (page - 1) || '].total' AS field, CAST(total // 100 AS VARCHAR) || '.' || lpad(CAST(total % 100 AS VARCHAR), 2, '0') AS value, 'float' AS kind, 'total' AS context, page AS page_hint, 0 AS gold_line FROM pg
  UNION ALL SELECT doc_id, 'orders[' || (page - 1) || '].date', strftime(day, '%B %-d, %Y'), 'str', 'order', page, 0 FROM pg
  UNION ALL SELECT doc_id, 'orders[' || (page - 1) || '].rows[' || (line_index - 1) || '].price', bare, 'float', '#' || line_index, page, line_index FROM li
)
"""

#: Prose in SQL: pl (lines), pt (tokens).
PROSE = r"""
WITH pl0 AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents
), pl AS (
  SELECT doc_id, CAST(n // 40 + 1 AS INTEGER) AS page, CAST(n % 40 AS INTEGER) AS line_index, text FROM pl0
), pt AS (
  SELECT doc_id, page, line_index, CAST(unnest(range(len(ws))) AS INTEGER) AS token_idx, unnest(ws) AS text
  FROM (SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM pl)
)
"""


def r6(c: Column | str) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def flat(df: DataFrame, box: str = "box") -> DataFrame:
    """The box as rounded columns x, y, w, h."""
    return df.withColumns({k: r6(F.col(box)[k]) for k in "xywh"}).drop(box)



@query(INV + "SELECT doc_id, page, line_index, token_idx, text, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM tok")
def src_invoice_tokens(spark, d):
    return flat(S.invoice_tokens(spark, d))


@query(INV + "SELECT doc_id, field, value, kind, context, page_hint, page_hint AS gold_page, gold_line FROM fld")
def src_invoice_fields(spark, d):
    return S.invoice_fields(spark, d)


@query(PROSE + "SELECT doc_id, page, line_index, token_idx, text FROM pt")
def src_prose_tokens(spark, d):
    return S.prose_tokens(S.table(spark, d, "documents")).drop("box")


_HTML = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_HTML = f"""trim(regexp_replace(replace(replace(replace(replace(replace({_HTML}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'))"""


@query(f"SELECT page_id, {_HTML} AS text, CAST(len(string_split({_HTML}, ' ')) AS INTEGER) AS words FROM pages")
def src_html_text(spark, d):
    return S.table(spark, d, "pages").select("page_id", S.html_text("html").alias("text"), F.size(F.split(S.html_text("html"), " ")).alias("words"))


@query("SELECT event_id, unnest(json_keys(props)) AS field, json_extract_string(props, unnest(json_keys(props))) AS value FROM events WHERE props IS NOT NULL")
def src_payload_entries(spark, d):
    return P.from_dicts(S.table(spark, d, "events").where("props is not null"), "event_id", "props")


@query("""
SELECT user_id, 'u' || user_id || '[0].value' AS field, CAST(n AS VARCHAR) AS value, 'int' AS kind, CAST(user_id % 9 + 1 AS INTEGER) AS page_hint, 'u' || user_id || '[0]' AS record
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
UNION ALL
SELECT user_id, 'u' || user_id || '[0].kinds[' || i || ']', kind, 'str', CAST(user_id % 9 + 1 AS INTEGER), 'u' || user_id || '[0]'
FROM (SELECT user_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT user_id, event_type FROM events))
""")
def src_payload_leaves(spark, d):
    per = S.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    record = F.array(F.struct(F.col("n").alias("value"), (F.col("user_id") % 9 + 1).alias("source_page"), F.col("kinds")))
    payload = F.concat(F.lit('{"u'), F.col("user_id").cast("string"), F.lit('":'), F.to_json(record), F.lit("}"))
    return P.flatten(per.select("user_id", payload.alias("payload")), "user_id").select("user_id", "field", "value", "kind", "page_hint", "record")


_LINES = INV + "SELECT doc_id, page, line_index, token_idx, text FROM tok"


@query(_LINES)
def idx_lines_fold(spark, d):
    bare = S.invoice_tokens(spark, d).withColumn("line_index", F.lit(-1))
    return I.cluster_lines(bare).drop("box")


@query(_LINES)
def idx_lines_gap(spark, d):
    bare = S.invoice_tokens(spark, d).withColumn("line_index", F.lit(-1))
    return I.lines_by_gap(bare).drop("box")


@query(INV + """SELECT doc_id, page, line_index, string_agg(text, ' ' ORDER BY x) AS text, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x + w) - min(x), 6) AS w, round(max(y + h) - min(y), 6) AS h
FROM tok GROUP BY doc_id, page, line_index""")
def idx_lines(spark, d):
    return flat(I.lines(S.invoice_tokens(spark, d)).select("doc_id", "page", "line_index", "text", "box"))


@query(INV + """SELECT doc_id, page, line_index, token_idx, lower(text) AS norm, trim(lower(text), ' ,.:;-/_''"()[]{}*&#$€£¥') AS stem FROM tok""")
def idx_token_postings(spark, d):
    return I.token_postings(S.invoice_tokens(spark, d)).select("doc_id", "page", "line_index", "token_idx", "norm", "stem")


@query(INV + """, st AS (SELECT doc_id, page, line_index, trim(lower(text), ' ,.:;-/_''"()[]{}*&#$€£¥') AS stem FROM tok)
SELECT DISTINCT doc_id, substr(stem, CAST(i AS INTEGER), 3) AS gram, page, line_index FROM (SELECT *, unnest(range(1, length(stem) - 1)) AS i FROM st WHERE length(stem) >= 4)""")
def idx_gram_postings(spark, d):
    return I.gram_postings(S.invoice_tokens(spark, d))


@query(INV + "SELECT doc_id, page, line_index, token_idx, number, CAST(round(number * 1000000) AS BIGINT) AS number_key FROM numtok")
def idx_number_postings(spark, d):
    return I.number_postings(S.invoice_tokens(spark, d)).select("doc_id", "page", "line_index", "token_idx", "number", "number_key")


@query(INV + """SELECT doc_id, page, line_index, token_idx, CAST(replace(replace(text, '$', ''), ',', '') AS DOUBLE) AS number, round(x, 6) AS x, round(w + 0.008, 6) AS w
FROM tok WHERE text LIKE '$%' AND replace(replace(text, '$', ''), ',', '') NOT LIKE '%O%'""")
def idx_pair_postings(spark, d):
    t = S.invoice_tokens(spark, d).where("text like '$%'")
    sign = t.withColumns({"text": F.lit("$"), "box": G.box(F.col("box.x"), F.col("box.y"), F.lit(0.006), F.col("box.h"))})
    rest = t.withColumns({"text": F.expr("substr(text, 2)"), "box": G.box(F.col("box.x") + 0.008, F.col("box.y"), F.col("box.w"), F.col("box.h")), "token_idx": F.col("token_idx") + 100})
    got = I.pair_postings(sign.union(rest)).where(~F.col("text").contains("O"))
    return flat(got.select("doc_id", "page", "line_index", "token_idx", "number", "box")).drop("y", "h")


@query(INV + r"""SELECT doc_id, page, line_index, CAST(token_idx + 1 AS INTEGER) AS first, strftime(CASE WHEN text LIKE '%/%' THEN strptime(text, '%m/%d/%Y') ELSE strptime(text, '%Y-%m-%d') END, '%Y-%m-%d') AS date
FROM tok WHERE regexp_full_match(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}')""")
def idx_date_postings(spark, d):
    got = I.date_postings(I.lines(S.invoice_tokens(spark, d)))
    return got.select("doc_id", "page", "line_index", "first", F.col("date").cast("string").alias("date"))


@query(INV + """, ln AS (SELECT doc_id, page, line_index, string_agg(lower(text), ' ' ORDER BY x) AS t FROM tok GROUP BY doc_id, page, line_index)
SELECT doc_id, page, string_agg(t, chr(10) ORDER BY line_index) AS text FROM ln GROUP BY doc_id, page""")
def idx_page_text(spark, d):
    return I.page_text(I.lines(S.invoice_tokens(spark, d)))


@query(PROSE + r""", s AS (
  SELECT doc_id, page, count(*) AS n, sum(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))) AS alnum, sum(length(text)) AS chars,
    sum(CASE WHEN regexp_matches(text, '^[.,][0-9]+') THEN 1 ELSE 0 END) AS sd, sum(CASE WHEN regexp_matches(text, '^[$(]+[0-9]+$') THEN 1 ELSE 0 END) AS sp FROM pt GROUP BY doc_id, page
)
SELECT doc_id, page, CAST(n AS BIGINT) AS p_tokens, CASE WHEN n < 25 OR (n < 50 AND CAST(alnum AS DOUBLE) / chars < 0.35) THEN 'ocr' ELSE 'liteparse' END AS mode FROM s""")
def idx_page_routes(spark, d):
    return I.route_pages(I.page_stats(S.prose_tokens(S.table(spark, d, "documents")))).select("doc_id", "page", "p_tokens", "mode")


@query(PROSE + r""", it AS (SELECT doc_id, page, line_index, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM pl),
ws AS (SELECT doc_id, page, line_index, greatest(length(text), 1) AS n, CAST(unnest(range(len(ws))) AS INTEGER) AS word_idx, unnest(ws) AS word FROM it),
st AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, page, line_index ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ws)
SELECT doc_id, page, line_index AS item_id, word_idx, word AS text, round(0.1::DOUBLE + (0.8::DOUBLE / n) * s, 6) AS x, round(greatest((0.8::DOUBLE / n) * (s + length(word) - s), 0.001::DOUBLE), 6) AS w FROM st""")
def idx_split_items(spark, d):
    lines = S.prose_lines(S.table(spark, d, "documents"))
    items = lines.withColumnRenamed("line_index", "item_id").withColumn("box", G.box(F.lit(0.1), F.lit(0.2), F.lit(0.8), F.lit(0.02)))
    return flat(I.split_items(items)).drop("y", "h")


@query(INV + "SELECT doc_id, page, line_index, token_idx, CASE WHEN line_index = 0 THEN 1 WHEN line_index <= 3 AND token_idx >= 3 THEN 3 ELSE 2 END AS block_id FROM tok")
def idx_attach_blocks(spark, d):
    t = S.invoice_tokens(spark, d)
    head = F.struct(F.lit(1).alias("block_id"), G.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.08)).alias("box"))
    body = F.struct(F.lit(2).alias("block_id"), G.box(F.lit(0.0), F.lit(0.10), F.lit(1.0), F.lit(0.9)).alias("box"))
    part = F.struct(F.lit(3).alias("block_id"), G.box(F.lit(0.5), F.lit(0.10), F.lit(0.5), F.lit(0.115)).alias("box"))
    blocks = S.invoice_pages(spark, d).select("doc_id", "page", F.inline(F.array(head, body, part)))
    return I.attach_blocks(t, blocks).select("doc_id", "page", "line_index", "token_idx", "block_id")


@query(PROSE + r""", w AS (SELECT DISTINCT text, replace(lower(text), 'ß', 'ss') AS norm FROM pt)
SELECT text, norm, trim(norm, ' ,.:;-/_''"()[]{}*&#$€£¥') AS stem, regexp_replace(upper(replace(text, 'ß', 'SS')), '[^B-DF-HJ-NP-TV-Z0-9]', '', 'g') AS skeleton,
  regexp_replace(translate(regexp_replace(text, '^[$€£¥§]+', ''), 'OoIlLi|Ss$BGZz·•', '00111115558622..'), '[^0-9.]', '', 'g') AS digits,
  regexp_replace(regexp_replace(text, '[,$€£¥\s]', '', 'g'), '^\((.*)\)$', '-\1') AS value_key FROM w""")
def fn_words(spark, d):
    w = S.prose_tokens(S.table(spark, d, "documents")).select("text").distinct()
    return w.select("text", T.fold("text").alias("norm"), T.word_key("text").alias("stem"), T.skeleton("text").alias("skeleton"), T.ocr_digits("text").alias("digits"), T.value_key("text").alias("value_key"))


@query(INV + """, a AS (SELECT doc_id, page, line_index, token_idx, text, x, y, w, h, lead(x) OVER o AS x2, lead(w) OVER o AS w2 FROM tok WINDOW o AS (PARTITION BY doc_id, page, line_index ORDER BY token_idx)),
b AS (SELECT *, greatest(least(x + w, x2 - 0.05::DOUBLE + w2) - greatest(x, x2 - 0.05::DOUBLE), 0) * h AS common FROM a WHERE x2 IS NOT NULL)
SELECT doc_id, page, line_index, token_idx, round(common / (w * h + w2 * h - common), 6) AS iou, round(greatest(x + w, x2 - 0.05::DOUBLE + w2) - least(x, x2 - 0.05::DOUBLE), 6) AS hull_w FROM b""")
def fn_geometry(spark, d):
    from pyspark.sql import Window

    o = Window.partitionBy("doc_id", "page", "line_index").orderBy("token_idx")
    a = S.invoice_tokens(spark, d).withColumn("n", F.lead("box").over(o)).where("n is not null")
    moved = G.box(F.col("n.x") - 0.05, F.col("n.y"), F.col("n.w"), F.col("n.h"))
    return a.select("doc_id", "page", "line_index", "token_idx", r6(G.iou("box", moved)).alias("iou"), r6(G.hull_of(F.array("box", moved))["w"]).alias("hull_w"))


_FORMS = ["%Y-%m-%d", "%m/%d/%Y", "%-m/%-d/%Y", "%d/%m/%Y", "%-d/%-m/%Y", "%-d-%m-%Y", "%d-%m-%Y", "%m-%d-%Y", "%-m-%-d-%Y", "%Y/%m/%d", "%y-%m-%d", "%m/%d/%y", "%-m/%-d/%y", "%d/%m/%y", "%-d/%-m/%y", "%b %-d, %Y", "%B %-d, %Y", "%b. %-d, %Y", "%-d %b %Y", "%-d %B %Y", "%b %-d %Y"]


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS t FROM orders) " + " UNION ".join(
    [f"SELECT strftime(t, '%Y-%m-%d') AS day, strftime(t, '{f}') AS variant FROM d" for f in _FORMS]
    + ["SELECT strftime(t, '%Y-%m-%d'), strftime(t, '%-d ') || upper(strftime(t, '%b')) || strftime(t, ' %Y') FROM d"]
))
def fn_date_variants(spark, d):
    days = S.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("t")).distinct()
    return days.select(F.col("t").cast("string").alias("day"), F.explode(T.date_variants("t")).alias("variant"))


@query(INV + """, f AS (SELECT doc_id, field, page_hint, gold_line FROM fld WHERE field LIKE '%.date')
SELECT f.doc_id, field, CAST(o.ord AS VARCHAR) AS value, t.page, t.line_index, round(t.x, 6) AS x FROM f JOIN pg AS o ON o.doc_id = f.doc_id AND o.page = f.page_hint JOIN tok AS t ON t.doc_id = f.doc_id AND t.text = CAST(o.ord AS VARCHAR)""")
def cand_exact_tokens(spark, d):
    p = S.invoice_pages(spark, d)
    f = p.select("doc_id", F.concat(F.lit("orders["), F.col("page") - 1, F.lit("].date")).alias("field"), F.col("order").cast("string").alias("value"), F.col("page").alias("page_hint"))
    got = C.exact_tokens(f, S.invoice_tokens(spark, d))
    return flat(got.select("doc_id", "field", F.col("matched_text").alias("value"), "page", "line_index", "box")).drop("y", "w", "h")


#: Prices, and the whole parts of totals, which few pages print.
@query(INV.replace("numtok AS (", "numtok AS MATERIALIZED (") + """, f AS (
  SELECT doc_id, field, CAST(value AS DOUBLE) AS v FROM fld WHERE field LIKE '%.price'
  UNION ALL SELECT doc_id, field, floor(CAST(value AS DOUBLE)) FROM fld WHERE field LIKE '%.total'
), same AS MATERIALIZED (
  SELECT f.doc_id, f.field, n.page, n.line_index, n.text AS matched_text, n.x, 1.0::DOUBLE AS similarity FROM f JOIN numtok AS n
  ON f.doc_id = n.doc_id AND CAST(round(f.v * 1000000) AS BIGINT) = CAST(round(n.number * 1000000) AS BIGINT)
), part AS (
  SELECT f.doc_id, f.field, n.page, n.line_index, n.text, n.x, 0.9::DOUBLE FROM f JOIN numtok AS n ON f.doc_id = n.doc_id AND f.v = trunc(n.number)
  WHERE f.v = floor(f.v) AND NOT EXISTS (SELECT 1 FROM same AS s WHERE s.doc_id = f.doc_id AND s.field = f.field)
)
SELECT * REPLACE (round(x, 6) AS x) FROM same UNION ALL SELECT * REPLACE (round(x, 6) AS x) FROM part""")
def cand_numbers(spark, d):
    f = S.invoice_fields(spark, d, "total", "price")
    whole = F.floor(F.col("value").cast("double")).cast("long").cast("string")
    f = f.withColumn("value", F.when(F.col("field").endswith(".total"), whole).otherwise(F.col("value")))
    got = C.numbers(f, I.number_postings(S.invoice_tokens(spark, d)))
    return flat(got.select("doc_id", "field", "page", "line_index", "matched_text", "similarity", "box")).drop("y", "w", "h")


@query(INV + """SELECT f.doc_id, f.field, n.page, n.line_index, n.text AS matched_text FROM fld AS f JOIN numtok AS n
ON f.doc_id = n.doc_id AND abs(CAST(f.value AS DOUBLE) - n.number) <= 0.001::DOUBLE * abs(CAST(f.value AS DOUBLE)) WHERE f.kind = 'float' AND n.number <> 0 AND CAST(f.value AS DOUBLE) <> 0""")
def cand_numbers_within(spark, d):
    f = S.invoice_fields(spark, d, "total", "price")
    got = C.numbers_within(f, I.number_postings(S.invoice_tokens(spark, d)), share=1e-3)
    return got.select("doc_id", "field", "page", "line_index", "matched_text")


_DATES = INV + r"""SELECT f.doc_id, f.field, t.page, t.line_index FROM fld AS f JOIN tok AS t ON f.doc_id = t.doc_id
AND strptime(f.value, '%B %-d, %Y') = CASE WHEN regexp_full_match(t.text, '[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN try_strptime(t.text, '%m/%d/%Y') WHEN regexp_full_match(t.text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_strptime(t.text, '%Y-%m-%d') END
WHERE f.field LIKE '%.date'"""


@query(_DATES)
def cand_dates(spark, d):
    f = S.invoice_fields(spark, d, "date")
    return C.dates(f, I.date_postings(I.lines(S.invoice_tokens(spark, d)))).select("doc_id", "field", "page", "line_index")


@query(INV + r"""SELECT f.doc_id, f.field, t.page, t.line_index, t.text AS matched_text FROM fld AS f JOIN tok AS t ON f.doc_id = t.doc_id
AND t.text IN (strftime(strptime(f.value, '%B %-d, %Y'), '%m/%d/%Y'), strftime(strptime(f.value, '%B %-d, %Y'), '%d/%m/%Y'), strftime(strptime(f.value, '%B %-d, %Y'), '%Y-%m-%d'))
WHERE f.field LIKE '%.date'""")
def cand_date_literals(spark, d):
    t = S.invoice_tokens(spark, d)
    f = S.invoice_fields(spark, d, "date")
    return C.date_literals(f, t, I.lines(t)).select("doc_id", "field", "page", "line_index", "matched_text")


def _prose_fields(spark, d) -> DataFrame:
    """Words 2 to 4 of the first line of each document with four words in it."""
    words = F.filter(F.split(F.get(F.split("text", "\n"), F.lit(0)), " "), lambda w: w != "")
    return S.table(spark, d, "documents").select("doc_id", words.alias("w")).where("size(w) >= 4").select("doc_id", F.lit("phrase").alias("field"), F.array_join(F.slice("w", 2, 3), " ").alias("value"), F.lit(None).cast("int").alias("page_hint"), F.lit("str").alias("kind"), F.lit("").alias("context"))


_PHRASE = PROSE + """, f AS (
  SELECT doc_id, array_to_string(ws[2:4], ' ') AS value FROM (SELECT doc_id, list_filter(string_split(string_split(text, chr(10))[1], ' '), lambda w: w <> '') AS ws FROM documents) WHERE len(ws) >= 4
), ln AS (SELECT doc_id, page, line_index, string_agg(text, ' ' ORDER BY token_idx) AS t FROM pt GROUP BY doc_id, page, line_index)
"""


@query(_PHRASE + "SELECT f.doc_id, ln.page, ln.line_index FROM f JOIN ln ON f.doc_id = ln.doc_id AND contains(replace(lower(ln.t), 'ß', 'ss'), replace(lower(f.value), 'ß', 'ss'))")
def cand_phrases(spark, d):
    lines = I.lines(S.prose_tokens(S.table(spark, d, "documents")))
    return C.phrases(_prose_fields(spark, d), lines).select("doc_id", "page", "line_index")


@query(INV + """, v AS (SELECT ord, doc_id, page, line_index, lower(text) AS t FROM raw JOIN pg USING (doc_id, page) WHERE token_idx = 4 AND line_index > 0),
nx AS (SELECT doc_id, page, line_index, lower(text) AS t FROM raw WHERE token_idx = 0 AND line_index > 0)
SELECT v.doc_id, v.page, v.line_index, CAST(count(*) AS BIGINT) AS n FROM v JOIN nx ON v.doc_id = nx.doc_id AND v.page = nx.page AND nx.line_index = v.line_index + 1 WHERE v.line_index = 1 GROUP BY ALL""")
def cand_multi_line(spark, d):
    """The last word of a page's first row and the first of its second, as one value."""
    t = S.invoice_tokens(spark, d)
    a = t.where("line_index = 1 and token_idx = 4").select("doc_id", "page", F.col("text").alias("ta"))
    b = t.where("line_index = 2 and token_idx = 0").select("doc_id", "page", F.col("text").alias("tb"))
    f = a.join(b, ["doc_id", "page"]).select("doc_id", F.concat(F.lit("p"), F.col("page")).alias("field"), F.concat_ws(" ", "ta", "tb").alias("value"), F.col("page").alias("page_hint"))
    got = C.multi_line(f, I.lines(t)).where("page = page_hint and line_index = 1")
    return got.groupBy("doc_id", "page", "line_index").agg(F.count("*").alias("n"))


@query(INV + """, ln AS (SELECT doc_id, page, line_index, string_agg(lower(text), ' ' ORDER BY x) AS t FROM tok GROUP BY doc_id, page, line_index),
pt AS (SELECT doc_id, page, string_agg(t, chr(10) ORDER BY line_index) AS t FROM ln GROUP BY doc_id, page)
SELECT doc_id, 'total' AS field, page, CAST(instr(t, 'total') - 1 AS INTEGER) AS at FROM pt""")
def cand_substrings(spark, d):
    t = S.invoice_tokens(spark, d)
    f = t.select("doc_id").distinct().select("doc_id", F.lit("total").alias("field"), F.lit("Total").alias("value"))
    return C.substrings(f, I.page_text(I.lines(t)))


@query(INV + """, st AS (SELECT doc_id, page, line_index, trim(lower(text), ' ,.:;-/_''"()[]{}*&#$€£¥') AS stem FROM tok),
g AS (SELECT DISTINCT doc_id, page, line_index, substr(stem, CAST(i AS INTEGER), 3) AS gram FROM (SELECT *, unnest(range(1, length(stem) - 1)) AS i FROM st WHERE length(stem) >= 4)),
a AS (SELECT DISTINCT doc_id, field, substr(value, CAST(i AS INTEGER), 3) AS gram FROM (SELECT *, unnest(range(1, length(value) - 1)) AS i FROM fld WHERE field LIKE '%.total' AND length(value) >= 4)),
m AS (SELECT doc_id, field, page, line_index, count(*) AS grams FROM a JOIN g USING (doc_id, gram) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, field ORDER BY grams DESC, page, line_index) AS INTEGER) AS rank FROM m)
SELECT * FROM r WHERE rank <= 5""")
def cand_grams(spark, d):
    f = S.invoice_fields(spark, d, "total")
    return C.gram_counts(f, I.gram_postings(S.invoice_tokens(spark, d)), lines_most=5)


@query(INV + """, a AS (SELECT doc_id, field, page_hint, value, row_number() OVER (PARTITION BY doc_id, page_hint, value ORDER BY gold_line) AS n FROM fld WHERE field LIKE '%.price'),
b AS (SELECT doc_id, page, line_index, text, replace(replace(lower(text), '$', ''), ',', '') AS v FROM tok),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, v ORDER BY line_index) AS n FROM b)
SELECT a.doc_id, a.field, c.page, c.line_index, c.text AS matched_text FROM a JOIN c ON a.doc_id = c.doc_id AND a.page_hint = c.page AND a.value = c.v AND a.n = c.n""")
def cand_nth_occurrence(spark, d):
    f = S.invoice_fields(spark, d, "price")
    return C.nth_occurrence(f, S.invoice_tokens(spark, d)).select("doc_id", "field", "page", "line_index", "matched_text")


@query(INV + """, c AS (SELECT f.doc_id, f.field, f.page_hint, n.page, n.line_index FROM fld AS f JOIN numtok AS n ON f.doc_id = n.doc_id AND CAST(f.value AS DOUBLE) = n.number WHERE f.kind = 'float'),
e AS (SELECT *, CASE WHEN page = page_hint THEN 0 WHEN abs(page - page_hint) = 1 THEN 1 ELSE 2 END AS drift FROM c)
SELECT doc_id, field, page, line_index, CAST(drift AS INTEGER) AS drift FROM (SELECT *, min(drift) OVER (PARTITION BY doc_id, field) AS l FROM e) WHERE drift = l""")
def cand_drift(spark, d):
    f = S.invoice_fields(spark, d, "total", "price")
    got = C.drifted(C.numbers(f, I.number_postings(S.invoice_tokens(spark, d))).where("similarity = 1"))
    return got.select("doc_id", "field", "page", "line_index", "drift")


@query(INV + """SELECT DISTINCT f.doc_id, f.field, n.page FROM fld AS f JOIN numtok AS n ON f.doc_id = n.doc_id AND CAST(f.value AS DOUBLE) = n.number WHERE f.field LIKE '%.total'""")
def cand_gated_pages(spark, d):
    t = S.invoice_tokens(spark, d)
    return C.gated_pages(S.invoice_fields(spark, d, "total"), I.token_postings(t), I.number_postings(t))


@query(INV + """, c AS (
  SELECT f.doc_id, f.field, f.value, f.page_hint, n.page, n.line_index, n.token_idx, n.text, n.x, n.y, n.w, n.h FROM fld AS f JOIN numtok AS n
  ON f.doc_id = n.doc_id AND n.page = f.page_hint AND CAST(round(CAST(f.value AS DOUBLE) * 1000000) AS BIGINT) = CAST(round(n.number * 1000000) AS BIGINT) WHERE f.field LIKE '%.total'
), k AS (SELECT *, CAST(count(*) OVER (PARTITION BY doc_id, field) AS BIGINT) AS n_cand FROM c)
SELECT doc_id, field, value, 'normalized' AS status, page, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, text AS matched_text FROM k WHERE line_index = 0 AND token_idx = 4""")
def resolve_totals(spark, d):
    """Where is each order's total printed?"""
    from quillmap.plans.resolve import resolve_numbers

    got = resolve_numbers(S.invoice_tokens(spark, d), S.invoice_fields(spark, d, "total"))
    return flat(got.select("doc_id", "field", "value", "status", "page", "box", "matched_text"))


@query(INV + "SELECT doc_id, field, 'normalized' AS status, page_hint AS page FROM fld WHERE field NOT LIKE '%.price'")
def resolve_fields(spark, d):
    """The whole plan over totals and dates: every one is found on its page."""
    from quillmap.plans.resolve import resolve

    f = S.invoice_fields(spark, d, "total", "date")
    return resolve(S.invoice_tokens(spark, d), f).select("doc_id", "field", "status", "page")


def _rows(spark, d) -> DataFrame:
    """Rows of invoices with the tokens' boxes: doc_id, table, page, row, column, box."""
    t = S.invoice_tokens(spark, d).where("line_index > 0")
    return t.select("doc_id", F.concat(F.lit("p"), F.col("page")).alias("table"), "page", (F.col("line_index") - 1).alias("row"), F.col("token_idx").alias("column"), "box", "text")


@query(INV + """, r AS (SELECT doc_id, page - 1 AS row, CASE WHEN page % 3 = 2 THEN page END AS p FROM pg)
SELECT doc_id, 'orders' AS "table", row, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(p IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS page FROM r""")
def tbl_filled_pages(spark, d):
    from quillmap.operators import tables as B

    r = S.invoice_pages(spark, d).select("doc_id", F.lit("orders").alias("table"), (F.col("page") - 1).alias("row"), F.when(F.col("page") % 3 == 2, F.col("page")).alias("page"))
    return B.filled_pages(r)


@query(INV + """SELECT f.doc_id, 'orders' AS "table", f.page_hint - 1 AS row, min(n.page) AS page FROM fld AS f JOIN numtok AS n ON f.doc_id = n.doc_id AND CAST(f.value AS DOUBLE) = n.number
WHERE f.kind = 'float' GROUP BY f.doc_id, f.page_hint HAVING count(DISTINCT n.page) = 1""")
def tbl_row_pages(spark, d):
    from quillmap.operators import tables as B

    got = C.numbers(S.invoice_fields(spark, d, "total", "price"), I.number_postings(S.invoice_tokens(spark, d))).where("similarity = 1")
    return B.row_pages(got.select("doc_id", F.lit("orders").alias("table"), (F.col("page_hint") - 1).alias("row"), "page"))


@query(INV + """SELECT doc_id, 'p' || page AS "table", line_index - 1 AS row, page, line_index, round(0.106::DOUBLE + line_index * 0.03::DOUBLE, 6) AS y, 8.0::DOUBLE AS score FROM li""")
def tbl_aligned_rows(spark, d):
    from quillmap.operators import tables as B

    t = S.invoice_tokens(spark, d)
    r = _rows(spark, d).groupBy("doc_id", "table", "page", "row").agg(F.array(F.max(F.when(F.col("column") == 0, F.col("text"))), F.max(F.when(F.col("column") == 1, F.col("text")))).alias("values"))
    got = B.aligned_rows(r.select("doc_id", "table", "row", "page", "values"), I.lines(t))
    return got.withColumn("y", r6("y"))


@query(INV + """, m AS (SELECT *, max(line_index) OVER (PARTITION BY doc_id, page) AS n FROM li)
SELECT doc_id, 'p' || page AS "table", page, line_index - 1 AS row, CASE WHEN line_index % 2 = 1 THEN 'aligned' WHEN n = 2 THEN 'none' ELSE 'interpolated' END AS anchor_kind,
  CASE WHEN n > 2 OR line_index = 1 THEN round(0.106::DOUBLE + line_index * 0.03::DOUBLE, 6) END AS y FROM m""")
def tbl_interpolated(spark, d):
    from quillmap.operators import tables as B

    r = _rows(spark, d).where("column = 0").select("doc_id", "table", "page", "row", F.when(F.col("row") % 2 == 0, G.cy("box")).alias("y"))
    return B.interpolated(r).withColumn("y", r6("y"))


@query(INV + """SELECT doc_id, 'p' || page AS "table", page, CAST(count(*) AS BIGINT) AS n, count(*) >= 5 AS grid FROM li GROUP BY doc_id, page""")
def tbl_is_grid(spark, d):
    from quillmap.operators import tables as B

    return B.is_grid(_rows(spark, d).where("column = 0")).select("doc_id", "table", "page", "n", "grid")


@query(INV + """SELECT doc_id, 'p' || page AS "table", token_idx AS "column", round(median(x), 6) AS x, round(median(w), 6) AS w, CAST(count(*) AS BIGINT) AS n FROM tok WHERE line_index > 0 GROUP BY doc_id, page, token_idx HAVING count(*) >= 3""")
def tbl_column_places(spark, d):
    from quillmap.operators import tables as B

    return B.column_places(_rows(spark, d)).withColumns({"x": r6("x"), "w": r6("w")})


@query(INV + """SELECT doc_id, 'p' || page AS "table", CAST(5 AS BIGINT) AS rails, CAST(10 * count(*) AS BIGINT) AS side, CAST(0 AS BIGINT) AS below, 'TRUE_2D_TABLE' AS kind FROM li GROUP BY doc_id, page""")
def tbl_kind(spark, d):
    from quillmap.operators import tables as B

    return B.table_kind(_rows(spark, d))


@query(INV + """, s AS (SELECT doc_id, page, line_index - 1 AS row, coalesce(sum(CASE WHEN quantity > 25 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM li)
SELECT doc_id, 'p' || page AS "table", row, CAST(s // 4 AS INTEGER) AS page_no, CAST(s % 4 AS INTEGER) AS slot FROM s""")
def tbl_slots(spark, d):
    from quillmap.operators import tables as B

    r = _rows(spark, d).where("column = 2").withColumn("quantity", F.col("text").cast("long"))
    return B.slots(r, 4, F.col("quantity") > 25).select("doc_id", "table", "row", "page_no", "slot")


@query(INV + """SELECT f.doc_id, f.field, n.page, n.line_index FROM fld AS f JOIN numtok AS n ON f.doc_id = n.doc_id AND CAST(f.value AS DOUBLE) = n.number AND n.token_idx = 3 WHERE f.field LIKE '%.price'""")
def rec_torn_numbers(spark, d):
    """Amounts torn after their third character."""
    from quillmap.operators import recovery as V

    t = S.invoice_tokens(spark, d).where("token_idx = 3 and line_index > 0")
    a = t.withColumns({"text": F.expr("substr(text, 1, 3)"), "box": G.part("box", F.lit(0), F.lit(3), F.length("text"))})
    b = t.withColumns({"text": F.expr("substr(text, 4)"), "token_idx": F.lit(4), "box": G.part("box", F.lit(3), F.length("text"), F.length("text"))})
    f = S.invoice_fields(spark, d, "price")
    return V.torn_numbers(f, I.lines(a.union(b))).select("doc_id", "field", "page", "line_index")


@query(INV + """, g AS (SELECT *, x - coalesce(lag(x + w) OVER o, 0) AS b, coalesce(lead(x) OVER o, 1) - (x + w) AS a FROM tok WINDOW o AS (PARTITION BY doc_id, page, line_index ORDER BY x))
SELECT doc_id, page, line_index, token_idx, round(x - least(0.06::DOUBLE, greatest(0, b) * 0.45::DOUBLE), 6) AS x, round(w + least(0.06::DOUBLE, greatest(0, b) * 0.45::DOUBLE) + least(0.12::DOUBLE, greatest(0, a) * 0.5::DOUBLE), 6) AS w FROM g""")
def ref_gap_expanded(spark, d):
    from quillmap.operators import refine as E

    return flat(E.gap_expanded(S.invoice_tokens(spark, d))).select("doc_id", "page", "line_index", "token_idx", "x", "w")


@query(INV + """, ln AS (SELECT doc_id, page, line_index, string_agg(lower(text), ' ' ORDER BY x) AS t FROM tok GROUP BY doc_id, page, line_index),
tt AS (SELECT doc_id, page, lower(text) AS v FROM tok WHERE line_index = 0 AND token_idx = 4)
SELECT ln.doc_id, CAST(count(*) AS BIGINT) AS total_lines, CAST(sum(CASE WHEN contains(ln.t, tt.v) THEN 1 ELSE 0 END) AS BIGINT) AS mapped_lines,
  round(100.0::DOUBLE * sum(CASE WHEN contains(ln.t, tt.v) THEN 1 ELSE 0 END) / count(*), 1) AS coverage_percent FROM ln JOIN tt USING (doc_id, page) GROUP BY ln.doc_id""")
def eval_coverage(spark, d):
    from quillmap.operators import evaluate as E

    t = S.invoice_tokens(spark, d)
    r = t.where("line_index = 0 and token_idx = 4").select("doc_id", "page", "box", F.col("text").alias("matched_text"))
    return E.coverage(I.lines(t), r)


def _judged(spark, d) -> DataFrame:
    """Prices found by rank of occurrence, beside their gold places."""
    from quillmap.operators import evaluate as E

    t, f = S.invoice_tokens(spark, d), S.invoice_fields(spark, d, "price")
    place = t.where("token_idx = 3").select("doc_id", F.col("page").alias("gold_page"), F.col("line_index").alias("gold_line"), F.col("box").alias("gold_box"))
    gold = f.join(place, ["doc_id", "gold_page", "gold_line"]).select("doc_id", "field", "gold_page", "gold_box")
    return E.judged(C.nth_occurrence(f, t).select("doc_id", "field", "page", "box"), gold)


_JUDGED = INV + """, a AS (SELECT doc_id, field, page_hint, value, gold_line, row_number() OVER (PARTITION BY doc_id, page_hint, value ORDER BY gold_line) AS n FROM fld WHERE field LIKE '%.price'),
b AS (SELECT doc_id, page, line_index, token_idx, replace(replace(lower(text), '$', ''), ',', '') AS v FROM tok),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, v ORDER BY line_index, token_idx) AS n FROM b),
j AS (SELECT a.doc_id, a.field, c.page, c.line_index IS NOT NULL AS placed, coalesce(c.line_index = a.gold_line AND c.token_idx = 3, false) AS hit FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.page_hint = c.page AND a.value = c.v AND a.n = c.n)
"""


@query(_JUDGED + """SELECT doc_id, CAST(count(*) AS BIGINT) AS n_gold, CAST(sum(CAST(placed AS INTEGER)) AS BIGINT) AS n_placed, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS hits,
  round(coalesce(sum(CAST(hit AS INTEGER))::DOUBLE / nullif(sum(CAST(placed AS INTEGER)), 0), 0), 6) AS precision, round(sum(CAST(hit AS INTEGER))::DOUBLE / count(*), 6) AS recall,
  round(2.0::DOUBLE * sum(CAST(hit AS INTEGER)) / (count(*) + sum(CAST(placed AS INTEGER))), 6) AS f1 FROM j GROUP BY doc_id""")
def eval_scores(spark, d):
    from quillmap.operators import evaluate as E

    s = E.scores(_judged(spark, d))
    return s.select("doc_id", "n_gold", "n_placed", "hits", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(_JUDGED + """, k AS (SELECT 'orders[].rows[].price' AS pattern, CASE WHEN NOT placed THEN 'ZERO_CANDIDATE' WHEN hit THEN 'PASS' ELSE 'WRONG_ROW' END AS class FROM j)
SELECT pattern, class, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY ROLLUP (pattern, class)""")
def eval_failures(spark, d):
    from quillmap.operators import evaluate as E

    return E.failures(_judged(spark, d))


@query(_JUDGED + """SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, round(avg(r), 6) AS recall FROM (SELECT doc_id, sum(CAST(hit AS INTEGER))::DOUBLE / count(*) AS r FROM j GROUP BY doc_id)""")
def eval_suite(spark, d):
    from quillmap.operators import evaluate as E

    return E.suite(E.scores(_judged(spark, d))).select("documents", r6("recall").alias("recall"))


@query("""WITH s AS (SELECT user_id AS doc_id, CASE event_type WHEN 'click' THEN 'exact' WHEN 'view' THEN 'fuzzy' WHEN 'error' THEN 'ambiguous' ELSE 'not_found' END AS s FROM events)
SELECT doc_id, CAST(sum(CASE WHEN s IN ('exact', 'fuzzy') THEN 1 ELSE 0 END) AS BIGINT) AS verified, CAST(sum(CASE WHEN s = 'ambiguous' THEN 1 ELSE 0 END) AS BIGINT) AS mismatch,
  CAST(sum(CASE WHEN s = 'not_found' THEN 1 ELSE 0 END) AS BIGINT) AS hallucination FROM s GROUP BY doc_id""")
def eval_status(spark, d):
    from quillmap.operators import evaluate as E

    kind = F.col("event_type")
    s = F.when(kind == "click", "exact").when(kind == "view", "fuzzy").when(kind == "error", "ambiguous").otherwise("not_found")
    return E.status_counts(S.table(spark, d, "events").select(F.col("user_id").alias("doc_id"), s.alias("status")))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS b, o_orderkey % 5 = 0 AS a, o_orderkey % 7 <> 0 AS has_b, o_orderkey % 11 <> 0 AS has_a FROM orders)
SELECT k AS doc_id, 'f' AS field, CASE WHEN NOT has_b THEN 'only_after' WHEN NOT has_a THEN 'only_before' WHEN NOT b AND a THEN 'gained' WHEN b AND NOT a THEN 'lost' ELSE 'same' END AS change FROM a WHERE has_a OR has_b""")
def eval_report_diff(spark, d):
    from quillmap.operators import evaluate as E

    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("f").alias("field"))
    got = E.report_diff(o.where("doc_id % 7 != 0").withColumn("hit", F.col("doc_id") % 3 == 0), o.where("doc_id % 11 != 0").withColumn("hit", F.col("doc_id") % 5 == 0))
    return got.select("doc_id", "field", "change")


@query(INV + """, c AS (SELECT f.doc_id, f.field, n.page, n.line_index, n.token_idx, f.page_hint, row_number() OVER (PARTITION BY f.doc_id, f.field ORDER BY n.page, n.line_index, n.x) AS rank
  FROM fld AS f JOIN numtok AS n ON f.doc_id = n.doc_id AND CAST(f.value AS DOUBLE) = n.number WHERE f.field LIKE '%.total'),
m AS (SELECT doc_id, field, min(CASE WHEN page = page_hint AND line_index = 0 AND token_idx = 4 THEN rank END) AS first FROM c GROUP BY doc_id, field)
SELECT CAST(count(*) AS BIGINT) AS fields, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5 FROM m""")
def eval_recall(spark, d):
    from pyspark.sql import Window
    from quillmap.operators import evaluate as E

    t, f = S.invoice_tokens(spark, d), S.invoice_fields(spark, d, "total")
    got = C.numbers(f, I.number_postings(t)).where("similarity = 1")
    ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "field").orderBy("page", "line_index", "box.x")))
    place = t.where("line_index = 0 and token_idx = 4").select("doc_id", F.col("page").alias("gold_page"), F.col("box").alias("gold_box"))
    gold = f.join(place, ["doc_id", "gold_page"]).select("doc_id", "field", "gold_page", "gold_box")
    return E.recall_at(ranked, gold).select("fields", r6("recall_1").alias("recall_1"), r6("recall_5").alias("recall_5"))


@query(INV + """SELECT doc_id, page, line_index, token_idx, lag(text) OVER o AS "left", lead(text) OVER o AS "right", lag(text) OVER v AS above, lead(text) OVER v AS below FROM tok
WINDOW o AS (PARTITION BY doc_id, page, line_index ORDER BY x), v AS (PARTITION BY doc_id, page, token_idx ORDER BY line_index)""")
def ctx_neighbours(spark, d):
    from quillmap.operators import context as X

    return X.neighbours(S.invoice_tokens(spark, d)).select("doc_id", "page", "line_index", "token_idx", "left", "right", "above", "below")


@query(INV + "SELECT doc_id, page, CAST(token_idx AS BIGINT) AS rail, round(x, 6) AS x, CAST(count(*) AS BIGINT) AS n FROM tok GROUP BY doc_id, page, token_idx, x HAVING count(*) >= 2")
def ctx_rails(spark, d):
    from quillmap.operators import context as X

    return X.rails(S.invoice_tokens(spark, d)).withColumn("x", r6("x"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER), '%Y-%m-%d') AS due FROM orders")
def ctx_relative_date(spark, d):
    from quillmap.operators import context as X

    o = S.table(spark, d, "orders")
    return o.select("o_orderkey", X.relative_date(F.concat(F.lit("Terms: Net "), F.col("o_orderkey") % 90), F.to_date("o_orderdate")).cast("string").alias("due"))


@query(INV + """, h AS (SELECT doc_id, page, line_index, part, last_value(CASE WHEN quantity > 10 THEN line_index END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM li)
SELECT doc_id, page, coalesce(h, line_index) AS line_index, string_agg(CAST(part AS VARCHAR), ' ' ORDER BY line_index) AS text, CAST(count(*) AS BIGINT) AS n_lines FROM h GROUP BY doc_id, page, coalesce(h, line_index)""")
def ctx_merged_wraps(spark, d):
    from quillmap.operators import context as X

    r = S.placed_rows(spark, d).select("doc_id", "page", "line_index", F.when(F.col("quantity") > 10, F.col("quantity").cast("string")).alias("key"), F.col("part").cast("string").alias("text"))
    return X.merged_wraps(r).drop("key")


@query("SELECT user_id AS doc_id, 'all' AS form, CAST(count(DISTINCT event_type) AS BIGINT) AS hits FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 3")
def tpl_detected(spark, d):
    from quillmap.operators import templates as L

    f = S.table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("field"))
    return L.detected(f, f.select(F.lit("all").alias("form"), "field").distinct())


from quillmap import derived_queries, page_queries  # noqa: E402, F401  add their queries
