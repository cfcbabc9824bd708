"""Queries over pages derived from the given tables: torn, broken, boxed and misread in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmap.functions import geometry as G, text as T
from quillmap.operators import candidates as C, context as X, index as I, recovery as V, tables as B
from quillmap.queries import INV, PROSE, flat, query, r6
from quillmap.sources import corpora as S


def _token(line: int | Column, at: int, text: Column, x: float, y: Column | float) -> Column:
    y = y if isinstance(y, Column) else F.lit(y)
    line = line if isinstance(line, Column) else F.lit(line)
    return F.struct(line.alias("line_index"), F.lit(at).alias("token_idx"), text.alias("text"), G.box(F.lit(x), y, F.length(text) * 0.008, F.lit(0.012)).alias("box"))


def _on_pages(spark, d, *tokens: Column) -> DataFrame:
    """Tokens made of each order's columns, on its page."""
    return S.invoice_pages(spark, d).select("doc_id", "page", F.inline(F.array(*tokens)))


def _asked(spark, d, name: str, value: Column, kind: str = "str") -> DataFrame:
    return S.invoice_pages(spark, d).select("doc_id", F.concat(F.lit("orders["), F.col("page") - 1, F.lit(f"].{name}")).alias("field"), value.alias("value"), F.lit(kind).alias("kind"), F.lit("").alias("context"), F.col("page").alias("page_hint"))


@query(INV + """SELECT f.doc_id, f.field, li.page, li.line_index, '$ ' || li.comma AS matched_text FROM fld AS f JOIN li ON f.doc_id = li.doc_id AND CAST(round(CAST(f.value AS DOUBLE) * 100) AS BIGINT) = li.price WHERE f.field LIKE '%.price'""")
def rec_split_signs(spark, d):
    """Amounts whose sign is a word of its own."""
    rows = S.placed_rows(spark, d)
    y, line = F.lit(0.10) + F.col("line_index") * 0.03, F.col("line_index")
    t = rows.select("doc_id", "page", F.inline(F.array(_token(line, 0, F.lit("$"), 0.5, y), _token(line, 1, S.printed(F.col("price")), 0.52, y))))
    f = S.invoice_fields(spark, d, "price")
    return V.split_signs(f, I.lines(t)).select("doc_id", "field", "page", "line_index", "matched_text")


@query(INV + """, f AS (SELECT doc_id, page AS p, ord, total FROM pg), t AS (SELECT doc_id, page, text AS shown FROM tok WHERE line_index = 0 AND token_idx = 4),
one AS (SELECT DISTINCT doc_id, page FROM li WHERE line_index = 1)
SELECT f.doc_id, 'orders[' || (f.p - 1) || '].head' AS field, f.p AS page, 0 AS line_index, 'Order ' || f.ord AS matched_text, 0.05::DOUBLE AS x, round(0.15::DOUBLE + length(CAST(f.ord AS VARCHAR)) * 0.008::DOUBLE, 6) AS w FROM f
UNION ALL SELECT f.doc_id, 'orders[' || (f.p - 1) || '].over', o.page, 0, b.shown || ' #1', 0.05::DOUBLE, round(0.7::DOUBLE + length(b.shown) * 0.008::DOUBLE, 6)
FROM f JOIN t AS a ON f.doc_id = a.doc_id AND f.p = a.page JOIN t AS b ON f.doc_id = b.doc_id AND a.shown = b.shown JOIN one AS o ON o.doc_id = b.doc_id AND o.page = b.page""")
def cand_sequences(spark, d):
    """Two words of a line, and the last word of a line with the first of the next."""
    t = S.invoice_tokens(spark, d)
    head = _asked(spark, d, "head", F.concat(F.lit("ORDER  "), F.col("order").cast("string")))
    over = _asked(spark, d, "over", F.concat(F.lit("$"), S.printed(F.col("total")), F.lit(" 1")))
    got = C.sequences(head.union(over).union(_asked(spark, d, "nowhere", F.concat(F.col("order").cast("string"), F.lit(" order")))), t)
    return flat(got.select("doc_id", "field", "page", "line_index", "matched_text", "box")).drop("y", "h")


@query(INV + """SELECT doc_id, 'orders[' || (page - 1) || '].' || k AS field, page, 0 AS line_index, 'inv-' || ord || 'x' AS matched_text FROM pg, (SELECT unnest(['whole', 'dashed']) AS k)""")
def cand_hyphenated(spark, d):
    """Values broken at a hyphen at a line's end, asked with and without it; one that goes on in capitals is none."""
    number = F.col("order").cast("string")
    t = _on_pages(spark, d, _token(0, 0, F.lit("ref"), 0.05, 0.1), _token(0, 1, F.lit("inv-"), 0.1, 0.1), _token(1, 0, F.concat(number, F.lit("x")), 0.05, 0.13), _token(2, 0, F.lit("no-"), 0.05, 0.16), _token(3, 0, F.concat(F.lit("A"), number), 0.05, 0.19))
    f = _asked(spark, d, "whole", F.concat(F.lit("inv"), number, F.lit("x"))).union(_asked(spark, d, "dashed", F.concat(F.lit("INV-"), number, F.lit("X")))).union(_asked(spark, d, "none", F.concat(F.lit("noA"), number)))
    return C.hyphenated(f, t).select("doc_id", "field", "page", "line_index", "matched_text")


@query(INV + """SELECT f.doc_id, 'orders[' || (f.page - 1) || '].is_paid' AS field, p.page, 1 AS line_index, CASE WHEN p.ord % 3 = 0 THEN '☒' ELSE '☐' END AS matched_text FROM pg AS f JOIN pg AS p ON f.doc_id = p.doc_id AND (f.ord % 3 = 0) = (p.ord % 3 = 0)""")
def cand_checkboxes(spark, d):
    """Boxes beside the word paid, in the value's state; the other box of a page stands too far from it."""
    paid = F.col("order") % 3 == 0
    box = F.when(paid, F.lit("☒")).otherwise(F.lit("☐"))
    t = _on_pages(spark, d, _token(0, 0, box, 0.5, 0.1), _token(0, 1, F.lit("Shipped"), 0.54, 0.1), _token(1, 0, box, 0.1, 0.2), _token(1, 1, F.lit("Paid:"), 0.14, 0.2), _token(2, 0, F.lit("☒"), 0.1, 0.4), _token(2, 1, F.lit("☐"), 0.2, 0.4))
    return C.checkboxes(_asked(spark, d, "is_paid", paid.cast("string"), "bool"), t).select("doc_id", "field", "page", "line_index", "matched_text")


@query(INV + """, w AS (SELECT doc_id, page, 'item' || lpad(CAST(ord AS VARCHAR), 8, '0') AS v, CASE WHEN ord % 2 = 0 THEN 'item' || lpad(CAST(ord AS VARCHAR), 8, '0') ELSE 'itemO' || lpad(CAST(ord AS VARCHAR), 7, '0') END AS shown FROM pg)
SELECT a.doc_id, 'orders[' || (a.page - 1) || '].code' AS field, b.page, b.shown AS matched_text, round(1 - levenshtein(a.v, lower(b.shown)) / 12.0::DOUBLE, 6) AS similarity FROM w AS a JOIN w AS b ON a.doc_id = b.doc_id AND levenshtein(a.v, lower(b.shown)) <= 1""")
def cand_noise(spark, d):
    """Codes, every second with a zero read as a letter; codes one digit apart are alike too."""
    code = F.concat(F.lit("item"), F.lpad(F.col("order").cast("string"), 8, "0"))
    shown = F.when(F.col("order") % 2 == 0, code).otherwise(F.concat(F.lit("itemO"), F.lpad(F.col("order").cast("string"), 7, "0")))
    t = _on_pages(spark, d, _token(0, 0, shown, 0.1, 0.1))
    got = C.noise_matches(_asked(spark, d, "code", code), I.noise_postings(t, t.select("doc_id", "page").distinct().withColumn("mode", F.lit("ocr"))))
    return got.select("doc_id", "field", "page", "matched_text", r6("similarity").alias("similarity"))


@query(INV + """, f AS (SELECT doc_id, 'n' || page AS field, CAST(ord AS DOUBLE) AS v FROM pg UNION ALL SELECT doc_id, 't' || page, total / 100.0::DOUBLE FROM pg),
h AS (SELECT DISTINCT f.doc_id, f.field, n.page FROM f JOIN numtok AS n ON f.doc_id = n.doc_id AND CAST(round(f.v * 1000000) AS BIGINT) = CAST(round(n.number * 1000000) AS BIGINT)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, field) AS n FROM h),
v AS (SELECT doc_id, page, sum(CASE WHEN n = 1 THEN 2.0::DOUBLE WHEN n <= 3 THEN 0.5::DOUBLE ELSE 0 END) AS votes FROM c GROUP BY doc_id, page)
SELECT doc_id, page, votes FROM v WHERE votes >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, page) = 1""")
def tbl_root_pages(spark, d):
    """The page most of whose order numbers and totals are on no other."""
    p = S.invoice_pages(spark, d)
    f = p.select("doc_id", F.concat(F.lit("n"), "page").alias("field"), F.col("order").cast("string").alias("value"), F.col("page").alias("page_hint")).union(p.select("doc_id", F.concat(F.lit("t"), "page"), S.printed(F.col("total"), commas=False), "page"))
    return B.root_pages(C.numbers(f, I.number_postings(S.invoice_tokens(spark, d))))


_BLOCKS = "(SELECT * FROM (VALUES (1, 0.0, 0.0, 1.0, 0.08), (2, 0.0, 0.10, 1.0, 0.9), (3, 0.5, 0.10, 0.5, 0.115)) AS v(block_id, bx, by_, bw, bh))"


@query(INV + f"""SELECT t.doc_id, t.page, t.line_index, t.token_idx, b.block_id FROM tok AS t JOIN {_BLOCKS} AS b
ON least(t.x + t.w, bx::DOUBLE + bw::DOUBLE) > greatest(t.x, bx::DOUBLE) AND least(t.y + t.h, by_::DOUBLE + bh::DOUBLE) > greatest(t.y, by_::DOUBLE)""")
def idx_blocks_at(spark, d):
    """The blocks of a page that each of its words meets."""
    block = lambda k, *b: F.struct(F.lit(k).alias("block_id"), G.box(*map(F.lit, b)).alias("box"))
    blocks = S.invoice_pages(spark, d).select("doc_id", "page", F.inline(F.array(block(1, 0.0, 0.0, 1.0, 0.08), block(2, 0.0, 0.10, 1.0, 0.9), block(3, 0.5, 0.10, 0.5, 0.115))))
    asked = S.invoice_tokens(spark, d).select("doc_id", "page", "line_index", "token_idx", F.col("box").alias("query_box"))
    return I.blocks_at(blocks, asked).select("doc_id", "page", "line_index", "token_idx", "block_id")


@query(INV + """SELECT doc_id, page, line_index, token_idx, round(x, 6) AS x0, round(y, 6) AS y0, round(x + w, 6) AS x1, round(y + h, 6) AS y1, CAST(round(y * 1000) AS INTEGER) AS top, CAST(round(x * 1000) AS INTEGER) AS "left",
CAST(round((y + h) * 1000) AS INTEGER) AS bottom, CAST(round((x + w) * 1000) AS INTEGER) AS "right" FROM tok""")
def fn_boxes(spark, d):
    """Corners and thousandths of every word's box, through its corners and back."""
    t = S.invoice_tokens(spark, d)
    back = t.withColumn("b", G.from_edges(G.x1("box"), F.col("box.y"), F.col("box.x"), G.y1("box")))
    e, k = G.edges("b"), G.thousandths("box")
    return back.select("doc_id", "page", "line_index", "token_idx", *[e[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], *[k[i].alias(n) for i, n in enumerate(("top", "left", "bottom", "right"))])


@query(PROSE + """, w AS (SELECT DISTINCT text AS a, lead(text) OVER (PARTITION BY doc_id, page, line_index ORDER BY token_idx) AS b FROM pt)
SELECT a, b, a = b OR starts_with(a, b) OR ends_with(a, b) OR (length(b) >= 3 AND contains(a, b)) OR starts_with(b, a) OR ends_with(b, a) OR (length(a) >= 3 AND contains(b, a)) AS hit FROM w WHERE b IS NOT NULL""")
def fn_word_hits(spark, d):
    """Whether neighbouring words of texts begin, end or contain each other."""
    after = F.lead("text").over(Window.partitionBy("doc_id", "page", "line_index").orderBy("token_idx"))
    pairs = S.prose_tokens(S.table(spark, d, "documents")).select(F.col("text").alias("a"), after.alias("b")).where("b is not null").distinct()
    return pairs.withColumn("hit", T.word_hits("a", "b"))


@query(INV + """SELECT doc_id, page, c AS "column", x, w FROM pg, (SELECT * FROM (VALUES ('number', 0.05::DOUBLE, 0.04::DOUBLE), ('sum', 0.5::DOUBLE, 0.048::DOUBLE)) AS v(c, x, w))""")
def tbl_column_headers(spark, d):
    """Columns by heads that every page prints; an alias that none prints gives no column."""
    names = [("sum", 0, "grand total"), ("sum", 1, "total:"), ("number", 0, "order"), ("never", 0, "subtotal")]
    aliases = S.table(spark, d, "region").limit(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(n).alias("nth"), F.lit(a).alias("alias")) for c, n, a in names])))
    got = B.column_headers(I.lines(S.invoice_tokens(spark, d)), aliases)
    return got.select("doc_id", "page", "column", r6("x").alias("x"), r6("w").alias("w"))


@query(INV + """, j AS (SELECT t.doc_id, t.page, t.line_index, t.token_idx, 'h' || h.token_idx AS header, abs(h.x + h.w / 2 - (t.x + t.w / 2)) AS off FROM tok AS t LEFT JOIN tok AS h ON t.doc_id = h.doc_id AND t.page = h.page AND h.line_index = 0 AND h.y < t.y AND h.x < t.x + t.w AND h.x + h.w > t.x WHERE t.line_index > 0)
SELECT doc_id, page, line_index, token_idx, coalesce(header, 'none') AS header FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, page, line_index, token_idx ORDER BY off, header DESC) = 1""")
def ctx_headers(spark, d):
    """The word of a page's first line that each word of the others stands under."""
    t = S.invoice_tokens(spark, d)
    heads = t.where("line_index = 0").select("doc_id", "page", F.concat(F.lit("h"), "token_idx").alias("header"), "box")
    got = X.under_header(t.where("line_index > 0"), heads)
    return got.select("doc_id", "page", "line_index", "token_idx", F.coalesce("header", F.lit("none")).alias("header"))


@query(INV + """, p AS (SELECT ord, line_index, (ord + line_index) % 5 AS k, price / 100.0::DOUBLE AS a FROM li),
q AS (SELECT ord, line_index, a, CASE k WHEN 0 THEN a WHEN 1 THEN a * 1.0000004::DOUBLE WHEN 2 THEN a * 1.000003::DOUBLE WHEN 3 THEN a * 1.0001::DOUBLE ELSE a * 100.0::DOUBLE END AS b FROM p)
SELECT ord AS "order", line_index, abs(a - b) <= greatest(1e-6::DOUBLE * greatest(abs(a), abs(b)), 1e-6::DOUBLE) AS same, abs(a - b) <= greatest(1e-6::DOUBLE, 1e-5::DOUBLE * abs(b)) OR abs(a * 100 - b) <= 1e-3::DOUBLE OR abs(a - b * 100) <= 1e-3::DOUBLE AS near FROM q""")
def fn_equal_numbers(spark, d):
    """Prices beside prices a little off, farther off, and as percentages of themselves."""
    rows = S.invoice_rows(spark, d).withColumn("a", F.col("price") / F.lit(100.0))
    k, a = (F.col("order") + F.col("line_index")) % 5, F.col("a")
    rows = rows.withColumn("b", F.when(k == 0, a).when(k == 1, a * 1.0000004).when(k == 2, a * 1.000003).when(k == 3, a * 1.0001).otherwise(a * 100.0))
    return rows.select("order", "line_index", T.same_number("a", "b").alias("same"), T.near_number("a", "b").alias("near"))


@query(INV + r"""SELECT field, regexp_extract(field, '^(.*)\[(\d+)\](.*)$', 1) AS prefix, CAST(regexp_extract(field, '^(.*)\[(\d+)\](.*)$', 2) AS INTEGER) AS idx, regexp_extract(field, '^(.*)\[(\d+)\](.*)$', 3) AS suffix,
regexp_matches(lower(field), 'total|sum|subtotal|tax_rate|average|ratio|percent|count') AS derived, array_to_string(list_filter(string_split(regexp_replace(lower(field), '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> ''), ' ') AS words,
array_to_string(list_filter(string_split(regexp_replace(lower(field), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')[1:4], '_') AS key FROM (SELECT DISTINCT field FROM fld)""")
def fn_field_names(spark, d):
    """Paths of fields taken apart at their last index, their words, keys and whether they tell of derived values."""
    f = S.invoice_fields(spark, d).select("field").distinct()
    path = T.array_path("field")
    return f.select("field", path["prefix"].alias("prefix"), path["idx"].alias("idx"), path["suffix"].alias("suffix"), T.likely_derived("field").alias("derived"), F.array_join(T.field_words("field"), " ").alias("words"), T.snake_key("field").alias("key"))


@query(INV + """, c AS (SELECT doc_id, page, line_index, token_idx, greatest(0, least(1, (x * 612 - 60) / 612)) AS a, greatest(0, least(1, (x + w) * 612 / 612)) AS c, 1 - greatest(0, least(1, y * 792 / 792)) AS b, 1 - greatest(0, least(1, (y + h) * 792 / 792)) AS d FROM tok)
SELECT doc_id, page, line_index, token_idx, round(least(a, c), 6) AS x, round(least(b, d), 6) AS y, round(abs(c - a), 6) AS w, round(abs(d - b), 6) AS h FROM c""")
def fn_from_points(spark, d):
    """Boxes in points of a page of 612 by 792 from its lower edge, some of them begun left of the page."""
    t = S.invoice_tokens(spark, d)
    b = G.from_points(F.col("box.x") * 612 - 60, F.col("box.y") * 792, G.x1("box") * 612, G.y1("box") * 792, F.lit(612.0), F.lit(792.0), bottom_left=True)
    return flat(t.select("doc_id", "page", "line_index", "token_idx", b.alias("box")))


@query(PROSE + r"""SELECT text, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\s.,\-$%]', ' ', 'g'), '\s+', ' ', 'g')) AS matchable FROM (SELECT DISTINCT text FROM pt)""")
def fn_match_texts(spark, d):
    return S.prose_tokens(S.table(spark, d, "documents")).select("text").distinct().withColumn("matchable", T.for_match("text"))


@query(INV + """, ln AS (SELECT doc_id, page, line_index, string_agg(text, ' ' ORDER BY x) AS t FROM tok GROUP BY doc_id, page, line_index),
tt AS (SELECT doc_id, page, text AS v FROM tok WHERE line_index = 0 AND token_idx = 4),
r AS (SELECT ln.doc_id, ln.page, ln.line_index, ln.t, CAST(row_number() OVER (PARTITION BY ln.doc_id ORDER BY ln.page, ln.line_index) AS INTEGER) AS id FROM ln JOIN tt USING (doc_id, page) WHERE NOT contains(lower(ln.t), lower(tt.v)))
SELECT doc_id, id, page, t AS text FROM r WHERE id <= 200""")
def eval_unmapped(spark, d):
    """The first two hundred lines of each document that don't print their page's total."""
    from quillmap.operators import evaluate as E

    t = S.invoice_tokens(spark, d)
    r = t.where("line_index = 0 and token_idx = 4").select("doc_id", "page", "box", F.col("text").alias("matched_text"))
    return E.unmapped(I.lines(t), r).select("doc_id", "id", "page", "text")


@query(INV + """, f AS (SELECT doc_id, page || '/' || line_index AS record, 'part' AS f, CAST(part AS DOUBLE) AS v FROM li UNION ALL SELECT doc_id, page || '/' || line_index, 'price', price / 100.0::DOUBLE FROM li),
c AS (SELECT f.doc_id, record, f.f, n.page, n.line_index, count(*) OVER (PARTITION BY f.doc_id, record, f.f) AS n FROM f JOIN numtok AS n ON f.doc_id = n.doc_id AND CAST(round(f.v * 1000000) AS BIGINT) = CAST(round(n.number * 1000000) AS BIGINT))
SELECT doc_id, record, f AS name, page, line_index FROM c WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY doc_id, record ORDER BY page, line_index, f) = 1""")
def tbl_record_anchors(spark, d):
    """Of each row's part and price the first that stands at one place of the document only."""
    rows = S.placed_rows(spark, d)
    record = F.concat_ws("/", "page", "line_index")
    one = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    f = rows.select("doc_id", record.alias("record"), F.inline(F.array(one("part", F.col("part").cast("string")), one("price", S.printed(F.col("price"), commas=False)))))
    f = f.select("doc_id", "record", "name", F.concat_ws(".", "record", "name").alias("field"), "value", F.lit(None).cast("int").alias("page_hint"))
    found = C.numbers(f, I.number_postings(S.invoice_tokens(spark, d))).join(f.select("doc_id", "field", "record", "name"), ["doc_id", "field"])
    return B.record_anchor(found).select("doc_id", "record", "name", "page", "line_index")


@query(INV + """, f AS (SELECT doc_id, field, value FROM fld WHERE field LIKE '%.price'),
ex AS MATERIALIZED (SELECT f.doc_id, f.field, t.page, t.line_index, t.text FROM f JOIN tok AS t ON f.doc_id = t.doc_id AND lower(t.text) = f.value),
st AS MATERIALIZED (SELECT f.doc_id, f.field, t.page, t.line_index, t.text FROM f ANTI JOIN ex USING (doc_id, field) JOIN tok AS t ON f.doc_id = t.doc_id AND trim(lower(t.text), ' ,.:;-/_''"()[]{}*&#$€£¥') = f.value),
nu AS (SELECT f.doc_id, f.field, n.page, n.line_index, n.text FROM f ANTI JOIN ex USING (doc_id, field) ANTI JOIN st USING (doc_id, field) JOIN numtok AS n ON f.doc_id = n.doc_id AND CAST(round(CAST(f.value AS DOUBLE) * 1000000) AS BIGINT) = CAST(round(n.number * 1000000) AS BIGINT))
SELECT doc_id, field, 0 AS tier, page, line_index, text AS matched_text FROM ex UNION ALL SELECT doc_id, field, 0, page, line_index, text FROM st UNION ALL SELECT doc_id, field, 1, page, line_index, text FROM nu""")
def rank_tiers(spark, d):
    """Prices by their print, or else by their number."""
    from quillmap.operators import ranking as R

    t, f = S.invoice_tokens(spark, d), S.invoice_fields(spark, d, "price")
    return R.tiers([C.exact_tokens(f, t), C.numbers(f, I.number_postings(t))]).select("doc_id", "field", "tier", "page", "line_index", "matched_text")
