"""Tokens and fields out of tables: invoices, prose and web pages.

Tokens have the columns doc_id, page, line_index, token_idx, text, box. All are
projections and joins on document keys; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillmap.functions import geometry as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Orders a partition: their 200,000 tokens, some 40 MB, are sorted in a task's memory.
ORDERS = 10_000
#: Orders a partition while their rows are numbered and joined with them: some 400,000 rows, that are sorted and dealt on in a task's memory.
ORDERS_KEYED = 100_000


def parts(spark: SparkSession, sf_dir: str) -> int:
    """How many partitions documents are dealt to; the more orders the more, so that a partition's tokens never grow."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "orders").count() // ORDERS))


def by_order(rows: DataFrame, sf_dir: str, key: str) -> DataFrame:
    """``rows`` dealt by order to as many partitions as keep sorting them in memory, if the session's number is too small for that; else as they are."""
    spark = rows.sparkSession
    parts = -(-table(spark, sf_dir, "orders").count() // ORDERS_KEYED)
    return rows if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(parts, key)


def together(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (doc_id, whole numbers and dates) with all of a document in one of ``parts`` partitions: they are shuffled while they
    are compact, and what groups, ranks or joins by the document and more keys, the far more tokens made of them too,
    shuffles no more. Joins count on that only with this setting of the session. As one array the columns are
    never cut down to those that are asked for, and no filter goes below what makes rows of it, so all who read the same rows share the one shuffle. Spark
    puts partitions together by the size of the compact rows; with a number it leaves them, so the sorts of tokens don't spill."""
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    kinds = [(c, k) for c, k in rows.dtypes if c != "doc_id"]
    packed = F.array(*[(F.unix_date(c) if k == "date" else F.col(c)).cast("long") for c, k in kinds])
    back = [F.date_from_unix_date(F.get("packed", F.lit(i)).cast("int")) if k == "date" else F.get("packed", F.lit(i)).cast(k) for i, (_, k) in enumerate(kinds)]
    return rows.select("doc_id", packed.alias("packed")).repartition(parts, "doc_id").select("doc_id", F.inline(F.array(F.struct(*[x.alias(c) for x, (c, _) in zip(back, kinds)]))))


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("long")


def printed(c: Column, commas: bool = True) -> Column:
    """Cents as an amount, with or without separators of thousands."""
    whole = F.floor(c / F.lit(100)).cast("long")
    head = F.format_number(whole, 0) if commas else whole.cast("string")
    return F.concat(head, F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


#: Left edges of an invoice's columns.
RAILS = (0.05, 0.20, 0.32, 0.50, 0.75)
HEIGHT, CHAR = 0.012, 0.008


def _token(line: Column, at: int, text: Column, y: Column) -> Column:
    return F.struct(line.alias("line_index"), F.lit(at).alias("token_idx"), text.alias("text"), G.box(F.lit(RAILS[at]), y, F.length(text) * CHAR, F.lit(HEIGHT)).alias("box"))


def invoice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, doc_id, page, date, total in cents): a page for each order, a document for each customer."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("order"), F.to_date("o_orderdate").alias("date"), cents("o_totalprice").alias("total"))
    page = F.row_number().over(Window.partitionBy("doc_id").orderBy("order"))
    return together(orders, parts(spark, sf_dir)).select("order", "doc_id", page.alias("page"), "date", "total")


def invoice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, line_index, part, quantity, price in cents, shipped): the lines of each order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    line = by_order(line, sf_dir, "l_orderkey").withColumn("line_index", F.row_number().over(w))
    return line.select(F.col("l_orderkey").alias("order"), "line_index", F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("quantity"), cents("l_extendedprice").alias("price"), F.to_date("l_shipdate").alias("shipped"))


def placed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``invoice_rows`` with doc_id and page, documents together."""
    return together(invoice_rows(spark, sf_dir).join(invoice_pages(spark, sf_dir).select("order", "doc_id", "page"), "order"), parts(spark, sf_dir))


def invoice_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header line, then a line for each row; amounts are printed in four ways."""
    pages = invoice_pages(spark, sf_dir)
    y = F.lit(0.05)
    head = pages.select("doc_id", "page", F.inline(F.array(
        _token(F.lit(0), 0, F.lit("Order"), y), _token(F.lit(0), 1, F.col("order").cast("string"), y), _token(F.lit(0), 2, F.date_format("date", "yyyy-MM-dd"), y),
        _token(F.lit(0), 3, F.lit("Total:"), y), _token(F.lit(0), 4, F.concat(F.lit("$"), printed(F.col("total"))), y),
    )))
    rows = placed_rows(spark, sf_dir)
    way, price = (F.col("order") + F.col("line_index")) % 4, printed(F.col("price"))
    shown = F.when(way == 0, price).when(way == 1, F.concat(F.lit("$"), price)).when(way == 2, F.translate(price, "0", "O")).otherwise(printed(F.col("price"), commas=False))
    day = F.when(F.col("order") % 3 == 0, F.date_format("shipped", "yyyy-MM-dd")).otherwise(F.date_format("shipped", "MM/dd/yyyy"))
    line, y = F.col("line_index"), F.lit(0.10) + F.col("line_index") * 0.03
    body = rows.select("doc_id", "page", F.inline(F.array(
        _token(line, 0, F.concat(F.lit("#"), line.cast("string")), y), _token(line, 1, F.col("part").cast("string"), y), _token(line, 2, F.col("quantity").cast("string"), y),
        _token(line, 3, shown, y), _token(line, 4, day, y),
    )))
    return head.union(body)


def invoice_fields(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """(doc_id, field, value, kind, context, page_hint, gold_page, gold_line): total and date of
    each order and the price of each row, clean, or those named of them. gold columns are for evaluation only."""
    pages = invoice_pages(spark, sf_dir)
    total = pages.select("doc_id", F.concat(F.lit("orders["), F.col("page") - 1, F.lit("].total")).alias("field"), printed(F.col("total"), commas=False).alias("value"), F.lit("float").alias("kind"), F.lit("total").alias("context"), "page", F.lit(0).alias("gold_line"))
    day = pages.select("doc_id", F.concat(F.lit("orders["), F.col("page") - 1, F.lit("].date")).alias("field"), F.date_format("date", "MMMM d, yyyy").alias("value"), F.lit("str").alias("kind"), F.lit("order").alias("context"), "page", F.lit(0).alias("gold_line"))
    rows = placed_rows(spark, sf_dir)
    price = rows.select("doc_id", F.concat(F.lit("orders["), F.col("page") - 1, F.lit("].rows["), F.col("line_index") - 1, F.lit("].price")).alias("field"), printed(F.col("price"), commas=False).alias("value"), F.lit("float").alias("kind"), F.concat(F.lit("#"), F.col("line_index").cast("string")).alias("context"), "page", F.col("line_index").alias("gold_line"))
    found = {"total": total, "date": day, "price": price}
    both = reduce(DataFrame.union, [found[n] for n in names or found])
    return both.select("doc_id", "field", "value", "kind", "context", F.col("page").alias("page_hint"), F.col("page").alias("gold_page"), "gold_line")


def invoice_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, field, value, kind, page, gold_line, gold_token): every value of each order and its rows, clean, as a payload has them."""
    pages = invoice_pages(spark, sf_dir)
    order = F.concat(F.lit("orders["), F.col("page") - 1, F.lit("]"))

    def leaf(name: Column, value: Column, kind: str, token: int) -> Column:
        return F.struct(name.alias("field"), value.alias("value"), F.lit(kind).alias("kind"), F.lit(token).alias("gold_token"))

    words = lambda c: F.date_format(c, "MMMM d, yyyy")
    heads = pages.select("doc_id", "page", F.lit(0).alias("gold_line"), F.inline(F.array(
        leaf(F.concat(order, F.lit(".number")), F.col("order").cast("string"), "int", 1), leaf(F.concat(order, F.lit(".date")), words("date"), "str", 2),
        leaf(F.concat(order, F.lit(".total")), printed(F.col("total"), commas=False), "float", 4),
    )))
    row = F.concat(order, F.lit(".rows["), F.col("line_index") - 1, F.lit("]"))
    rows = placed_rows(spark, sf_dir).select("doc_id", "page", F.col("line_index").alias("gold_line"), F.inline(F.array(
        leaf(F.concat(row, F.lit(".part")), F.col("part").cast("string"), "int", 1), leaf(F.concat(row, F.lit(".quantity")), F.col("quantity").cast("string"), "int", 2),
        leaf(F.concat(row, F.lit(".price")), printed(F.col("price"), commas=False), "float", 3), leaf(F.concat(row, F.lit(".shipped")), words("shipped"), "str", 4),
    )))
    return heads.union(rows).select("doc_id", "field", "value", "kind", "page", "gold_line", "gold_token")


def prose_lines(docs: DataFrame, per_page: int = 40) -> DataFrame:
    """(doc_id, page, line_index, text): the lines of texts, forty to a page."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.select("doc_id", (F.floor(F.col("n") / per_page) + 1).cast("int").alias("page"), (F.col("n") % per_page).alias("line_index"), "text")


def prose_tokens(docs: DataFrame, per_page: int = 40) -> DataFrame:
    """The words of texts on a page of lines, each a fiftieth of the page wide at most."""
    words = prose_lines(docs, per_page).select("doc_id", "page", "line_index", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("token_idx", "text"))
    x = F.least(F.col("token_idx") * 0.02, F.lit(0.98))
    return words.withColumn("box", G.box(x, F.col("line_index") / F.lit(per_page), F.lit(0.018), F.lit(0.02)))


def html_text(html: str) -> Column:
    """Visible text of a web page: no scripts, styles, comments or tags; five entities decoded."""
    t = F.regexp_replace(F.col(html), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_tokens(pages: DataFrame) -> DataFrame:
    """Words of web pages; each page is a document of one page."""
    rows = pages.select(F.col("page_id").alias("doc_id"), html_text("html").alias("text"))
    return prose_tokens(rows)
