"""Surroundings of tokens: neighbours, rails, printed variants, relative dates, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmap.functions import geometry as G, text as T


def neighbours(tokens: DataFrame) -> DataFrame:
    """Tokens with the words left and right of them and those above and below in the next lines."""
    w = Window.partitionBy("doc_id", "page", "line_index").orderBy("box.x", "token_idx")
    rows = tokens.withColumns({"left": F.lag("text").over(w), "right": F.lead("text").over(w)})
    other = tokens.select("doc_id", "page", F.col("line_index").alias("l2"), F.col("text").alias("t2"), F.col("box").alias("b2"))
    out = rows
    for name, k in (("above", -1), ("below", 1)):
        o = other.withColumn("line_index", F.col("l2") - k).drop("l2")
        met = rows.select("doc_id", "page", "line_index", "token_idx", "box").join(o, ["doc_id", "page", "line_index"]).where((F.col("b2.x") < G.x1("box")) & (G.x1("b2") > F.col("box.x")))
        best = met.groupBy("doc_id", "page", "line_index", "token_idx").agg(F.min_by("t2", F.struct(F.abs(G.cx("b2") - G.cx("box")), "t2")).alias(name))
        out = out.join(best, ["doc_id", "page", "line_index", "token_idx"], "left")
    return out


def rails(tokens: DataFrame, gap: float = 0.035) -> DataFrame:
    """(doc_id, page, rail, x, n): groups of left edges with no gap over ``gap``, two tokens and more."""
    w = Window.partitionBy("doc_id", "page").orderBy("box.x", "line_index", "token_idx")
    rows = tokens.withColumn("b", F.coalesce((F.col("box.x") - F.lag("box.x").over(w) > gap).cast("int"), F.lit(0))).withColumn("rail", F.sum("b").over(w))
    return rows.groupBy("doc_id", "page", "rail").agg(F.percentile("box.x", 0.5).alias("x"), F.count("*").alias("n")).where("n >= 2")


def under_header(tokens: DataFrame, headers: DataFrame) -> DataFrame:
    """header of each token: the lowest header (doc_id, page, header, box) above it that it overlaps."""
    h = headers.select("doc_id", "page", "header", F.col("box").alias("hb"))
    met = tokens.join(h, ["doc_id", "page"]).where((F.col("hb.y") < F.col("box.y")) & (F.col("hb.x") < G.x1("box")) & (G.x1("hb") > F.col("box.x")))
    best = met.groupBy("doc_id", "page", "line_index", "token_idx").agg(F.max_by("header", F.struct("hb.y", -F.abs(G.cx("hb") - G.cx("box")), "header")).alias("header"))
    return tokens.join(best, ["doc_id", "page", "line_index", "token_idx"], "left")


def variants(value: Column) -> Column:
    """Printed forms of a value: as it is, without punctuation, with and without thousands'
    separators, as money, as percentage and fraction, a dash for zero."""
    v, n = F.trim(value), T.number(value)
    whole = n == F.floor(n)
    plain = F.when(whole, n.cast("long").cast("string"))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(
        v, F.regexp_replace(v, r"[^\p{L}\p{N} ]", ""), plain, F.when(n.isNotNull(), F.format_number(n, 2)), F.when(whole, F.format_number(n, 0)),
        F.when(n.isNotNull(), F.concat(F.lit("$"), F.format_number(n, 2))), F.when(v.endswith("%"), F.format_number(n / 100, 4)),
        F.when(F.abs(n) < 1, F.concat(F.format_number(n * 100, 2), F.lit("%"))), F.when(n == 0, F.lit("-")),
    ))))


def relative_date(text: Column, base: Column) -> Column:
    """The date that ``Net 30``, ``due in 15 days`` or ``15 days from ...`` means, counted from a base."""
    t = F.lower(text)
    days = F.coalesce(F.nullif(F.regexp_extract(t, r"\bnet\s*(\d{1,3})\b", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"\b(\d{1,3})\s*days?\s*(?:from|after|of|net)?\b", 1), F.lit("")))
    weeks = F.nullif(F.regexp_extract(t, r"\b(\d{1,2})\s*weeks?\b", 1), F.lit(""))
    n = F.coalesce(days.cast("int"), weeks.cast("int") * 7, F.when(t.contains("upon receipt"), 0))
    return F.date_add(base, n)


def merged_wraps(rows: DataFrame) -> DataFrame:
    """Lines of a table (doc_id, page, line_index, key, text) whose key is empty joined to the last with one."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_index")
    head = F.when(F.coalesce(F.col("key"), F.lit("")) != "", F.col("line_index"))
    rows = rows.withColumn("head", F.coalesce(F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("line_index")))
    parts = F.array_sort(F.collect_list(F.struct("line_index", "text")))
    out = rows.groupBy("doc_id", "page", F.col("head").alias("line_index")).agg(F.max("key").alias("key"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.count("*").alias("n_lines"))
    return out


def features(ranked: DataFrame) -> DataFrame:
    """Candidates with numbers that tell them apart, none of which knows the gold place."""
    own = Window.partitionBy("doc_id", "field")
    return ranked.withColumns({
        "f_similarity": F.col("similarity"), "f_rank": 1 / F.col("rank"), "f_margin": F.coalesce("margin", F.lit(1.0)), "f_count": F.log1p(F.count("*").over(own)),
        "f_page_gap": F.coalesce(F.abs(F.col("page") - F.col("page_hint")), F.lit(0)).cast("double"), "f_x": F.col("box.x"), "f_y": F.col("box.y"), "f_area": G.area("box"),
        "f_length": F.length("matched_text").cast("double"),
    })
