"""Lines and postings of tokens.

Postings are projections of tokens, clustered by nothing but what the join that
follows asks for: every one has the document and a key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quillmap.functions import geometry as G, text as T

PAGE = ["doc_id", "page"]


def cluster_lines(tokens: DataFrame) -> DataFrame:
    """line_index of each token: from the top left, a token joins the first line whose growing
    box it overlaps by half its height (a fold per page, so exact on skewed pages too; many pages
    a batch, and of a token nothing but its place, through Arrow)."""

    def fold(tops: list[float], lefts: list[float], heights: list[float], places: list[int]) -> list[int]:
        lines: list[list] = []
        for i in sorted(range(len(tops)), key=lambda i: (tops[i], lefts[i], places[i])):
            top, height = tops[i], max(heights[i], 0.001)
            for line in lines:
                if min(line[1], top + heights[i]) - max(line[0], top) >= 0.5 * height:
                    line[0], line[1] = min(line[0], top), max(line[1], top + heights[i])
                    line[2].append(i)
                    break
            else:
                lines.append([top, top + heights[i], [i]])
        lines.sort(key=lambda g: (g[0], min(lefts[i] for i in g[2])))
        index = [0] * len(tops)
        for k, g in enumerate(lines):
            for i in g[2]:
                index[i] = k
        return index

    @F.pandas_udf("array<int>")
    def folded(tops: pd.Series, lefts: pd.Series, heights: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([fold(*(x.tolist() for x in page)) for page in zip(tops, lefts, heights, places)], dtype=object)

    pages = tokens.groupBy(*PAGE).agg(F.collect_list(F.struct("*")).alias("rows"))
    at = folded("rows.box.y", "rows.box.x", "rows.box.h", "rows.token_idx")
    rows = pages.withColumn("at", at).select(F.inline(F.arrays_zip("rows", "at")))
    kind = tokens.schema["line_index"].dataType
    return rows.select(*[F.col("at").cast(kind).alias(c) if c == "line_index" else F.col("rows")[c].alias(c) for c in tokens.columns])


def lines_by_gap(tokens: DataFrame, share: float = 0.5) -> DataFrame:
    """The same for clean pages, in generated code: a line begins where a token's top is more
    than a share of its height below the token before."""
    w = Window.partitionBy(*PAGE).orderBy("box.y", "box.x", "token_idx")
    begins = F.coalesce((F.col("box.y") - F.lag("box.y").over(w) > F.col("box.h") * share).cast("int"), F.lit(0))
    return tokens.withColumn("__b", begins).withColumn("line_index", F.sum("__b").over(w).cast("int")).drop("__b")


def lines(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, line_index, box, text, norm, words): a row per line, words from left to right."""
    words = F.array_sort(F.collect_list(F.struct("box.x", "token_idx", "text", "box")))
    rows = tokens.groupBy(*PAGE, "line_index").agg(G.hull("box").alias("box"), words.alias("words"))
    text = F.array_join(F.transform("words", lambda t: t["text"]), " ")
    return rows.withColumn("text", text).withColumn("norm", T.fold("text"))


def token_postings(tokens: DataFrame) -> DataFrame:
    """Tokens with norm and stem."""
    return tokens.withColumn("norm", T.fold("text")).withColumn("stem", T.stem("norm"))


def gram_postings(tokens: DataFrame, n: int = 3, least: int = 4) -> DataFrame:
    """(doc_id, gram, page, line_index): the n-grams of stems of at least four characters."""
    rows = token_postings(tokens).where(F.length("stem") >= least)
    grams = F.transform(F.sequence(F.lit(1), F.length("stem") - (n - 1)), lambda i: F.substring(F.col("stem"), i, F.lit(n)))
    return rows.select("doc_id", "page", "line_index", F.explode(grams).alias("gram")).distinct()


def number_postings(tokens: DataFrame) -> DataFrame:
    """Tokens that are numbers, with the number and its key."""
    rows = tokens.withColumn("number", T.number("text"))
    return rows.where("number is not null").withColumn("number_key", T.number_key("number"))


def pair_postings(tokens: DataFrame) -> DataFrame:
    """Numbers whose sign or currency is a token of its own before them."""
    w = Window.partitionBy(*PAGE, "line_index").orderBy("box.x", "token_idx")
    rows = tokens.withColumn("__next", F.lead(F.struct("text", "box")).over(w)).where(F.col("text").isin("$", "€", "£", "¥", "-", "+") & F.col("__next").isNotNull())
    text = F.concat("text", F.col("__next")["text"])
    pair = rows.select("doc_id", "page", "line_index", "token_idx", text.alias("text"), G.hull_of(F.array("box", F.col("__next")["box"])).alias("box"))
    return number_postings(pair)


def date_postings(lines_: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, page, line_index, first, n_words, date, box): dates in one to four words of a line;
    a window that contains a shorter one is left out."""
    rows = lines_.where(F.col("text").rlike(r"\d")).select(*PAGE, "line_index", "words", F.size("words").alias("size"))
    starts = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("n_words")).where("n_words <= size")
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n_words") + 1)).alias("first"))
    spans = spans.withColumn("span", F.slice("words", F.col("first"), F.col("n_words")))
    spans = spans.withColumn("date", T.date(F.array_join(F.transform("span", lambda t: t["text"]), " "))).where("date is not null")
    found = spans.select(*PAGE, "line_index", "first", "n_words", "date", G.hull_of(F.transform("span", lambda t: t["box"])).alias("box"))
    w = Window.partitionBy(*PAGE, "line_index")
    inner = F.collect_list(F.struct("first", "n_words")).over(w)
    contains = F.exists(inner, lambda s: (s["n_words"] < F.col("n_words")) & (s["first"] >= F.col("first")) & (s["first"] + s["n_words"] <= F.col("first") + F.col("n_words")))
    return found.withColumn("__c", contains).where("not __c").drop("__c")


def page_text(lines_: DataFrame) -> DataFrame:
    """(doc_id, page, text): lines of a page, folded, one below the other."""
    rows = F.array_sort(F.collect_list(F.struct("line_index", "norm")))
    return lines_.groupBy(*PAGE).agg(F.array_join(F.transform(rows, lambda r: r["norm"]), "\n").alias("text"))


def noise_postings(tokens: DataFrame, modes: DataFrame) -> DataFrame:
    """Grams of the tokens of pages whose mode is ``ocr``."""
    read = tokens.join(modes.where("mode = 'ocr'").select(*PAGE).hint("merge"), PAGE, "left_semi")
    rows = token_postings(read).where(F.length("stem") >= 4)
    grams = F.transform(F.sequence(F.lit(1), F.length("stem") - 2), lambda i: F.substring(F.col("stem"), i, F.lit(3)))
    return rows.select("doc_id", "page", "line_index", "token_idx", "text", "stem", "box", F.explode(F.array_distinct(grams)).alias("gram"))


def split_items(items: DataFrame) -> DataFrame:
    """Words of items of several words; an item's width goes by characters."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = items.withColumn("__all", F.greatest(F.length("text"), F.lit(1))).select("*", F.posexplode(words).alias("word_idx", "word"))
    w = Window.partitionBy("doc_id", "page", "item_id").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("word") + 1).over(w), F.lit(0))
    rows = rows.withColumn("__s", before)
    place = G.part("box", F.col("__s"), F.col("__s") + F.length("word"), F.col("__all"))
    return rows.select("doc_id", "page", "item_id", "word_idx", F.col("word").alias("text"), place.alias("box"))


def attach_blocks(tokens: DataFrame, blocks: DataFrame, slack: float = 1e-4) -> DataFrame:
    """block_id of each token: of the blocks its middle is in, the smallest; 0 for none."""
    b = blocks.select("doc_id", "page", F.col("block_id").alias("__id"), F.col("box").alias("__box"))
    inside = G.cx("box").between(F.col("__box.x") - slack, G.x1("__box") + slack) & G.cy("box").between(F.col("__box.y") - slack, G.y1("__box") + slack)
    met = tokens.join(b, PAGE).where(inside).groupBy("doc_id", "page", "line_index", "token_idx").agg(F.min_by("__id", F.struct(G.area("__box"), "__id")).alias("block_id"))
    return tokens.join(met, ["doc_id", "page", "line_index", "token_idx"], "left").fillna(0, ["block_id"])


def blocks_at(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Blocks that meet the given boxes (doc_id, page, query_box)."""
    return blocks.join(boxes, PAGE).where(G.meet_area("box", "query_box") > 0)


def route_pages(stats: DataFrame, least_tokens: int = 25, density: float = 0.35) -> DataFrame:
    """mode of each page: ``ocr``, ``pdfium`` or ``liteparse``.

    ``stats`` counts what two readers found: p_tokens, l_tokens, alnum and
    non_space characters, split_decimals, split_parens, cells, tax_form,
    garbled, full_image, scanned.
    """
    p, l = F.col("p_tokens"), F.col("l_tokens")
    ratio = F.when(p > 0, l / p).otherwise(1.0)
    few = (p < least_tokens) & (l < least_tokens)
    poor = F.col("garbled") | (F.col("full_image") & (l < 50)) | (F.col("scanned") & (l < 50))
    thin = (l > 0) & (l < 50) & (F.col("non_space") > 0) & (F.col("alnum") / F.col("non_space") < density)
    torn = ((F.col("split_decimals") >= 5) | ((F.col("split_decimals") >= 2) & (F.col("split_parens") >= 2))) & (ratio >= 1.05)
    loose = (F.col("split_decimals") >= 2) & (F.col("cells") == 0) & (ratio > 1.03)
    form = F.col("tax_form") & ((F.col("split_decimals") > 0) | (ratio > 1.01))
    mode = F.when(few | poor | thin, "ocr").when((l < least_tokens) & (p >= least_tokens), "pdfium").when(form | torn | loose, "pdfium").otherwise("liteparse")
    return stats.withColumn("mode", mode)


def page_stats(tokens: DataFrame) -> DataFrame:
    """What ``route_pages`` counts, for one reader's tokens taken as both readers'."""
    hit = lambda p: F.count_if(F.col("text").rlike(p))
    return tokens.groupBy(*PAGE).agg(
        F.count("*").alias("p_tokens"), F.count("*").alias("l_tokens"),
        F.sum(F.length(F.regexp_replace("text", "[^A-Za-z0-9]", ""))).alias("alnum"), F.sum(F.length("text")).alias("non_space"),
        hit(r"^[.,][0-9]+").alias("split_decimals"), hit(r"^[$(]+[0-9]+$").alias("split_parens"), F.lit(0).alias("cells"),
        F.lit(False).alias("tax_form"), F.lit(False).alias("garbled"), F.lit(False).alias("full_image"), F.lit(False).alias("scanned"),
    )
