"""Places in a page's text and the tokens that stand there.

A page's text is its folded lines, words a space apart, one line below the other,
so a word's characters are counted by running sums over the words before it. A place
found in the text is an interval of characters, and the tokens that it covers are those
whose intervals meet it: an interval join, made an equi-join by strips of
``STRIP`` characters, of which a word or a value is in a few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmap.functions import geometry as G, text as T
from quillmap.operators import candidates as C, index as I

STRIP = 64
PAGE = ["doc_id", "page"]
FIELD = ["doc_id", "field"]

# The least height and width of a span, and what a lesser one is stretched by.
LEAST_HEIGHT, TALLER = 0.0070, 1.4
LEAST_WIDTH, WIDER = 0.010, 1.2


def token_offsets(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_index, token_idx, text, box, first, end): where each word of some lines stands in its page's
    folded text, the end not included."""
    words = lines.select(*PAGE, "line_index", F.posexplode("words").alias("place", "w"))
    words = words.select(*PAGE, "line_index", "place", F.col("w.token_idx").alias("token_idx"), F.col("w.text").alias("text"), F.col("w.box").alias("box"), F.length(T.fold("w.text")).alias("size"))
    before = Window.partitionBy(*PAGE).orderBy("line_index", "place").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).cast("int")
    return words.withColumn("first", first).withColumn("end", F.col("first") + F.col("size")).drop("size", "place")


def _strips(first: Column, end: Column) -> Column:
    strip = lambda c: F.floor(c / STRIP).cast("int")
    return F.sequence(strip(first), strip(F.greatest(end - 1, first)))


def covered_tokens(places: DataFrame, tokens: DataFrame, key: list[str]) -> DataFrame:
    """The tokens (``token_offsets``) that each place (doc_id, page, key, at, stop) meets: a row for each of them,
    with the first and end of the common characters as part_first and part_end within the token."""
    asked = places.select(*PAGE, *[k for k in key if k not in PAGE], "at", "stop", F.explode(_strips(F.col("at"), F.col("stop"))).alias("strip"))
    there = tokens.withColumn("strip", F.explode(_strips(F.col("first"), F.col("end"))))
    met = asked.join(there, [*PAGE, "strip"]).where((F.col("first") < F.col("stop")) & (F.col("at") < F.col("end")))
    # both can share several strips: the pair counts in the first of them
    met = met.where(F.col("strip") == F.floor(F.greatest("at", "first") / STRIP).cast("int")).drop("strip")
    return met.withColumns({"part_first": F.greatest("at", "first") - F.col("first"), "part_end": F.least("stop", "end") - F.col("first")})


def substring_boxes(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, field, page, at, line_index, box, matched_text): every place where a page has the folded value between
    characters that are no letters or digits, inside words, over several and over lines, with the hull and
    the texts of the words that it covers; line_index is that of the first."""
    places = C.substrings(fields, I.page_text(lines))
    norms = fields.select(*FIELD, F.length(T.squash(T.fold("value"))).alias("size")).distinct()
    places = places.join(norms, FIELD).withColumn("stop", F.col("at") + F.col("size")).drop("size")
    met = covered_tokens(places, token_offsets(lines), ["field"])
    run = F.array_sort(F.collect_list(F.struct("first", "line_index", "text", "box")))
    found = met.groupBy(*FIELD, "page", "at").agg(run.alias("run"))
    return found.select(*FIELD, "page", "at", F.get("run", F.lit(0))["line_index"].alias("line_index"), G.hull_of(F.transform("run", lambda t: t["box"])).alias("box"), F.array_join(F.transform("run", lambda t: t["text"]), " ").alias("matched_text"))


def cursor_places(fields: DataFrame, page_text: DataFrame) -> DataFrame:
    """(doc_id, page, field, place, at, stop): where a cursor finds each field, fields of a page in order of ``place``.

    The cursor stands at the page's begin. A field is where its folded value next stands at or after the cursor,
    inside words too, or else, once, from the begin; the cursor goes to its end. A field whose value the
    page doesn't have leaves the cursor and has no row. ``fields`` have doc_id, page, field, place, value.
    The fold runs in generated code over the fields of a page.
    """
    f = fields.select(*PAGE, "field", "place", T.squash(T.fold("value")).alias("norm")).where("norm != ''")
    asked = f.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("place", "field", "norm"))).alias("asked"))
    pages = asked.join(page_text, PAGE)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<place:int,field:string,at:int,stop:int>>)").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        ahead = F.call_function("locate", x["norm"], F.col("text"), acc["at"] + 1)
        hit = F.when(ahead > 0, ahead).otherwise(F.call_function("locate", x["norm"], F.col("text"), F.lit(1))) - 1
        stop = hit + F.length(x["norm"])
        row = F.struct(x["place"].cast("int").alias("place"), x["field"].alias("field"), hit.alias("at"), stop.alias("stop"))
        return F.when(hit < 0, acc).otherwise(F.struct(stop.alias("at"), F.concat(acc["found"], F.array(row)).alias("found")))

    return pages.select(*PAGE, F.inline(F.aggregate("asked", start, step)["found"])).select(*PAGE, "field", "place", "at", "stop")


def cursor_spans(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """The places of ``cursor_places`` with line_index, box and matched_text: the box is the hull of the parts of words that the
    value takes, stretched where it is lower or narrower than a span can be."""
    places = cursor_places(fields, I.page_text(lines))
    met = covered_tokens(places, token_offsets(lines), ["field", "place"])
    met = met.withColumn("part", G.part("box", F.col("part_first"), F.col("part_end"), F.length(T.fold("text"))))
    run = F.array_sort(F.collect_list(F.struct("first", "line_index", "text", "part")))
    found = met.groupBy(*PAGE, "field", "place", "at", "stop").agg(run.alias("run"))
    found = found.withColumn("b", G.hull_of(F.transform("run", lambda t: t["part"])))
    four = lambda c: F.round(c, 4)
    high = F.when(four(F.col("b.h")) < LEAST_HEIGHT, four(four(F.col("b.h")) * TALLER)).otherwise(four(F.col("b.h")))
    wide = F.when(four(F.col("b.w")) < LEAST_WIDTH, four(four(F.col("b.w")) * WIDER)).otherwise(four(F.col("b.w")))
    box = G.box(four(F.col("b.x")), four(F.col("b.y")), wide, high)
    return found.select(*PAGE, "field", "place", "at", "stop", F.get("run", F.lit(0))["line_index"].alias("line_index"), box.alias("box"), F.array_join(F.transform("run", lambda t: t["text"]), " ").alias("matched_text"))
