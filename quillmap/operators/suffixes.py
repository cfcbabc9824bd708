"""Suffix arrays of documents and lookup in them.

All suffixes of a document's text are ordered by prefix doubling: they are ranked by their first
``HEAD`` characters, then in each round by the pair of their own rank and that of the suffix as many characters
further on as the order already holds for, so every round doubles that number. A rank is a window
over the document, the suffix further on a lead in the order of places; all windows share one shuffle by
document and spill, so memory is bounded by nothing but the page of a sort.

A value is looked up by a range join: its lower and upper bound are sorted in among the
suffixes' heads, a running count tells the range of the order that begins with it, and the range
meets the suffixes by their number in the order. Work goes with the occurrences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Characters that suffixes are first ranked by.
HEAD = 16
#: Sorts behind every text that goes on.
LAST = "\U0010ffff"


def suffix_array(texts: DataFrame, exact: int | None = None) -> DataFrame:
    """(doc_id, at, head, rank, nth) of every suffix of ``texts`` (doc_id, text), at counted from 0.

    ``nth`` numbers a document's suffixes from 1 in their order, ``rank`` is equal for suffixes that the
    order doesn't tell apart: none, or with ``exact`` those that are equal in so many characters. Null and empty texts
    have no suffix. A repeated doc_id is an error of the input: its texts would be one.
    """
    chars = texts.where(F.length("text") > 0).select("doc_id", F.posexplode(F.split("text", "")).alias("at", "c"))
    place, order = Window.partitionBy("doc_id").orderBy("at"), Window.partitionBy("doc_id")
    head = F.concat("c", *[F.coalesce(F.lead("c", k).over(place), F.lit("")) for k in range(1, HEAD)])
    rows = chars.withColumn("head", head).drop("c").withColumn("rank", F.dense_rank().over(order.orderBy("head")))
    longest = exact if exact is not None else texts.agg(F.max(F.length("text"))).first()[0] or 0
    known = HEAD
    while known < longest:
        # a suffix that ends sooner comes first
        rows = rows.withColumn("next", F.coalesce(F.lead("rank", known).over(place), F.lit(0)))
        rows = rows.withColumn("rank", F.dense_rank().over(order.orderBy("rank", "next"))).drop("next")
        known *= 2
    return rows.withColumn("nth", F.row_number().over(order.orderBy("rank", "at")))


def occurrences(values: DataFrame, array: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, field, at): every place where a document's text has a value (doc_id, field, value), overlapping ones too.

    Ranges are those of the value's first ``HEAD`` characters; longer values are compared with the text at the places in the
    range. Empty and null values are nowhere.
    """
    v = values.where(F.length("value") > 0).select("doc_id", "field", "value", F.substring("value", 1, HEAD).alias("begin"))
    asked = v.select("doc_id", "begin").distinct()
    zero, one = F.lit(0).alias("kind"), F.lit(1).cast("long")
    marks = array.select("doc_id", F.col("head").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("begin"), one.alias("n"))
    marks = marks.union(asked.select("doc_id", F.col("begin").alias("key"), zero, "begin", F.lit(0).cast("long")))
    marks = marks.union(asked.select("doc_id", F.concat("begin", F.lit(LAST)).alias("key"), F.lit(2), "begin", F.lit(0).cast("long")))
    count = F.sum("n").over(Window.partitionBy("doc_id").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = marks.withColumn("count", count).where("kind != 1").groupBy("doc_id", "begin").agg(F.min("count").alias("low"), F.max("count").alias("high")).where("high > low")
    # the heads' order is the array's as far as it goes, so counts are numbers in it
    range_ = ends.select("doc_id", "begin", F.explode(F.sequence((F.col("low") + 1).cast("int"), F.col("high").cast("int"))).alias("nth"))
    met = v.join(range_, ["doc_id", "begin"]).join(array.select("doc_id", "nth", "at"), ["doc_id", "nth"]).select("doc_id", "field", "value", "at")
    short, long_ = met.where(F.length("value") <= HEAD), met.where(F.length("value") > HEAD)
    whole = long_.join(texts.select("doc_id", "text"), "doc_id").where(F.expr("substring(text, at + 1, length(value)) = value"))
    return short.union(whole.select(*short.columns)).select("doc_id", "field", "at")
