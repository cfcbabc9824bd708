"""Values among the words of a row that was read by machine: what each word can be taken for, and runs
of words that are like the value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillmap.functions import geometry as G, text as T
from quillmap.operators.candidates import FIELD

# Parts of names of checkboxes, and texts taken for boxes without or with a mark.
BOX_NAMES = T.BOOLEAN_NAMES + ("contingent", "unliquidated", "disputed", "subject_to_offset")
BARE, MARKED = ("no", "o", "q", "d", "[]", "[ ]", "0"), ("yes", "x", "[x]", "1")


def _sliced(w: Column) -> Column:
    """The box of a word without the noise at its ends."""
    span = T.noise_span(w["text"])
    return F.when(span["start"] < span["end"], G.part(w["box"], span["start"], span["end"], F.length(w["text"]), least=0.002)).otherwise(w["box"])


def _hit(text: Column, box: Column, similarity: float) -> Column:
    return F.struct(text.alias("text"), box.alias("box"), F.lit(similarity).alias("similarity"))


def sequences(fields: DataFrame, lines: DataFrame, least: float = 0.72) -> DataFrame:
    """(doc_id, field, page, line_index, box, matched_text, similarity): of the runs of up to four more words than
    the value has the one that is most like it, the shortest and first of equals, from ``least``;
    noise at the ends of its first and last word is cut off.

    ``fields`` name the line (page, line_index) to look in.
    """
    f = fields.select(*FIELD, "page", "line_index", F.trim("value").alias("value")).where(F.col("value").rlike("[A-Za-z0-9]"))
    met = f.join(lines.select("doc_id", "page", "line_index", "words"), ["doc_id", "page", "line_index"])
    most = F.least(F.size("words"), F.size(F.split("value", r"\s+")) + 4)
    met = met.select("*", F.explode(F.sequence(F.lit(1), most)).alias("n")).select("*", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("first"))
    run = F.slice("words", F.col("first"), F.col("n"))
    met = met.withColumn("joined", F.array_join(F.transform(run, lambda w: w["text"]), "")).withColumn("similarity", T.ocr_similarity("value", "joined"))
    best = met.groupBy(*FIELD, "page", "line_index", "words").agg(F.max_by(F.struct("similarity", "first", "n"), F.struct("similarity", -F.col("n"), -F.col("first"))).alias("b")).where(F.col("b.similarity") >= least)
    best = best.withColumn("run", F.slice("words", F.col("b.first"), F.col("b.n")))
    boxes = F.transform("run", lambda w, i: F.when((i == 0) | (i == F.size("run") - 1), _sliced(w)).otherwise(w["box"]))
    return best.select(*FIELD, "page", "line_index", G.hull_of(boxes).alias("box"), F.array_join(F.transform("run", lambda w: w["text"]), " ").alias("matched_text"), F.col("b.similarity").alias("similarity"))


def rows(fields: DataFrame, lines: DataFrame, least: float = 0.72) -> DataFrame:
    """(doc_id, field, page, line_index, box, matched_text, similarity): a checkbox in the value's state; a word
    that is its number, or has its digits; two words that are its number together; for other
    values the run of ``sequences``. The first of these that is there, in this order.

    ``fields`` (doc_id, field, value, kind) name the line (page, line_index) to look in.
    """
    v = F.trim("value")
    f = fields.where(F.coalesce(v != "", F.lit(False))).select(*FIELD, "page", "line_index", v.alias("value"), "kind")
    word = F.lower("value").isin("true", "false", "yes", "no")
    f = f.withColumn("boolean", (F.col("kind") == "bool") | (word & F.lower("field").rlike("|".join(BOX_NAMES)))).withColumn("wanted", T.number("value"))
    met = f.join(lines.select("doc_id", "page", "line_index", "words"), ["doc_id", "page", "line_index"])
    truth = F.lower("value").isin("true", "yes", "1")

    def mark(w: Column) -> Column:
        low = F.lower(F.trim(w["text"]))
        other = F.when(truth, low.isin(*MARKED)).otherwise(low.isin(*BARE))
        return F.when(F.coalesce(T.checkbox(w["text"]) == truth, F.lit(False)), _hit(w["text"], w["box"], 0.95)).when(other, _hit(w["text"], w["box"], 0.90))

    first = lambda found: F.get(F.filter(found, lambda h: h.isNotNull()), F.lit(0))
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    same = F.transform("words", lambda w: F.when(F.coalesce(T.same_number(T.number(w["text"]), "wanted"), F.lit(False)), _hit(w["text"], _sliced(w), 0.95)))
    alike = F.transform("words", lambda w: F.when((F.length(digits(F.col("value"))) >= 2) & (digits(w["text"]) == digits(F.col("value"))), _hit(w["text"], _sliced(w), 0.90)))

    def pair(w: Column, i: Column) -> Column:
        n = F.get("words", i + 1)
        both = F.concat(w["text"], n["text"])
        return F.when(F.coalesce(T.same_number(T.number(both), "wanted"), F.lit(False)), _hit(both, G.hull_of(F.array(w["box"], n["box"])), 0.95))

    number = F.when(F.col("wanted").isNotNull(), F.coalesce(first(same), first(alike), first(F.transform("words", pair))))
    # explode of one value computes it once, where a projection would be merged into every use
    met = met.select("*", F.explode(F.array(F.when(F.col("boolean"), first(F.transform("words", mark))).otherwise(number))).alias("hit"))
    found = met.where("hit is not null").select(*FIELD, "page", "line_index", F.col("hit.box").alias("box"), F.col("hit.text").alias("matched_text"), F.col("hit.similarity").alias("similarity"))
    rest = met.where("hit is null and not boolean and kind not in ('int', 'float')").select(*FIELD, "page", "line_index", "value")
    return found.union(sequences(rest, lines, least))
