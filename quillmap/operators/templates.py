"""Form templates as tables: the mechanism here, the constants in rows joined in.

A template row has form, page_no, name, kind (anchor, checkbox, zone), label
(text of the anchor), x0, x1, y and row_pitch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmap.functions import geometry as G, text as T
from quillmap.operators.candidates import FIELD


def detected(fields: DataFrame, signatures: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, form, hits): forms (form, field) of whose signature fields a document has three."""
    met = fields.select("doc_id", "field").join(signatures, "field")
    return met.groupBy("doc_id", "form").agg(F.countDistinct("field").alias("hits")).where(F.col("hits") >= least)


def page_forms(tokens: DataFrame, patterns: DataFrame, first: int = 40) -> DataFrame:
    """(doc_id, page, form): forms (form, pattern) whose pattern is in a page's first forty words.

    """
    w = Window.partitionBy("doc_id", "page").orderBy("line_index", "token_idx")
    head = tokens.withColumn("i", F.row_number().over(w)).where(F.col("i") <= first)
    text = head.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda r: r["text"]), " ").alias("head"))
    # one row with all patterns beside each page, instead of a join without a key
    every = patterns.agg(F.array_sort(F.collect_set(F.struct("form", "pattern"))).alias("patterns"))
    found = F.filter("patterns", lambda p: F.regexp_like(F.lower("head"), p["pattern"]))
    met = text.select("doc_id", "page", "head", every.select("patterns").scalar().alias("patterns"))
    return met.select("doc_id", "page", F.explode(F.array_distinct(F.transform(found, lambda p: p["form"]))).alias("form"))


def anchored(fields: DataFrame, tokens: DataFrame, template: DataFrame) -> DataFrame:
    """Numbers at a form's line: of the tokens equal to a field's number the one nearest to the
    template's place, a hundredth off costing a tenth; five off in x costs half.

    ``fields`` have doc_id, field, value, name and form.
    """
    f = fields.join(template.where("kind = 'anchor'"), ["form", "name"]).withColumn("number", T.number("value")).where("number is not null").withColumn("number_key", T.number_key("number"))
    t = tokens.withColumn("number", T.number("text")).where("number is not null").withColumn("number_key", T.number_key("number")).drop("number")
    met = f.select(*FIELD, "name", "page_no", "x0", "x1", "y", "number_key").join(t, ["doc_id", "number_key"]).where(F.col("page") == F.col("page_no"))
    score = 1 - 10 * F.abs(G.cy("box") - F.col("y")) - F.when(G.cx("box").between(F.col("x0") - 0.05, F.col("x1") + 0.05), 0.0).otherwise(0.5)
    return _first(met.withColumn("score", score))


def checked(fields: DataFrame, tokens: DataFrame, template: DataFrame, reach: float = 0.03, side: float = 0.018) -> DataFrame:
    """Checkboxes of a form: the glyph nearest to the template's place, else a box drawn there."""
    f = fields.join(template.where("kind = 'checkbox'"), ["form", "name"]).select(*FIELD, "page_no", F.col("x0").alias("tx"), F.col("y").alias("ty"))
    marks = tokens.where(T.checkbox("text").isNotNull()).select("doc_id", F.col("page").alias("page_no"), "line_index", "box", "text")
    met = f.join(marks, ["doc_id", "page_no"], "left")
    gap = F.sqrt(F.pow(G.cx("box") - F.col("tx"), 2) + F.pow(G.cy("box") - F.col("ty"), 2))
    met = met.withColumn("gap", gap).withColumn("r", F.row_number().over(Window.partitionBy(*FIELD).orderBy(F.asc_nulls_last("gap"), "line_index"))).where("r = 1")
    drawn = G.box(F.col("tx") - side / 2, F.col("ty") - side / 2, F.lit(side), F.lit(side))
    near = F.coalesce(F.col("gap") <= reach, F.lit(False))
    return met.select(*FIELD, F.col("page_no").alias("page"), F.when(near, F.col("box")).otherwise(drawn).alias("box"), F.when(near, T.checkbox("text")).alias("state"), near.alias("printed"))


def zoned(fields: DataFrame, lines: DataFrame, template: DataFrame, least: float = 0.70) -> DataFrame:
    """Names and the like in a zone of a form: the line most like the value, from 70 %."""
    f = fields.join(template.where("kind = 'zone'"), ["form", "name"])
    met = f.join(lines.select("doc_id", F.col("page").alias("page_no"), "line_index", "box", "norm", F.col("text").alias("text")), ["doc_id", "page_no"])
    met = met.where(G.cx("box").between(F.col("x0"), F.col("x1")) & G.cy("box").between(F.col("y"), F.col("y") + F.col("row_pitch")))
    met = met.withColumn("score", T.indel(T.fold("value"), "norm")).where(F.col("score") >= least).withColumn("page", F.col("page_no"))
    return _first(met)


def _first(met: DataFrame) -> DataFrame:
    w = Window.partitionBy(*FIELD).orderBy(F.desc("score"), "page", "line_index", "box.x")
    return met.withColumn("r", F.row_number().over(w)).where("r = 1").select(*FIELD, "page", "line_index", "box", F.col("text").alias("matched_text"), "score")


def families(docs: DataFrame, names: DataFrame) -> DataFrame:
    """family of each document: that of the longest name (name, family) that its key contains, the first
    of equally long ones."""
    key = F.struct((-F.length("name")).alias("l"), F.col("name").alias("name"), F.col("family").alias("family"))
    every = names.agg(F.array_sort(F.collect_set(key)).alias("names"))
    met = docs.withColumn("__names", every.select("names").scalar())
    first = F.get(F.filter("__names", lambda n: F.col("doc_key").contains(n["name"])), F.lit(0))
    return met.withColumn("family", first["family"]).drop("__names")


# Words of labels that exclude each other.
OPPOSITES = (("beginning", "ending"), ("employee", "employer"), ("federal", "state"), ("current", "prior"), ("gross", "net"), ("yes", "no"))


def qualifier(words: Column, label: Column) -> Column:
    """3.5 for a label with the field's own qualifier, -3 for one with its opposite, else 0."""
    out = F.lit(0.0)
    for a, b in OPPOSITES:
        for x, y in ((a, b), (b, a)):
            mine = F.array_contains(words, x)
            out = out + F.when(mine & label.contains(x), 3.5).when(mine & label.contains(y), -3.0).otherwise(0.0)
    return out


def flat_forms(ranked: DataFrame, lines: DataFrame, margin: float = 0.05) -> DataFrame:
    """Ranked candidates of flat forms, ranked anew: where two and more stand in the first one's
    row, .06 apart, the one whose nearest label has most of the field's words wins by a margin,
    unless it is the same place."""
    top = ranked.where("rank = 1").select(*FIELD, F.col("page").alias("p0"), F.col("box").alias("b0"))
    near = ranked.join(top, FIELD).where((F.col("page") == F.col("p0")) & (F.abs(G.cy("box") - G.cy("b0")) <= 0.012))
    own = Window.partitionBy(*FIELD)
    near = near.withColumns({"spread": F.max("box.x").over(own) - F.min("box.x").over(own), "k": F.count("*").over(own)}).where("k >= 2 and spread >= 0.06")
    words = T.field_words("field")
    label = lines.select("doc_id", "page", F.col("box").alias("lb"), F.explode("words").alias("w")).select("doc_id", "page", F.col("w.box").alias("lb"), T.fold("w.text").alias("label"))
    met = near.withColumn("fw", words).join(label, ["doc_id", "page"]).where(F.exists("fw", lambda w: F.col("label").contains(w)))
    gap = F.sqrt(F.pow(G.cx("box") - G.cx("lb"), 2) + F.pow(G.cy("box") - G.cy("lb"), 2))
    side = F.when(F.col("lb.x") <= F.col("box.x"), 0.5).otherwise(-0.5)
    s = F.exp(-gap * gap / (2 * 0.08**2)) * 3 + side + qualifier(F.col("fw"), F.col("label"))
    best = met.withColumn("s", s).groupBy(*FIELD, "rank").agg(F.max("s").alias("s"))
    first = best.where("rank = 1").select(*FIELD, F.col("s").alias("s0"))
    w = Window.partitionBy(*FIELD).orderBy(F.desc("s"), "rank")
    win = best.withColumn("r", F.row_number().over(w)).where("r = 1").join(first, FIELD, "left").where(F.col("s") > F.coalesce("s0", F.lit(0.0)) + margin).select(*FIELD, F.col("rank").alias("winner"))
    moved = ranked.join(win, FIELD, "left")
    new = F.when(F.col("winner").isNull(), F.col("rank")).when(F.col("rank") == F.col("winner"), 1).when(F.col("rank") < F.col("winner"), F.col("rank") + 1).otherwise(F.col("rank"))
    return moved.withColumn("rank", new).drop("winner")
