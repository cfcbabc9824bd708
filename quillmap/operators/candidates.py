"""Candidate generation: joins of fields with postings.

Fields have doc_id, field, value, kind, context, page_hint. Candidates have
doc_id, field, page, line_index, box, matched_text, match_type, similarity,
page_hint. Every join has the document and a key as equi-keys; what can't be an
equi-join is reduced by one first.
"""

from __future__ import annotations

from math import log1p

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmap.functions import geometry as G, text as T
from quillmap.functions.algos import indel_ratio, partial_ratio

FIELD = ["doc_id", "field"]
COLUMNS = [*FIELD, "page", "line_index", "box", "matched_text", "match_type", "similarity", "page_hint"]


def _as_candidates(df: DataFrame, kind: str, similarity: Column | float = 1.0) -> DataFrame:
    s = similarity if isinstance(similarity, Column) else F.lit(similarity)
    return df.withColumns({"match_type": F.lit(kind), "similarity": s.cast("double")}).select(*COLUMNS)


def exact_tokens(fields: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens equal to the value once both are folded, or once stemmed where no folded one is."""
    f = fields.withColumn("norm", T.fold("value")).withColumn("stem", T.stem("norm")).select(*FIELD, "page_hint", "norm", "stem")
    t = tokens.select("doc_id", "page", "line_index", "box", F.col("text").alias("matched_text"), T.fold("text").alias("norm")).withColumn("stem", T.stem("norm"))
    whole = f.join(t.drop("stem"), ["doc_id", "norm"])
    bare = f.join(whole.select(*FIELD).distinct(), FIELD, "left_anti").where("stem != ''").join(t.drop("norm"), ["doc_id", "stem"])
    return _as_candidates(whole, "exact").union(_as_candidates(bare, "exact"))


def parts_of(c: Column) -> Column:
    """The runs of letters and digits of a folded text, each once."""
    return F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def _rarest(f: DataFrame, posted: DataFrame) -> DataFrame:
    """Fields (with norm) beside the places of their rarest run of letters and digits in ``posted`` (doc_id, word, place...)."""
    counts = posted.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    asked = f.select(*FIELD, "norm", F.explode(parts_of(F.col("norm"))).alias("word"))
    rare = asked.join(counts, ["doc_id", "word"]).groupBy(*FIELD, "norm").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    return rare.join(posted, ["doc_id", "word"]).drop("word")


def _bounded(norm: str) -> Column:
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.col(norm), F.lit(r"\E(?![\p{L}\p{N}])"))


def line_hits(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, field, norm, page, line_index, line_norm, words, line_box): lines that have the folded value between
    characters that are no letters or digits. What stands so has whole runs of letters and
    digits, so lines are found by the rarest of them."""
    f = fields.withColumn("norm", T.squash(T.fold("value"))).where("norm != ''").select(*FIELD, "norm").distinct()
    posted = lines.select("doc_id", "page", "line_index", F.explode(parts_of(F.col("norm"))).alias("word"))
    whole = lines.select("doc_id", "page", "line_index", F.col("norm").alias("line_norm"), "words", F.col("box").alias("line_box"))
    met = _rarest(f, posted).join(whole, ["doc_id", "page", "line_index"])
    return met.where(F.col("line_norm").contains(F.col("norm")) & F.regexp_like("line_norm", _bounded("norm")))


def _unpunctuated(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s,.;:\-_()]+", " "))


def _spans(words: Column, least: Column, most: Column) -> Column:
    """All runs of ``least`` to ``most`` of some words, shorter ones first, then by place."""
    sizes = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda n: (n >= least) & (n <= most) & (n <= F.size(words)))
    return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n))))


def locate(words: Column, norm: Column) -> Column:
    """Struct (text, box) of the words of a line that are a folded value; null if none are.

    First a run of about as many words that equals it, as it is, without punctuation,
    or by five and more digits; then a shorter one; then a run with the same letters and
    digits; then the part of one word that has it.
    """
    own = F.transform(words, lambda w: F.struct(F.trim(T.fold(w["text"])).alias("norm"), w["text"].alias("text"), w["box"].alias("box")))
    text = lambda r: F.array_join(F.transform(r, lambda w: w["norm"]), " ")
    digits = lambda c: F.regexp_replace(c, r"\D+", "")
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    k = F.size(F.split(norm, " "))
    middle = F.greatest(F.lit(1), k - 1)

    def same(r: Column) -> Column:
        return (text(r) == norm) | (_unpunctuated(text(r)) == _unpunctuated(norm)) | ((F.length(digits(norm)) >= 5) & (digits(text(r)) == digits(norm)))

    def joined(r: Column) -> Column:
        return (F.length(bare(norm)) >= 3) & (bare(F.array_join(F.transform(r, lambda w: w["text"]), "")) == bare(norm))

    def found(w: Column) -> Column:
        first = lambda spans, test: F.get(F.filter(spans, test), F.lit(0))
        run = F.coalesce(first(_spans(w, middle, k + 3), same), first(_spans(w, F.lit(1), middle - 1), same), first(_spans(w, F.lit(1), k + 4), joined))
        whole = F.when(run.isNotNull(), F.struct(F.array_join(F.transform(run, lambda x: x["text"]), " ").alias("text"), G.hull_of(F.transform(run, lambda x: x["box"])).alias("box")))
        core = _unpunctuated(norm)
        holder = F.get(F.filter(w, lambda x: F.lower(x["text"]).contains(core) & (F.length(x["text"]) > F.length(core))), F.lit(0))
        at = F.instr(F.lower(holder["text"]), core) - 1
        part = F.when(holder.isNotNull() & (F.length(core) >= 2), F.struct(core.alias("text"), G.part(holder["box"], at, at + F.length(core), F.length(holder["text"])).alias("box")))
        return F.coalesce(whole, part)

    return T.let(own, found)


def phrases(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines that contain the folded value, found by its rarest word; the box is that of the
    words that are the value, or of the line where no run of them is. A value may begin and end
    inside of words, so of three and more the first and last find nothing: those between are whole
    wherever it stands. One of two words, or one, is found by a whole one."""
    key = lambda w: F.when(T.stem(w) != "", T.stem(w)).otherwise(w)
    f = fields.withColumn("norm", T.squash(T.fold("value"))).where("norm != ''").withColumn("ws", F.split("norm", " "))
    sure = F.when(F.size("ws") > 2, F.slice("ws", F.lit(2), F.greatest(F.size("ws") - 2, F.lit(1)))).otherwise(F.col("ws"))
    words = f.select(*FIELD, "page_hint", "norm", F.explode(F.array_distinct(F.transform(sure, key))).alias("word"))
    posted = lines.select("doc_id", "page", "line_index", F.explode(F.array_distinct(F.transform(F.split("norm", " "), key))).alias("word"))
    counts = posted.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    rare = words.join(counts, ["doc_id", "word"]).groupBy(*FIELD).agg(F.min_by(F.struct("word", "norm", "page_hint"), F.struct("n", "word")).alias("r")).select(*FIELD, "r.*")
    met = rare.join(posted, ["doc_id", "word"]).join(lines.select("doc_id", "page", "line_index", "words", F.col("norm").alias("line_norm"), F.col("text").alias("line_text"), F.col("box").alias("line_box")), ["doc_id", "page", "line_index"])
    met = met.where(F.col("line_norm").contains(F.col("norm"))).withColumn("__at", locate(F.col("words"), F.col("norm")))
    met = met.withColumns({"matched_text": F.coalesce("__at.text", "line_text"), "box": F.coalesce("__at.box", "line_box")})
    return _as_candidates(met, "exact")


def line_spans(lines: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, page, line_index, last_line, norm, text, box): runs of two to five lines that follow each other."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_index").rowsBetween(0, most - 1)
    ahead = lines.withColumn("ahead", F.collect_list(F.struct("line_index", "norm", "text", "box")).over(w))
    spans = ahead.select("doc_id", "page", "line_index", "ahead", F.explode(F.sequence(F.lit(2), F.lit(most))).alias("n")).where(F.size("ahead") >= F.col("n"))
    spans = spans.withColumn("ahead", F.slice("ahead", 1, F.col("n")))
    join = lambda k: F.array_join(F.transform("ahead", lambda r: r[k]), " ")
    return spans.select("doc_id", "page", "line_index", F.element_at("ahead", -1)["line_index"].alias("last_line"), join("norm").alias("norm"), join("text").alias("text"), G.hull_of(F.transform("ahead", lambda r: r["box"])).alias("box"), F.transform("ahead", lambda r: r["norm"]).alias("norms"))


def multi_line(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """Values printed over two to five lines: the first word meets a line, the span must contain it all."""
    f = fields.withColumn("norm", T.squash(T.fold("value"))).where(F.instr("norm", " ") > 0)
    f = f.withColumn("word", T.stem(F.get(F.split("norm", " "), F.lit(0)))).select(*FIELD, "page_hint", F.col("norm").alias("wanted"), "word")
    posted = lines.select("doc_id", "page", "line_index", F.explode(F.array_distinct(F.transform("words", lambda w: T.stem(T.fold(w["text"]))))).alias("word"))
    met = f.join(posted, ["doc_id", "word"]).join(line_spans(lines), ["doc_id", "page", "line_index"])
    met = met.where(F.col("norm").contains(F.col("wanted")) & ~F.exists("norms", lambda n: n.contains(F.col("wanted"))))
    short = met.groupBy(*FIELD, "page", "line_index").agg(F.min_by(F.struct("box", "text", "page_hint", "last_line"), "last_line").alias("m")).select(*FIELD, "page", "line_index", "m.*")
    # a span that begins a line too early has one that begins at the next as its part
    tight = short.groupBy(*FIELD, "page", "last_line").agg(F.max_by(F.struct("line_index", "box", F.col("text").alias("matched_text"), "page_hint"), "line_index").alias("m"))
    return _as_candidates(tight.select(*FIELD, "page", "m.*"), "exact")


def substrings(fields: DataFrame, page_text: DataFrame) -> DataFrame:
    """(doc_id, field, page, at): every place where a page's text has the folded value between
    characters that are no letters or digits. Pages are found by the value's rarest run of
    letters and digits; only a value without one meets all pages of its document."""
    f = fields.withColumn("norm", T.squash(T.fold("value"))).where("norm != ''").select(*FIELD, "norm").distinct()
    posted = page_text.select("doc_id", "page", F.explode(parts_of(F.col("text"))).alias("word"))
    known = _rarest(f, posted).union(f.where(F.size(parts_of(F.col("norm"))) == 0).join(page_text.select("doc_id", "page"), "doc_id").select("doc_id", "field", "norm", "page"))
    met = known.join(page_text, ["doc_id", "page"]).where(F.col("text").contains(F.col("norm")))
    parts = F.split(F.col("text"), _bounded("norm"))
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.length(F.array_join(F.slice(parts, 1, i), "")) + (i - 1) * F.length("norm"))
    return met.where(F.size(parts) > 1).select(*FIELD, "page", F.explode(ends).alias("at"))


def numbers(fields: DataFrame, number_postings: DataFrame) -> DataFrame:
    """Tokens with the value's number; where there is none, those whose whole part is the value."""
    f = fields.withColumn("number", T.number("value")).where("number is not null").withColumn("number_key", T.number_key("number"))
    f = f.select(*FIELD, "page_hint", F.col("number").alias("wanted"), "number_key")
    t = number_postings.select("doc_id", "page", "line_index", "box", F.col("text").alias("matched_text"), "number", "number_key")
    same = f.join(t, ["doc_id", "number_key"])
    rest = f.where(F.col("wanted") == F.floor("wanted")).join(same.select(*FIELD).distinct(), FIELD, "left_anti").withColumn("whole", F.col("wanted").cast("long")).drop("number_key")
    part = rest.join(t.withColumn("whole", F.col("number").cast("long")), ["doc_id", "whole"])
    return _as_candidates(same, "normalized_number").union(_as_candidates(part, "normalized_number", 0.9))


def numbers_within(fields: DataFrame, number_postings: DataFrame, share: float = 1e-5) -> DataFrame:
    """Tokens within a relative tolerance: a band join over buckets of the logarithm, three a value."""
    # a little wider than the tolerance is in logarithms, so partners are one bucket apart at most
    bucket = lambda c: F.floor(F.log(F.abs(c)) / F.lit(-1.01 * log1p(-share))).cast("long")
    f = fields.withColumn("wanted", T.number("value")).where("wanted != 0").select(*FIELD, "page_hint", "wanted", F.explode(F.array(*[bucket(F.col("wanted")) + k for k in (-1, 0, 1)])).alias("bucket"))
    t = number_postings.where("number != 0").select("doc_id", "page", "line_index", "box", F.col("text").alias("matched_text"), "number", bucket(F.col("number")).alias("bucket"))
    met = f.join(t, ["doc_id", "bucket"]).where(F.abs(F.col("number") - F.col("wanted")) <= share * F.abs("wanted"))
    return _as_candidates(met, "normalized_number", 0.95)


def dates(fields: DataFrame, date_postings: DataFrame) -> DataFrame:
    """Spans with the value's date."""
    f = fields.withColumn("date", T.date("value")).where("date is not null").select(*FIELD, "page_hint", "date")
    met = f.join(date_postings, ["doc_id", "date"]).withColumn("matched_text", F.col("date").cast("string"))
    return _as_candidates(met, "normalized_date")


def date_literals(fields: DataFrame, tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """Tokens, or runs of two to four words of a line, that are one of a date's printed forms."""
    f = fields.withColumn("d", T.date_flexible("value")).where("d is not null")
    forms = f.select(*FIELD, "page_hint", F.explode(T.date_variants("d", "value")).alias("form"))
    one = tokens.select("doc_id", "page", "line_index", "box", F.col("text").alias("form"))
    runs = lines.select("doc_id", "page", "line_index", "words", F.explode(F.sequence(F.lit(2), F.lit(4))).alias("n")).where(F.size("words") >= F.col("n"))
    runs = runs.select("doc_id", "page", "line_index", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.slice("words", i, F.col("n")))).alias("run"))
    runs = runs.select("doc_id", "page", "line_index", G.hull_of(F.transform("run", lambda w: w["box"])).alias("box"), F.array_join(F.transform("run", lambda w: w["text"]), " ").alias("form"))
    # some twenty forms a date, of whose number Spark's estimate of their size knows nothing: they must not be broadcast
    met = forms.hint("merge").join(one.union(runs), ["doc_id", "form"]).withColumn("matched_text", F.col("form"))
    return _as_candidates(met, "normalized_date")


def gram_counts(fields: DataFrame, gram_postings: DataFrame, lines_most: int | None = None, stems: DataFrame | None = None) -> DataFrame:
    """(doc_id, field, page, line_index, grams, rank): lines by how many 3-grams they share with a value,
    and three more for each word of three characters that is one of their ``stems``. All lines,
    or the best ``lines_most``."""
    f = fields.withColumn("norm", T.fold("value")).where(F.length("norm") >= 4)
    grams = F.transform(F.sequence(F.lit(1), F.length("norm") - 2), lambda i: F.substring(F.col("norm"), i, F.lit(3)))
    asked = f.select(*FIELD, F.explode(F.array_distinct(grams)).alias("gram"))
    met = asked.join(gram_postings, ["doc_id", "gram"]).select(*FIELD, "page", "line_index", F.lit(1).alias("k"))
    if stems is not None:
        words = f.select(*FIELD, F.explode(F.filter(F.transform(F.split("norm", r"\s+"), T.stem), lambda w: F.length(w) >= 3)).alias("stem"))
        met = met.union(words.join(stems.select("doc_id", "page", "line_index", "stem").distinct(), ["doc_id", "stem"]).select(*FIELD, "page", "line_index", F.lit(3).alias("k")))
    met = met.groupBy(*FIELD, "page", "line_index").agg(F.sum("k").alias("grams"))
    w = Window.partitionBy(*FIELD).orderBy(F.desc("grams"), "page", "line_index")
    met = met.withColumn("rank", F.row_number().over(w))
    return met if lines_most is None else met.where(F.col("rank") <= lines_most)


def fuzzy(fields: DataFrame, lines: DataFrame, gram_postings: DataFrame, threshold: float = 0.82, lines_most: int | None = None, stems: DataFrame | None = None) -> DataFrame:
    """Lines like the value: of those that share 3-grams or words with it, those whose best part is as
    similar as the threshold; the box is that of the run of words that is most like it, if that
    is 85 % of the threshold, else the line's (Arrow for the last step)."""

    @F.pandas_udf("similarity double, first int, n int")
    def best(wanted: pd.Series, line: pd.Series, words: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, ws in zip(wanted, line, words):
            s = partial_ratio(a, b)
            if s < threshold:
                out.append((s, 0, 0))
                continue
            k, top = max(1, len(a.split())), (0.0, 0, 0)
            for n in range(max(1, k - 1), min(len(ws), k + 2) + 1):
                for i in range(len(ws) - n + 1):
                    r = indel_ratio(a, " ".join(ws[i : i + n]))
                    if r > top[0]:
                        top = (r, i + 1, n)
            out.append((max(s, top[0]), top[1], top[2]) if top[0] >= 0.85 * threshold else (s, 0, 0))
        return pd.DataFrame(out, columns=["similarity", "first", "n"])

    met = gram_counts(fields, gram_postings, lines_most, stems).join(fields.select(*FIELD, "value", "page_hint"), FIELD)
    met = met.join(lines.select("doc_id", "page", "line_index", "norm", "words", F.col("box").alias("line_box"), F.col("text").alias("line_text")), ["doc_id", "page", "line_index"])
    met = met.withColumn("b", best(T.squash(T.fold("value")), F.col("norm"), F.transform("words", lambda w: F.trim(T.fold(w["text"]))))).where(F.col("b.similarity") >= threshold)
    run = F.slice("words", F.greatest(F.col("b.first"), F.lit(1)), F.col("b.n"))
    part = F.col("b.n") > 0
    met = met.withColumns({"box": F.when(part, G.hull_of(F.transform(run, lambda w: w["box"]))).otherwise(F.col("line_box")), "matched_text": F.when(part, F.array_join(F.transform(run, lambda w: w["text"]), " ")).otherwise(F.col("line_text"))})
    return _as_candidates(met, "fuzzy", F.col("b.similarity"))


# Words of fields' names that tell nothing about their checkboxes.
NO_CONTEXT = (
    "true", "false", "yes", "no", "the", "and", "for", "box", "item", "check", "is", "has", "flag", "part", "sec", "to", "of", "in", "a", "an", "type",
    "recovery", "flooding", "augmented", "injection", "displacement",
)


def checkboxes(fields: DataFrame, tokens: DataFrame, reach: float = 0.16) -> DataFrame:
    """Boxes in the value's state beside a word of a boolean field's name or context: in its row, within
    reach. An equal word counts 3, one that has a word of four letters and more 1.5; nearness
    and standing left of the word add to it. The box is cut to the word's height."""
    truth = F.lower("value").isin("true", "yes", "1")
    f = fields.where("kind = 'bool'").withColumn("truth", truth)
    words = F.array_distinct(F.concat(T.field_words(F.regexp_extract("field", r"([^.]*)$", 1)), F.filter(F.split(F.lower(F.coalesce("context", F.lit(""))), r"\s+"), lambda w: w != "")))
    words = F.filter(words, lambda w: F.length(w) >= 2)
    told = F.filter(words, lambda w: ~w.isin(*NO_CONTEXT))
    told = F.when(F.size(told) > 0, told).otherwise(words)
    told = F.when(F.array_contains(told, "co2"), F.concat(told, F.array(F.lit("carbon"), F.lit("dioxide")))).otherwise(told)
    asked = f.select(*FIELD, "page_hint", "truth", F.explode(told).alias("word"))
    bare = tokens.select("doc_id", "page", F.col("box").alias("label"), F.btrim(F.lower("text"), F.lit(" -.,;:_()[]{}/'\"")).alias("bare"))
    same = asked.join(bare.withColumnRenamed("bare", "word"), ["doc_id", "word"]).select(*FIELD, "page_hint", "truth", "page", "label", F.lit(3.0).alias("weight"))
    # a word of four letters stands in a longer one where its first four do
    fours = bare.where(F.length("bare") > 4).select("*", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("bare") - 3), lambda i: F.substring(F.col("bare"), i, F.lit(4))))).alias("four"))
    inside = asked.where(F.length("word") >= 4).withColumn("four", F.substring("word", 1, 4)).join(fours, ["doc_id", "four"]).where(F.col("bare").contains(F.col("word")) & (F.col("bare") != F.col("word")))
    labels = same.union(inside.select(*FIELD, "page_hint", "truth", "page", "label", F.lit(1.5)))
    labels = labels.groupBy(*FIELD, "page_hint", "truth", "page", "label").agg(F.max("weight").alias("weight"))
    marks = tokens.withColumn("truth", T.checkbox("text")).where("truth is not null").select("doc_id", "page", "truth", "line_index", F.col("box").alias("mark"), F.col("text").alias("matched_text"))
    met = labels.join(marks, ["doc_id", "page", "truth"])
    middle, away = G.cy("label"), F.abs(F.col("mark.x") - F.col("label.x"))
    level = (F.abs(G.cy("mark") - middle) <= F.greatest(F.lit(0.015), F.col("label.h") * 1.5)) | middle.between(F.col("mark.y"), G.y1("mark"))
    met = met.where(level & (away <= reach))
    high = F.greatest(F.lit(0.010), F.least(F.lit(0.016), F.col("label.h") * 1.05))
    top = F.when(F.col("mark.h") > high * 1.8, F.greatest(F.lit(0.0), F.col("label.y") - 0.001)).otherwise(F.col("mark.y"))
    met = met.withColumns({"box": G.box(F.col("mark.x"), top, F.greatest(F.lit(0.014), F.least(F.lit(0.022), F.col("mark.w"))), high), "s": F.col("weight") * 5 - away * 20 + F.when(F.col("mark.x") <= F.col("label.x"), 2.0).otherwise(0.0)})
    best = met.groupBy(*FIELD, "page", "line_index", "matched_text", "page_hint", "mark").agg(F.max_by("box", "s").alias("box"), F.max("s").alias("s"))
    return _as_candidates(best, "boolean", F.col("s"))


def gated_pages(fields: DataFrame, stems: DataFrame, number_postings: DataFrame) -> DataFrame:
    """(doc_id, field, page): pages that have a value's number, or all its longer words."""
    n = fields.withColumn("number", T.number("value")).where("number is not null").withColumn("number_key", T.number_key("number"))
    by_number = n.select(*FIELD, "number_key").join(number_postings.select("doc_id", "page", "number_key"), ["doc_id", "number_key"]).select(*FIELD, "page")
    words = fields.where(T.number("value").isNull()).select(*FIELD, F.array_distinct(F.filter(F.split(T.fold("value"), r"\s+"), lambda w: F.length(T.stem(w)) >= 4)).alias("words")).where(F.size("words") > 0)
    each = words.select(*FIELD, F.size("words").alias("n"), F.explode("words").alias("word")).withColumn("stem", T.stem("word"))
    hit = each.join(stems.select("doc_id", "page", "stem").distinct(), ["doc_id", "stem"]).groupBy(*FIELD, "page", "n").agg(F.countDistinct("stem").alias("met"))
    return by_number.union(hit.where("met = n").select(*FIELD, "page")).distinct()


def drifted(candidates: DataFrame) -> DataFrame:
    """Of each field's candidates those nearest its hinted page: on it, else a page before or
    after, else anywhere; dates and fuzzy ones off the page lose a twentieth."""
    gap = F.abs(F.col("page") - F.col("page_hint"))
    drift = F.when(F.col("page_hint").isNull() | (gap == 0), 0).when(gap == 1, 1).otherwise(2)
    rows = candidates.withColumn("drift", drift)
    rows = rows.withColumn("__least", F.min("drift").over(Window.partitionBy(*FIELD))).where("drift = __least").drop("__least")
    lose = (F.col("drift") > 0) & F.col("match_type").isin("normalized_date", "fuzzy")
    return rows.withColumn("similarity", F.when(lose, F.col("similarity") * 0.95).otherwise(F.col("similarity")))


def nth_occurrence(fields: DataFrame, tokens: DataFrame) -> DataFrame:
    """The n-th field with a value meets its n-th occurrence from the top (a join on the rank)."""
    row = F.regexp_extract("field", r"\[(\d+)\][^\[]*$", 1).try_cast("int")
    f = fields.withColumn("norm", T.value_key(T.fold("value"))).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page_hint", "norm").orderBy(row, "field")))
    t = tokens.withColumn("norm", T.value_key(T.fold("text"))).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page", "norm").orderBy("box.y", "box.x", "token_idx")))
    met = f.select(*FIELD, "page_hint", "norm", "n").join(t.select("doc_id", F.col("page").alias("page_hint"), "line_index", "box", F.col("text").alias("matched_text"), "norm", "n"), ["doc_id", "page_hint", "norm", "n"])
    return _as_candidates(met.withColumn("page", F.col("page_hint")), "exact")


def hyphenated(fields: DataFrame, tokens: DataFrame) -> DataFrame:
    """Values broken at a hyphen: a token that ends in one and a token of the next two lines that
    goes on in lower case or digits make the value; of several the first."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_index", "token_idx")
    ranked = tokens.withColumn("i", F.row_number().over(w))
    a = ranked.where(F.col("text").rlike("[-‐‑–—]$")).select("doc_id", "page", F.col("i").alias("ia"), F.col("line_index"), F.col("text").alias("ta"), F.col("box").alias("ba"))
    b = ranked.where(F.col("text").rlike("^[a-z0-9]")).select("doc_id", "page", F.col("i").alias("ib"), F.col("line_index").alias("lb"), F.col("text").alias("tb"), F.col("box").alias("bb"))
    # the next seven tokens as seven equal keys instead of a range
    a = a.withColumn("ib", F.explode(F.sequence(F.col("ia") + 1, F.col("ia") + 7)))
    pairs = a.join(b, ["doc_id", "page", "ib"]).where("lb > line_index and lb - line_index <= 2")
    pairs = pairs.withColumn("bare", F.regexp_replace("ta", "[-‐‑–—]$", "")).withColumn("joined", F.explode(F.array(T.fold(F.concat("bare", "tb")), T.fold(F.concat("ta", "tb")))))
    f = fields.select(*FIELD, "page_hint", T.fold("value").alias("joined"))
    met = f.join(pairs, ["doc_id", "joined"]).groupBy(*FIELD, "page", "line_index", "page_hint", "ia").agg(F.min_by(F.struct("ba", "bb", "ta", "tb"), "ib").alias("m"))
    met = met.withColumns({"box": G.hull_of(F.array("m.ba", "m.bb")), "matched_text": F.concat("m.ta", "m.tb")})
    return _as_candidates(met, "exact")


def clusters(candidates: DataFrame, gap: float = 0.05, most: int | None = None, beside: float | None = None) -> DataFrame:
    """(doc_id, field, page, cluster, box, n): candidates of a field in groups, from the top, with no
    vertical gap over ``gap``, or with ``beside`` none that is no less than both. The first ``most``, or all."""
    w = Window.partitionBy(*FIELD, "page").orderBy("box.y", "box.x")
    down, aside = F.col("box.y") - F.lag("box.y").over(w), F.abs(F.col("box.x") - F.lag("box.x").over(w))
    apart = down > gap if beside is None else (down >= gap) & (aside >= beside)
    rows = candidates.withColumn("__b", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("cluster", F.sum("__b").over(w))
    rows = rows if most is None else rows.where(F.col("cluster") < most)
    return rows.groupBy(*FIELD, "page", "cluster").agg(G.hull("box").alias("box"), F.count("*").alias("n"))


def noise_matches(fields: DataFrame, noise_postings: DataFrame, most: int | None = None) -> DataFrame:
    """Misread tokens one edit from a value that share a 3-gram with it; all, or the ``most`` most alike."""
    f = fields.withColumn("stem", T.stem(T.fold("value"))).where(F.length("stem") >= 4)
    grams = F.transform(F.sequence(F.lit(1), F.length("stem") - 2), lambda i: F.substring(F.col("stem"), i, F.lit(3)))
    asked = f.select(*FIELD, "page_hint", F.col("stem").alias("wanted"), F.explode(F.array_distinct(grams)).alias("gram"))
    # grams are many times what the size of their table tells, so neither side is broadcast
    met = asked.hint("merge").join(noise_postings, ["doc_id", "gram"]).drop("gram").distinct()
    met = met.withColumn("edits", F.levenshtein("wanted", "stem", 1)).where("edits >= 0")
    met = met.withColumn("similarity", 1 - F.col("edits") / F.greatest(F.length("wanted"), F.length("stem"))).where("similarity >= 0.75")
    w = Window.partitionBy(*FIELD).orderBy(F.desc("similarity"), "page", "line_index", "token_idx")
    met = met.withColumn("r", F.row_number().over(w)).withColumn("matched_text", F.col("text"))
    return _as_candidates(met if most is None else met.where(F.col("r") <= most), "fuzzy", F.col("similarity"))


def _pieces(tokens: DataFrame) -> DataFrame:
    """The normalized words of tokens by their place on the page: doc_id, page, at, token, first, last, word, box, line_index, text."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_index", "token_idx")
    rows = tokens.withColumn("token", F.row_number().over(w)).withColumn("ws", F.filter(F.split(T.for_match("text"), " "), lambda x: x != ""))
    rows = rows.select("doc_id", "page", "line_index", "token", "box", "text", F.size("ws").alias("n"), F.posexplode("ws").alias("i", "word"))
    at = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("token", "i"))
    return rows.select("doc_id", "page", "line_index", "token", "box", "text", "word", (F.col("i") == 0).alias("first"), (F.col("i") == F.col("n") - 1).alias("last"), at.alias("at"))


def sequences(fields: DataFrame, tokens: DataFrame, gap: int = 2) -> DataFrame:
    """Values of several words as tokens that follow each other, over lines too: a positional join
    of their words; on each page the first."""
    f = fields.select(*FIELD, "page_hint", F.filter(F.split(T.for_match("value"), " "), lambda x: x != "").alias("ws")).where(F.size("ws") > 0)
    asked = f.select(*FIELD, "page_hint", F.size("ws").alias("k"), F.posexplode("ws").alias("i", "word"))
    met = asked.join(_pieces(tokens), ["doc_id", "word"]).withColumn("start", F.col("at") - F.col("i"))
    runs = met.groupBy(*FIELD, "page_hint", "page", "start", "k").agg(
        F.count("*").alias("n"), F.min_by("first", "i").alias("first"), F.max_by("last", "i").alias("last"), F.min("line_index").alias("line_index"),
        F.array_sort(F.collect_list(F.struct("token", "text", "box"))).alias("run"),
    )
    runs = runs.where((F.col("n") == F.col("k")) & F.col("first") & F.col("last")).withColumn("run", F.array_distinct("run"))
    runs = runs.where(F.element_at("run", -1)["token"] - F.element_at("run", 1)["token"] < F.col("k") + 2 * gap + 5)
    w = Window.partitionBy(*FIELD, "page").orderBy("start")
    runs = runs.withColumn("r", F.row_number().over(w)).where("r = 1")
    runs = runs.withColumns({"box": G.hull_of_some(F.transform("run", lambda t: t["box"])), "matched_text": F.array_join(F.transform("run", lambda t: t["text"]), " ")})
    return _as_candidates(runs.where("box is not null"), "exact")


def assembled(fields: DataFrame, lines: DataFrame, most_lines: int = 5, gap: float = 0.05) -> DataFrame:
    """Values whose words a page has in order, others between them, over up to five lines no two gaps
    apart: from each token that is the first word the next of each word in turn; the first that holds."""
    f = fields.select(*FIELD, "page_hint", F.filter(F.split(T.for_match("value"), " "), lambda x: x != "").alias("ws")).where(F.size("ws") >= 2)
    ordered = F.array_sort(F.collect_list(F.struct("line_index", "words")))
    pages = lines.groupBy("doc_id", "page").agg(F.flatten(F.transform(ordered, lambda l: F.transform(l["words"], lambda w: F.struct(T.for_match(w["text"]).alias("norm"), w["text"].alias("text"), w["box"].alias("box"), l["line_index"].alias("line"))))).alias("page_words"))
    begins = pages.select("doc_id", "page", F.posexplode(F.transform("page_words", lambda w: w["norm"])).alias("start", "word"))
    met = f.withColumn("word", F.get("ws", F.lit(0))).join(begins, ["doc_id", "word"]).join(pages, ["doc_id", "page"])
    k = F.size("ws")
    near = F.transform(F.slice("page_words", F.col("start") + 1, 2 * k + 12), lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("open"), F.slice("page_words", 1, 0).alias("run"))

    def step(acc: Column, x: Column) -> Column:
        hit = acc["open"] & (acc["at"] < k) & F.coalesce(F.get("ws", acc["at"]) == x["w"]["norm"], F.lit(False))
        open_ = acc["open"] & (hit | (x["i"] <= k + 10))
        return F.struct((acc["at"] + hit.cast("int")).alias("at"), open_.alias("open"), F.when(hit, F.concat(acc["run"], F.array(x["w"]))).otherwise(acc["run"]).alias("run"))

    met = met.withColumn("f", F.aggregate(near, start, step)).where(F.col("f.at") == k).withColumn("run", F.col("f.run"))
    tops = F.array_sort(F.transform("run", lambda w: w["box"]["y"]))
    jump = F.array_max(F.transform(F.sequence(F.lit(1), F.size(tops) - 1), lambda i: F.get(tops, i) - F.get(tops, i - 1)))
    met = met.where((jump <= 2 * gap) & (F.size(F.array_distinct(F.transform(tops, lambda y: F.round(y, 3)))) <= most_lines))
    first = Window.partitionBy(*FIELD, "page").orderBy("start")
    met = met.withColumn("r", F.row_number().over(first)).where("r = 1")
    met = met.withColumns({"box": G.hull_of_some(F.transform("run", lambda w: w["box"]), 0.0001), "matched_text": F.array_join(F.transform("run", lambda w: w["text"]), " "), "line_index": F.get("run", F.lit(0))["line"]})
    return _as_candidates(met, "exact")


def pieces_of(fields: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens that are a value, or from three characters a part of it, for ``clusters``."""
    f = fields.withColumn("norm", T.for_match("value")).where("norm != ''").select(*FIELD, "page_hint", "norm")
    t = tokens.withColumn("piece", T.for_match("text")).where("piece != ''").select("doc_id", "page", "line_index", "box", F.col("text").alias("matched_text"), "piece")
    grams = F.transform(F.sequence(F.lit(1), F.length("norm") - 2), lambda i: F.substring(F.col("norm"), i, F.lit(3)))
    long_ = f.where(F.length("norm") >= 3).withColumn("gram", F.explode(F.array_distinct(grams))).join(t.where(F.length("piece") >= 3).withColumn("gram", F.substring("piece", 1, 3)), ["doc_id", "gram"])
    long_ = long_.where(F.col("norm").contains(F.col("piece"))).drop("gram")
    short = f.where(F.length("norm") < 3).join(t, (f["doc_id"] == t["doc_id"]) & (f["norm"] == t["piece"])).drop(t["doc_id"])
    return _as_candidates(long_.unionByName(short.select(*long_.columns)), "exact")


def cells(fields: DataFrame, cells_: DataFrame) -> DataFrame:
    """Table cells (doc_id, page, box, text) with a value: equal 1, containing it .85."""
    f = fields.withColumn("norm", T.value_key(T.fold("value"))).where("norm != ''")
    c = cells_.select("doc_id", "page", "box", F.col("text").alias("matched_text"), T.value_key(T.fold("text")).alias("cell"))
    # equal by the whole key; containing by the first three characters of the value among the cell's
    whole = f.join(c.withColumnRenamed("cell", "norm").withColumn("cell", F.col("norm")), ["doc_id", "norm"])
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("cell") - 2, F.lit(1))), lambda i: F.substring(F.col("cell"), i, F.lit(3)))
    parts = c.withColumn("gram", F.explode(F.array_distinct(F.concat(grams, F.split("cell", "")))))
    parts = f.withColumn("gram", F.when(F.length("norm") >= 3, F.substring("norm", 1, 3)).otherwise(F.substring("norm", 1, 1))).join(parts, ["doc_id", "gram"]).drop("gram")
    met = whole.unionByName(parts.where(F.col("cell").contains(F.col("norm")) & (F.col("cell") != F.col("norm"))))
    met = met.where(F.coalesce(F.col("page_hint") == F.col("page"), F.lit(True)))
    met = met.withColumn("line_index", F.lit(None).cast("int"))
    return _as_candidates(met, "table_cell", F.when(F.col("cell") == F.col("norm"), 1.0).otherwise(0.85))
