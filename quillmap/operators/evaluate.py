"""Evaluation and reports: the only module that sees gold places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmap.functions import geometry as G, text as T

FIELD = ["doc_id", "field"]


def coverage(lines: DataFrame, results: DataFrame, share: float = 0.25) -> DataFrame:
    """(doc_id, total_lines, mapped_lines, coverage_percent): lines that a result's box covers by a
    quarter, or whose text and a result's contain one another.

    Results meet lines on the page, so no pair of documents or pages is made.
    """
    r = results.where("box is not null").select("doc_id", "page", F.col("box").alias("__b"), T.fold("matched_text").alias("__t"))
    met = lines.join(r, ["doc_id", "page"])
    text = (F.col("__t") != "") & (F.col("norm").contains(F.col("__t")) | F.col("__t").contains(F.col("norm")))
    hit = met.where((G.covered("__b", "box") > share) | text).select("doc_id", "page", "line_index").distinct().withColumn("mapped", F.lit(1))
    out = lines.select("doc_id", "page", "line_index").join(hit, ["doc_id", "page", "line_index"], "left")
    out = out.groupBy("doc_id").agg(F.count("*").alias("total_lines"), F.count("mapped").alias("mapped_lines"))
    return out.withColumn("coverage_percent", F.round(100 * F.col("mapped_lines") / F.col("total_lines"), 1))


def unmapped(lines: DataFrame, results: DataFrame, most: int = 200) -> DataFrame:
    """The first 200 lines of each document that no result covers."""
    r = results.where("box is not null").select("doc_id", "page", F.col("box").alias("__b"), T.fold("matched_text").alias("__t"))
    text = (F.col("__t") != "") & (F.col("norm").contains(F.col("__t")) | F.col("__t").contains(F.col("norm")))
    hit = lines.join(r, ["doc_id", "page"]).where((G.covered("__b", "box") > 0.25) | text).select("doc_id", "page", "line_index").distinct()
    rest = lines.join(hit, ["doc_id", "page", "line_index"], "left_anti")
    w = Window.partitionBy("doc_id").orderBy("page", "line_index")
    return rest.withColumn("id", F.row_number().over(w)).where(F.col("id") <= most).select("doc_id", "id", "page", "text", "box")


def rollup_status(status: str = "status") -> Column:
    s = F.col(status)
    return F.when(s.isin("exact", "normalized", "fuzzy", "multi_region"), "VERIFIED").when(s.isin("ambiguous", "derived"), "MISMATCH").otherwise("HALLUCINATION")


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("doc_id").agg(*[F.count_if(rollup_status() == s).alias(s.lower()) for s in ("VERIFIED", "MISMATCH", "HALLUCINATION")])


def judged(results: DataFrame, gold: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Results beside gold places (doc_id, field, gold_page, gold_box): iou, page_hit, hit."""
    m = gold.join(results, FIELD, "left")
    page = F.coalesce(F.col("page") == F.col("gold_page"), F.lit(False))
    iou = F.when(page & F.col("box").isNotNull(), G.iou("box", "gold_box")).otherwise(0.0)
    return m.withColumns({"page_hit": page, "iou": iou, "hit": iou >= least_iou})


def scores(judged_: DataFrame) -> DataFrame:
    """(doc_id, n_gold, n_placed, hits, page_hits, precision, recall, f1)."""
    s = judged_.groupBy("doc_id").agg(F.count("*").alias("n_gold"), F.count("box").alias("n_placed"), F.count_if("hit").alias("hits"), F.count_if("page_hit").alias("page_hits"))
    p, r = F.col("hits") / F.nullif(F.col("n_placed"), F.lit(0)), F.col("hits") / F.col("n_gold")
    f1 = 2 * F.col("hits") / (F.col("n_gold") + F.col("n_placed"))
    return s.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": r, "f1": f1})


def suite(scores_: DataFrame, documents: int | None = None) -> DataFrame:
    """One row: means over the documents with gold places; over all ``documents``, absent ones as 0, if given."""
    n = F.count("*") if documents is None else F.lit(documents)
    return scores_.agg(n.alias("documents"), *[(F.sum(c) / n).alias(c) for c in ("precision", "recall", "f1")], (1 - F.sum("precision") / n).alias("false_grounding"))


def failure_class(row_gap: float = 0.02) -> Column:
    """Why a judged result missed, or PASS."""
    b = F.col("box")
    return (
        F.when(b.isNull(), "ZERO_CANDIDATE").when((b["w"] <= 0) | (b["h"] <= 0), "MALFORMED_BBOX").when(~F.col("page_hit"), "PAGE_DRIFT").when(F.col("hit"), "PASS")
        .when(F.abs(G.cy("box") - G.cy("gold_box")) > row_gap, "WRONG_ROW").otherwise("INSUFFICIENT_IOU")
    )


def pattern(field: Column) -> Column:
    """A field's path without its indexes."""
    return F.regexp_replace(field, r"\[\d+\]", "[]")


def failures(judged_: DataFrame) -> DataFrame:
    """(pattern, class, n) with sums over classes and all (rollup)."""
    rows = judged_.select(pattern(F.col("field")).alias("pattern"), failure_class().alias("class"))
    return rows.rollup("pattern", "class").agg(F.count("*").alias("n"))


def recall_at(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: shares of gold places among the first k candidates."""
    m = gold.join(ranked.select(*FIELD, "page", "box", "rank"), FIELD, "left")
    hit = (F.col("page") == F.col("gold_page")) & (G.iou("box", "gold_box") >= 0.5)
    first = m.groupBy(*FIELD).agg(F.min(F.when(hit, F.col("rank"))).alias("first"))
    return first.agg(F.count("*").alias("fields"), *[F.avg((F.coalesce("first", F.lit(1 << 30)) <= k).cast("double")).alias(f"recall_{k}") for k in ks])


def report_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fields of two reports (doc_id, field, hit): gained, lost, same, only_before, only_after."""
    b, a = before.select(*FIELD, F.col("hit").alias("b")), after.select(*FIELD, F.col("hit").alias("a"))
    m = b.join(a, FIELD, "full_outer")
    return m.withColumn("change", F.when(F.col("b").isNull(), "only_after").when(F.col("a").isNull(), "only_before").when(~F.col("b") & F.col("a"), "gained").when(F.col("b") & ~F.col("a"), "lost").otherwise("same"))


def correlation(registry: DataFrame, candidates: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """One row: what candidates would change in a registry (doc_id, field, status, category,
    gold_page, gold_box): newly passing, regressions, purity, recall, and whether that is verified."""
    c = candidates.select(*FIELD, "page", "box")
    m = registry.join(c, FIELD, "left")
    ok = (F.col("page") == F.col("gold_page")) & (G.iou("box", "gold_box") >= least_iou)
    per = m.groupBy(*FIELD, "status").agg(F.max(F.coalesce(ok, F.lit(False))).alias("ok"), F.count("page").alias("n"))
    failed, passed = F.col("status") == "FAIL", F.col("status") == "PASS"
    out = per.agg(F.count_if(failed & F.col("ok")).alias("gained"), F.count_if(passed & (F.col("n") > 0) & ~F.col("ok")).alias("regressed"), F.count_if(failed).alias("failed"), F.count_if(F.col("n") > 0).alias("touched"), F.count_if((F.col("n") > 0) & F.col("ok")).alias("right"))
    out = out.withColumns({"purity": F.coalesce(F.col("right") / F.nullif(F.col("touched"), F.lit(0)), F.lit(0.0)), "recall": F.coalesce(F.col("gained") / F.nullif(F.col("failed"), F.lit(0)), F.lit(0.0))})
    return out.withColumn("verified", (F.col("gained") > 0) & (F.col("regressed") == 0) & (F.col("purity") >= 0.6))
