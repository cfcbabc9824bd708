"""Operators on a hand-made invoice, and whole plans."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmap.functions import geometry as G, text as T
from quillmap.operators import candidates as C, evaluate as E, index as I, ranking as R, recovery as V, refine as X, tables as B, templates as L
from quillmap.plans.resolve import Options, resolve, resolve_payloads, two_rounds
from quillmap.sources import payload as P
from quillmap.sources.files import citations

TOKENS = "doc_id string, page int, line_index int, token_idx int, text string, box struct<x: double, y: double, w: double, h: double>"
FIELDS = "doc_id string, field string, value string, kind string, context string, page_hint int"

LINES = [
    (1, 0.20, [("Subtotal", 0.1), ("$50.00", 0.3)]), (1, 0.25, [("Tax", 0.1), ("$50.00", 0.3)]), (1, 0.30, [("Total", 0.1), ("Due:", 0.16), ("USD", 0.3), ("1,450.00", 0.34)]),
    (1, 0.35, [("Date:", 0.1), ("15", 0.2), ("March", 0.24), ("2026", 0.31)]), (1, 0.45, [("12", 0.1), ("Example", 0.14), ("Road,", 0.22)]), (1, 0.48, [("Sector", 0.1), ("28,", 0.17)]),
    (1, 0.60, [("Rate", 0.1), ("3", 0.3), ("3", 0.315), (".", 0.33), ("5", 0.34)]), (1, 0.65, [("☒", 0.1), ("Express", 0.13), ("delivery", 0.2)]), (1, 0.70, [("inter-", 0.1)]), (1, 0.73, [("national", 0.1)]),
    (2, 0.20, [("Balance", 0.1), ("......", 0.2), ("77", 0.5)]), (2, 0.25, [("Balance", 0.1), ("88", 0.5)]),
]


def page_tokens(lines=LINES, doc="d"):
    out, seen = [], {}
    for page, y, words in lines:
        line = seen[page] = seen.get(page, -1) + 1
        out += [(doc, page, line, k, text, (x, y, 0.008 * len(text), 0.012)) for k, (text, x) in enumerate(words)]
    return out


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame(page_tokens(), TOKENS).cache()


@pytest.fixture(scope="module")
def lines(tokens):
    return I.lines(tokens).cache()


def fields(spark, *rows):
    return spark.createDataFrame([("d", *r) for r in rows], FIELDS)


def places(df):
    return sorted((r.field, r.page, r.line_index, r.matched_text) for r in df.collect())


def test_lines_survive_shuffling(spark, tokens):
    rows = page_tokens()
    random.Random(0).shuffle(rows)
    got = I.cluster_lines(spark.createDataFrame([(*r[:2], -1, *r[3:]) for r in rows], TOKENS))
    assert sorted(map(str, got.collect())) == sorted(map(str, tokens.collect()))


def test_numbers_and_pairs(spark, tokens):
    got = C.numbers(fields(spark, ("tax", "50", "int", "Tax", None), ("due", "1450.0", "float", "Total", 1)), I.number_postings(tokens))
    assert places(got) == [("due", 1, 2, "1,450.00"), ("tax", 1, 0, "$50.00"), ("tax", 1, 1, "$50.00")]
    wide = C.numbers_within(fields(spark, ("due", "1450.01", "float", "", None)), I.number_postings(tokens))
    assert places(wide) == [("due", 1, 2, "1,450.00")]


def test_phrases_begin_and_end_inside_of_words(spark):
    t = [("d", 1, i, j, w, (0.1 * j, 0.1 * i, 0.05, 0.01)) for i, line in enumerate(["at sat on", "The bobcat sat only", "cat | on", "bobcat | once", "cat on sat"]) for j, w in enumerate(line.split())]
    lines = I.lines(spark.createDataFrame(t, TOKENS))
    f = fields(spark, ("words", "at sat on", "str", "", None), ("signs", "Cat | on", "str", "", None), ("two", "cat on", "str", "", None))
    assert [p[:3] for p in places(C.phrases(f, lines))] == [("signs", 1, 2), ("signs", 1, 3), ("two", 1, 4), ("words", 1, 0), ("words", 1, 1)]


def test_phrases_dates_lines(spark, tokens, lines):
    f = fields(spark, ("street", "12 example road", "str", "", None), ("date", "2026-03-15", "str", "", None), ("address", "12 Example Road, Sector 28,", "str", "", None))
    assert places(C.phrases(f, lines)) == [("street", 1, 4, "12 Example Road,")]
    assert places(C.dates(f, I.date_postings(lines)))[0][:3] == ("date", 1, 3)
    assert places(C.date_literals(f, tokens, lines)) == [("date", 1, 3, "15 March 2026")]
    assert places(C.multi_line(f, lines)) == [("address", 1, 4, "12 Example Road, Sector 28,")]
    got = C.substrings(fields(spark, ("b", "balance", "str", "", None), ("x", "rat", "str", "", None)), I.page_text(lines)).collect()
    assert sorted((r.field, r.page, r.at) for r in got) == [("b", 2, 0), ("b", 2, 18)]


def test_fuzzy_noise_boxes_hyphens(spark, tokens, lines):
    f = fields(spark, ("a", "Exemple Road", "str", "", None))
    assert places(C.fuzzy(f, lines, I.gram_postings(tokens)))[0][:3] == ("a", 1, 4)
    modes = spark.createDataFrame([("d", 1, "ocr")], "doc_id string, page int, mode string")
    assert places(C.noise_matches(fields(spark, ("n", "Examp1e", "str", "", None)), I.noise_postings(tokens, modes))) == [("n", 1, 4, "Example")]
    assert places(C.checkboxes(fields(spark, ("express_delivery", "true", "bool", "", None)), tokens)) == [("express_delivery", 1, 7, "☒")]
    assert places(C.hyphenated(fields(spark, ("h", "international", "str", "", None)), tokens)) == [("h", 1, 8, "inter-national")]
    cells = spark.createDataFrame([("d", 1, (0.1, 0.2, 0.3, 0.02), "Total 77"), ("d", 1, (0.1, 0.3, 0.3, 0.02), "77")], "doc_id string, page int, box struct<x: double, y: double, w: double, h: double>, text string")
    assert sorted(r.similarity for r in C.cells(fields(spark, ("c", "77", "int", "", None)), cells).collect()) == [0.85, 1.0]


def test_recovery(spark, lines):
    f = fields(spark, ("rate", "33.5", "float", "", None), ("due", "1450", "int", "", None), ("road", "12 Example Road, East", "str", "", None), ("s", "Express delivery", "str", "", None))
    assert ("rate", 1, 6, "3 3 . 5") in places(V.spaced_numbers(f, lines)) and ("rate", 1, 6, "3 3 . 5") in places(V.torn_numbers(f, lines))
    assert places(V.split_signs(f, lines)) == [("due", 1, 2, "USD 1,450.00")]
    assert ("road", 1, 4, "12 Example Road,") in places(V.bounded_spans(f, lines))
    assert places(V.interleaved(f, lines)) == [("s", 1, 7, "Express delivery")]


def test_equal_amounts_are_told_by_their_labels(spark, tokens):
    got = {r.field: r for r in resolve(tokens, fields(spark, ("subtotal", "50", "int", "Subtotal", None), ("tax", "50", "int", "Tax", None), ("grand_total", "999", "int", "", None), ("nothing", "zzz", "str", "", None), ("blank", " ", "str", "", None)), Options(recovery=False)).collect()}
    assert (got["subtotal"].status, round(got["subtotal"].box.y, 2)) == ("normalized", 0.20) and round(got["tax"].box.y, 2) == 0.25
    assert got["grand_total"].status == "derived" and got["nothing"].status == "not_found"
    assert got["blank"].status == "exact" and got["blank"].box is None and got["blank"].confidence == 1


def test_identical_labels_are_ambiguous(spark):
    t = spark.createDataFrame(page_tokens([(1, 0.2, [("Tax", 0.1), ("$50.00", 0.3)]), (1, 0.6, [("Tax", 0.1), ("$50.00", 0.3)])]), TOKENS)
    assert [r.status for r in resolve(t, fields(spark, ("tax", "50", "int", "Tax", None)), Options(recovery=False)).collect()] == ["ambiguous"]


def test_payloads_and_rounds(spark, tokens):
    payload = {"due": 1450.0, "when": "2026-03-15", "flag": None, "items": [{"name": "Balance", "amount": 77, "page": 2}, {"name": "Balance", "amount": 88, "page": 2}]}
    df = spark.createDataFrame([("d", json.dumps(payload)), ("e", "no json"), ("deep", "[" * 9000 + "]" * 9000)], "doc_id string, payload string")
    assert P.flatten(df).where("kind = 'error'").count() == 2
    flat = {r.field: (r.value, r.kind, r.page_hint, r.record) for r in P.flatten(df).collect()}
    assert flat["items[1].amount"] == ("88", "int", 2, "items[1]") and flat["due"] == ("1450.0", "float", None, None) and flat["flag"][1] == "null" and flat[None][1] == "error"
    got = {r.field: (r.status, r.page) for r in resolve_payloads(tokens, df, Options(recovery=False)).collect()}
    assert got["items[0].amount"] == ("normalized", 2) and got["items[1].amount"] == ("normalized", 2) and got["due"] == ("normalized", 1) and got["when"] == ("normalized", 1)
    f = fields(spark, ("items[0].amount", "77", "int", "", 2), ("items[1].amount", "88", "int", "", 2))
    again = {r.field: round(r.box.y, 2) for r in two_rounds(tokens, f, Options(recovery=False)).collect()}
    assert again == {"items[0].amount": 0.20, "items[1].amount": 0.25}
    assert json.loads(citations(resolve(tokens, f, Options(recovery=False))).first().citations)[0]["place"]["page"] == 2


def test_scores_at_their_marks(spark):
    b = spark.createDataFrame([((0.5, 0.494, 0.1, 0.012), 1)], "box struct<x: double, y: double, w: double, h: double>, page int")
    n, t = F.lit(None).cast("double"), F.lit(True)
    got = b.select(
        R.column_score("box", F.lit(0.5), F.lit(0.6), t), R.column_score("box", F.lit(0.1), F.lit(0.2), t), R.column_score("box", n, n, t), R.row_score("box", F.lit(0.5), n, n), R.row_score("box", F.lit(0.9), n, n), R.row_score("box", n, n, n),
        R.sequence_score("box", F.lit(0.5), n, n), R.sequence_score("box", n, F.lit(0.6), n), R.sequence_score("box", n, F.lit(0.4), F.lit(0.6)), R.page_score("box", F.col("page"), F.lit(2), F.lit(1.0), F.lit(False), F.lit(3)),
        R.page_score("box", F.col("page"), F.lit(1), F.lit(1.0), F.lit(False), F.lit(3)), R.y_score("box", F.lit(0.5)), R.y_score("box", F.lit(0.9)),
    ).first()
    assert [round(x, 6) for x in got] == [1, -1, 0, 1, -1, 0, 1, -1, 0.5, -1, 1, 12, -24]


def test_tables(spark, lines):
    r = spark.createDataFrame([("d", "t", i, p) for i, p in enumerate([1, 1, 3, 2, 2, 4])], "doc_id string, table string, row int, page int")
    assert sorted(x.row for x in B.rising_pages(r).collect()) == [0, 1, 3, 4, 5]
    anchors = spark.createDataFrame([("d", "t", k, "f", x, 0) for k, x in enumerate(("Sector 28", "Example Road", "Express delivery"))], "doc_id string, table string, place int, field string, text string, page_hint int")
    assert [(x.offset, x.tier) for x in B.page_offsets(anchors, lines).collect()] == [(1, "tier1_narrow")]
    s = spark.createDataFrame([("d", "t", i, j, float(v)) for i, row in enumerate([[9, 8], [9, 1]]) for j, v in enumerate(row)], "doc_id string, table string, row int, cand int, score double")
    assert sorted((x.row, x.cand) for x in B.assigned(s).collect()) == [(0, 1), (1, 0)]
    schema = "doc_id string, record string, field string, rank_in_record int, page int, line_index int, box struct<x: double, y: double, w: double, h: double>, matched_text string, similarity double, anchor_page int, anchor_y double"
    c = [("d", "r", "a", 0, 5, 1, (0.1, 0.294, 0.1, 0.012), "A", 1.0, 5, 0.3), ("d", "r", "b", 1, 5, 1, (0.5, 0.294, 0.1, 0.012), "7", 1.0, 5, 0.3), ("d", "r", "b", 1, 5, 9, (0.5, 0.694, 0.1, 0.012), "7", 1.0, 5, 0.3), ("d", "r", "c", 2, 6, 9, (0.5, 0.694, 0.1, 0.012), "8", 1.0, 5, 0.3)]
    df = spark.createDataFrame(c, schema)
    assert sorted((x.field, x.line_index) for x in B.joint_record(df).collect()) == [("a", 1), ("b", 1)]
    assert sorted(x.field for x in B.joint_record(df, "E").collect()) == ["a", "b", "c"]
    assert B.record_anchor(df.withColumn("matched_text", F.when(F.col("field") == "a", "AB12CD34").otherwise(F.col("matched_text")))).first().field == "a"
    hits = spark.createDataFrame([("d", "a", 2), ("d", "b", 2), ("d", "b", 3)], "doc_id string, field string, page int")
    assert [(x.page, x.votes) for x in B.root_pages(hits).collect()] == [(2, 2.5)]


def test_refinement(spark, tokens, lines):
    schema = "doc_id string, page int, box struct<x: double, y: double, w: double, h: double>, matched_text string, value string, confidence double, protected boolean, right double"
    m = spark.createDataFrame([
        ("d", 1, (0.1, 0.45, 0.016, 0.012), "12", "12 Example Road", 0.9, False, None), ("d", 1, (0.1, 0.45, 0.016, 0.012), "12", "12 Example Road", 0.9, True, None), ("d", 1, (0.1, 0.45, 0.016, 0.012), "12", "12 Example Road", 0.9, False, 0.21),
        ("d", 2, (0.1, 0.20, 0.148, 0.012), "Balance ......", "Balance", 0.9, False, None), ("d", 1, (0.1, 0.3, 0.4, 0.012), "No:12345", "12345", 0.9, False, None), ("d", 1, (0.1, 0.3, 0.4, 0.012), "No:12345", "12345", 0.5, False, None),
    ], schema)
    got = [(r.value, r.protected, r.right, round(r.box.x, 3), round(r.box.w, 3)) for r in X.refined(m, lines).collect()]
    assert sorted(got, key=str) == sorted([
        ("12 Example Road", False, None, 0.1, 0.16), ("12 Example Road", True, None, 0.1, 0.016), ("12 Example Road", False, 0.21, 0.1, 0.096),
        ("Balance", False, None, 0.1, 0.042), ("12345", False, None, 0.25, 0.25), ("12345", False, None, 0.1, 0.4),
    ], key=str)


def test_reports(spark, lines):
    res = spark.createDataFrame([("d", "a", 1, (0.1, 0.2, 0.25, 0.012), "Subtotal")], "doc_id string, field string, page int, box struct<x: double, y: double, w: double, h: double>, matched_text string")
    got = E.coverage(lines, res).first()
    assert (got.total_lines, got.mapped_lines, got.coverage_percent) == (12, 1, 8.3) and E.unmapped(lines, res, 3).count() == 3
    reg = spark.createDataFrame([("d", "a", "FAIL", "x", 1, (0.1, 0.2, 0.25, 0.012)), ("d", "b", "PASS", "x", 1, (0.1, 0.2, 0.2, 0.012))], "doc_id string, field string, status string, category string, gold_page int, gold_box struct<x: double, y: double, w: double, h: double>")
    c = E.correlation(reg, res).first()
    assert (c.gained, c.regressed, c.purity, c.recall, c.verified) == (1, 0, 1.0, 1.0, True)
    j = E.judged(res, reg.select("doc_id", "field", "gold_page", "gold_box"))
    assert sorted(r[0] for r in j.select(E.failure_class()).collect()) == ["PASS", "ZERO_CANDIDATE"]


def test_templates(spark, tokens, lines):
    schema = "form string, page_no int, name string, kind string, label string, x0 double, x1 double, y double, row_pitch double"
    t = spark.createDataFrame([("f", 1, "due", "anchor", "", 0.3, 0.4, 0.3, None), ("f", 1, "express", "checkbox", "", 0.104, None, 0.656, None), ("f", 1, "second", "checkbox", "", 0.8, None, 0.9, None), ("f", 1, "street", "zone", "", 0.0, 0.5, 0.4, 0.1)], schema)
    f = spark.createDataFrame([("d", "x.due", "1450", "due", "f"), ("d", "x.e", "true", "express", "f"), ("d", "x.s", "true", "second", "f"), ("d", "x.street", "12 Example Road", "street", "f")], "doc_id string, field string, value string, name string, form string")
    assert [r.matched_text for r in L.anchored(f, tokens, t).collect()] == ["1,450.00"]
    assert {r.field: (r.state, r.printed) for r in L.checked(f, tokens, t).collect()} == {"x.e": (True, True), "x.s": (None, False)}
    assert [r.line_index for r in L.zoned(f, lines, t).collect()] == [4]
    p = spark.createDataFrame([("inv", "total due")], "form string, pattern string")
    assert [tuple(r) for r in L.page_forms(tokens, p).collect()] == [("d", 1, "inv")]
    n = spark.createDataFrame([("acme", "A"), ("acme-corp", "B")], "name string, family string")
    assert L.families(spark.createDataFrame([("x-acme-corp-1",), ("zz",)], "doc_key string"), n).select("family").collect() == [("B",), (None,)]


def test_templates_of_any_size(spark, tokens, lines):
    """Patterns, names and siblings beyond any small number count like the first."""
    p = spark.createDataFrame([(f"f{i:03}", "no such text" if i < 299 else "total due") for i in range(300)], "form string, pattern string")
    assert [tuple(r) for r in L.page_forms(tokens, p).collect()] == [("d", 1, "f299")]
    n = spark.createDataFrame([(f"name{i:03}x", f"F{i}") for i in range(300)], "name string, family string")
    assert [r.family for r in L.families(spark.createDataFrame([("a-name299x-b",)], "doc_key string"), n).collect()] == ["F299"]
    rows = [(1, 0.1 + 0.02 * k, [(f"k{k}", 0.1), ("7", 0.5)]) for k in range(40)]
    t = spark.createDataFrame(page_tokens(rows, "s"), TOKENS)
    f = spark.createDataFrame([("s", f"rows[0].f{k}", f"k{k}", "str", "", 1) for k in range(40)], FIELDS)
    assert two_rounds(t, f, Options(recovery=False)).where("box is not null").count() == 40


def test_evidence_recovery_and_no_verifier(spark, tokens):
    f = fields(spark, ("rate", "33.5", "float", "", 1), ("x", "99", "int", "", None)).withColumn("evidence_text", F.when(F.col("field") == "x", "Example Road,"))
    got = {r.field: (r.status, r.matched_text) for r in resolve(tokens, f, Options(verify=False)).collect()}
    assert got == {"rate": ("fuzzy", "3 3 . 5"), "x": ("exact", "Example Road,")}
    twice = fields(spark, ("a", "50", "int", "", None))
    assert [r.status for r in resolve(tokens, twice, Options(recovery=False, verify=False)).collect()] == ["ambiguous"]
    assert [r.matched_text for r in resolve(tokens, fields(spark, ("s", "(Express)", "str", "", None)), Options(strip=True, recovery=False)).collect()] == ["Express"]


def test_characters_fold_as_by_themselves(spark):
    """Scripts with case and compatibility forms; beyond these Java and Python know different versions of Unicode."""
    blocks = [(0x80, 0x1000), (0x1E00, 0x2200), (0x2440, 0x2500), (0x3000, 0x3400), (0xF900, 0x10000), (0x1D400, 0x1D800)]
    text = spark.createDataFrame([("".join(map(chr, range(k, k + 64))),) for x, y in blocks for k in range(x, y, 64)], "t string")
    got = text.select("t", T.fold("t").alias("a"), T.fold_mapped("t")["text"].alias("b")).where("a != b").collect()
    assert [r.t for r in got] == []


def test_stream(spark, tokens, tmp_path):
    from quillmap.streaming.resolve import resolve_stream

    src = str(tmp_path / "in")
    fields(spark, ("due", "1450", "int", "Total", None)).write.parquet(src)
    stream = spark.readStream.schema(FIELDS).parquet(src)
    resolve_stream(tokens, stream, str(tmp_path / "out"), str(tmp_path / "cp"), Options(recovery=False)).awaitTermination(120)
    assert [r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["normalized"]
