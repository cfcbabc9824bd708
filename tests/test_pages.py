"""Places in page texts, regions, chains, staged plans and records, on hand-made pages and against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillmap.operators import index as I, offsets as O, regions as R, suffixes as X, tables as B, wordsets as W
from quillmap.plans import staged as P
from quillmap.plans.records import leaves_of, resolve_records

TOKEN = "doc_id long, page int, line_index int, token_idx int, text string, box struct<x:double,y:double,w:double,h:double>"
FIELD = "doc_id long, field string, value string, kind string, context string, page_hint int"


def page(lines, doc=1, number=1, top=0.1, pitch=0.03, char=0.01, high=0.012):
    """Tokens of lines of words: words of a line follow each other, or stand at (x, text)."""
    out = []
    for i, line in enumerate(lines):
        x = 0.05
        for j, w in enumerate(line.split() if isinstance(line, str) else line):
            x, w = w if isinstance(w, tuple) else (x, w)
            out.append((doc, number, i, j, w, (x, top + i * pitch, len(w) * char, high)))
            x += (len(w) + 1) * char
    return out


def fields(*rows):
    """(field, value) or (field, value, kind, page)."""
    return [(1, r[0], r[1], r[2] if len(r) > 2 else "str", "", r[3] if len(r) > 3 else None) for r in rows]


def test_substrings_meet_the_words_they_cover(spark):
    t = spark.createDataFrame(page(["Total due: $1,450.00 now", "STRASSE groß", "total"]), TOKEN)
    f = spark.createDataFrame(fields(("a", "1,450"), ("b", "due: $1,450.00"), ("c", "now strasse"), ("d", "total"), ("e", "45"), ("f", "gross total"), ("g", ""), ("h", None)), FIELD)
    got = {(r.field, r.at): (r.line_index, r.matched_text, round(r.box.x, 6), round(r.box.w, 6)) for r in O.substring_boxes(f, I.lines(t)).collect()}
    assert got[("a", 12)] == (0, "$1,450.00", 0.16, 0.09)
    assert got[("b", 6)] == (0, "due: $1,450.00", 0.11, 0.14)
    # over a line's end there is a line break, not a space; folded words are longer than printed ones
    assert {k for k in got} == {("a", 12), ("b", 6), ("d", 0), ("d", 39)}
    assert got[("d", 39)][:2] == (2, "total")


def test_a_cursor_goes_on_and_wraps_once(spark):
    t = spark.createDataFrame(page(["7 17 27 i", "7 17"]), TOKEN)
    rows = [(1, 1, n, k, v) for k, (n, v) in enumerate([("a", "17"), ("b", "7"), ("c", "7"), ("d", "99"), ("e", "27"), ("f", "i"), ("g", None)])]
    f = spark.createDataFrame(rows, "doc_id long, page int, field string, place int, value string")
    got = {r.field: r for r in O.cursor_spans(f, I.lines(t)).collect()}
    text = "7 17 27 i\n7 17"
    # 17 first, then the 7 of 27 though the page begins with one, then the 7 of the next line; 27 only from the begin again
    assert {k: r.at for k, r in got.items()} == {"a": 2, "b": 6, "c": 10, "e": 5, "f": 8} and text[6] == "7"
    assert got["b"].matched_text == "27" and got["b"].line_index == 0
    # half of 27's box; an i of .01 is wide enough, a digit's part of .01 too
    assert (round(got["b"].box.x, 4), round(got["b"].box.w, 4), got["b"].box.h) == (0.11, 0.01, 0.012)
    low = spark.createDataFrame(page(["1"], char=0.005, high=0.006), TOKEN)
    one = O.cursor_spans(spark.createDataFrame([(1, 1, "a", 0, "1")], f.schema), I.lines(low)).first()
    assert (one.box.w, one.box.h) == (0.006, 0.0084)
    assert O.cursor_spans(f.limit(0), I.lines(t)).collect() == []


TEXTS = ["banana bandana", "a" * 70, "", None, "abcabcabc" * 9, "no repeat", "ünï ünï", "x", "the cat sat on the mat and the cat sat on the hat " * 3]


def test_suffixes_are_in_order(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for exact in (None, 40):
        rows = X.suffix_array(df, exact).collect()
        for i, text in enumerate(TEXTS):
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.nth)
            order = sorted(range(len(text or "")), key=lambda k: (text[k:].encode() if exact is None else text[k : k + 64].encode(), k))
            assert [r.at for r in own] == order
            if exact is None:
                assert len({r["rank"] for r in own}) == len(own)


def test_every_occurrence_is_found(spark):
    rng = random.Random(4)
    texts = [t for t in TEXTS if t] + ["".join(rng.choice("ab ") for _ in range(300)) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    values = []
    for i, t in enumerate(texts):
        for n in (1, 2, 5, 16, 17, 30):
            k = rng.randrange(max(len(t) - n, 0) + 1)
            values.append((i, f"{n}", t[k : k + n]))
        values += [(i, "not", "zzz"), (i, "empty", ""), (i, "null", None), (i, "longer", t + "!")]
    got = sorted(map(tuple, X.occurrences(spark.createDataFrame(values, "doc_id long, field string, value string"), X.suffix_array(df, 64), df).collect()))
    want = sorted((i, n, k) for i, n, v in values if v for k in range(len(texts[i])) if texts[i].startswith(v, k))
    assert got == want


def test_regions_of_a_page_with_a_head_and_two_columns(spark):
    lines = [[(0.1, "A"), (0.115, "title"), (0.17, "over"), (0.215, "all")]] + [[(0.1, "left"), (0.15, "text"), (0.6, "right"), (0.66, "text")] for _ in range(5)]
    rows = [(d, p, 0 if i == 0 else i + 1, j, w, (b[0], b[1] + (0.05 if i else 0), *b[2:])) for d, p, i, j, w, b in page(lines)] + [(2, 1, 0, 0, "alone", (0.1, 0.1, 0.05, 0.01))]
    t = spark.createDataFrame(rows, TOKEN)
    got = {(r.doc_id, r.block): r.n for r in R.blocks(t, least=0.03).collect()}
    # the strip between the columns, beside the head, is the widest
    assert got == {(1, "lt"): 4, (1, "lb"): 10, (1, "r"): 10, (2, ""): 1}
    (split,) = R.column_splits(t).where("doc_id = 1").collect()
    assert split.split == 1 and abs(split.x - (0.245 + 0.6) / 2) < 1e-9
    assert R.column_splits(t).where("doc_id = 2").count() == 0 and {r.n for r in R.row_bands(t).where("doc_id = 1").collect()} == {4}
    cells = R.grid_cells(t).collect()
    assert {r.doc_id for r in cells} == {1} and {r.band for r in cells if r.text == "right"} == {1, 2, 3, 4, 5} and len({r.column for r in cells if r.text == "right"}) == 1
    assert R.xy_cut(t.limit(0)).collect() == []


def test_word_sets_count_what_differs(spark):
    t = spark.createDataFrame(page(["Doe, John paid $5,000.00 USD", "USD 5000 5000", "John Smith", "5000.00 usd"]), TOKEN)
    f = spark.createDataFrame(fields(("a", "John Doe"), ("b", "5000 USD"), ("c", "USD USD"), ("d", "John"), ("e", "Doe Smith"), ("f", "5000 5000")), FIELD)
    got = sorted((r.field, r.line_index, r.first, r.matched_text, r.cost) for r in W.word_sets(f, I.lines(t)).collect())
    assert got == [("a", 0, 1, "Doe, John", 0.0), ("b", 0, 4, "$5,000.00 USD", 1.0), ("b", 1, 1, "USD 5000", 0.0), ("b", 3, 1, "5000.00 usd", 1.0), ("f", 1, 2, "5000 5000", 0.0)]
    assert [(r.field, r.line_index) for r in W.best_word_sets(f, I.lines(t)).orderBy("field").collect()] == [("a", 0), ("b", 1), ("f", 1)]
    assert W.word_sets(f, I.lines(t), most=0.0).where("field = 'b'").count() == 1


def longest_chain(points, least=0.007, most=0.022):
    points = sorted(points)
    for n in range(len(points), 0, -1):
        good = [c for c in itertools.combinations(points, n) if all(least <= (b[1] - a[1]) / (b[0] - a[0]) <= most for a, b in zip(c, c[1:]))]
        if good:
            return set(min([p[0] for p in c] for c in good))
    return set()


def test_the_longest_steady_chain_is_kept(spark):
    rng, rows = random.Random(3), []
    for t in range(40):
        for row in range(9):
            y = None if rng.random() < 0.2 else 0.1 + 0.012 * row + rng.choice([0, 0, 0, 0.05, -0.03, 0.009])
            rows.append((1, f"t{t}", 1, row, y))
    df = spark.createDataFrame(rows, "doc_id long, table string, page int, row int, y double")
    got = {}
    for r in B.steady(df).collect():
        got.setdefault(r.table, set()).update([r.row] if r.kept else [])
    assert got == {f"t{t}": longest_chain([(r[3], r[4]) for r in rows if r[1] == f"t{t}" and r[4] is not None]) for t in range(40)}


def test_rows_between_anchors_pass_over_outliers(spark):
    rows = [(1, "a", 1, 0, 0.10), (1, "a", 1, 1, 0.40), (1, "a", 1, 2, None), (1, "a", 1, 3, 0.145), (1, "a", 1, 4, None)] + [(1, "b", 1, r, None) for r in range(20)] + [(1, "c", 1, r, None) for r in range(19)]
    got = {(r.table, r.row): (r.anchor_kind, r.y) for r in B.filled_rows(spark.createDataFrame(rows, "doc_id long, table string, page int, row int, y double")).collect()}
    assert [got["a", r][0] for r in range(5)] == ["aligned", "interpolated", "interpolated", "aligned", "interpolated"]
    assert [round(got["a", r][1], 6) for r in range(5)] == [0.1, 0.115, 0.13, 0.145, 0.16]
    assert got["b", 0] == ("pitch", 0.078) and round(got["b", 19][1], 6) == round(0.078 + 19 * 0.0114, 6)
    assert {got["c", r] for r in range(19)} == {("none", None)}


def staged_case(spark):
    t = spark.createDataFrame(page(["Total due: $1,450.00", "March 5, 2026", "Doe, John", "exam- ple text"]), TOKEN)
    f = spark.createDataFrame(fields(("amount", "1450.00", "float"), ("day", "2026-03-05"), ("name", "John Doe"), ("word", "Total"), ("none", "nothing of this")), FIELD)
    return t, f


def test_stages_see_what_is_open(spark, monkeypatch):
    t, f = staged_case(spark)
    asked = {}
    for name, look in list(P.STAGES.items()):
        def seen(open_, pages, name=name, look=look):
            asked[name] = sorted(r.field for r in open_.collect())
            return look(open_, pages)
        monkeypatch.setitem(P.STAGES, name, seen)
    got = {r.field: (r.stage, r.status, r.matched_text) for r in P.resolve_staged(t, f).collect()}
    assert got == {"amount": ("numbers", "normalized", "$1,450.00"), "day": ("dates", "normalized", "2026-03-05"), "name": ("word_sets", "exact", "Doe, John"), "word": ("exact", "exact", "Total"), "none": (None, "not_found", None)}
    assert asked["numbers"] == ["amount", "day", "name", "none", "word"] and asked["dates"] == ["day", "name", "none"] and asked["recovered"] == ["none"]
    assert "fuzzy" not in asked


def test_stages_can_be_switched_and_end_early(spark):
    t, f = staged_case(spark)
    found, ran = P.stage_candidates(t, f.where("field = 'amount'"))
    assert ran == ["checkboxes", "numbers"] and {r.stage for r in found.collect()} == {"numbers"}
    got = {r.field: r.stage for r in P.resolve_staged(t, f, {"exact", "numbers"}).collect()}
    assert got == {"amount": "numbers", "word": "exact", "day": None, "name": None, "none": None}
    assert {r.stage for r in P.resolve_staged(t, f, set()).collect()} == {None}
    with pytest.raises(ValueError):
        P.stage_candidates(t, f, {"no such stage"})


def test_leaves_know_their_row_and_column(spark):
    f = spark.createDataFrame(fields(("a[2].b[10].c.d", "x"), ("total", "x"), ("kinds[3]", "x")), FIELD)
    got = {r.field: (r.table, r["row"], r.column, r.kind_of) for r in leaves_of(f).collect()}
    assert got == {"a[2].b[10].c.d": ("a[2].b", 10, "c.d", "a[].b"), "total": ("", 0, "total", ""), "kinds[3]": ("kinds", 3, "", "kinds")}


def test_records_stand_where_rows_and_columns_cross(spark):
    """Equal values in other rows and columns, a row whose line is not seen, values on no page, hints that are a page off."""
    items = [("Bolt", "7", "7.00"), ("Nut", "7", "14.00"), ("Ring", "14", "7.00"), ("Clip", "3", "21.00"), ("Pin", "21", "3.00"), ("Cap", "9", "9.00")]
    def body(n):
        return [[(0.05, f"Sheet{n}"), (0.3, "of"), (0.5, "items")]] + [[(0.05, f"{name}{n}x"), (0.4, q), (0.7, p)] for name, q, p in items]
    t = spark.createDataFrame(page(body(1)) + page(body(2), number=2) + page(body(3), number=3), TOKEN)
    rows = []
    for n in (1, 2):  # the payload counts from the second sheet
        for k, (name, q, p) in enumerate(items):
            at = f"sheets[{n - 1}].items[{k}]"
            rows += [(f"{at}.name", f"{name}{n + 1}x" if k != 3 else "Misread", "str", n), (f"{at}.count", q if k != 3 else "99", "int", n), (f"{at}.price", p, "float", n)]
    f = spark.createDataFrame(fields(*rows), FIELD)
    got = {r.field: r for r in resolve_records(t, f).collect()}
    assert len(got) == 36
    for n in (1, 2):
        for k, (name, q, p) in enumerate(items):
            for column, x, value in (("name", 0.05, name), ("count", 0.4, q), ("price", 0.7, p)):
                r = got[f"sheets[{n - 1}].items[{k}].{column}"]
                if k == 3 and column != "price":
                    assert (r.box, r.source, r.confidence, r.page) == (None, "page_only", 0.4, n + 1)
                else:
                    assert r.page == n + 1 and (round(r.box.x, 6), round(r.box.y, 6)) == (x, round(0.1 + 0.03 * (k + 1), 6)), r
    # without hints pages are told by what one page has alone
    bare = spark.createDataFrame(fields(*[(a, b, c) for a, b, c, _ in rows]), FIELD)
    again = {r.field: (r.page, r.box) for r in resolve_records(t, bare).collect()}
    assert again == {k: (r.page, r.box) for k, r in got.items()}
    lost = spark.createDataFrame(fields(("x[0].y", "absent"), ("x[0].z", None, "null")), FIELD)
    assert [(r.status, r.page, r.confidence) for r in resolve_records(t, lost).collect()] == [("not_found", None, 0.0)]


def test_kept_rows_stay_dealt_by_document(spark):
    """Tokens written once are grouped and joined without a shuffle."""
    from conftest import TESTDATA
    from quillmap.operators import index as I
    from quillmap.sources import corpora as S
    from quillmap.sources.shared import kept

    t, parts = S.invoice_tokens(spark, TESTDATA), S.parts(spark, TESTDATA)
    own = kept(t, parts)
    met = I.lines(own).join(own.select("doc_id", "page", "line_index", "token_idx").hint("merge"), ["doc_id", "page", "line_index"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and f"SelectedBucketsCount: {parts} out of {parts}" in plan
    assert own.exceptAll(t).count() == 0 and t.exceptAll(own).count() == 0


def test_staged_query_tells_how_documents_are_dealt(spark, monkeypatch):
    """Else its tables are checkpoints, and each stage shuffles them again."""
    from conftest import TESTDATA
    from quillmap.plans import staged
    from quillmap.queries import QUERIES
    from quillmap.sources import corpora as S

    told = []
    first = lambda tokens, fields, **options: told.append(options["parts"]) or fields.selectExpr("*", "'none' AS stage", "'not_found' AS status", "0 AS page")
    monkeypatch.setattr(staged, "resolve_staged", first)
    QUERIES["resolve_staged"](spark, TESTDATA)
    assert told == [S.parts(spark, TESTDATA)]
