"""Hand-made cases, whose results are stated beside them as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmap.functions import geometry as G, text as T

#: Runs by name, and what each must give.
QUERIES: dict = {}
SQL: dict[str, str] = {}


def literal(x: object, kind: str) -> str:
    if x is None:
        return f"CAST(NULL AS {kind})"
    text = str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return f"CAST({text} AS {kind})"


DUCK = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def stated(schema: str, rows: list[tuple]) -> str:
    """SQL of a table that is stated row by row, numbers to six decimals."""
    rows = [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]
    columns = [c.split() for c in schema.split(", ")]
    selects = (", ".join(f'{literal(x, DUCK[kind])} AS "{name}"' for x, (name, kind) in zip(r, columns)) for r in rows)
    return " UNION ALL ".join(f"SELECT {s}" for s in selects)


def cases(schema: str, given: int, rows: list[tuple]):
    """A query of (given columns, results): the function gets a table of the first ``given`` columns and
    gives the others; the SQL states all."""

    def add(f):
        def run(spark: SparkSession, _: str) -> DataFrame:
            columns = schema.split(", ")
            names = [c.split()[0] for c in columns]
            df = spark.createDataFrame([r[:given] for r in rows], ", ".join(columns[:given]))
            return df.withColumns(dict(zip(names[given:], f()))).select(*names)

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        SQL[f.__name__] = stated(schema, rows)
        return f

    return add


@cases("text string, folded string, mapped string", 1, [(a, b, b) for a, b in (
    ("ﬁne", "fine"), ("ﬅ", "st"), ("ﬆ", "st"), ("‚x", ",x"), ("STRASSE ß", "strasse ss"), ("½", "1⁄2"), ("１２ＡＢ", "12ab"), ("ſ", "s"), ("a b", "a b"), ("x​y﻿", "xy"),
    ("Ⅷ", "viii"), ("㎏", "kg"), ("Éa", "éa"), ("“Q”", '"q"'), ("—–−‐‑", "-----"), ("ΣΑΣ", "σασ"), ("…", "..."), ("plain Text 1", "plain text 1"), ("co­op", "coop"), ("™", "tm"), ("x²", "x2"), ("", ""),
)])
def fn_folded():
    return T.fold("text"), T.fold_mapped("text")["text"]


@cases("text string, first int, stop int, start long, end long", 3, [
    ("ﬁne", 0, 2, 0, 1), ("ﬁne", 1, 3, 0, 2), ("ﬁne", 2, 4, 1, 3), ("aßb", 1, 3, 1, 2), ("a​b", 1, 2, 2, 3), ("abc", 0, 3, 0, 3),
])
def fn_original_span():
    span = T.original_span(T.fold_mapped("text"), F.col("first"), F.col("stop"))
    return span["start"].cast("long"), span["end"].cast("long")


@cases("text string, number double", 1, [
    ("1,450.00", 1450.0), ("usd 1,450.00", 1450.0), ("Eur 5", 5.0), ("(100.00)", -100.0), ("(99.4%)", 99.4), ("$-5", -5.0), ("1_000", 1000.0), ("１２", 12.0), ("1.5e3", 1500.0), ("l2O", 120.0), ("B5", 85.0), ("§1", 51.0),
    ("B", None), ("~3", 3.0), ("12'", 12.0), ("5%", 5.0), ("abc", None), ("", None), ("₹7", 7.0), ("(-3)", -3.0), ("- 3", -3.0), ("+4", 4.0), (".5", 0.5), ("5.", 5.0), ("O", 0.0), ("1 234", 1234.0), ("USD", None), ("12-5", None), ("٣", 3.0), (None, None),
])
def fn_numbers():
    return (T.number("text"),)


@cases("text string, money string, repaired string", 1, [
    ("$1,200.50", "1200.50", "$1,200.50"), ("(1,200)", "-1200", "(1,200)"), ("CHF 7", "7", "CHF 7"), ("10 usd", "10", "10 usd"), ("(12%)", "12%", "(12%)"), ("lO", "lO", "10"), ("Bl", "Bl", "81"), ("AUDI 3", "AUDI3", "AUD1 3"), ("§§", "§§", "§§"),
])
def fn_money():
    return T.money("text"), T.repair_digits("text")


@cases("a double, b double, same boolean, near boolean", 2, [
    (1.0, 1.0000005, True, True), (1.0, 1.00001, False, True), (1e9, 1e9 + 500.0, True, True), (0.333333, 33.3333, False, True), (33.3333, 0.333333, False, True), (5.0, 5.2, False, False), (0.0, 0.0, True, True),
])
def fn_equal_numbers():
    return T.same_number("a", "b"), T.near_number("a", "b")


@cases("text string, state string", 1, [
    ("X", "true"), ("[X]", "true"), ("[*]", "true"), ("[v]", "true"), ("☒", "true"), ("■", "true"), ("✔", "true"), ("checked", "true"), ("LX.J", "true"), ("[XJ", "true"), ("[", "true"), (" Yes ", "true"), ("TRUE", "true"),
    ("[ ]", "false"), ("☐", "false"), ("LJ", "false"), ("unchecked", "false"), ("D", "false"), ("O", "false"), ("ooo", "false"), ("q", "false"), ("[_]", "false"), ("]", "false"), ("No", "false"), ("✗", "none"), ("(x)", "none"), ("maybe", "none"), ("", "none"),
])
def fn_checkboxes():
    return (F.coalesce(T.checkbox("text").cast("string"), F.lit("none")),)


@cases("field string, kind string, value string, type string", 3, [
    ("candidate_id", "str", "A12", "identifier"), ("is_active", "str", "yes", "boolean"), ("is_active", "str", "maybe", "string"), ("shipped", "bool", "true", "boolean"), ("amount", "int", "5", "numeric"), ("amount", "str", "1,200.50", "currency"),
    ("memo", "str", "$5", "currency"), ("start_date", "str", "2024-03-05", "date"), ("start_date", "str", "soon", "string"), ("qty", "str", "12", "numeric"), ("zip", "str", "AB 12", "identifier"), ("rows[0].label", "str", "abc", "table_cell"),
    ("label", "str", "abc", "string"), ("memo", "null", None, "string"), ("total", "str", "abc", "string"), ("tax_rate", "float", "0.1", "numeric"), ("has_pets", "str", "0", "boolean"), ("period", "str", "March 5, 2024", "date"), ("qty", "str", "5l", "string"),
])
def fn_field_types():
    return (T.field_type("field", "kind", "value"),)


@cases("text string, plausible boolean", 1, [
    ("Page 3/4/2024", False), ("3/4", False), ("March 5", True), ("May", False), ("2024-05", True), ("2024", False), ("5/6/24", True), ("number 5/6/24", False), ("12 sept 2020", True), ("due 3/4 2021", True), ("Item March 5", False), ("acres 1/2/2020", False), ("none", False),
])
def fn_plausible_dates():
    return (T.plausible_date("text"),)


@cases("text string, day string, flexible string", 1, [
    ("2024-03-05", "2024-03-05", "2024-03-05"), ("3/4/2024", "2024-03-04", "2024-03-04"), ("25/12/2024", "2024-12-25", None), ("3-4-2024", "2024-03-04", "2024-04-03"), ("March 5, 2024", "2024-03-05", "2024-03-05"), ("5 Sept. 2024", "2024-09-05", "2024-09-05"),
    ("Dec 1st, 1999", "1999-12-01", None), ("1/2/24", "2024-01-02", "2024-01-02"), ("1/2/87", "1987-01-02", "1987-01-02"), ("2024/7/9", "2024-07-09", "2024-07-09"), ("31/31/2024", None, None), ("1800-01-01", None, "1800-01-01"), ("_2024-03-05|", "2024-03-05", None), ("page 3/4/2024", None, None), ("text", None, None),
])
def fn_parsed_dates():
    return T.date("text").cast("string"), T.date_flexible("text").cast("string")


@cases("text string, clean string, noise string, start int, end int, leader boolean", 1, [
    ("_|abc|_", "abc", "abc", 2, 5, False), ("a__b", "a b", "a__b", 0, 4, False), ("'x'", "x", "x", 1, 2, False), ("...", "...", "", 3, 3, True), ("…", "…", "…", 0, 1, True), (". . .", ". . .", "", 5, 5, True), (".", ".", "", 1, 1, False),
    ("--", "--", "", 2, 2, False), ("..-", "..-", "", 3, 3, True), ("$1,200.", "$1,200.", "1,200", 1, 6, False), ("“Acme”", "“Acme”", "Acme”", 1, 6, False), ("§12§", "§12§", "12", 1, 3, False),
])
def fn_specks():
    span = T.noise_span("text")
    return T.clear_specks("text"), span["text"], span["start"], span["end"], T.is_leader("text")


@cases("a string, b string, hit boolean", 2, [
    ("net", "net", True), ("network", "net", True), ("ethernet", "net", True), ("net", "network", True), ("planets", "net", True), ("ab", "cab", True), ("abcd", "xbcx", False), ("aab", "xaaby", True), ("", "x", False), ("cat", "dog", False),
])
def fn_word_hits():
    return (T.word_hits("a", "b"),)


@cases("text string, matchable string, key string", 1, [
    ("A/B (c)", "a b c", "A/B(c)"), ("x$5.00%", "x$5.00%", "x5.00%"), ("(1,200)", "1,200", "-1200"), ("Élan_2!", "élan_2", "Élan_2!"), ("  two   words ", "two words", "twowords"), ("€ 5", "5", "5"),
])
def fn_match_texts():
    return T.for_match("text"), T.value_key("text")


@cases("line string, value string, has boolean", 2, [
    ("Acme Holdings Corp 1,200", "acme holdings", True), ("ACMEHOLDINGS", "Acme Holdings", True), ("Acme Group Limited", "Acme Holdings Limited", True), ("Acme Group", "Other Holdings Limited", False), ("one", "two", False), ("the cat", "cat dogs", True), ("price 12", "…", False),
])
def fn_line_values():
    return (T.line_has_value("line", "value"),)


@cases("field string, words string, share double, key string, derived boolean, prefix string, idx int, suffix string", 1, [
    ("invoice.totalAmount", "invoice total amount", 0.0, "invoice_totalamount", True, None, -1, None), ("rows[12].unit_price", "rows unit price", 1 / 3, "rows_12_unit_price", False, "rows", 12, ".unit_price"),
    ("a[1].b[2]", "a b", 1.0, "a_1_b_2", False, "a[1].b", 2, ""), ("subtotal", "subtotal", 0.0, "subtotal", True, None, -1, None), ("unit price of all", "unit price of all", 0.5, "unit_price_of_all", False, None, -1, None),
    ("one two three four five", "one two three four five", 0.0, "one_two_three_four", False, None, -1, None), ("!!!", "!!!", 0.0, "field", False, None, -1, None),
])
def fn_field_names():
    path = T.array_path("field")
    return F.array_join(T.field_words("field"), " "), T.word_overlap(T.field_words("field"), F.lit("Unit of ab")), T.snake_key("field"), T.likely_derived("field"), path["prefix"], F.coalesce(path["idx"], F.lit(-1)), path["suffix"]


@cases("a string, b string, similarity double, ratio double, edits int", 2, [
    ("TARGET EXT", "TARGETEXT", 1.0, 0.947368, 1), ("2003", "2OO3", 0.98, 0.5, -1), ("ABCDEFGHIJ", "ABCDEFGH", 0.97, 0.888889, -1), ("abc", "xyz", 0.0, 0.0, -1), ("kitten", "sitting", 0.615385, 0.615385, -1), ("same", "same", 1.0, 1.0, 0),
    ("!!", "??", 0.0, 0.0, -1), ("BIG MIKE'S A/C", "BIGMIKESAC", 1.0, 0.833333, -1), ("Smith", "Smlth", 0.98, 0.8, 1), ("0.5", "05", 1.0, 0.8, 1),
])
def fn_similarities():
    r6 = lambda c: F.round(c, 6)
    return r6(T.ocr_similarity("a", "b")), r6(T.indel("a", "b")), F.levenshtein("a", "b", 1)


@cases("x double, y double, w double, h double, n int, cx double, cy double, cw double, ch double", 5, [
    (0.1, 0.2, 0.1, 0.012, 0, 0.095, 0.198, 0.11, 0.016), (0.1, 0.2, 0.1, 0.012, 5, 0.06, 0.195, 0.18, 0.022), (0.1, 0.2, 0.01, 0.01, 9, 0.035, 0.196, 0.03, 0.018), (0.001, 0.001, 0.1, 0.01, 0, 0.0, 0.0, 0.11, 0.014),
    (0.95, 0.99, 0.04, 0.01, 14, 0.935, 0.972, 0.065, 0.025), (0.5, 0.5, 0.2, 0.02, 11, 0.492, 0.496, 0.248, 0.028), (0.5, 0.5, 0.0, 0.0, 13, 0.488, 0.488, 0.024, 0.024),
])
def fn_padded_cells():
    c = F.get(G.padded(G.box("x", "y", "w", "h")), F.col("n"))
    return c["x"], c["y"], c["w"], c["h"]


@cases("x double, y double, w double, h double, cells int, tops string", 4, [
    # all of 28 places, in the own height and those of the four that differ by a thousandth
    (0.1, 0.5, 0.1, 0.011, 140, "0.4449"), (0.1, 0.5, 0.1, 0.0125, 112, "0.4449"), (0.1, 0.02, 0.1, 0.011, 90, "0.0476"), (0.1, 0.97, 0.1, 0.011, 82, "0.9149"),
])
def fn_shifted_rows():
    cells = G.shifted_rows(G.box("x", "y", "w", "h"))
    return F.size(cells), F.get(cells, F.lit(0))["y"].cast("string")


TOKENS = "doc_id string, page int, line_index int, token_idx int, text string, box struct<x: double, y: double, w: double, h: double>"
FIELDS = "doc_id string, field string, value string, kind string, context string, page_hint int"
BOX = "struct<x: double, y: double, w: double, h: double>"


def tokens(spark: SparkSession, lines: list[tuple], doc: str = "d") -> DataFrame:
    """Tokens of lines (page, top, words); a word is (text, left) or (text, left, top)."""
    out, seen = [], {}
    for page, y, words in lines:
        line = seen[page] = seen.get(page, -1) + 1
        out += [(doc, page, line, k, w[0], (w[1], w[2] if len(w) > 2 else y, 0.01 * len(w[0]), 0.012)) for k, w in enumerate(words)]
    return spark.createDataFrame(out, TOKENS)


def wanted(spark: SparkSession, *rows: tuple) -> DataFrame:
    """Fields (name, value, kind, context, page_hint), the last ones as far as they are given."""
    return spark.createDataFrame([("d", *r, *("str", "", None)[len(r) - 2 :]) for r in rows], FIELDS)


def page(schema: str, rows: list[tuple]):
    """A query on hand-made documents; the SQL states its result."""

    def add(f):
        def run(spark: SparkSession, _: str) -> DataFrame:
            return f(spark).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        SQL[f.__name__] = stated(schema, rows)
        return f

    return add


def with_box(df: DataFrame, sides: str = "xw", name: str = "box") -> DataFrame:
    return df.withColumns({k: F.round(F.col(name)[k], 6) for k in sides})


FOUND = "field string, page int, line_index int, matched_text string, similarity double, x double, w double"


@page(FOUND, [("rate", 1, 0, "3 3 . 5 %", 0.98, 0.2, 0.13), ("id", 1, 1, "1 2 3", 0.98, 0.2, 0.07)])
def rec_spaced_numbers(spark):
    """Digits apart by .02; one wider than .04 away stays out."""
    from quillmap.operators import index as I, recovery as V

    t = tokens(spark, [(1, 0.1, [("Rate", 0.1), ("3", 0.2), ("3", 0.23), (".", 0.26), ("5", 0.29), ("%", 0.32)]), (1, 0.2, [("Id", 0.1), ("1", 0.2), ("2", 0.23), ("3", 0.26), ("4", 0.4)])])
    got = V.spaced_numbers(wanted(spark, ("rate", "33.5", "float"), ("id", "123", "int"), ("far", "1234", "int")), I.lines(t))
    # the sign is no part of the number, but belongs to its longest run
    best = got.groupBy("field").agg(F.max_by(F.struct("page", "line_index", "matched_text", "similarity", "box"), F.length("matched_text")).alias("m"))
    return with_box(best.select("field", "m.*"))


@page(FOUND, [("due", 1, 0, "USD 1,450.00", 0.99, 0.2, 0.14), ("rate", 1, 1, "12.5 %", 0.99, 0.2, 0.07)])
def rec_split_signs(spark):
    from quillmap.operators import index as I, recovery as V

    t = tokens(spark, [(1, 0.1, [("Due", 0.1), ("USD", 0.2), ("1,450.00", 0.26)]), (1, 0.2, [("Rate", 0.1), ("12.5", 0.2), ("%", 0.26)]), (1, 0.3, [("Far", 0.1), ("$", 0.2), ("77", 0.3)])])
    return with_box(V.split_signs(wanted(spark, ("due", "1450", "int"), ("rate", "12.5", "float"), ("far", "77", "int")), I.lines(t)))


@page(FOUND, [("name", 1, 0, "TELCO EXPERTS LLC", 0.97, 0.1, 0.5), ("edge", 1, 1, "TELCO PARK EXPERTS", 0.97, 0.1, 0.27), ("part", 1, 0, "38 PARK AVENUE,", 0.97, 0.16, 0.37)])
def rec_interleaved(spark):
    """Two rows in one line, .009 apart; and one row whose words lie on either side of .21."""
    from quillmap.operators import index as I, recovery as V

    t = tokens(spark, [
        (1, 0.1, [("TELCO", 0.1), ("38", 0.16, 0.109), ("PARK", 0.2, 0.109), ("EXPERTS", 0.3), ("AVENUE,", 0.46, 0.109), ("LLC", 0.57)]),
        (1, 0.21, [("TELCO", 0.1, 0.2099), ("PARK", 0.2, 0.2101), ("EXPERTS", 0.3, 0.2099)]),
    ])
    return with_box(V.interleaved(wanted(spark, ("name", "Telco Experts LLC"), ("edge", "TELCO PARK EXPERTS"), ("part", "38 Park Avenue"), ("no", "LLC Telco")), I.lines(t)))


@page(FOUND, [("road", 1, 0, "12 Example Road,", 0.96, 0.2, 0.3), ("all", 1, 0, "12 Example Road,", 0.98, 0.2, 0.3)])
def rec_bounded_spans(spark):
    """All but the last of four words, and all of three; two of four are too few."""
    from quillmap.operators import index as I, recovery as V

    t = tokens(spark, [(1, 0.1, [("At", 0.1), ("12", 0.2), ("Example", 0.26), ("Road,", 0.45), ("x", 0.6)])])
    return with_box(V.bounded_spans(wanted(spark, ("road", "12 example road east"), ("all", "12 Example Road"), ("few", "12 example lane west")), I.lines(t)))


@page("field string, page int, similarity double", [("a", 1, 0.99), ("b", 2, 0.9), ("b", 5, 0.9 * 0.85), ("c", 4, 0.9 * 0.85), ("n", 3, 0.8)])
def rec_staged(spark):
    """Near the hinted page first; far only on gated pages, for fields without a sure near one, at a loss."""
    from quillmap.operators import recovery as V

    rows = [("a", 1, 1, 0.99), ("a", 5, 1, 0.99), ("b", 2, 1, 0.9), ("b", 5, 1, 0.9), ("b", 6, 1, 0.9), ("c", 4, 1, 0.9), ("n", 3, None, 0.8)]
    c = spark.createDataFrame([("d", f, p, 0, (0.1, 0.1, 0.1, 0.1), "t", s, h) for f, p, h, s in rows], f"doc_id string, field string, page int, line_index int, box {BOX}, matched_text string, similarity double, page_hint int")
    gates = spark.createDataFrame([("d", "a", 5), ("d", "b", 5), ("d", "c", 4), ("d", "n", 3)], "doc_id string, field string, page int")
    return V.staged(c, gates)


@page(FOUND + ", kind string", [("two", 1, 0, "New York", 1.0, 0.2, 0.14, "exact"), ("over", 1, 1, "Grand Total Amount", 1.0, 0.05, 0.5, "exact"), ("punct", 1, 0, "$5.00 (net)", 1.0, 0.5, 0.16, "exact")])
def cand_sequences(spark):
    """Words that follow each other, over two lines too; not with another between them, nor within a word."""
    from quillmap.operators import candidates as C

    t = tokens(spark, [(1, 0.1, [("in", 0.1), ("New", 0.2), ("York", 0.3), ("$5.00", 0.5), ("(net)", 0.61)]), (1, 0.2, [("x", 0.1), ("Grand", 0.5)]), (1, 0.23, [("Total", 0.05), ("Amount", 0.2)])])
    f = wanted(spark, ("two", "new york"), ("over", "Grand total amount"), ("punct", "$5.00 net"), ("gap", "in York"), ("inside", "ew York"))
    return with_box(C.sequences(f, t)).withColumn("kind", F.col("match_type"))


@page("field string, page int, line_index int, matched_text string, x double, y double, w double, h double", [
    ("addr", 1, 0, "12 Oak Lane Springfield", 0.1, 0.1, 0.11, 0.072), ("skip", 1, 0, "Oak Springfield", 0.1, 0.1, 0.11, 0.072),
])
def cand_assembled(spark):
    """An address over three lines with other columns between; words over a gap of .1 apart are none."""
    from quillmap.operators import candidates as C, index as I

    t = tokens(spark, [(1, 0.1, [("12", 0.1), ("Oak", 0.15), ("Qty", 0.5)]), (1, 0.13, [("Lane", 0.1), ("7", 0.5)]), (1, 0.16, [("Springfield", 0.1)]), (1, 0.5, [("Far", 0.1)])])
    got = C.assembled(wanted(spark, ("addr", "12 Oak Lane Springfield"), ("skip", "Oak Springfield"), ("far", "Springfield Far"), ("one", "Oak")), I.lines(t))
    return with_box(got, "xywh")


@page("mode string, cluster int, n int, x double, y double, w double, h double", [
    ("down", 0, 2, 0.1, 0.1, 0.45, 0.032), ("down", 1, 1, 0.1, 0.3, 0.05, 0.012), ("down", 2, 1, 0.9, 0.6, 0.04, 0.012),
    ("across", 0, 3, 0.1, 0.1, 0.45, 0.212), ("across", 1, 1, 0.9, 0.6, 0.04, 0.012),
])
def cand_regions(spark):
    """Pieces of a value by gaps down the page, and by gaps both down and across."""
    from quillmap.operators import candidates as C

    t = tokens(spark, [(1, 0.1, [("Alpha", 0.1)]), (1, 0.12, [("Beta", 0.51), ("zz", 0.7)]), (1, 0.3, [("Gamma", 0.1)]), (1, 0.6, [("Beta", 0.9)])])
    found = C.pieces_of(wanted(spark, ("v", "alpha beta gamma")), t)
    down, across = C.clusters(found, 0.05), C.clusters(found, 0.05, beside=0.5)
    return with_box(down.withColumn("mode", F.lit("down")).union(across.withColumn("mode", F.lit("across"))), "xywh")


@page(FOUND, [("v", 1, 0, "inter-national", 1.0, 0.1, 0.08), ("n", 1, 2, "A-17", 1.0, 0.1, 0.02)])
def cand_hyphenated(spark):
    from quillmap.operators import candidates as C

    t = tokens(spark, [(1, 0.1, [("inter-", 0.1)]), (1, 0.13, [("national", 0.1)]), (1, 0.2, [("A-", 0.1)]), (1, 0.23, [("17", 0.1)]), (1, 0.3, [("co-", 0.1)]), (1, 0.33, [("Op", 0.1)])])
    return with_box(C.hyphenated(wanted(spark, ("v", "international"), ("n", "A-17"), ("upper", "coOp")), t))


@page("field string, page int, matched_text string, similarity double", [("n", 1, "Examp1e", 1 - 1 / 7), ("m", 1, "Roads", 1 - 1 / 5)])
def cand_noise(spark):
    """Words of pages read by machine that are one edit away, and no others."""
    from quillmap.operators import candidates as C, index as I

    t = tokens(spark, [(1, 0.1, [("Examp1e", 0.1), ("Roads", 0.3), ("Rxxds", 0.5)]), (2, 0.1, [("Example", 0.1)])])
    modes = spark.createDataFrame([("d", 1, "ocr"), ("d", 2, "pdfium")], "doc_id string, page int, mode string")
    return C.noise_matches(wanted(spark, ("n", "Example"), ("m", "Road")), I.noise_postings(t, modes))


@page("field string, page int, matched_text string, similarity double", [("c", 1, "$77.00", 1.0), ("c", 1, "Total 77.00", 0.85), ("h", 2, "Acme", 1.0)])
def cand_cells(spark):
    from quillmap.operators import candidates as C

    cells = spark.createDataFrame([("d", p, (0.1, y, 0.3, 0.02), t) for p, y, t in ((1, 0.1, "Total 77.00"), (1, 0.2, "$77.00"), (1, 0.3, "78"), (1, 0.4, "Acme"), (2, 0.4, "Acme"))], f"doc_id string, page int, box {BOX}, text string")
    return C.cells(wanted(spark, ("c", "77.00", "float"), ("h", "acme", "str", "", 2)), cells)


@page("field string, line_index int, matched_text string, similarity double, x double, w double, h double", [
    ("express_delivery", 0, "☒", 3 * 5 - 0.03 * 20 + 2, 0.1, 0.014, 0.0126), ("is_gift", 1, "[ ]", 3 * 5 - 0.1 * 20, 0.2, 0.022, 0.0126), ("wrapping", 2, "X", 1.5 * 5 - 0.02 * 20 + 2, 0.1, 0.014, 0.0126),
])
def cand_checkboxes(spark):
    """Beside an equal word, right of one, beside a longer word; not in the other state, nor out of reach."""
    from quillmap.operators import candidates as C

    t = tokens(spark, [(1, 0.1, [("☒", 0.1), ("Express", 0.13)]), (1, 0.2, [("Gift", 0.1), ("[ ]", 0.2)]), (1, 0.3, [("X", 0.1), ("Giftwrapping", 0.12)]), (1, 0.4, [("☒", 0.1), ("Priority", 0.4)])])
    f = wanted(spark, ("express_delivery", "true", "bool"), ("is_gift", "false", "bool"), ("wrapping", "true", "bool"), ("priority", "true", "bool"))
    return with_box(C.checkboxes(f, t).withColumn("similarity", F.round("similarity", 6)), "xwh")


@page(FOUND, [("a", 1, 0, "Example Road", 1 - 2 / 24, 0.2, 0.16), ("b", 1, 1, "Springfeld", 20 / 21, 0.1, 0.1)])
def cand_fuzzy(spark):
    """The run of words that is most like the value, with the better of its similarity and the line's best part."""
    from quillmap.operators import candidates as C, index as I

    t = tokens(spark, [(1, 0.1, [("at", 0.1), ("Example", 0.2), ("Road", 0.32)]), (1, 0.2, [("Springfeld", 0.1)])])
    got = C.fuzzy(wanted(spark, ("a", "Exemple Road"), ("b", "Springfield"), ("c", "Nothing here")), I.lines(t), I.gram_postings(t))
    return with_box(got.withColumn("similarity", F.round("similarity", 6)))


def box(c: Column) -> tuple[Column, ...]:
    return tuple(F.round(c[k], 6) for k in "xywh")


@cases("a double, b double, c double, d double, flip boolean, x double, y double, w double, h double", 5, [
    (61.2, 79.2, 122.4, 158.4, False, 0.1, 0.1, 0.1, 0.1), (61.2, 79.2, 122.4, 158.4, True, 0.1, 0.8, 0.1, 0.1), (-10.0, 0.0, 700.0, 900.0, False, 0.0, 0.0, 1.0, 1.0), (122.4, 158.4, 61.2, 79.2, False, 0.1, 0.1, 0.1, 0.1),
])
def fn_from_points():
    at = lambda flip: G.from_points("a", "b", "c", "d", F.lit(612.0), F.lit(792.0), flip)
    return box(F.when(F.col("flip"), at(True)).otherwise(at(False)))


@page("doc_id string, offset int, votes int, tier string, reason string, score double, second double, confidence double", [
    ("zero", 0, 2, "tier1_narrow", "decisive_zero", 3.3, 0.0, 1.0), ("plus", 2, 3, "tier1_narrow", "decisive_offset", 5.3, 0.0, 1.0), ("far", 12, 3, "tier2_medium", "decisive_offset", 5.3, 0.0, 1.0),
    ("wide", 20, 3, "tier3_wide", "decisive_offset", 5.3, 0.0, 1.0), ("few", 0, 0, "fallback", "insufficient_evidence", 0.0, 0.0, 0.0), ("plain", 0, 0, "none", "no_usable_anchors", 0.0, 0.0, 0.0), ("single", 0, 0, "single_page", "single_page_doc", 0.0, 0.0, 1.0),
    ("tied", 0, 0, "fallback", "insufficient_evidence", 0.0, 0.0, 0.0), ("often", 0, 0, "fallback", "insufficient_evidence", 0.0, 0.0, 0.0), ("head", 1, 4, "tier1_narrow", "decisive_offset", 4.5, 0.665, 1.0), ("minus", -1, 3, "tier1_narrow", "decisive_offset", 5.3, 0.0, 1.0),
])
def tbl_page_offsets(spark):
    """Offsets 0, 2, 12, 20 and -1; abstentions for two texts, digits and boilerplate alone, one page, a tie of two
    offsets, and texts on four pages; texts in running heads count a third.

    A text of one word of 5 to 9 characters weighs 1, of 10 and more 1.4, of 15 and more 1.8; two words
    add .5. "Alpha One" weighs 1.5, "Quarterly Plan" 1.9, "Longitudinalism" 1.8, "Zebra" 1 and "Mango" 1.
    """
    three = ("Alpha One", "Quarterly Plan", "Quarterly Rest")

    def doc(name: str, pages: int, texts: tuple, places: dict[int, tuple], y: float = 0.3) -> tuple[list, list]:
        t = [(name, p, k, 0, x, (0.1, y + 0.05 * k, 0.3, 0.012)) for p in range(1, pages + 1) for k, x in enumerate(places.get(p, ("filler",)))]
        return t, [(name, "t", k, "f", x, h) for k, (x, h) in enumerate(texts)]

    docs = [
        doc("zero", 3, (("Alpha One", 2), ("Longitudinalism", 3)), {2: ("Alpha One",), 3: ("see Longitudinalism, here",)}),
        doc("plus", 6, tuple((x, 2) for x in three), {4: three}), doc("far", 16, tuple((x, 2) for x in three), {14: three}), doc("wide", 25, tuple((x, 2) for x in three), {22: three}), doc("minus", 6, tuple((x, 4) for x in three), {3: three}),
        doc("few", 6, (("Alpha One", 2), ("Longitudinalism", 2)), {4: ("Alpha One", "Longitudinalism")}),
        doc("plain", 4, (("12,345.00", 1), ("Common  Stock", 1), ("abc", 1), ("TEXAS", 2)), {2: ("12,345.00", "Common Stock", "abc", "Texas")}),
        doc("single", 1, tuple((x, 1) for x in three), {1: three}),
        doc("tied", 8, tuple((x, 2) for x in three), {3: three, 6: three}),
        doc("often", 8, tuple((x, 3) for x in three), {2: three, 3: three, 5: three, 6: three}),
    ]
    body = doc("head", 6, (("Zebra", 2), ("Mango", 2), ("Alpha One", 2), ("Crimson", 2), ("Running Head", 4)), {3: ("Zebra", "Mango", "Alpha", "One Alpha One", "Crimson.")})
    # a longer word is no hit; a text in a page's head counts .35 of 1.9
    body[0].append(("head", 6, 9, 0, "Running Header x", (0.1, 0.01, 0.3, 0.012)))
    body[0].append(("head", 1, 9, 0, "Orange Juice", (0.1, 0.01, 0.3, 0.012)))
    body[1].append(("head", "t", 9, "f", "Orange Juice", 2))
    docs.append(body)
    from quillmap.operators import index as I, tables as B

    t = spark.createDataFrame([x for d in docs for x in d[0]], TOKENS)
    a = spark.createDataFrame([x for d in docs for x in d[1]], "doc_id string, table string, place int, field string, text string, page_hint int")
    got = B.page_offsets(a, I.lines(t))
    return got.withColumns({c: F.round(c, 6) for c in ("score", "second", "confidence")})


@page("doc_id string, field string, matched_text string, similarity double, x double, w double", [
    ("d", "flag_box", "X", 0.95, 0.5, 0.01), ("d", "is_paid", "0", 0.9, 0.6, 0.01), ("d", "sum", "$1,200.50'", 0.95, 0.11, 0.08), ("d", "lost", "311.", 0.9, 0.3, 0.03), ("d", "pair", "$6,867.62", 0.95, 0.7, 0.12),
    ("e", "name", "TARGETEXTERMINATING", 1.0, 0.1, 0.19), ("e", "confused", "5MITH", 0.98, 0.4, 0.05), ("e", "split", "BIG MIKE'S A/C", 1.0, 0.5, 0.17), ("e", "noise", "|Acme,", 1.0, 0.81, 0.04),
])
def ocr_rows(spark):
    """Marks, numbers with specks, lost points, signs apart; joined, confused, split and noisy names."""
    from quillmap.operators import index as I, ocr as O

    a = tokens(spark, [(1, 0.1, [("$1,200.50'", 0.1), ("311.", 0.3), ("X", 0.5), ("0", 0.6), ("$", 0.7), ("6,867.62", 0.74)])])
    b = tokens(spark, [(1, 0.1, [("TARGETEXTERMINATING", 0.1), ("5MITH", 0.4), ("BIG", 0.5), ("MIKE'S", 0.55), ("A/C", 0.64), ("|Acme,", 0.8)])], "e")
    f = [("d", "flag_box", "true", "bool"), ("d", "is_paid", "false", "bool"), ("d", "sum", "1200.5", "float"), ("d", "lost", "3.11", "float"), ("d", "pair", "6867.62", "float"), ("d", "none", "99", "int")]
    f += [("e", "name", "Target Exterminating", "str"), ("e", "confused", "Smith", "str"), ("e", "split", "Big Mikes AC", "str"), ("e", "noise", "ACME", "str"), ("e", "other", "Quite Different", "str")]
    fields = spark.createDataFrame([(*r, 1, 0) for r in f], "doc_id string, field string, value string, kind string, page int, line_index int")
    # two words "$" and "6,867.62" are one number; a lone word of it is one as well, so the pair is asked without it
    found = O.rows(fields.where("field != 'pair'"), I.lines(a.union(b)))
    torn = tokens(spark, [(1, 0.1, [("$6,867", 0.7), (".62", 0.79)])])
    return with_box(found.union(O.rows(fields.where("field = 'pair'"), I.lines(torn))).withColumn("similarity", F.round("similarity", 6)))


@page("doc_id string, page int, lines int", [("few", 1, 5), ("many", 1, 6)])
def tbl_content_lines(spark):
    """Heads and margins go; with five rows that begin at one edge, so do lines that begin elsewhere."""
    from quillmap.operators import index as I, tables as B

    def lines(doc: str, rows: int) -> DataFrame:
        body = [(1, 0.2 + 0.05 * k, [(f"Name{k}", 0.1), ("x", 0.5)]) for k in range(rows)]
        return tokens(spark, [(1, 0.01, [("Margin", 0.1)]), (1, 0.1, [("Page", 0.1), ("1", 0.2)]), *body, (1, 0.7, [("Elsewhere", 0.5)])], doc)

    t = lines("few", 4).union(lines("many", 6))
    rows = spark.createDataFrame([("few", 1, k, f"NAME{k}") for k in range(4)] + [("many", 1, k, f"NAME{k}") for k in range(6)], "doc_id string, page int, row int, first string")
    return B.content_lines(I.lines(t), rows).groupBy("doc_id", "page").agg(F.count("*").alias("lines"))


@page("column string, x double, w double", [("issuer", 0.1, 0.14), ("value", 0.4, 0.05), ("state", 0.7, 0.05)])
def tbl_column_headers(spark):
    from quillmap.operators import index as I, tables as B

    t = tokens(spark, [(1, 0.02, [("value", 0.9)]), (1, 0.1, [("Name", 0.1), ("of", 0.15), ("Issuer", 0.18), ("Value", 0.4)]), (1, 0.15, [("value", 0.6), ("State", 0.7)]), (1, 0.6, [("City", 0.1)])])
    aliases = spark.createDataFrame([("issuer", 0, "name of issuer"), ("issuer", 1, "issuer"), ("value", 0, "fair value"), ("value", 1, "value"), ("state", 0, "state"), ("city", 0, "city")], "column string, nth int, alias string")
    return B.column_headers(I.lines(t), aliases)


@page("record string, field string, page int", [("a", "title", 2), ("b", "zip", 3)])
def tbl_single_anchors(spark):
    """The first telling field that is sure, else one that is surer; records of many fields have none."""
    from quillmap.operators import tables as B

    rows = [("a", 0, "paid", "true", "bool", 1, 0.99), ("a", 1, "qty", "12", "str", 1, 0.99), ("a", 2, "title", "Plan", "str", 2, 0.8), ("b", 0, "memo", "Longer text", "str", 1, 0.7), ("b", 1, "zip", "77", "int", 3, 0.9), ("c", 0, "memo", "Longer text", "str", 1, 0.7)]
    rows += [("big", k, "name", "Some name", "str", 1, 0.9) for k in range(6)]
    r = spark.createDataFrame([("d", a, b, c, v, k, p, (0.1, 0.1, 0.1, 0.01), s) for a, b, c, v, k, p, s in rows], f"doc_id string, record string, place int, field string, value string, kind string, page int, box {BOX}, confidence double")
    return B.single_anchors(r)


@page("row int, page int", [(0, 1), (1, 1), (3, 2), (4, 2), (5, 4)])
def tbl_rising_pages(spark):
    from quillmap.operators import tables as B

    return B.rising_pages(spark.createDataFrame([("d", "t", i, p) for i, p in enumerate([1, 1, 3, 2, 2, 4])], "doc_id string, table string, row int, page int"))


@page("page int, votes double, slope double", [(2, 4.5, 0.02)])
def tbl_root_pages(spark):
    """One field on page 2 alone, one on two pages, one on four; and the slope of a head that falls by .01 over half a page."""
    from quillmap.operators import tables as B

    hits = spark.createDataFrame([("d", "a", 2), ("d", "b", 2), ("d", "b", 3), ("d", "c", 1), ("d", "c", 2), ("d", "c", 3), ("d", "c", 4), ("d", "e", 2)], "doc_id string, field string, page int")
    head = spark.createDataFrame([("d", 1, (0.1, 0.02, 0.1, 0.01)), ("d", 1, (0.6, 0.03, 0.1, 0.01))], f"doc_id string, page int, box {BOX}")
    return B.root_pages(hits).join(B.skew(head).select("doc_id", F.round("slope", 6).alias("slope")), "doc_id")


@page("row int, cand int, score double", [(0, 1, 8.0), (1, 0, 9.0), (2, 2, 1.0)])
def tbl_assigned(spark):
    from quillmap.operators import tables as B

    scores = [[9, 8, 0], [9, 1, 0], [9, 8, 1]]
    return B.assigned(spark.createDataFrame([("d", "t", i, j, float(v)) for i, row in enumerate(scores) for j, v in enumerate(row)], "doc_id string, table string, row int, cand int, score double"))


@page("mode string, field string, line_index int", [("A", "a", 1), ("A", "b", 9), ("A", "c", 9), ("E", "a", 1), ("E", "b", 1), ("E", "c", 9), ("F", "a", 1), ("F", "b", 1)])
def tbl_joint_records(spark):
    """Modes: similarity alone picks the other row, all scores the anchor's; the last leaves a field on another page out."""
    from quillmap.operators import tables as B

    rows = [("a", 0, 5, 1, 0.1, 0.294, 1.0), ("b", 1, 5, 1, 0.5, 0.294, 0.9), ("b", 1, 5, 9, 0.5, 0.694, 1.0), ("c", 2, 6, 9, 0.5, 0.694, 1.0)]
    c = spark.createDataFrame([("d", "r", f, k, p, l, (x, y, 0.1, 0.012), f, s, 5, 0.3) for f, k, p, l, x, y, s in rows], f"doc_id string, record string, field string, rank_in_record int, page int, line_index int, box {BOX}, matched_text string, similarity double, anchor_page int, anchor_y double")
    out = [B.joint_record(c, m).withColumn("mode", F.lit(m)) for m in "AEF"]
    return out[0].union(out[1]).union(out[2])


@page("record string, field string", [("r", "code"), ("s", "title")])
def tbl_record_anchors(spark):
    """Codes of six and more letters and digits first, then longer texts; ambiguous ones don't count."""
    from quillmap.operators import tables as B

    rows = [("r", "title", "A very long title indeed"), ("r", "code", "AB12CD34"), ("r", "n", "12"), ("s", "title", "Some title"), ("s", "n", "12"), ("s", "code", "ZZ99YY88"), ("s", "code", "ZZ99YY88")]
    return B.record_anchor(spark.createDataFrame([("d", r, f, 1, k, t) for k, (r, f, t) in enumerate(rows)], "doc_id string, record string, field string, page int, line_index int, matched_text string"))


@page("name string, x double, w double", [
    ("grown", 0.1, 0.22), ("cell", 0.1, 0.02), ("bound", 0.1, 0.11), ("gap", 0.1, 0.02), ("leaders", 0.1, 0.16 * 7 / 14 * 8 / 14), ("text", 0.1, 0.28 * 7 / 14 * 7 / 14), ("chars", 0.25, 0.25), ("unsure", 0.1, 0.4), ("most", 0.1, 0.4), ("crowded", 0.1, 0.4),
])
def ref_refined(spark):
    """A value that goes on, in a cell, up to a bound, over a gap; leaders, cut by the value's characters first and then
    by those before the dots; a part of a token, not where that is unsure, nearly all or in a crowd."""
    from quillmap.operators import index as I, refine as E

    t = tokens(spark, [(1, 0.1, [("12", 0.1), ("Example", 0.14), ("Road,", 0.22 + 0.05)]), (1, 0.2, [("12", 0.1), ("Example", 0.3)]), (1, 0.3, [("Balance", 0.1), ("......", 0.2), ("77", 0.5)])])
    rows = [
        ("grown", 0.1, 0.1, 0.02, "12", "12 Example Road", 0.9, False, None), ("cell", 0.1, 0.1, 0.02, "12", "12 Example Road", 0.9, True, None), ("bound", 0.1, 0.1, 0.02, "12", "12 Example Road", 0.9, False, 0.22),
        ("gap", 0.2, 0.1, 0.02, "12", "12 Example Road", 0.9, False, None), ("leaders", 0.3, 0.1, 0.16, "Balance ......", "Balance", 0.9, False, None), ("text", 0.6, 0.1, 0.28, "Balance.......", "Balance", 0.9, False, None),
        ("chars", 0.7, 0.1, 0.4, "No:12345", "12345", 0.9, False, None), ("unsure", 0.7, 0.1, 0.4, "No:12345", "12345", 0.5, False, None), ("most", 0.7, 0.1, 0.4, "12345678901", "1234567890", 0.9, False, None),
        ("crowded", 0.7, 0.1, 0.4, "12 EUR 12345678", "12", 0.9, True, None),
    ]
    m = spark.createDataFrame([("d", 1, n, (x, y, w, 0.012), t, v, s, p, r) for n, y, x, w, t, v, s, p, r in rows], f"doc_id string, page int, name string, box {BOX}, matched_text string, value string, confidence double, protected boolean, right double")
    return with_box(E.refined(m, I.lines(t)))


@page("field string, status string, page int, confidence double", [("one", "exact", 1, 0.95), ("tie", "ambiguous", -1, 0.5), ("same", "exact", 1, 0.9), ("clear", "normalized", 1, 0.99), ("near", "fuzzy", 1, 0.75)])
def rank_unverified(spark):
    """Without verification: a lone candidate, a tie, a tie at one place, a wide and a narrow margin."""
    from quillmap.operators import ranking as R

    rows = [("one", 1, 0.1, "exact", 1.0), ("tie", 1, 0.1, "exact", 1.0), ("tie", 1, 0.5, "exact", 1.0), ("same", 1, 0.1, "exact", 1.0), ("same", 1, 0.1001, "exact", 1.0), ("clear", 1, 0.1, "normalized_number", 9.0), ("clear", 2, 0.1, "exact", 1.0), ("near", 1, 0.1, "fuzzy", 1.2), ("near", 1, 0.6, "fuzzy", 1.0)]
    c = spark.createDataFrame([("d", f, p, k, (0.1, y, 0.1, 0.01), "t", m, s) for k, (f, p, y, m, s) in enumerate(rows)], f"doc_id string, field string, page int, line_index int, box {BOX}, matched_text string, match_type string, score double")
    return R.unverified(R.ranked(c)).withColumn("page", F.coalesce("page", F.lit(-1)))


@page("field string, status string, reason string", [
    ("small", "not_found", "degenerate box"), ("off", "not_found", "box off the page"), ("amount_wide", "not_found", "box too large"), ("amount_other", "not_found", "number differs"), ("start_date", "not_found", "date differs"), ("is_on", "not_found", "checkbox differs"),
    ("note", "exact", "accepted"), ("close", "ambiguous", "ambiguous"), ("grand_total", "derived", "derived"), ("nothing", "not_found", "no candidate"), ("blank", "exact", "blank value"), ("amount", "normalized", "accepted"),
])
def rank_verified(spark):
    """One field for each reason of the verifier."""
    from quillmap.operators import ranking as R

    rows = [
        ("small", "x", "str", (0.1, 0.1, 0.0001, 0.01), "x", "exact", 1.0), ("off", "x", "str", (1.0, 0.1, 0.1, 0.01), "x", "exact", 1.0), ("amount_wide", "5.0", "float", (0.05, 0.1, 0.9, 0.01), "5", "normalized_number", 1.0),
        ("amount_other", "5.0", "float", (0.1, 0.1, 0.1, 0.01), "6", "normalized_number", 1.0), ("start_date", "2024-03-05", "str", (0.1, 0.1, 0.1, 0.01), "3/6/2024", "normalized_date", 1.0), ("is_on", "true", "bool", (0.1, 0.1, 0.1, 0.01), "[ ]", "boolean", 1.0),
        ("note", "x", "str", (0.1, 0.1, 0.1, 0.01), "x", "exact", 1.0), ("close", "x", "str", (0.1, 0.1, 0.1, 0.01), "x", "exact", 1.0), ("close", "x", "str", (0.5, 0.5, 0.1, 0.01), "x", "exact", 0.99), ("amount", "5.0", "float", (0.1, 0.1, 0.1, 0.01), "$5", "normalized_number", 1.0),
    ]
    c = spark.createDataFrame([("d", f, 1, k, b, t, m, s) for k, (f, _, _, b, t, m, s) in enumerate(rows)], f"doc_id string, field string, page int, line_index int, box {BOX}, matched_text string, match_type string, score double")
    known = {f: (v, k) for f, v, k, *_ in rows} | {"grand_total": ("9", "int"), "nothing": ("y", "str"), "blank": (" ", "str")}
    return R.verify(R.ranked(c), wanted(spark, *[(f, v, k) for f, (v, k) in known.items()]))


@page("field string, line_index int", [("lone_near", 0), ("top_far", 1), ("top_near", 0), ("free", 0)])
def rank_y_gated(spark):
    """A lone candidate .2 off goes; a best one .06 off gives way to one within .04; without a hint all stay."""
    from quillmap.operators import ranking as R

    rows = [("lone_far", 0, 0.3, 0.1), ("lone_near", 0, 0.12, 0.1), ("top_far", 0, 0.16, 0.1), ("top_far", 1, 0.11, 0.1), ("top_near", 0, 0.13, 0.1), ("top_near", 1, 0.1, 0.1), ("free", 0, 0.9, None)]
    c = spark.createDataFrame([("d", f, k, k + 1, (0.1, y - 0.005, 0.1, 0.01), h) for f, k, y, h in rows], f"doc_id string, field string, line_index int, rank int, box {BOX}, y_hint double")
    return R.y_gated(c).where("rank = 1")


@page("name string, score double", [
    ("column on rail", 1.0), ("column away", -1.0), ("column unknown", 0.0), ("row at", 1.0), ("row away", -1.0), ("sequence above", -1.0), ("sequence expected", 1.0), ("sequence free", 0.5), ("page other", -1.0), ("page head", 0.8), ("y at", 12.0), ("y away", -24.0),
    ("sibling beside", 0.6 + 0.4 / 1.6), ("sibling none", 0.0),
])
def rank_scores(spark):
    """Scores at their marks, for a box of .1 by .012 at (.5, .494); for the page's head one at the top."""
    from quillmap.operators import ranking as R

    b = spark.createDataFrame([((0.5, 0.494, 0.1, 0.012), (0.5, 0.034, 0.1, 0.012), [(0.4, 0.494, 0.1, 0.012)], 1)], f"box {BOX}, head {BOX}, sib array<{BOX}>, page int")
    n, lit = F.lit(None).cast("double"), F.lit
    scores = {
        "column on rail": R.column_score("box", lit(0.5), lit(0.6), lit(True)), "column away": R.column_score("box", lit(0.1), lit(0.2), lit(True)), "column unknown": R.column_score("box", n, n, lit(True)), "row at": R.row_score("box", lit(0.5), n, n),
        "row away": R.row_score("box", lit(0.9), n, n), "sequence above": R.sequence_score("box", n, lit(0.6), n), "sequence expected": R.sequence_score("box", lit(0.5), n, n), "sequence free": R.sequence_score("box", n, lit(0.4), lit(0.6)),
        "page other": R.page_score("box", F.col("page"), lit(2), lit(1.0), lit(False), lit(3)), "page head": R.page_score("head", F.col("page"), lit(1), lit(1.0), lit(False), lit(3)), "y at": R.y_score("box", lit(0.5)), "y away": R.y_score("box", lit(0.9)),
        "sibling beside": R.sibling_score("box", "sib"), "sibling none": R.sibling_score("box", F.slice("sib", 1, 0)),
    }
    return b.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.round(v, 6).alias("score")) for k, v in scores.items()])))


@page("field string, page int, status string, regions int, y double, h double", [("two", 1, "multi_region", 2, 0.1, 0.042), ("one", 1, "exact", 1, 0.5, 0.012)])
def rank_regions(spark):
    from quillmap.operators import ranking as R

    rows = [("two", 0, 0.1), ("two", 0, 0.1), ("two", 1, 0.13), ("one", 4, 0.5)]
    p = spark.createDataFrame([("d", f, 1, k, (0.1 + 0.1 * i, y, 0.08, 0.012)) for i, (f, k, y) in enumerate(rows)], f"doc_id string, field string, page int, line_index int, box {BOX}")
    return with_box(R.regions(p).withColumn("regions", F.size("regions")), "yh")


@page("how string, field string, stage int", [("first", "a", 1), ("first", "b", 2), ("vote", "a", 3), ("vote", "b", 2)])
def rank_stages(spark):
    """The first stage that has a result, and the surest."""
    from quillmap.operators import ranking as R

    s = spark.createDataFrame([("d", "a", 1, 0.8), ("d", "a", 3, 0.95), ("d", "b", 2, 0.9), ("d", "b", 5, 0.9)], "doc_id string, field string, stage int, confidence double")
    return R.first_stage(s).withColumn("how", F.lit("first")).union(R.voted(s).withColumn("how", F.lit("vote")))


@page("page int, similarity double", [(1, 0.9), (1, 0.5), (2, 0.6)])
def rank_suppressed(spark):
    """What overlaps a better candidate by .7 goes; another page or place stays."""
    from quillmap.operators import ranking as R

    rows = [(1, 0.1, 0.9), (1, 0.105, 0.8), (1, 0.5, 0.5), (2, 0.1, 0.6)]
    return R.suppressed(spark.createDataFrame([("d", "f", p, k, (x, 0.1, 0.1, 0.01), "t", s) for k, (p, x, s) in enumerate(rows)], f"doc_id string, field string, page int, line_index int, box {BOX}, matched_text string, similarity double"))


@page("field string, page int, text string, state string, printed string", [("due", 1, "1,450.00", "-", "-"), ("express", 1, "-", "true", "true"), ("second", 1, "-", "-", "false"), ("street", 1, "12 Example Road,", "-", "-")])
def tpl_placed(spark):
    """A number at a form's line, a box that is printed and one that isn't, a name in a zone."""
    from quillmap.operators import index as I, templates as L

    t = tokens(spark, [(1, 0.3, [("Total", 0.1), ("1,450.00", 0.34)]), (1, 0.5, [("1,450.00", 0.34)]), (1, 0.45, [("12", 0.1), ("Example", 0.14), ("Road,", 0.25)]), (1, 0.65, [("☒", 0.1), ("Express", 0.13)])])
    rows = [("f", 1, "due", "anchor", "", 0.3, 0.4, 0.3, None), ("f", 1, "express", "checkbox", "", 0.104, None, 0.656, None), ("f", 1, "second", "checkbox", "", 0.8, None, 0.9, None), ("f", 1, "street", "zone", "", 0.0, 0.5, 0.4, 0.1)]
    template = spark.createDataFrame(rows, "form string, page_no int, name string, kind string, label string, x0 double, x1 double, y double, row_pitch double")
    f = spark.createDataFrame([("d", n, v, n, "f") for n, v in (("due", "1450"), ("express", "true"), ("second", "true"), ("street", "12 Example Road"))], "doc_id string, field string, value string, name string, form string")
    none = F.lit("-")
    told = L.anchored(f, t, template).union(L.zoned(f, I.lines(t), template)).select("field", "page", F.col("matched_text").alias("text"), none.alias("state"), none.alias("printed"))
    return told.union(L.checked(f, t, template).select("field", "page", none, F.coalesce(F.col("state").cast("string"), none), F.col("printed").cast("string")))


@page("key string, found string", [("page 1", "inv"), ("page 2", "-"), ("x-acme-corp-1", "B"), ("acme", "A"), ("zz", "-")])
def tpl_forms_and_families(spark):
    from quillmap.operators import templates as L

    t = tokens(spark, [(1, 0.1, [("Total", 0.1), ("Due:", 0.2)]), (2, 0.1, [("other", 0.1)])])
    forms = L.page_forms(t, spark.createDataFrame([("inv", "total due"), ("x", "no.hit")], "form string, pattern string"))
    pages = t.select("page").distinct().join(forms, "page", "left").select(F.concat(F.lit("page "), "page").alias("key"), F.coalesce("form", F.lit("-")).alias("found"))
    names = spark.createDataFrame([("acme", "A"), ("acme-corp", "B")], "name string, family string")
    keys = L.families(spark.createDataFrame([("x-acme-corp-1",), ("acme",), ("zz",)], "doc_key string"), names)
    return pages.union(keys.select("doc_key", F.coalesce("family", F.lit("-"))))


@page("field string, line_index int", [("beginning_balance", 0), ("plain", 0), ("ending_balance", 1)])
def tpl_flat_forms(spark):
    """Of two amounts in a row the one under the label of the field's own qualifier."""
    from quillmap.operators import index as I, templates as L

    t = tokens(spark, [(1, 0.1, [("beginning", 0.3), ("ending", 0.6)]), (1, 0.14, [("5", 0.3), ("5", 0.6)])])
    rows = [("beginning_balance", 1, 0, 0.3), ("beginning_balance", 2, 1, 0.6), ("ending_balance", 1, 0, 0.3), ("ending_balance", 2, 1, 0.6), ("plain", 1, 0, 0.3), ("plain", 2, 1, 0.6)]
    c = spark.createDataFrame([("d", f, r, 1, k, (x, 0.14, 0.01, 0.012)) for f, r, k, x in rows], f"doc_id string, field string, rank int, page int, line_index int, box {BOX}")
    return L.flat_forms(c, I.lines(t)).where("rank = 1")


@page("gained long, regressed long, purity double, recall double, verified string", [(1, 1, 0.5, 0.5, "false")])
def eval_correlation(spark):
    """Four records: one gained, one still failing, one kept without a candidate, one lost."""
    from quillmap.operators import evaluate as E

    at, off = (0.1, 0.2, 0.2, 0.01), (0.6, 0.6, 0.2, 0.01)
    reg = spark.createDataFrame([("d", f, s, "x", 1, at) for f, s in (("a", "FAIL"), ("b", "FAIL"), ("c", "PASS"), ("e", "PASS"))], f"doc_id string, field string, status string, category string, gold_page int, gold_box {BOX}")
    cand = spark.createDataFrame([("d", "a", 1, at), ("d", "e", 1, off)], f"doc_id string, field string, page int, box {BOX}")
    return E.correlation(reg, cand)


@page("class string, n long", [("ZERO_CANDIDATE", 1), ("MALFORMED_BBOX", 1), ("PAGE_DRIFT", 1), ("PASS", 2), ("WRONG_ROW", 1), ("INSUFFICIENT_IOU", 1)])
def eval_classes(spark):
    """One result for each class of failure."""
    from quillmap.operators import evaluate as E

    gold = (0.1, 0.2, 0.2, 0.01)
    rows = [("a", None, None), ("b", 1, (0.1, 0.2, 0.0, 0.01)), ("c", 2, gold), ("d", 1, gold), ("e", 1, (0.1, 0.3, 0.2, 0.01)), ("f", 1, (0.25, 0.2, 0.2, 0.01)), ("g", 1, (0.1, 0.2, 0.25, 0.01))]
    g = spark.createDataFrame([("d", f, 1, gold) for f, *_ in rows], f"doc_id string, field string, gold_page int, gold_box {BOX}")
    r = spark.createDataFrame([("d", f, p, b) for f, p, b in rows if p], f"doc_id string, field string, page int, box {BOX}")
    return E.judged(r, g).groupBy(E.failure_class().alias("class")).agg(F.count("*").alias("n"))


@page("id int, page int, text string", [(1, 1, "Tax"), (2, 2, "Rest")])
def eval_unmapped(spark):
    """The first two lines that nothing covers, of three."""
    from quillmap.operators import evaluate as E, index as I

    t = tokens(spark, [(1, 0.1, [("Total", 0.1)]), (1, 0.2, [("Tax", 0.1)]), (2, 0.1, [("Rest", 0.1)]), (2, 0.2, [("More", 0.1)])])
    res = spark.createDataFrame([("d", "a", 1, (0.1, 0.1, 0.05, 0.012), "Total")], f"doc_id string, field string, page int, box {BOX}, matched_text string")
    return E.unmapped(I.lines(t), res, 2)


@page("text string, variants string", [
    ("5", "$5.00 | 5 | 5.00"), ("0.25", "$0.25 | 0.25 | 025 | 25.00%"), ("12%", "$12.00 | 0.1200 | 12 | 12% | 12.00"), ("A.B.", "A.B. | AB"), ("0", "$0.00 | - | 0 | 0.00 | 0.00%"), ("1234", "$1,234.00 | 1,234 | 1,234.00 | 1234"),
])
def ctx_variants(spark):
    from quillmap.operators import context as X

    df = spark.createDataFrame([(t,) for t in ("5", "0.25", "12%", "A.B.", "0", "1234")], "text string")
    return df.select("text", F.array_join(X.variants(F.col("text")), " | ").alias("variants"))


@page("text string, header string", [("a", "Left"), ("b", "Right"), ("c", "Lower"), ("Lower", "Right"), ("Left", "-"), ("Right", "-")])
def ctx_headers(spark):
    """The lowest header above that a word overlaps."""
    from quillmap.operators import context as X

    t = tokens(spark, [(1, 0.1, [("Left", 0.1), ("Right", 0.5)]), (1, 0.2, [("a", 0.11), ("b", 0.53)]), (1, 0.3, [("Lower", 0.5)]), (1, 0.4, [("c", 0.52)])])
    heads = t.where("text in ('Left', 'Right', 'Lower')").select("doc_id", "page", F.col("text").alias("header"), "box")
    return X.under_header(t, heads).withColumn("header", F.coalesce("header", F.lit("-")))


@page("name string, score double, result string", [
    ("align", 2.0, "0-0 -1 1-2 2-3"), ("distance", 1.0, "1"), ("distance free", 0.0, "0"), ("distance far", -1.0, "-"), ("rise", 4.0, "0,1,3,4"), ("solve", 3.0, "1,2,0"), ("transport", 1.0, "0>1 1>0"), ("assignment", 2.0, "0>1 1>0"), ("ratio", 0.8, "4"),
])
def alg_values(spark):
    """Small cases of the algorithms that grouped functions use."""
    import numpy as np

    from quillmap.functions import algos as A

    cost = np.array([[9.0, 1.0], [1.0, 9.0]])
    plan, pairs = A.transport(cost), A.assignment(cost)
    score, columns = A.global_alignment("GAT", "GCAT")
    picked = A.solve([[0, 1], [2], [0, 1, 2]], lambda i, x, j, y: x != y and not (i == 0 and j == 2 and x < y) and not (i == 2 and j == 0 and y < x))
    rows = [
        ("align", float(score), " ".join(f"{'' if i is None else i}-{'' if j is None else j}" for i, j in columns)), ("distance", 1.0, str(A.bounded_distance("cat", "cut", 1))), ("distance free", 0.0, str(A.bounded_distance("O1", "0l", 1, frozenset({("O", "0"), ("1", "l")})))),
        ("distance far", -1.0, str(A.bounded_distance("cat", "dog", 2)).replace("None", "-")), ("rise", 4.0, ",".join(map(str, A.longest_rise([1, 1, 3, 2, 2])))), ("solve", 3.0, ",".join(map(str, picked or []))),
        ("transport", round(float(plan.sum()), 6), " ".join(f"{i}>{int(r.argmax())}" for i, r in enumerate(plan))), ("assignment", float(sum(cost[i, j] for i, j in pairs)), " ".join(f"{i}>{j}" for i, j in pairs)), ("ratio", A.indel_ratio("abcde", "abxde"), str(A.common_length("abcde", "abxde"))),
    ]
    return spark.createDataFrame(rows, "name string, score double, result string")


@page("name string, mode string", [
    ("few", "ocr"), ("garbled", "ocr"), ("image", "ocr"), ("image, many words", "liteparse"), ("scanned", "ocr"), ("thin", "ocr"), ("one reader", "pdfium"), ("torn", "pdfium"), ("torn by parentheses", "pdfium"), ("loose", "pdfium"), ("loose, cells", "liteparse"), ("form", "pdfium"), ("plain", "liteparse"),
])
def idx_routes(spark):
    """A page for each rule of routing, and pages that just miss one."""
    from quillmap.operators import index as I

    plain = {"p_tokens": 100, "l_tokens": 100, "alnum": 90, "non_space": 100, "split_decimals": 0, "split_parens": 0, "cells": 0, "tax_form": False, "garbled": False, "full_image": False, "scanned": False}
    rows = {
        "few": {"p_tokens": 24, "l_tokens": 24}, "garbled": {"garbled": True}, "image": {"full_image": True, "l_tokens": 49}, "image, many words": {"full_image": True, "l_tokens": 50}, "scanned": {"scanned": True, "l_tokens": 30},
        "thin": {"l_tokens": 40, "alnum": 34}, "one reader": {"l_tokens": 24}, "torn": {"split_decimals": 5, "l_tokens": 105}, "torn by parentheses": {"split_decimals": 2, "split_parens": 2, "l_tokens": 105, "cells": 1},
        "loose": {"split_decimals": 2, "l_tokens": 104}, "loose, cells": {"split_decimals": 2, "l_tokens": 104, "cells": 1}, "form": {"tax_form": True, "split_decimals": 1}, "plain": {},
    }
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int'}" for k, v in plain.items())
    return I.route_pages(spark.createDataFrame([(n, *(plain | r).values()) for n, r in rows.items()], f"name string, {kinds}"))


@page("table string, rails long, side long, below long, kind string", [("rows", 2, 2, 0, "TRUE_2D_TABLE"), ("forms", 1, 0, 2, "LINEAR_RECORD"), ("single", 1, 0, 0, "UNKNOWN"), ("both", 2, 1, 1, "UNKNOWN")])
def tbl_kinds(spark):
    """Records side by side, one below the other, of one field, and one of each."""
    from quillmap.operators import tables as B

    rows = [("rows", r, c, 0.1 + 0.4 * c, 0.1 + 0.05 * r) for r in range(2) for c in range(2)] + [("forms", r, c, 0.1, 0.1 + 0.2 * r + 0.05 * c) for r in range(2) for c in range(2)]
    rows += [("single", r, 0, 0.1, 0.1 + 0.05 * r) for r in range(3)] + [("both", 0, 0, 0.1, 0.1), ("both", 0, 1, 0.5, 0.1), ("both", 1, 0, 0.1, 0.3), ("both", 1, 1, 0.1, 0.35)]
    return B.table_kind(spark.createDataFrame([("d", t, r, c, 1, (x, y, 0.1, 0.012)) for t, r, c, x, y in rows], f"doc_id string, table string, row int, column int, page int, box {BOX}"))


@page("table string, n long, grid string", [("even", 6, "true"), ("uneven", 6, "false"), ("short", 4, "false"), ("wide", 6, "false"), ("crooked", 6, "false")])
def tbl_grids(spark):
    """Even rows; uneven ones, four, some .05 apart, and some that begin in two places."""
    from quillmap.operators import tables as B

    tops = {"even": [0.1 + 0.02 * k for k in range(6)], "uneven": [0.1, 0.11, 0.14, 0.15, 0.18, 0.19], "short": [0.1 + 0.02 * k for k in range(4)], "wide": [0.1 + 0.05 * k for k in range(6)], "crooked": [0.1 + 0.02 * k for k in range(6)]}
    rows = [("d", t, 1, k, (0.1 + (0.1 * (k % 2) if t == "crooked" else 0), y, 0.1, 0.012)) for t, ys in tops.items() for k, y in enumerate(ys)]
    return B.is_grid(spark.createDataFrame(rows, f"doc_id string, table string, page int, row int, box {BOX}"))


@page("total_lines long, mapped_lines long, coverage_percent double", [(5, 3, 60.0)])
def eval_covered(spark):
    """A line covered by a third, one by a fifth, one whose text a result has, one that has a result's, one untouched."""
    from quillmap.operators import evaluate as E, index as I

    t = tokens(spark, [(1, 0.1, [("abcdefghij", 0.1)]), (1, 0.2, [("klmnopqrst", 0.1)]), (1, 0.3, [("total", 0.1)]), (1, 0.4, [("grand", 0.1), ("sum", 0.2)]), (1, 0.5, [("rest", 0.1)])])
    rows = [(0.1, 0.1, 0.033, 0.012, "x1"), (0.1, 0.2, 0.02, 0.012, "x2"), (0.9, 0.9, 0.01, 0.01, "the total due"), (0.9, 0.9, 0.01, 0.01, "grand")]
    return E.coverage(I.lines(t), spark.createDataFrame([("d", 1, r[:4], r[4]) for r in rows], f"doc_id string, page int, box {BOX}, matched_text string"))


@page("status string, place string, text string", [("normalized", "1", "1,450.00")])
def snk_citations(spark):
    """Results as one JSON text for each document, read again."""
    from quillmap.sources.files import citations

    r = spark.createDataFrame([("d", "due", 1, (0.1, 0.2, 0.25, 0.012), "1,450.00", 0.95, "normalized")], f"doc_id string, field string, page int, box {BOX}, matched_text string, confidence double, status string")
    at = lambda path: F.get_json_object("citations", path)
    return citations(r).select(at("$[0].status").alias("status"), at("$[0].place.page").alias("place"), at("$[0].reference_text").alias("text"))


@page("name string, x double, y double, w double, h double", [
    ("corners", 0.1, 0.2, 0.3, 0.4), ("part", 0.125, 0.2, 0.05, 0.01), ("least part", 0.1, 0.2, 0.002, 0.01), ("tall", 0.1, 0.196, 0.1, 0.018), ("tall enough", 0.1, 0.2, 0.1, 0.05), ("meet", 0.15, 0.2, 0.05, 0.01), ("hull of some", 0.1, 0.2, 0.5, 0.11),
    ("edges", 0.1, 0.2, 0.2, 0.21), ("thousandths", 200.0, 100.0, 210.0, 200.0), ("measures", 0.2, 0.21, 0.15, 0.205), ("shares", 0.333333, 0.5, 0.0, 1.0), ("valid", 1.0, 0.0, 0.0, 0.0),
])
def fn_boxes(spark):
    """Boxes and measures of a box of .1 by .01 at (.1, .2)."""
    lit = F.lit
    a, b = G.box(lit(0.1), lit(0.2), lit(0.1), lit(0.01)), G.box(lit(0.15), lit(0.2), lit(0.1), lit(0.01))
    none, four = G.box(lit(0.9), lit(0.9), lit(0.0), lit(0.1)), lambda v: F.struct(*[v[i].cast("double").alias(k) for i, k in enumerate("xywh")])
    bad = G.box(lit(0.1), lit(0.1), lit(-0.1), lit(0.1))
    flag = lambda c: c.cast("double")
    rows = {
        "corners": G.from_edges(lit(0.4), lit(0.6), lit(0.1), lit(0.2)), "part": G.part(a, lit(1), lit(3), lit(4)), "least part": G.part(a, lit(0), lit(0), lit(4), 0.002), "tall": G.tall(a), "tall enough": G.tall(G.box(lit(0.1), lit(0.2), lit(0.1), lit(0.05))),
        "meet": G.meet(a, b), "hull of some": G.hull_of_some(F.array(a, none, G.box(lit(0.5), lit(0.3), lit(0.1), lit(0.01)))), "edges": four(G.edges(a)), "thousandths": four(G.thousandths(a)),
        "measures": four(F.array(G.x1(a), G.y1(a), G.cx(a), G.cy(a))), "shares": four(F.array(G.iou(a, b), G.covered(a, b), G.iou(a, none), G.covered(a, a))),
        "valid": four(F.array(flag(G.valid(a, lit(1))), flag(G.valid(a, lit(0))), flag(G.valid(bad, lit(1))), flag(G.meet(a, none).isNotNull()))),
    }
    got = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("box")) for n, v in rows.items()])))
    return with_box(got, "xywh")


@page("block_id int, text string", [(1, "head"), (3, "cell")])
def idx_blocks_at(spark):
    """Blocks that a box meets; touching edges is not meeting."""
    from quillmap.operators import index as I

    blocks = spark.createDataFrame([("d", 1, k, (x, y, 0.2, 0.1), t) for k, x, y, t in ((1, 0.0, 0.0, "head"), (2, 0.0, 0.1, "body"), (3, 0.1, 0.05, "cell"))] + [("d", 2, 4, (0.0, 0.0, 1.0, 1.0), "other")], f"doc_id string, page int, block_id int, box {BOX}, text string")
    return I.blocks_at(blocks, spark.createDataFrame([("d", 1, (0.15, 0.0, 0.05, 0.1))], f"doc_id string, page int, query_box {BOX}"))


@page("field string, rank int, rank_share double, margin double, many double, gap double, length double", [("a", 1, 1.0, 0.5, 1.098612, 0.0, 3.0), ("a", 2, 0.5, 1.0, 1.098612, 2.0, 1.0), ("b", 1, 1.0, 1.0, 0.693147, 0.0, 2.0)])
def ctx_features(spark):
    from quillmap.operators import context as X

    rows = [("a", 1, 0.5, 1, 1, "one"), ("a", 2, None, 3, 1, "x"), ("b", 1, None, 2, None, "zz")]
    r = spark.createDataFrame([("d", f, k, m, p, h, t, 1.0, (0.1, 0.2, 0.1, 0.01)) for f, k, m, p, h, t in rows], f"doc_id string, field string, rank int, margin double, page int, page_hint int, matched_text string, similarity double, box {BOX}")
    got = X.features(r)
    return got.select("field", "rank", F.col("f_rank").alias("rank_share"), F.col("f_margin").alias("margin"), F.round("f_count", 6).alias("many"), F.col("f_page_gap").alias("gap"), F.col("f_length").alias("length"))


@page("field string, page int, tier int, matched_text string", [("a", 2, 0, "first"), ("b", 1, 1, "second"), ("b", 3, 1, "far")])
def rank_tiers(spark):
    """Each field's first tier that has any candidate."""
    from quillmap.operators import ranking as R

    schema = f"doc_id string, field string, page int, line_index int, box {BOX}, matched_text string, similarity double, page_hint int"
    row = lambda f, p, t: ("d", f, p, 0, (0.1, 0.1, 0.1, 0.1), t, 1.0, 1)
    parts = [spark.createDataFrame(rows, schema) for rows in ([row("a", 2, "first")], [row("a", 1, "late"), row("b", 1, "second"), row("b", 3, "far")])]
    return R.tiers(parts)


@page("sha string, copies long", [("ba7816bf", 2), ("cb8379ac", 1)])
def src_by_content(spark):
    """Files told by their content: two equal ones and another."""
    from quillmap.sources.files import by_content

    files = spark.createDataFrame([("a", bytearray(b"abc")), ("b", bytearray(b"abc")), ("c", bytearray(b"def"))], "path string, content binary")
    return by_content(files).groupBy(F.substring("sha256", 1, 8).alias("sha")).agg(F.max("copy").cast("long").alias("copies"))


@page("line_index int, text string, x double, w double", [
    (0, "Example Road", 0.2, 0.16), (1, "Smith, John", 0.1, 0.16), (2, "12-34567", 0.3, 0.08), (3, "TARGET EXT", 0.1, 0.2), (4, "box 53", 0.12, 0.06), (5, "-", -1.0, -1.0),
])
def cand_located(spark):
    """A run of words that is a value as it is, without punctuation, by its digits, by its letters, and the part of
    a word that has it; and a line that has none."""
    from quillmap.operators import candidates as C, index as I

    t = tokens(spark, [(1, 0.1, [("at", 0.1), ("Example", 0.2), ("Road", 0.32)]), (1, 0.2, [("Smith,", 0.1), ("John", 0.22)]), (1, 0.3, [("No", 0.1), ("12-34567", 0.3)]), (1, 0.4, [("TARGET", 0.1), ("EXT", 0.27)]), (1, 0.5, [("pobox 53", 0.1)]), (1, 0.6, [("none", 0.1)])])
    wanted_ = spark.createDataFrame([(0, "example road"), (1, "smith john"), (2, "1234567"), (3, "targetext"), (4, "box 53"), (5, "other")], "line_index int, norm string")
    got = I.lines(t).select("line_index", "words").join(wanted_, "line_index").withColumn("at", C.locate(F.col("words"), F.col("norm")))
    none = F.lit(-1.0)
    return got.select("line_index", F.coalesce("at.text", F.lit("-")).alias("text"), F.coalesce(F.round("at.box.x", 6), none).alias("x"), F.coalesce(F.round("at.box.w", 6), none).alias("w"))


@page("field string, page int, drift int, similarity double", [("on", 1, 0, 0.9), ("beside", 2, 1, 0.95 * 0.9), ("beside_number", 2, 1, 0.9), ("any", 7, 2, 0.95 * 0.9), ("free", 3, 0, 0.9)])
def cand_drifted(spark):
    """On the hinted page, else beside it, else anywhere; dates off it lose a twentieth, numbers don't."""
    from quillmap.operators import candidates as C

    rows = [("on", 1, 1, "fuzzy"), ("on", 2, 1, "fuzzy"), ("beside", 2, 1, "normalized_date"), ("beside", 9, 1, "normalized_date"), ("beside_number", 2, 1, "normalized_number"), ("any", 7, 1, "fuzzy"), ("free", 3, None, "fuzzy")]
    c = spark.createDataFrame([("d", f, p, h, k, 0.9) for f, p, h, k in rows], "doc_id string, field string, page int, page_hint int, match_type string, similarity double")
    return C.drifted(c).withColumn("similarity", F.round("similarity", 6))


@page("field string, status string, matched_text string", [("evidence", "exact", "Example Road,"), ("stripped", "exact", "Express"), ("torn", "exact", "3 3 . 5"), ("number", "normalized", "$77.00"), ("when", "normalized", "2024-03-05"), ("lost", "not_found", "-")])
def resolve_tiers(spark):
    """One field for each way of being found: by its evidence, without its punctuation, recovered, as number and as date."""
    from quillmap.plans.resolve import Options, resolve

    t = tokens(spark, [(1, 0.1, [("12", 0.1), ("Example", 0.14), ("Road,", 0.23)]), (1, 0.2, [("Express", 0.1)]), (1, 0.3, [("Rate", 0.1), ("3", 0.2), ("3", 0.22), (".", 0.24), ("5", 0.26)]), (1, 0.4, [("$77.00", 0.1)]), (1, 0.5, [("March", 0.1), ("5,", 0.17), ("2024", 0.2)])])
    f = wanted(spark, ("evidence", "99", "int", "", 1), ("stripped", "(Express)", "str", "", 1), ("torn", "33.5", "float", "", 1), ("number", "77", "int", "", 1), ("when", "2024-03-05", "str", "", 1), ("lost", "zzz", "str", "", 1))
    f = f.withColumn("evidence_text", F.when(F.col("field") == "evidence", "Example Road,"))
    got = resolve(t, f, Options(strip=True))
    return got.withColumn("matched_text", F.coalesce("matched_text", F.lit("-")))
