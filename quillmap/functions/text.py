"""Text, number, date and boolean functions on columns.

All but those that say otherwise are built-in expressions and stay in generated
code. Columns may be given by name.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as ST

from quillmap.functions.algos import indel_ratio

C = Column | str

_FOLDED = ST.StructType([ST.StructField("text", ST.StringType()), ST.StructField("char_map", ST.ArrayType(ST.IntegerType())), ST.StructField("original", ST.StringType())])

# Glyphs that stand for other characters, or for none.
GLYPHS = {
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st",
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u201a": ",",
    "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u2010": "-", "\u2011": "-",
    "\u00ad": "", "\u00a0": " ", "\u200b": "", "\ufeff": "",
}

# Characters taken off the ends of a word to get its stem.
STEM_CHARS = " ,.:;-/_'\"()[]{}*&#$€£¥"

# Signs of money, and codes that stand beside amounts in any case.
MONEY_SIGNS, MONEY_CODES = "$€£¥₹", "USD|EUR|GBP|JPY|INR|CAD|AUD|CHF"

# Texts of checked and unchecked boxes, lower-cased; any run of o's is unchecked too.
CHECKED = ("[x]", "[*]", "[v]", "☒", "■", "✔", "✓", "x", "yes", "true", "checked", "lx.j", "[xj", "[x", "x]", "[")
UNCHECKED = ("[ ]", "☐", "no", "false", "unchecked", "d", "o", "q", "lj", "[]", "[_]", "]")

# Specks taken off the ends of a text that was read by machine.
SPECKS = " _|\t\r\n\x00\x01\x02\x03\x04\x05\x06\x07\x08\x0b\x0e\x0f`'\""


def _folded(ch: str) -> str:
    """What becomes of a character: glyphs, compatibility form, case."""
    return unicodedata.normalize("NFKC", GLYPHS.get(ch, ch)).casefold()


@cache
def _fold_tables() -> tuple[str, str, dict[str, str], str]:
    """Of all characters that lower case alone doesn't fold: those that become one other
    character or none (from, to), those that become several, and a pattern of the latter."""
    one, none, many = {}, [], {}
    for ch in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))):
        to = _folded(ch)
        if to == ch.lower() and ch != "\u03a3":
            continue
        if len(to) == 1:
            one[ch] = to
        elif to:
            many[ch] = to
        else:
            none.append(ch)
    return "".join(one) + "".join(none), "".join(one.values()), many, "[" + "".join(many) + "]"


@cache
def _digit_tables() -> tuple[str, str]:
    """Decimal digits of other scripts, and the digits they are."""
    found = [(ch, str(unicodedata.decimal(ch))) for ch in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if unicodedata.decimal(ch, None) is not None]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


def _c(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _plain(c: Column) -> Column:
    """Whether a text is ASCII throughout."""
    return F.octet_length(c) == F.char_length(c)


def fold(c: C) -> Column:
    """Character by character: glyphs, compatibility form (NFKC), case. ASCII texts are only lowered;
    the tables are for the others, and those of several characters for texts that have one. Cherokee
    letters fold to small ones here."""
    text = _c(c)
    source, target, many, pattern = _fold_tables()
    wide = F.from_json(F.lit(json.dumps(many)), "map<string,string>")  # folded to one literal
    apart = F.array_join(F.transform(F.split(text, ""), lambda ch: F.when(_plain(ch), ch).otherwise(F.coalesce(F.try_element_at(wide, ch), ch))), "")
    whole = F.when(text.rlike(pattern), apart).otherwise(text)
    return F.when(_plain(text), F.lower(text)).otherwise(F.lower(F.translate(whole, source, target)))


@F.pandas_udf(_FOLDED)
def fold_mapped(texts: pd.Series) -> pd.DataFrame:
    """Character by character: glyphs, NFKC, casefold; each character's source place (Arrow)."""
    out = []
    for t in texts:
        parts = [_folded(ch) for ch in t or ""]
        out.append(("".join(parts), [i for i, p in enumerate(parts) for _ in p], t))
    return pd.DataFrame(out, columns=["text", "char_map", "original"])


def original_span(folded: C, start: C, end: C) -> Column:
    """Struct (start, end) in the original of a span [start, end) of ``fold_mapped``; null outside it."""
    m = _c(folded)["char_map"]
    ok = (_c(start) >= 0) & (_c(end) > _c(start)) & (_c(end) <= F.size(m))
    return F.when(ok, F.struct(F.get(m, _c(start)).alias("start"), (F.get(m, _c(end) - 1) + 1).alias("end")))


def squash(c: C) -> Column:
    """Trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def stem(c: C) -> Column:
    """Without punctuation and signs at the ends."""
    return F.btrim(_c(c), F.lit(STEM_CHARS))


def money(c: C) -> Column:
    """Without signs of money, codes, separators of thousands and spaces; (x) as -x, unless a percentage."""
    t = F.trim(_c(c))
    bracketed = t.startswith("(") & t.endswith(")") & (F.length(t) > 1)
    inner = F.trim(F.substring(t, F.lit(2), F.length(t) - 2))
    body = F.translate(F.when(bracketed, inner).otherwise(t), MONEY_SIGNS, "")
    bare = F.translate(F.trim(F.when(body.rlike("[A-Za-z]{3}"), F.regexp_replace(body, rf"(?i)\b(?:{MONEY_CODES})\b", "")).otherwise(body)), ", ", "")
    minus = bracketed & ~inner.endswith("%") & ~inner.startswith("-") & ~bare.startswith("-")
    return F.when(minus, F.concat(F.lit("-"), bare)).otherwise(bare)


def repair_digits(c: C) -> Column:
    """Letters that stand for digits: O and l always, § and B beside a digit."""
    t = F.translate(_c(c), "OolI", "0011")
    return F.when(t.rlike(r"\d"), F.translate(t, "§B", "58")).otherwise(t)


def number(c: C) -> Column:
    """The number that a text is, after ``money`` and, if need be, ``repair_digits``; else null.
    Digits of any script count, and an underscore between digits is none. Words
    for infinity and the like are no numbers."""
    some = r"\d+(?:_\d+)*"
    shape = rf"^[+-]?(?:{some}\.?(?:{some})?|\.{some})(?:[eE][+-]?{some})?$"
    source, target = _digit_tables()
    ascii_ = lambda t: F.when(_plain(t), t).otherwise(F.translate(t, source, target))
    bare = let(let(_c(c), ascii_), lambda t: F.regexp_replace(F.trim(F.regexp_replace(money(t), "^[~≈]", "")), r"[%'\"]+$", ""))
    cast = lambda t: F.when(t.rlike(shape), F.translate(t, "_", "").try_cast("double"))
    whole = let(bare, lambda t: F.coalesce(cast(t), let(repair_digits(t), cast)))
    # most numbers and dates of a page are told by one pattern each, without the steps above, which come to the same
    return F.when(_c(c).rlike(r"^\$?[0-9][0-9,]*(?:\.[0-9]*)?$"), F.translate(_c(c), "$,", "").try_cast("double")).when(~_c(c).rlike(r"^(?:#[0-9]+|[0-9]+[-/][0-9/-]*)$"), whole)


def number_key(c: C) -> Column:
    """Millionths of a number as a long, an exact join key; null where it has no room."""
    v = _c(c) * 1e6
    return F.when(F.abs(v) < 9e18, F.round(v).cast("long"))


def same_number(a: C, b: C) -> Column:
    """Equal within a millionth, relative or absolute."""
    a, b = _c(a), _c(b)
    return F.abs(a - b) <= F.greatest(F.lit(1e-6) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-6))


def near_number(a: C, b: C) -> Column:
    """Nearly equal, or equal as a fraction and a percentage."""
    a, b = _c(a), _c(b)
    return (F.abs(a - b) <= F.greatest(F.lit(1e-6), 1e-5 * F.abs(b))) | (F.abs(a * 100 - b) <= 1e-3) | (F.abs(a - b * 100) <= 1e-3)


def clear_specks(c: C) -> Column:
    """Without specks at the ends; runs of underscores as a space."""
    return F.trim(F.regexp_replace(F.btrim(_c(c), F.lit(SPECKS)), "__+", " "))


def checkbox(c: C) -> Column:
    """True, false or null for the text of a box."""
    t = F.lower(F.trim(_c(c)))
    return F.when(t.isin(*CHECKED), True).when(t.isin(*UNCHECKED) | t.rlike("^o+$"), False)


# Words that no date has; years, months and numeric dates as patterns.
_NO_DATE = r"(?i)\b(?:week|table|item|step|rule|section|volume|page|no|number|district|well|acres)\b"
_YEAR = r"\b(?:19\d\d|20\d\d)\b"
_MONTH = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b"
_DAY_MONTH = r"\b\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\b"
_YEAR_MONTH = r"\b\d{4}[-/]\d{1,2}\b"
_FULL_NUMERIC = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"


def plausible_date(c: C) -> Column:
    """Whether a text looks like a calendar date: a month's name with a digit, a full numeric date, or
    a year beside a day and month or behind a month's number; and no word that dates don't have."""
    t = _c(c)
    return t.rlike(r"\d") & (t.rlike(_MONTH) | t.rlike(_FULL_NUMERIC) | (t.rlike(_YEAR) & (t.rlike(_DAY_MONTH) | t.rlike(_YEAR_MONTH)))) & ~t.rlike(_NO_DATE)


#: Fixed formats of ``date`` by shape, tried in turn; months come first where both can be.
DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ("yyyy-M-d",)), (r"^\d{4}/\d{1,2}/\d{1,2}$", ("yyyy/M/d",)),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ("M/d/yyyy", "d/M/yyyy")), (r"^\d{1,2}-\d{1,2}-\d{4}$", ("M-d-yyyy", "d-M-yyyy")),
)
_NAMED = (r"^([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$", r"^(\d{1,2})(?:st|nd|rd|th)? ([A-Za-z]{3,9})\.?,? (\d{4})$")


def date(c: C) -> Column:
    """The date of a text in one of the fixed forms, years 1900 to 2100; else null."""

    def parse(text: Column) -> Column:
        # years of two digits turn at 50
        short = r"^(\d{1,2}[/-]\d{1,2}[/-])(\d{2})$"
        t = F.when(text.rlike(short), F.regexp_replace(F.regexp_replace(text, r"([/-])([0-4]\d)$", "$120$2"), r"([/-])([5-9]\d)$", "$119$2")).otherwise(text)
        out = F.lit(None).cast("date")
        for shape, formats in reversed(DATE_SHAPES):
            out = F.when(t.rlike(shape), F.coalesce(*[F.try_to_date(t, f) for f in formats])).otherwise(out)
        month = lambda k, p: F.initcap(F.substring(F.regexp_extract(t, p, k), 1, 3))
        part = lambda k, p: F.regexp_extract(t, p, k)
        for p, (d, m) in zip(_NAMED, ((2, 1), (1, 2))):
            out = F.when(t.rlike(p) & t.rlike(_MONTH), F.try_to_date(F.concat_ws(" ", part(d, p), month(m, p), part(3, p)), "d MMM yyyy")).otherwise(out)
        return F.when(t.rlike(r"\d") & ~t.rlike(_NO_DATE), out)

    # what has neither the numbers of a date alone nor a month's name is none, whatever is cleared away
    near = r"^[^0-9A-Za-z]*\d{1,4}[-/]\d{1,2}[-/]\d{1,4}[^0-9A-Za-z]*$|(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    return F.when(_c(c).rlike(near), let(let(squash(clear_specks(c)), parse), lambda d: F.when(F.year(d).between(1900, 2100), d)))


@F.pandas_udf(ST.DateType())
def date_fuzzy(texts: pd.Series) -> pd.Series:
    """A date anywhere in a text, by dateutil (Arrow); apply behind ``plausible_date``."""
    from dateutil import parser

    def one(t: str | None):
        try:
            d = parser.parse(t, fuzzy=True).date() if t else None
        except (ValueError, OverflowError, TypeError):
            return None
        return d if d and 1900 <= d.year <= 2100 else None

    return texts.map(one)


def date_flexible(c: C) -> Column:
    """Dates as in statements: ISO, m/d/y, d-m-y, month names; two-digit years turn at 50."""
    t = F.trim(_c(c))
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    whole = lambda x: x.try_cast("int")
    long_year = lambda y: F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
    month = lambda x: F.ceil(F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(F.lower(x), 1, 3)) / F.lit(3)).cast("int")
    iso, us, eu = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$", r"^(\d{1,2})-(\d{1,2})-(\d{2,4})$"
    mdy, dmy = r"^([A-Za-z]{3,})\.?\s+(\d{1,2}),?\s+(\d{4})$", r"^(\d{1,2})\s+([A-Za-z]{3,})\.?\s+(\d{4})$"
    make = lambda y, m, d: F.try_make_date(y, m, d) if hasattr(F, "try_make_date") else F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    return (
        F.when(t.rlike(iso), make(whole(part(iso, 1)), whole(part(iso, 2)), whole(part(iso, 3))))
        .when(t.rlike(us), make(long_year(whole(part(us, 3))), whole(part(us, 1)), whole(part(us, 2))))
        .when(t.rlike(eu), make(long_year(whole(part(eu, 3))), whole(part(eu, 2)), whole(part(eu, 1))))
        .when(t.rlike(mdy), make(whole(part(mdy, 3)), month(part(mdy, 1)), whole(part(mdy, 2))))
        .when(t.rlike(dmy), make(whole(part(dmy, 3)), month(part(dmy, 2)), whole(part(dmy, 1))))
    )


# The ways in which a date is printed.
VARIANTS = (
    "yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "dd/MM/yyyy", "d/M/yyyy", "d-MM-yyyy", "dd-MM-yyyy", "MM-dd-yyyy", "M-d-yyyy", "yyyy/MM/dd",
    "yy-MM-dd", "MM/dd/yy", "M/d/yy", "dd/MM/yy", "d/M/yy", "MMM d, yyyy", "MMMM d, yyyy", "MMM. d, yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy",
)


def date_variants(d: C, original: C | None = None) -> Column:
    """All printed forms of a date (and the given text), sorted and distinct."""
    forms = [F.date_format(_c(d), f) for f in VARIANTS]
    forms.append(F.concat_ws(" ", F.date_format(_c(d), "d"), F.upper(F.date_format(_c(d), "MMM")), F.date_format(_c(d), "yyyy")))
    return F.array_sort(F.array_distinct(F.array(*forms, *([_c(original)] if original is not None else []))))


def for_match(c: C) -> Column:
    """Lower case; letters, digits, space and .,-$% only."""
    return squash(F.regexp_replace(F.lower(_c(c)), r"(?U)[^\w\s.,\-$%]", " "))


def value_key(c: C) -> Column:
    """Without signs of money, commas and spaces; (x) as -x."""
    t = F.regexp_replace(_c(c), r"[,$€£¥\s]", "")
    return F.regexp_replace(t, r"^\((.*)\)$", "-$1")


def word_key(c: C) -> Column:
    return stem(fold(c))


def word_hits(a: C, b: C) -> Column:
    """Equal, or one begins, ends or (from three characters) contains the other."""
    a, b = _c(a), _c(b)
    one = lambda x, y: (F.length(y) > 0) & (x.startswith(y) | x.endswith(y) | ((F.length(y) >= 3) & x.contains(y)))
    return (a == b) | one(a, b) | one(b, a)


def is_leader(c: C) -> Column:
    """Whether a token is a leader: an ellipsis, nothing but dots and ellipses, or these among dashes and
    underscores with two dots at least."""
    t = F.trim(_c(c))
    return t.rlike(r"^…$|^[.…]{2,}$") | (t.rlike(r"^[.\s…—\-_]{2,}$") & t.rlike(r"\..*\."))


# Letters and signs that are misread for digits, and the digits.
CONFUSED, MEANT = "OoIlLi|Ss$BGZz", "00111115558622"

# What machines read into the ends of words.
NOISE = "*“\"'’‘`_~|#.-:;,\\()[]{}<>=+/!?%$—–§•"


def noise_span(c: C) -> Column:
    """Struct (text, start, end): a token without noise and white space at its ends, and where that
    stands in it; for noise alone an empty text at the token's end."""
    t = _c(c)
    ends = F.lit(NOISE + " \t\r\n\u00a0")
    tail = F.ltrim(t, ends) if hasattr(F, "ltrim") else t
    core = F.btrim(t, ends)
    start = F.length(t) - F.length(tail)
    return F.struct(core.alias("text"), start.alias("start"), (start + F.length(core)).alias("end"))


def ocr_digits(c: C) -> Column:
    """Digits and dots that are left when letters taken for digits are digits again."""
    bare = F.regexp_replace(F.trim(_c(c)), "^[$€£¥§]+", "")
    return F.regexp_replace(F.translate(bare, CONFUSED + "·•", MEANT + ".."), r"[^0-9.]", "")


def skeleton(c: C) -> Column:
    """Consonants and digits."""
    return F.regexp_replace(F.upper(_c(c)), r"[^B-DF-HJ-NP-TV-Z0-9]", "")


@F.pandas_udf(ST.DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    """Normalised insertion and deletion similarity, 0 to 1 (Arrow)."""
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)])


def ocr_similarity(a: C, b: C, ratio=None) -> Column:
    """Similarity of texts that may be misread, by their letters and digits: 1 if equal, .98 if equal
    but for confusions, from .85 for containment of 80 % from three characters, else the edit
    similarity of the texts or, from six characters, of their skeletons. The last rung
    runs in Arrow, or is what ``ratio`` makes of two texts."""
    ratio = ratio or indel
    bare = lambda t: F.upper(F.regexp_replace(_c(t), "[^A-Za-z0-9]+", ""))
    x, y = bare(a), bare(b)
    dx, dy = F.translate(x, CONFUSED, MEANT), F.translate(y, CONFUSED, MEANT)
    short, long_ = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    cover = short / F.greatest(long_, F.lit(1))
    sx, sy = skeleton(x), skeleton(y)
    bones = F.when((short >= 6) & (sx != "") & (sy != ""), 0.92 * ratio(sx, sy)).otherwise(0.0)
    return (
        F.when(_c(a) == _c(b), 1.0).when(short == 0, 0.0).when(x == y, 1.0).when(dx == dy, 0.98)
        .when((x.contains(y) | y.contains(x)) & (short >= 3) & (cover >= 0.8), 0.85 + 0.15 * cover)
        .otherwise(F.greatest(ratio(dx, dy), bones))
    )


# Parts of a field's name that tell its type, and values that are booleans.
BOOLEAN_NAMES = ("_box", "checkbox", "is_", "has_", "flag", "_yes", "_no")
DATE_NAMES = ("date", "time", "day", "month", "year", "dob", "period")
CURRENCY_NAMES = ("price", "amount", "total", "subtotal", "tax", "fee", "balance", "cost")
IDENTIFIER_NAMES = ("id", "ssn", "number", "no", "code", "ein", "zip", "phone")
BOOLEAN_VALUES = ("true", "false", "yes", "no", "0", "1")


def field_type(name: C, kind: C, value: C, as_number: C | None = None, as_date: C | None = None) -> Column:
    """Type of a field from the kind of its JSON value, its name and the value; its number and
    date may be given. A name alone makes no date, currency or boolean: the value must be one."""
    n, v = F.lower(_c(name)), F.coalesce(F.trim(_c(value)), F.lit(""))
    as_number, as_date = number(value) if as_number is None else _c(as_number), date(value) if as_date is None else _c(as_date)
    named = lambda parts: n.rlike("|".join(parts))
    return (
        F.when(_c(kind) == "bool", "boolean").when(_c(kind).isin("int", "float"), "numeric")
        .when(named(BOOLEAN_NAMES) & F.lower(v).isin(*BOOLEAN_VALUES), "boolean")
        .when(named(DATE_NAMES) & as_date.isNotNull(), "date")
        .when((v.rlike("[$€£¥]") | named(CURRENCY_NAMES)) & as_number.isNotNull(), "currency")
        .when(as_number.isNotNull() & ~v.rlike("[a-zA-Z]"), "numeric")
        .when(named(IDENTIFIER_NAMES), "identifier").when(n.contains("[") & n.contains("]"), "table_cell").otherwise("string")
    )


def array_path(c: C) -> Column:
    """Struct (prefix, idx, suffix) at the last index of a path; null without one."""
    p = r"^(.*)\[(\d+)\](.*)$"
    part = lambda k: F.regexp_extract(_c(c), p, k)
    return F.when(_c(c).rlike(p), F.struct(part(1).alias("prefix"), part(2).cast("int").alias("idx"), part(3).alias("suffix")))


def likely_derived(name: C) -> Column:
    return F.lower(_c(name)).rlike("total|sum|subtotal|tax_rate|average|ratio|percent|count")


def line_has_value(line: C, value: C) -> Column:
    """Whether a line has a value: as it is, by letters and digits, or half of its words of three
    and more letters or digits, if it has two."""
    x, y = F.upper(_c(line)), F.upper(_c(value))
    ax, ay = (F.regexp_replace(t, "[^A-Z0-9]+", "") for t in (x, y))
    words = F.filter(F.split(y, "[^A-Z0-9]+"), lambda w: F.length(w) >= 3)
    hits = F.size(F.filter(words, lambda w: ax.contains(w)))
    return x.contains(y) | ((ay != "") & (ax.contains(ay) | ((F.size(words) >= 2) & (hits * 2 >= F.size(words)))))


def field_words(c: C) -> Column:
    """Words of a field's path: snake and camel case, dots and indexes taken apart."""
    apart = F.regexp_replace(F.regexp_replace(_c(c), r"([a-z0-9])([A-Z])", "$1 $2"), r"[\[\]._0-9-]+", " ")
    return F.filter(F.split(F.trim(F.lower(apart)), r"\s+"), lambda w: w != "")


def word_overlap(words: C, text: C) -> Column:
    """Share of some words that a text contains."""
    hits = F.size(F.filter(_c(words), lambda w: fold(text).contains(w)))
    return F.when(F.size(_c(words)) > 0, hits / F.size(_c(words))).otherwise(0.0)


def snake_key(c: C, words: int = 4) -> Column:
    """The first words in snake case, or ``field``."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    key = F.array_join(F.slice(parts, 1, words), "_")
    return F.when(key == "", "field").otherwise(key)


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
