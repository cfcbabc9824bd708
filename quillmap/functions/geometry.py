"""Boxes on pages: structs (x, y, w, h) in [0, 1], origin at the top left, and a page beside them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

C = Column | str


def _b(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def box(x: C, y: C, w: C, h: C) -> Column:
    return F.struct(_b(x).cast("double").alias("x"), _b(y).cast("double").alias("y"), _b(w).cast("double").alias("w"), _b(h).cast("double").alias("h"))


def x1(b: C) -> Column:
    return _b(b)["x"] + _b(b)["w"]


def y1(b: C) -> Column:
    return _b(b)["y"] + _b(b)["h"]


def cx(b: C) -> Column:
    return _b(b)["x"] + _b(b)["w"] / 2


def cy(b: C) -> Column:
    return _b(b)["y"] + _b(b)["h"] / 2


def area(b: C) -> Column:
    return _b(b)["w"] * _b(b)["h"]


def valid(b: C, page: C) -> Column:
    """No negative side, page from 1."""
    return (_b(b)["w"] >= 0) & (_b(b)["h"] >= 0) & (_b(page) >= 1)


def from_edges(x0: C, y0: C, x1_: C, y1_: C) -> Column:
    """From two opposite corners in any order."""
    a, b, c, d = _b(x0), _b(y0), _b(x1_), _b(y1_)
    return box(F.least(a, c), F.least(b, d), F.abs(c - a), F.abs(d - b))


def edges(b: C) -> Column:
    """[x0, y0, x1, y1], six decimals."""
    return F.array(*[F.round(v, 6) for v in (_b(b)["x"], _b(b)["y"], x1(b), y1(b))])


def thousandths(b: C) -> Column:
    """[top, left, bottom, right] in thousandths."""
    return F.array(*[F.bround(v * 1000).cast("int") for v in (_b(b)["y"], _b(b)["x"], y1(b), x1(b))])


def from_points(x0: C, y0: C, x1_: C, y1_: C, width: C, height: C, bottom_left: bool = False) -> Column:
    """From points on a page of some size, clamped to the page; null for a page without size."""
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    w, h = _b(width), _b(height)
    a, c = clamp(_b(x0) / w), clamp(_b(x1_) / w)
    b, d = clamp(_b(y0) / h), clamp(_b(y1_) / h)
    b, d = (1 - b, 1 - d) if bottom_left else (b, d)
    return F.when((w > 0) & (h > 0), from_edges(a, b, c, d))


def meet(a: C, b: C) -> Column:
    """The common part; null if there is none."""
    x0, y0 = F.greatest(_b(a)["x"], _b(b)["x"]), F.greatest(_b(a)["y"], _b(b)["y"])
    x, y = F.least(x1(a), x1(b)), F.least(y1(a), y1(b))
    return F.when((x > x0) & (y > y0), box(x0, y0, x - x0, y - y0))


def meet_area(a: C, b: C) -> Column:
    w = F.least(x1(a), x1(b)) - F.greatest(_b(a)["x"], _b(b)["x"])
    h = F.least(y1(a), y1(b)) - F.greatest(_b(a)["y"], _b(b)["y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: C, b: C) -> Column:
    """Common part over union; 0 for boxes without area."""
    common = meet_area(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, F.least(F.lit(1.0), common / union)).otherwise(0.0)


def hull_of_some(boxes: C, least: float = 0.001) -> Column:
    """The hull of those boxes of an array that have an area, six decimals, no side under ``least``; null
    where there is none."""
    some = F.filter(_b(boxes), lambda b: (b["w"] > 0) & (b["h"] > 0))
    h = hull_of(some)
    return F.when(F.size(some) > 0, box(F.round(h["x"], 6), F.round(h["y"], 6), F.round(F.greatest(h["w"], F.lit(least)), 6), F.round(F.greatest(h["h"], F.lit(least)), 6)))


def covered(a: C, b: C) -> Column:
    """Share of b's area that a covers."""
    return F.when(area(b) > 0, meet_area(a, b) / area(b)).otherwise(0.0)


def hull(b: C) -> Column:
    """Aggregate: the smallest box around those of a group."""
    x, y = F.min(_b(b)["x"]), F.min(_b(b)["y"])
    return box(x, y, F.max(x1(b)) - x, F.max(y1(b)) - y)


def hull_of(boxes: C) -> Column:
    """The smallest box around those of an array; null for an empty one."""
    a = _b(boxes)
    low = lambda k: F.array_min(F.transform(a, lambda b: b[k]))
    x, y = low("x"), low("y")
    return F.when(F.size(a) > 0, box(x, y, F.array_max(F.transform(a, x1)) - x, F.array_max(F.transform(a, y1)) - y))


def part(b: C, start: C, end: C, length: C, least: float = 0.001) -> Column:
    """The part of a box that characters start to end of its text take."""
    step = _b(b)["w"] / F.greatest(_b(length), F.lit(1))
    return box(_b(b)["x"] + step * _b(start), _b(b)["y"], F.greatest(step * (_b(end) - _b(start)), F.lit(least)), _b(b)["h"])


def tall(b: C, height: float = 0.018) -> Column:
    """Padded evenly to a line's height, if lower."""
    pad = F.greatest(F.lit(0.0), (height - _b(b)["h"]) / 2)
    return box(_b(b)["x"], _b(b)["y"] - pad, _b(b)["w"], _b(b)["h"] + 2 * pad)


# Paddings (left, right, top, bottom) that tables' cells have around their text.
PADDINGS = (
    (0.005, 0.005, 0.002, 0.002), (0.010, 0.010, 0.003, 0.003), (0.015, 0.015, 0.004, 0.004), (0.020, 0.020, 0.005, 0.005), (0.030, 0.030, 0.005, 0.005),
    (0.040, 0.040, 0.005, 0.005), (0.020, 0.005, 0.003, 0.003), (0.035, 0.005, 0.003, 0.003), (0.050, 0.008, 0.004, 0.004), (0.065, 0.008, 0.004, 0.004),
    (0.005, 0.025, 0.003, 0.003), (0.008, 0.040, 0.004, 0.004), (0.008, 0.008, 0.008, 0.008), (0.012, 0.012, 0.012, 0.012), (0.015, 0.015, 0.018, 0.018),
)

# Pitches of rows, rows to go, and heights of cells.
PITCHES = (0.02756, 0.02340, 0.02920, 0.02030, 0.01520, 0.01250, 0.00980)
STEPS = (-2, -1, 1, 2)
HEIGHTS = (0.00943, 0.01273, 0.01523, 0.02031)


def _rounded(b: Column, places: int = 4) -> Column:
    return box(*[F.round(b[k], places) for k in "xywh"])


def padded(b: C) -> Column:
    """Array of the cells a text may stand in, one for each padding: on the page, up to three times
    as wide and 2.5 times as high as the text."""
    x, y, w, h = (_b(b)[k] for k in "xywh")
    most_w, most_h = 3 * F.greatest(w, F.lit(0.01)), 2.5 * F.greatest(h, F.lit(0.01))

    def cell(left: float, right: float, top: float, bottom: float) -> Column:
        x0, y0 = F.greatest(F.lit(0.0), x - left), F.greatest(F.lit(0.0), y - top)
        return box(x0, y0, F.least(1 - x0, most_w, w + left + right), F.least(1 - y0, most_h, h + top + bottom))

    return F.array(*[_rounded(cell(*p)) for p in PADDINGS])


def shifted_rows(b: C) -> Column:
    """Array of the box one or two rows up or down for each pitch, in its own height and in the
    usual ones that differ from it; what leaves the page is left out."""
    at = _b(b)
    tops = F.array(*[at["y"] + k * p for p in PITCHES for k in STEPS])
    tops = F.filter(tops, lambda t: (t >= 0) & (t <= 0.99))
    tall_ = F.concat(F.array(at["h"]), F.filter(F.array(*map(F.lit, HEIGHTS)), lambda h: F.abs(h - at["h"]) > 0.001))
    cells = F.flatten(F.transform(tops, lambda t: F.transform(tall_, lambda h: _rounded(box(at["x"], t, at["w"], h)))))
    return F.filter(cells, lambda c: c["y"] + c["h"] <= 1.0)
