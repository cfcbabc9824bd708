"""Toxicity by a convolutional text classifier.

A text is the sequence of its lowered words. Two hashes of a word name a row in
each of two tables, so that words that meet in one still differ in the other, and a hash of its
beginning a row in a third, so that a word of no training text can be like one that is. The
three rows together are its embedding. Filters one, two and three words wide slide over
the whole text; the largest answer of each filter anywhere in it goes to one
logistic unit. So a text is judged by its worst passages, however long it is.

Everything is trained by stochastic gradient descent in numpy (Adagrad) on a bounded
sample of labelled texts; of its passes the one that does best on a fold set aside is
kept. On that fold the score is calibrated to be a probability at the labels' natural
frequency, and each language gets the threshold from which its scores are
precise enough. A language is looked at for its threshold alone, never for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quillmap.llm.langid import letters

BITS, DIMS, TABLES = 17, 8, 3
#: Bytes of a word's beginning.
STEM = 6
WIDTHS, FILTERS = (1, 2, 3), 8
#: Words at both ends of a text that stand for nothing, so that every filter fits in.
PAD = max(WIDTHS) - 1
#: Bytes of text whose words are looked at in one go. A longer word counts as its pieces.
SLICE = 1 << 18
#: Where no language has a threshold of its own.
THRESHOLD = 0.7

_BASE, _MIXES = 0x100000001B3, (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _powers(base: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, one for each byte of a slice."""
    steps = np.full(SLICE, base % (1 << 64), np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of each word of at most ``SLICE`` bytes and of its beginning, modulo 2**64, from running sums over the bytes."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], b != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _UP[: len(b)], dtype=np.uint64)))
    return (sums[ends] - sums[starts]) * _DOWN[starts], (sums[np.minimum(ends, starts + STEM)] - sums[starts]) * _DOWN[starts]


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of each word, (words, tables), slice by slice, padded at the ends; bucket 0 is the padding's."""
    raw, at = letters(text), 0
    pad = np.zeros((PAD, TABLES), np.int32)
    yield pad
    while at < len(raw):
        stop = at + SLICE
        if stop < len(raw):
            stop = raw.rfind(b" ", at + 1, stop) + 1 or stop
        word, stem = hashes(raw[at:stop])
        yield np.stack([np.maximum((h * m) >> np.uint64(64 - BITS), np.uint64(1)).astype(np.int32) for h, m in ((word, _MIXES[0]), (word, _MIXES[1]), (stem, _MIXES[0]))], axis=1)
        at = stop
    yield pad


@dataclass
class Net:
    """Tables of parts of embeddings, filters (width, dims, filters) for each width, their biases, the last unit."""

    tables: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    last: float

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Net:
        # small rows: of words that no training text has the largest answer must not count
        tables = rng.normal(0, 0.02, (TABLES, 1 << BITS, DIMS)).astype(np.float32)
        tables[:, 0] = 0
        filters = [rng.normal(0, (2 / (w * TABLES * DIMS)) ** 0.5, (w, TABLES * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(tables, filters, np.zeros(n, np.float32), rng.normal(0, n**-0.5, n).astype(np.float32), 0.0)

    def copy(self) -> Net:
        return Net(self.tables.copy(), [f.copy() for f in self.filters], self.bias.copy(), self.out.copy(), self.last)

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([table[ids[..., t]] for t, table in enumerate(self.tables)], axis=-1)

    def answers(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest answer of each filter over some words, and the first place where it is given."""
        x = self.embedded(ids)
        top, place = [], []
        for w, f in zip(WIDTHS, self.filters):
            n = len(x) - w + 1
            z = x[:n] @ f[0]
            for k in range(1, w):
                z += x[k : n + k] @ f[k]
            at = z.argmax(axis=0)
            place.append(at)
            top.append(z[at, np.arange(FILTERS)])
        return np.concatenate(top), np.concatenate(place)

    def logit(self, parts: Iterator[np.ndarray]) -> float:
        """Of a whole text; windows go on from part to part."""
        top, before = np.full(len(self.bias), -np.inf, np.float32), np.zeros((0, TABLES), np.int32)
        for ids in parts:
            ids = np.concatenate((before, ids))
            if len(ids) > PAD:
                top = np.maximum(top, self.answers(ids)[0])
            before = ids[max(len(ids) - PAD, 0) :]
        return float(np.maximum(top + self.bias, 0) @ self.out + self.last)


@dataclass
class Adagrad:
    """Steps that shrink with the squared gradients so far, for the net's arrays and rows of its tables."""

    rate: float
    net: Net
    seen: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        net = self.net
        self.seen = {"tables": np.full(net.tables.shape[:2], 1e-3, np.float32), "bias": np.full(net.bias.shape, 1e-3, np.float32), "out": np.full(net.out.shape, 1e-3, np.float32), "last": 1e-3}
        self.seen |= {w: np.full(f.shape, 1e-3, np.float32) for w, f in zip(WIDTHS, net.filters)}

    def learn(self, ids: np.ndarray, label: int) -> None:
        """One step on one text."""
        net, rate = self.net, self.rate
        top, place = net.answers(ids)
        a = np.maximum(top + net.bias, 0)
        wrong = _sigmoid(float(a @ net.out + net.last)) - label
        back = wrong * net.out * (a > 0)
        live = np.flatnonzero(back)
        rows, steps = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, net.filters)):
            which = live[live // FILTERS == k] % FILTERS
            if len(which):
                windows = ids[place[k * FILTERS + which][:, None] + np.arange(w)[None, :]]
                x = net.embedded(windows)
                g = back[k * FILTERS + which]
                rows.append(windows.reshape(-1, TABLES))
                steps.append((f[:, :, which].transpose(2, 0, 1) * g[:, None, None]).reshape(-1, TABLES * DIMS))
                grad = (x * g[:, None, None]).transpose(1, 2, 0)
                self.seen[w][:, :, which] += grad**2
                f[:, :, which] -= rate * grad / np.sqrt(self.seen[w][:, :, which])
        for name, grad in (("out", wrong * a), ("bias", back)):
            self.seen[name] += grad**2
            getattr(net, name)[:] -= rate * grad / np.sqrt(self.seen[name])
        self.seen["last"] += wrong**2
        net.last -= rate * wrong / self.seen["last"] ** 0.5
        if rows:
            at, grad = np.concatenate(rows), np.concatenate(steps)
            for t in range(TABLES):
                own, part = at[:, t], grad[:, t * DIMS : (t + 1) * DIMS]
                own, part = own[own > 0], part[own > 0]
                which, inverse = np.unique(own, return_inverse=True)
                total = np.zeros((len(which), DIMS), np.float32)
                np.add.at(total, inverse, part)
                self.seen["tables"][t, which] += (total**2).mean(axis=1)
                net.tables[t, which] -= rate * total / np.sqrt(self.seen["tables"][t, which])[:, None]


def _sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())


def calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * z + shift) likeliest (Newton's method, a little held back)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = np.array([(weight * (p - y) * z).sum() + 1e-2 * (a - 1), (weight * (p - y)).sum() + 1e-3 * b])
        h = weight * p * (1 - p)
        m = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float) -> float:
    """The middle of the widest step down from the least score from which the weighted precision
    holds; ``THRESHOLD`` where it holds nowhere."""
    order = np.argsort(-score, kind="stable")
    s, hit, all_ = score[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    good = ends[hit[ends] >= precision * all_[ends]]
    if not len(good) or not hit[good[-1]]:
        return THRESHOLD
    below = s[good[-1] + 1] if good[-1] + 1 < len(s) else 0.0
    return float((s[good[-1]] + below) / 2)


@dataclass
class Model:
    net: Net | None
    slope: float
    shift: float
    thresholds: dict[str | None, float]

    def score(self, text: str | None) -> float:
        return 0.0 if self.net is None else _sigmoid(self.slope * self.net.logit(buckets(text)) + self.shift)


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_chars: int) -> tuple[list[tuple], dict[int, int]]:
    """(hash, label, language, buckets) of the training texts, and the number of distinct texts by label.

    A text with a label counts once, however many rows repeat it. Of each label
    ``sample_rows`` / 2 texts at most, those of least hash, are taken while they
    have ``sample_chars`` / 2 characters together.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("label"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    small = texts.select("doc_id", F.xxhash64("text").alias("hash"), F.length("text").alias("size")).join(known, "doc_id")
    distinct = small.groupBy("hash", "label").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"))
    there = {r.label: r.n for r in distinct.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked: list[tuple] = []
    for label in (0, 1):
        room = sample_chars // 2
        for r in distinct.where(F.col("label") == label).orderBy("hash").limit(sample_rows // 2).collect():
            if r.size <= room:
                room -= r.size
                picked.append((r.doc_id, r.hash, label))
    few = F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long, hash long, label int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.concatenate(list(buckets(x.as_py()))).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("label"), batch.column("lang"), pa.array(found, pa.binary())], ["hash", "label", "lang", "ids"])

    chosen = texts.join(few, "doc_id").where(F.xxhash64("text") == F.col("hash"))
    one = chosen.groupBy("hash", "label").agg(F.min(F.struct("lang", "text")).alias("x")).select("hash", "label", "x.lang", "x.text")
    got = one.mapInArrow(run, "hash long, label int, lang string, ids binary").collect()
    return sorted((r.hash, r.label, r.lang, np.frombuffer(bytes(r.ids), np.int32).reshape(-1, TABLES)) for r in got), there


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, sample_chars: int = 24_000_000, passes: int = 8, rate: float = 0.05, precision: float = 0.9, least: int = 20) -> Model:
    """Learn from ``labels`` (doc_id, toxic 0/1), joined to ``docs`` (doc_id, text, lang) on doc_id.

    The sample is bounded by ``sample_rows`` and ``sample_chars`` (texts are taken whole or
    not at all). A language with ``least`` set-aside texts of each label gets the threshold from
    which ``precision`` of its set-aside texts are toxic; others, and null, get that of
    all. Labels that are null or neither 0 nor 1 are ignored; contradicting labels of
    a text both count. Without labels of both kinds every score is 0.
    """
    rows, there = sample(docs, labels, sample_rows, sample_chars)
    y = np.array([r[1] for r in rows], np.float64)
    if len(set(y)) < 2:
        return Model(None, 1.0, 0.0, {None: THRESHOLD})
    rng = np.random.default_rng(13)
    deal = rng.permutation(len(rows))
    aside, kept = (deal[: len(rows) // 5], deal[len(rows) // 5 :]) if len(rows) >= 20 else (deal, deal)
    best, worse, net = (np.inf, None), 0, Net.fresh(rng)
    teacher = Adagrad(rate, net)
    # a text of the sample stands for so many of its label
    weight = np.array([there[int(v)] / (y == v).sum() for v in y])
    for _ in range(passes):
        for i in rng.permutation(kept):
            teacher.learn(rows[i][3], int(y[i]))
        z = np.array([net.logit(iter((rows[i][3],))) for i in aside])
        loss = _loss(z, y[aside], np.ones(len(aside)))
        best, worse = ((loss, net.copy()), 0) if loss < best[0] else (best, worse + 1)
        if worse == 2:
            break
    net = best[1] or net
    z = np.array([net.logit(iter((rows[i][3],))) for i in aside])
    slope, shift = calibrated(z, y[aside], weight[aside])
    score, langs = np.array([_sigmoid(slope * v + shift) for v in z]), [rows[i][2] for i in aside]
    thresholds = {None: threshold(score, y[aside], weight[aside], precision)}
    for lang in sorted({l for l in langs if l is not None}):
        own = np.array([l == lang for l in langs])
        if min(y[aside][own].sum(), (1 - y[aside][own]).sum()) >= least:
            thresholds[lang] = threshold(score[own], y[aside][own], weight[aside][own], precision)
    return Model(net, slope, shift, thresholds)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text, anything) with toxicity_score (0 to 1), toxicity_threshold and toxic, row by row.

    The threshold is that of the row's ``lang``, where there is such a column, and toxic is
    whether the score reaches it; the score is the text's alone. Null text counts as
    empty; empty texts, and texts without a letter, are scored like any other: as one without
    words. Repeated rows are scored one by one, and an empty table gives an empty table;
    other columns go through unchanged but for those named like the added ones, which are replaced.
    """
    added = ("toxicity_score", "toxicity_threshold", "toxic")
    held = docs.sparkSession.sparkContext.broadcast(model)
    clean = docs.drop(*added)
    kinds = (T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*clean.schema.fields, *(T.StructField(n, k) for n, k in zip(added, kinds))])
    names, has_lang = schema.fieldNames(), "lang" in clean.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            score = [m.score(x.as_py()) for x in batch.column("text")]
            langs = [x.as_py() for x in batch.column("lang")] if has_lang else [None] * len(score)
            limit = [m.thresholds.get(None if l is None else str(l), m.thresholds[None]) for l in langs]
            new = [pa.array(score, pa.float64()), pa.array(limit, pa.float64()), pa.array([s >= t for s, t in zip(score, limit)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)

    return clean.mapInArrow(run, schema)
