"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic in Spark. The table of these
sums, a cell for each combination that occurs, is raked: its margins are scaled
in turn to the target shares of sources, languages and topics until they hold.
No cell can give more tokens than it has. What a cell can't give the others of
its margin take over, and what a whole margin's label can't give the other labels
do; ``margins`` tells what was asked, what can be had and what came out. The
raked cell over the cell's tokens is the probability with which each of its
documents is kept; the draw is a hash of the id, so a rerun keeps the same.

The topics are learned: centres of hashed, weighted word counts, less the mean of
the text's language, by k-means over all documents. Every document's topic is
told from its whole text. Texts are split into words twice: once for the counts, of which topics are
learned and cells summed, and once for the documents that are returned.

The driver rakes the cells in numpy, at some 100 bytes a cell: labels of collections and their
combinations are few beside documents, and ``MOST_CELLS`` of them fit; more are an error.
Up to ``BROADCAST_CELLS`` cells are broadcast to the documents, others are joined by a shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillmap.llm.shared import cut, fresh_dir

TOPICS, BITS = 8, 11
MOST_CELLS, BROADCAST_CELLS = 2_000_000, 20_000
MARGINS = ("source", "lang", "topic")

_ADDED = "__source string, __lang string, __topic string, __tokens long"


def word_counts(words: list[bytes]) -> np.ndarray:
    """Hashed counts of the words of three bytes and more."""
    if long_ := [w for w in words if len(w) >= 3]:
        heads = np.frombuffer(b"".join((w * 8)[:8] for w in long_), "<u8")
        sizes = np.fromiter(map(len, long_), np.uint64, len(long_))
        code = (heads ^ (sizes << np.uint64(56))) * np.uint64(0x9E3779B97F4A7C15)
        return np.bincount((code >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS).astype(np.float32)
    return np.zeros(1 << BITS, np.float32)


#: The bytes between words. Of a word of 0 to 8 bytes and more: what it has of eight bytes, and the factor that repeats it over them.
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_REPEAT = np.array([0] + [sum(1 << i for i in range(0, 64, 8 * k)) for k in range(1, 9)], np.uint64)


def text_counts(raw: bytes) -> tuple[np.ndarray, int]:
    """What ``word_counts`` tells of the words of a text in UTF-8, and how many words it has, without a list of them."""
    b = np.frombuffer(b"".join((b" ", raw.lower(), b"        ")), np.uint8)
    space = _SPACE[b]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    n, long_ = len(starts), sizes >= 3
    starts, sizes = starts[long_], sizes[long_]
    # eight bytes from every place
    heads = np.ndarray((len(b) - 7,), "<u8", b, strides=(1,))[starts]
    eight = np.minimum(sizes, 8)
    code = ((heads & _OWN[eight]) * _REPEAT[eight] ^ (sizes.astype(np.uint64) << np.uint64(56))) * np.uint64(0x9E3779B97F4A7C15)
    return np.bincount((code >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS).astype(np.float32), n


def _bytes(texts: pa.Array) -> Iterator[bytes]:
    """Texts in UTF-8, null as empty."""
    return (x.as_py() or b"" for x in texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary()))


@dataclass
class Topics:
    """idf, the mean vector of each language, and the centres."""

    idf: np.ndarray
    means: dict[str | None, np.ndarray]
    centres: np.ndarray

    def vector(self, counts: np.ndarray, lang: str | None) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        x = x / max(float(np.linalg.norm(x)), 1e-12)
        return x - self.means[lang if lang in self.means else None]

    def of(self, words: list[bytes], lang: str | None) -> int:
        """The nearest centre, the first of equals; -1 without a word that counts."""
        return self.of_counts(word_counts(words), lang)

    def of_counts(self, counts: np.ndarray, lang: str | None) -> int:
        if not counts.any() or not len(self.centres):
            return -1
        return int((self.centres @ self.vector(counts, lang)).argmax())


#: Sums of vectors are whole numbers of these, so that they come out the same in whatever order they are summed.
UNIT = 2.0**-32


def _joined(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a column of binaries holds, one row's after the other's, and how many each has."""
    ends = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.binary() else np.int64)[column.offset :][: len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // np.dtype(kind).itemsize


class _Counts:
    """The hashed counts of a batch of texts, one after the other: the text of each count (``row``), its place and itself."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.langs, self.n = batch.column("lang").to_pylist(), batch.num_rows
        at, sizes = _joined(batch.column("at"), np.uint16)
        self.at, self.counts = at.astype(np.int64), _joined(batch.column("counts"), np.float32)[0]
        self.row, self.starts = np.repeat(np.arange(self.n), sizes), np.cumsum(sizes) - sizes

    def units(self, idf: np.ndarray) -> np.ndarray:
        """The weighted counts, each text's scaled to length 1, in whole units."""
        x = np.log1p(self.counts) * idf[self.at]
        norm = np.sqrt(np.add.reduceat(x.astype(float) ** 2, self.starts))
        return np.rint(x / np.maximum(norm, 1e-12)[self.row] / UNIT)

    def by(self, group: np.ndarray, units: np.ndarray, groups: int) -> np.ndarray:
        """The sum of the units of each group of texts."""
        return np.bincount((group << BITS)[self.row] + self.at, units, groups << BITS).reshape(groups, -1)


def _summed(found: DataFrame, sums: Callable[[_Counts], Iterator[tuple[int, str | None, np.ndarray]]]) -> dict[tuple[int, str | None], np.ndarray]:
    """The sums over all texts of vectors of whole numbers that ``sums`` gives for each batch, by group and language: added up within
    a task, then between tasks by Spark, so that the driver gets one vector of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, str | None], np.ndarray] = {}
        for batch in filter(len, batches):
            for k, lang, vector in sums(_Counts(batch)):
                own[k, lang] = own.get((k, lang), 0) + vector.astype(np.int64)
        for (k, lang), vector in own.items():
            at = np.flatnonzero(vector)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(vector[at], pa.int64())], ["k", "lang", "at", "v"])

    out: dict[tuple[int, str | None], np.ndarray] = {}
    for k, lang, at, v in found.mapInArrow(run, "k int, lang string, at int, v long").groupBy("k", "lang", "at").agg(F.sum("v").alias("v")).collect():
        out.setdefault((k, lang), np.zeros(1 << BITS, np.int64))[at] = v
    return out


def label(x: object) -> str:
    """``=`` and a value; null is empty."""
    return "" if x is None else f"={x}"


_COUNTED = "source string, lang string, tokens long, at binary, counts binary"


def counted(docs: DataFrame) -> DataFrame:
    """What topics and cells need of ``docs`` (text, source, lang), written once: the label of the source, the language, the
    number of words and the counts of those of three bytes and more, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, source, lang in zip(_bytes(batch.column("text")), batch.column("source"), batch.column("lang")):
                c, n = text_counts(raw)
                at = np.flatnonzero(c)
                rows.append((label(source.as_py()), lang.as_py(), n, at.astype(np.uint16).tobytes(), c[at].tobytes()))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=schema.names), schema, preserve_index=False)

    schema = pa.schema([("source", pa.string()), ("lang", pa.string()), ("tokens", pa.int64()), ("at", pa.binary()), ("counts", pa.binary())])
    rows = docs.select(F.col("text").cast("string").alias("text"), "source", F.col("lang").cast("string").alias("lang"))
    spark, path = docs.sparkSession, fresh_dir(docs.sparkSession, "topics")
    rows.mapInArrow(run, _COUNTED).write.parquet(path)
    return spark.read.schema(_COUNTED).parquet(path)


def learn_topics(docs: DataFrame, topics: int = TOPICS, rounds: int = 12) -> Topics:
    """Topics of ``docs`` (doc_id, text, lang), of all their rows."""
    return learned(counted(docs.select("text", "lang", F.lit(None).cast("string").alias("source"))), topics, rounds)


def learned(rows: DataFrame, topics: int = TOPICS, rounds: int = 12) -> Topics:
    """Topics of ``counted`` rows, which are read for the weights of words, for the means of languages and in every round.
    The first centres are ``topics`` different texts, those of least hash."""
    found = rows.where("length(at) > 0").select("lang", "at", "counts")
    width = 1 << BITS
    one = np.ones(1, np.int64)

    def texts(counts: _Counts) -> Iterator[tuple[int, str | None, np.ndarray]]:
        yield 0, None, np.bincount(counts.at, minlength=width)
        yield 1, None, one * counts.n

    got = _summed(found, texts)
    n = int(got[1, None][0]) if got else 0
    idf = (np.log((1 + n) / (1 + got.get((0, None), np.zeros(width)))) + 1).astype(np.float32)
    if not n:
        return Topics(idf, {None: np.zeros(width, np.float32)}, np.zeros((0, width), np.float32))

    def of_languages(counts: _Counts) -> Iterator[tuple[int, str | None, np.ndarray]]:
        names = list(dict.fromkeys(counts.langs))
        lang = np.array([names.index(l) for l in counts.langs])
        for name, vector, m in zip(names, counts.by(lang, counts.units(idf), len(names)), np.bincount(lang)):
            yield 0, name, vector
            yield 1, name, one * m

    got = _summed(found, of_languages)
    mean = lambda total, m: (total * UNIT / m).astype(np.float32)
    sizes = {lang: int(v[0]) for (k, lang), v in got.items() if k}
    means: dict[str | None, np.ndarray] = {lang: mean(got[0, lang], m) for lang, m in sizes.items() if lang is not None}
    means[None] = mean(sum(got[0, lang].astype(float) for lang in sorted(sizes, key=str)), n)
    known = Topics(idf, means, np.zeros((0, width), np.float32))
    marked = found.withColumn("hash", F.xxhash64("at", "counts", "lang"))
    least = [r.hash for r in marked.select("hash").distinct().orderBy("hash").limit(topics).collect()]
    firsts = {r.hash: r for r in marked.where(F.col("hash").isin(least)).dropDuplicates(["hash"]).collect()}

    def first(r) -> np.ndarray:
        c = np.zeros(width, np.float32)
        c[np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.counts, np.float32)
        return known.vector(c, r.lang)

    centres = np.array([first(firsts[h]) for h in least], np.float32)

    def nearest(counts: _Counts) -> Iterator[tuple[int, str | None, np.ndarray]]:
        names = list(means)
        place = {l: i for i, l in enumerate(names)}
        units, lang = counts.units(idf), np.array([place.get(l, place[None]) for l in counts.langs])
        off = np.array([centres @ means[l] for l in names])
        x = (units * UNIT).astype(np.float32)
        score = np.stack([np.add.reduceat(centre[counts.at] * x, counts.starts) for centre in centres], axis=1) - off[lang]
        best = score.argmax(axis=1)
        total = counts.by(best, units, len(centres))
        for k in np.unique(best).tolist():
            yield k, None, total[k]
            # the language's mean is taken off as often as the centre has it
            for i, m in enumerate(np.bincount(lang[best == k], minlength=len(names)).tolist()):
                if m:
                    yield -1 - k, names[i], one * m

    for _ in range(rounds):
        got, before = _summed(found, nearest), centres
        centres = before.copy()
        for k in range(len(centres)):
            if (k, None) in got:
                held = {lang: int(v[0]) for (j, lang), v in got.items() if j == -1 - k}
                centres[k] = (got[k, None] * UNIT - sum(m * means[l].astype(float) for l, m in sorted(held.items(), key=str))) / sum(held.values())
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        if np.array_equal(centres, before):
            break
    return Topics(idf, means, centres)


def described(docs: DataFrame, topics: Topics) -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, with its id and text, the labels of its cell and its number of words.
    As a struct a row's columns clash with nothing; only what labels need goes through Python."""
    held = docs.sparkSession.sparkContext.broadcast(topics)
    kinds = pa.struct([("__source", pa.string()), ("__lang", pa.string()), ("__topic", pa.string()), ("__tokens", pa.int64())])

    @F.arrow_udf(f"struct<{_ADDED.replace(' ', ':').replace(',:', ',')}>")
    def told(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, sources, langs in batches:
            out: list[tuple] = []
            # text by text: the places of the words of a whole batch take many times its room
            for raw, source, lang in zip(_bytes(texts), sources, langs):
                (counts, n), lang = text_counts(raw), lang.as_py()
                out.append((label(source.as_py()), label(lang), label(held.value.of_counts(counts, lang)), n))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kinds)], fields=list(kinds))

    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("string").alias("id"), text.alias("text"), told(text, "source", lang).alias("told"))
    return rows.select("row", "id", "text", "told.*")


def cells_of(rows: DataFrame, topics: Topics) -> DataFrame:
    """The labels and the number of words that ``described`` tells, of ``counted`` rows."""
    held = rows.sparkSession.sparkContext.broadcast(topics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = batch.column("lang").to_pylist(), []
            for at, counts, lang in zip(batch.column("at"), batch.column("counts"), langs):
                c = np.zeros(1 << BITS, np.float32)
                c[np.frombuffer(at.as_py(), np.uint16)] = np.frombuffer(counts.as_py(), np.float32)
                found.append(label(held.value.of_counts(c, lang)))
            columns = [batch.column("source"), pa.array(map(label, langs), pa.string()), pa.array(found, pa.string()), batch.column("tokens")]
            yield pa.RecordBatch.from_arrays(columns, ["__source", "__lang", "__topic", "__tokens"])

    return rows.mapInArrow(run, _ADDED)


def targets(shares: np.ndarray, temper: float) -> np.ndarray:
    """Shares raised to ``temper``: 1 keeps them, 0 makes them equal."""
    t = np.where(shares > 0, shares, 1) ** temper * (shares > 0)
    return t / max(t.sum(), 1e-300)


def feasible(wanted: np.ndarray, there: np.ndarray, budget: float) -> np.ndarray:
    """Tokens for each label: its share of the budget, but no more than there are; what labels
    can't give the others take over in proportion."""
    out, open_ = np.zeros(len(there)), np.ones(len(there), bool)
    while open_.any():
        left = budget - out[~open_].sum()
        share = np.where(open_, wanted, 0.0)
        share = share / share.sum() if share.sum() > 0 else open_ / open_.sum()
        give = share * left
        over = open_ & (give > there)
        if not over.any():
            out[open_] = give[open_]
            break
        out[over] = there[over]
        open_ &= ~over
    return np.minimum(out, there)


def _fill(u: np.ndarray, cells: np.ndarray, key: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The factor f of each label with sum(min(cells, f * u)) = goal over its cells; u is positive."""
    full = cells / u  # the factor at which each cell is full
    order = np.lexsort((full, key))
    k, full, u, cells = key[order], full[order], u[order], cells[order]
    first, size = np.searchsorted(k, np.arange(len(goal))), np.bincount(k, minlength=len(goal))

    def before(x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(x)))
        return total[:-1] - total[first[k]]

    held, free = before(cells), np.bincount(k, u, len(goal))[k] - before(u)
    done = np.bincount(k, held + full * free < goal[k], len(goal)).astype(np.int64)
    at = np.minimum(first + np.minimum(done, np.maximum(size - 1, 0)), len(k) - 1)
    return np.where(done >= size, full[at], (goal - held[at]) / np.maximum(free[at], 1e-300))


def rake(cells: np.ndarray, keys: list[np.ndarray], goals: list[np.ndarray], rounds: int = 500) -> np.ndarray:
    """Cell weights, none over its cell, whose margins along each key are as near the goals as
    raking gets; a factor for each label, so that no cell is favoured. Warns where the rounds end
    before the weights stand still, as they can where the margins can't all hold."""
    u, change, least = cells.astype(float), 0.0, 1e-9 * max(cells.sum(), 1.0)
    for k, goal in zip(keys, goals):
        u[goal[k] <= 0] = 0.0
    live = np.flatnonzero(u > 0)
    w, some = u.copy(), cells[live]
    for _ in range(rounds if len(live) else 0):
        before = w
        for k, goal in zip(keys, goals):
            # where margins can't all hold, factors would grow without end
            u[live] = np.clip(u[live] * _fill(u[live], some, k[live], goal)[k[live]], some * 1e-9, some * 1e9)
        w = np.minimum(u, cells)
        change = np.abs(w - before).max(initial=0)
        if change <= least:
            return w
    if change > least:
        warnings.warn(f"after {rounds} rounds of raking cells still move by {change:.3g} tokens", stacklevel=2)
    return w


def _goals(sums: pd.DataFrame, margin: str, total: float, fraction: float, temper: float, given: dict | None) -> pd.DataFrame:
    """(label, there, wanted, goal) of a margin, by label; ``given`` are shares by value."""
    rows = sums.sort_values("label", ignore_index=True)
    there = rows["there"].to_numpy(float)
    if given is None:
        share = targets(there / max(there.sum(), 1e-300), temper)
    else:
        shares = {"" if k is None else f"={k}": float(v) for k, v in given.items()}
        if min(shares.values(), default=0) < 0 or not sum(shares.values()) > 0:
            raise ValueError(f"the target shares of {margin} must be positive")
        share = np.array([shares.get(x, 0.0) for x in rows["label"]]) / sum(shares.values())
    return rows.assign(margin=margin, wanted=share * fraction * total, goal=feasible(share, there, fraction * total))


def probabilities(rows: DataFrame, fraction: float, temper: float, shares: dict[str, dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """The probability ``__p`` of each cell that has tokens, and the margins: (margin, label, there,
    wanted, goal, reached) in tokens."""
    spark, names = rows.sparkSession, [f"__{m}" for m in MARGINS]
    unknown = set(shares or {}) - set(MARGINS)
    if unknown:
        raise ValueError(f"no margins: {sorted(unknown)}")
    sums = cut(rows.groupBy(*names).agg(F.sum("__tokens").alias("n")).where("n > 0"))
    if (size := sums.count()) > MOST_CELLS:
        raise ValueError(f"{size} combinations of source, language and topic; {MOST_CELLS} fit the driver")
    table = sums.toPandas().sort_values(names, ignore_index=True)
    cells, keys = table["n"].to_numpy(float), [pd.factorize(table[n], sort=True) for n in names]
    goals = [_goals(pd.DataFrame({"label": labels, "there": np.bincount(k, cells, len(labels))}), m, cells.sum(), fraction, temper, (shares or {}).get(m)) for m, (k, labels) in zip(MARGINS, keys)]
    w = rake(cells, [k for k, _ in keys], [g["goal"].to_numpy() for g in goals]) if len(cells) else cells
    margins = pd.concat([g.assign(reached=np.bincount(k, w, len(g))) for g, (k, _) in zip(goals, keys)])
    found = spark.createDataFrame(table[names].assign(__p=w / cells).astype({n: object for n in names}), "__source string, __lang string, __topic string, __p double")
    columns = ["margin", "label", "there", "wanted", "goal", "reached"]
    found = F.broadcast(found) if size <= BROADCAST_CELLS else found
    return found, spark.createDataFrame(margins[columns].astype({"label": object}), "margin string, label string, there double, wanted double, goal double, reached double")


def _drawn() -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce("id", "text")), 11).cast("double") * F.lit(2.0**-53)


def mix(docs: DataFrame, fraction: float = 0.7, temper: float = 0.5, shares: dict[str, dict] | None = None, topics: Topics | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, lang, anything) with topic, n_tokens, probability and kept.

    ``shares`` gives target shares by value for any of source, lang and topic (values that
    it doesn't name get nothing); a margin without them aims at the labels' shares
    of all tokens, each raised to ``temper``. About ``fraction`` of the tokens is kept. A
    null source or language is a label of its own, apart from the empty text. Texts
    without a word weigh nothing and have topic -1 and probability 1. Rows that repeat
    an id are drawn alike; a null id is drawn by its text. Columns of ``docs`` named like
    the added ones, in any case of letters, are replaced. An empty table gives an empty table.
    """
    return mixed(docs, fraction, temper, shares, topics)[0]


def mixed(docs: DataFrame, fraction: float = 0.7, temper: float = 0.5, shares: dict[str, dict] | None = None, topics: Topics | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``mix`` gives, and the margins as ``probabilities`` tells them."""
    added = ("topic", "n_tokens", "probability", "kept")
    # Spark's names differ by more than case
    columns = [c for c in docs.columns if c.lower() not in added]
    counts = counted(docs) if topics is None else None
    topics = learned(counts) if topics is None else topics
    rows = described(docs.select(*(F.col(f"`{c}`") for c in columns)), topics)
    told = rows.select("__source", "__lang", "__topic", "__tokens") if counts is None else cells_of(counts, topics)
    cells, margins = probabilities(told, fraction, temper, shares)
    p = F.when(F.col("__tokens") > 0, F.coalesce("__p", F.lit(0.0))).otherwise(1.0)
    found = rows.join(cells, ["__source", "__lang", "__topic"], "left").withColumn("__p", p)
    topic = F.substring("__topic", 2, 20).cast("int")
    return found.select("row.*", topic.alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__p").alias("probability"), (_drawn() < F.col("__p")).alias("kept")), margins
