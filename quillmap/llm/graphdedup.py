"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors of a label are dealt to the ``overlap`` nearest of its cluster centres,
so that neighbours share a shard. In each shard every vector is tied to its
nearest ones, robustly pruned: of the candidates in order of distance one is
dropped when a kept one is nearer to it, by the factor alpha, than the vector
itself. The adjacency lists of a vector from all its shards are united. A
greedy search then runs for every vector in the shard of its nearest centre,
from the shard's medoid and from its own place: it expands the most similar
known vectors, and once inside the range expands everything in range until
nothing new turns up. What it finds is verified in double precision.

A vector can have partners in shards that it is not dealt to. Two vectors of
cosine t are sqrt(2 - 2t) apart at most, so by the Cauchy-Schwarz inequality a
vector y with nearest centre c has none whose nearest centre is d unless
y.d >= y.c - sqrt(2 - 2t) |c - d|. Where this holds, the vector is compared with
all vectors at home in that shard, so dealing loses no link, whatever the overlap.

Inside a shard a search can miss what no edge leads to. So an exact check follows each: the
shard's rows lie in cells about some of them, and a search's vector is compared with the rows
of every cell that the triangle inequality can't rule out. Links that the search missed are
added, so the result hangs on no draw, and what was missed is the audit: each row carries the
recall that the searches of its shard had, measured over all their links.

Equal vectors are collapsed first. Shards over ``block_rows`` rows are cut into
blocks by a hash, and every block of searches meets every block of the shard,
so memory is bounded whatever a cluster holds. Searches give numbers of links
and a spanning forest of what they found, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillmap.llm.components import components
from quillmap.llm.shared import cut

#: Home vectors per shard to aim at; the number of centres, and so the size of what is broadcast, has a bound.
SHARD_ROWS, MOST_CENTRES = 500, 16384
DEGREE, POOL, ALPHA = 24, 64, 1.2
#: Entry points of a block: its medoid and rows far from it and from each other.
ENTRIES = 8
#: The greedy part of a search goes on while one of so many best known rows is not expanded.
BEAM = 12
PAIRS = 1 << 16


def usable(embedding: str, label: str) -> Column:
    """Whether a vector can link: not null, finite throughout, not zero, labelled."""
    finite = f"forall(`{embedding}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return F.expr(f"coalesce(`{label}` is not null and size(`{embedding}`) > 0 and {finite} and exists(`{embedding}`, x -> x != 0), false)")


def unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_list()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prune(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of the pruned graph over the rows of a shard, both ways."""
    n = len(x)
    pool = min(POOL, n - 1)
    if pool < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.empty((n, pool), np.int64)
    for lo in range(0, n, 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        best = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        near[lo : lo + len(s)] = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)
    away = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,npd->np", x, x[near]), 0)) if n * pool * x.shape[1] < 1 << 25 else _in_blocks(x, near)
    alive, kept = np.ones((n, pool), bool), np.zeros((n, pool), bool)
    for k in range(pool):
        take = alive[:, k] & (kept.sum(axis=1) < DEGREE)
        kept[:, k] = take
        rows = np.flatnonzero(take)
        for part in np.array_split(rows, max(1, len(rows) * pool * x.shape[1] >> 24)):
            if len(part) and k + 1 < pool:
                rest = near[part, k + 1 :]
                gap = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,npd->np", x[near[part, k]], x[rest]), 0))
                alive[part, k + 1 :] &= ALPHA * gap > away[part, k + 1 :]
    a, k = np.nonzero(kept)
    b = near[a, k]
    return np.concatenate((a, b)), np.concatenate((b, a))


def _in_blocks(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 24) // (near.shape[1] * x.shape[1]))
    return np.concatenate([np.sqrt(np.maximum(2 - 2 * np.einsum("nd,npd->np", x[i : i + step], x[near[i : i + step]]), 0)) for i in range(0, len(x), step)])


def entries(x: np.ndarray) -> list[int]:
    """The medoid, then each time the row least like all entries so far."""
    found = [int((x @ x.mean(axis=0)).argmax())]
    like = x @ x[found[0]]
    while len(found) < min(ENTRIES, len(x)):
        found.append(int(like.argmin()))
        like = np.maximum(like, x @ x[found[-1]])
    return found


def range_search(x: np.ndarray, first: np.ndarray, to: np.ndarray, q: np.ndarray, own: np.ndarray, threshold: float) -> np.ndarray:
    """For each query the rows of x found with cosine >= threshold (a matrix of booleans).

    The edges of row i are ``to[first[i]:first[i + 1]]``; ``own`` is a query's own
    row or -1.
    """
    m, n = len(q), len(x)
    known = np.full((m, n), -np.inf)
    done = np.zeros((m, n), bool)

    def learn(who: np.ndarray, what: np.ndarray) -> None:
        for lo in range(0, len(who), PAIRS):
            i, j = who[lo : lo + PAIRS], what[lo : lo + PAIRS]
            new = np.isneginf(known[i, j])
            i, j = i[new], j[new]
            known[i, j] = np.einsum("nd,nd->n", q[i], x[j])

    def expand(who: np.ndarray, what: np.ndarray) -> None:
        done[who, what] = True
        width = first[what + 1] - first[what]
        ends = np.cumsum(width)
        for part in np.array_split(np.arange(len(who)), max(1, int(ends[-1]) // (PAIRS * 8)) if len(who) else 1):
            w = width[part]
            at = np.repeat(first[what[part]] - np.concatenate(([0], np.cumsum(w)[:-1])), w) + np.arange(int(w.sum()))
            learn(np.repeat(who[part], w), to[at])

    everyone = np.arange(m)
    for entry in entries(x):
        learn(everyone, np.full(m, entry))
    learn(everyone[own >= 0], own[own >= 0])
    busy, beam = everyone, min(BEAM, n)
    while len(busy):
        rows = known[busy]
        open_ = np.where(done[busy], -np.inf, rows)
        best = open_.argmax(axis=1)
        top = open_[np.arange(len(busy)), best]
        go = ~np.isneginf(top) & (top >= np.partition(rows, n - beam, axis=1)[:, n - beam])
        busy, best = busy[go], best[go]
        expand(busy, best)
    while True:
        who, what = np.nonzero((known >= threshold) & ~done)
        if not len(who):
            break
        expand(who, what)
    return known >= threshold


class Cover:
    """Rows in cells about some of them, each with the largest distance of a member."""

    def __init__(self, x: np.ndarray) -> None:
        n = len(x)
        self.x, self.leaders = x, x[np.linspace(0, n - 1, max(int(n**0.5), 1)).astype(np.int64)]
        like = x @ self.leaders.T
        at = like.argmax(axis=1)
        order = np.argsort(at, kind="stable")
        self.cells = np.split(order, np.searchsorted(at[order], np.arange(1, len(self.leaders))))
        self.radius = np.array([_away(like[c, k]).max(initial=0) for k, c in enumerate(self.cells)])

    def within(self, q: np.ndarray, threshold: float) -> np.ndarray:
        """For each query the rows with cosine >= threshold, as a matrix of booleans, by every comparison that the bound leaves."""
        hits, like = np.zeros((len(q), len(self.x)), bool), q @ self.leaders.T
        at, apart = like.argmax(axis=1), _away(threshold)
        for k in np.unique(at):
            rows = np.flatnonzero(at == k)
            gap = _away(self.leaders @ self.leaders[k])
            near = np.flatnonzero(gap <= _away(like[rows, k]).max() + self.radius + apart + 1e-6)
            columns = np.concatenate([self.cells[c] for c in near])
            hits[np.ix_(rows, columns)] = q[rows] @ self.x[columns].T >= threshold
        return hits


def _away(cosine: np.ndarray | float) -> np.ndarray:
    """The distance of unit vectors of a cosine."""
    return np.sqrt(np.maximum(2 - 2 * np.asarray(cosine), 0))


def forest(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the pairs (a, b)."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        u, v = root(i), root(j)
        if u != v:
            parent[max(u, v)] = min(u, v)
            yield i, j


def centres(rows: DataFrame, shard_rows: int) -> dict[tuple, np.ndarray]:
    """Unit centres of each group (label and length) of over ``shard_rows`` vectors,
    by a few rounds of k-means on a bounded sample of about eight vectors a centre."""
    n = rows.count()
    size = max(shard_rows, -(-n // MOST_CENTRES))
    large = {(r.label, r.dims): -(-r.n // size) for r in rows.groupBy("label", "dims").agg(F.count("*").alias("n")).where(F.col("n") > size).collect()}
    if not large:
        return {}
    part = min(1.0, 8.0 * sum(large.values()) / n)
    wanted = F.broadcast(rows.sparkSession.createDataFrame(list(large), rows.select("label", "dims").schema))
    sample = rows.where(F.shiftrightunsigned(F.xxhash64("embedding"), 11).cast("double") * F.lit(2.0**-53) < part).join(wanted, ["label", "dims"])
    got = sample.select("label", "dims", "embedding").toPandas()
    found = {}
    for (label, dims), rows_ in got.groupby(["label", "dims"]):
        x = unit(rows_["embedding"])
        x = x[np.lexsort(x.T)]
        c = x[np.random.default_rng(5).permutation(len(x))[: large[label, dims]]].copy()
        for _ in range(5):
            at = np.concatenate([(x[k : k + 1024] @ c.T).argmax(axis=1) for k in range(0, len(x), 1024)])
            sums = np.zeros_like(c)
            np.add.at(sums, at, x)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), c)
        found[label, dims] = c
    return found


#: Beyond the rounding of cosines of unit vectors.
SLACK = 1e-9
#: Vectors dealt out in one go.
SLICE = 1024


def spread(rows: DataFrame, found: dict[tuple, np.ndarray], overlap: int, threshold: float) -> DataFrame:
    """A row for each vector and shard it belongs to; ``home`` marks the nearest, ``extra``
    the shards beyond the ``overlap`` nearest at home in which there can be a partner."""
    held = rows.sparkSession.sparkContext.broadcast(found)
    apart = float(np.sqrt(max(2 - 2 * threshold, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # in slices: a row of cosines is as long as there are centres
            for k in range(0, len(batch), SLICE):
                yield from dealt(batch.slice(k, SLICE).to_pandas())

    def dealt(pdf: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        out = []
        for (label, dims), g in pdf.groupby(["label", "dims"]):
            c = held.value.get((label, dims))
            at = np.zeros((len(g), 1), np.int64)
            far = []
            if c is not None:
                s = unit(g["embedding"]) @ c.T
                k = min(overlap, s.shape[1])
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                at = np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)
                far = _beyond(s, at, c, apart)
            for k in range(at.shape[1]):
                out.append(g.assign(shard=at[:, k].astype(np.int32), home=k == 0, extra=False))
            for who, what in far:
                if out:
                    yield pa.RecordBatch.from_pandas(pd.concat(out), schema, preserve_index=False)
                out = [g.iloc[who].assign(shard=what.astype(np.int32), home=False, extra=True)]
        if out:
            yield pa.RecordBatch.from_pandas(pd.concat(out), schema, preserve_index=False)

    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("label", _arrow(rows, "label")), ("dims", pa.int32()), ("embedding", pa.list_(pa.float64())), ("shard", pa.int32()), ("home", pa.bool_()), ("extra", pa.bool_())])
    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("rep", "n", "label", "dims", "embedding").mapInArrow(run, f"rep long, n long, label {kind}, dims int, embedding array<double>, shard int, home boolean, extra boolean")


def _beyond(s: np.ndarray, at: np.ndarray, c: np.ndarray, apart: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and centres, not among the row's ``at``, that the bound can't tell apart."""
    step = max(1, (1 << 14) // len(c))
    for lo in range(0, len(s), step):
        part, mine = s[lo : lo + step], at[lo : lo + step]
        first = mine[:, :1]
        gap = np.sqrt(np.maximum((c * c).sum(1)[None, :] + (c * c).sum(1)[first] - 2 * c[first[:, 0]] @ c.T, 0))
        need = part >= np.take_along_axis(part, first, 1) - apart * gap - SLACK
        np.put_along_axis(need, mine, False, axis=1)
        who, what = np.nonzero(need)
        if len(who):
            yield who + lo, what


def _arrow(rows: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[column].dataType)


def found_links(rows: DataFrame, threshold: float, overlap: int, shard_rows: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Per search (a, n, seen, b null) its number of links, and of those that the search itself found;
    per forest edge (a, b, n null). Then (rep, recall) of the searches in the vector's shard."""
    key = ["label", "dims", "shard"]
    every = cut(spread(rows, centres(rows, shard_rows), overlap, threshold))
    members = every.where("not extra").drop("extra")
    large = members.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > block_rows)
    blocks = large.select(*key, F.ceil(F.col("size") / block_rows).cast("int").alias("blocks"))
    members = members.join(blocks, key, "left").fillna(1, ["blocks"])
    members = cut(members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = prune(unit(pdf["embedding"]))
        ids = pdf["rep"].to_numpy()
        pairs = pd.DataFrame({"rep": ids[a], "to": ids[b]}).drop_duplicates()
        # a shard of one vector has no edge, and pandas no list to tell the type by
        return pairs.groupby("rep")["to"].agg(list).reset_index(name="edges").astype({"edges": object})

    lists = members.groupBy(*key, "block").applyInPandas(build, "rep long, edges array<long>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
    data = members.join(united, "rep", "left").withColumn("searches", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = members.where("home").withColumn("searches", F.col("block")).withColumn("edges", F.lit(None).cast("array<long>"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = [*key, "block", "searches", "rep", "n", "embedding", "edges"]
    both = data.select(*columns, F.lit(False).alias("asks")).union(asked.select(*columns, F.lit(True)))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        own_rows, queries = pdf[~asks], pdf[asks]
        out = []
        if len(own_rows) and len(queries):
            ids, qids = own_rows["rep"].to_numpy(), queries["rep"].to_numpy()
            by = np.argsort(ids)
            own_rows, ids = own_rows.iloc[by], ids[by]
            lists_ = [np.asarray(e if e is not None else [], np.int64) for e in own_rows["edges"]]
            to = np.concatenate(lists_) if lists_ else np.zeros(0, np.int64)
            source = np.repeat(np.arange(len(ids)), [len(e) for e in lists_])
            at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
            inside = ids[at] == to
            first = np.searchsorted(source[inside], np.arange(len(ids) + 1))
            own = np.minimum(np.searchsorted(ids, qids), len(ids) - 1)
            own = np.where(ids[own] == qids, own, -1)
            x, q, weight = unit(own_rows["embedding"]), unit(queries["embedding"]), own_rows["n"].to_numpy(np.int64)
            cover = Cover(x)
            for lo in range(0, len(q), 512):
                part = slice(lo, lo + 512)
                found = range_search(x, first, at[inside], q[part], own[part], threshold)
                hits = found | cover.within(q[part], threshold)
                mine = np.flatnonzero(own[part] >= 0)
                found[mine, own[part][mine]] = hits[mine, own[part][mine]] = False
                out += [(i, None, k, l) for i, k, l in zip(qids[part].tolist(), (hits @ weight).tolist(), (found @ weight).tolist())]
                a, b = np.nonzero(hits)
                out += [(i, j, None, None) for i, j in forest(qids[part][a], ids[b])]
        return pd.DataFrame(out, columns=["a", "b", "n", "seen"], dtype=object).astype("Int64")

    home = every.where("home")
    searched = both.groupBy(*key, "block", "searches").applyInPandas(search, "a long, b long, n long, seen long")
    searched = cut(searched.union(compared(home, every.where("extra"), threshold, block_rows).withColumn("seen", F.lit(None).cast("long"))))
    links = searched.where("seen is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    shards = home.select("rep", *key)
    share = F.when(F.sum("n") > 0, F.sum("seen") / F.sum("n")).otherwise(1.0)
    measured = shards.join(shards.join(links, "rep").groupBy(*key).agg(share.alias("recall")), key).select("rep", "recall")
    return searched.drop("seen"), measured


def compared(asked: DataFrame, others: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """What ``found_links`` gives, by comparing all of ``asked`` with all of ``others`` of the same shard."""
    key = ["label", "dims", "shard"]

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    counts = cut(blocks(asked, "na").join(blocks(others, "nb"), key))

    def dealt(df: DataFrame, own: str, met: str, asks: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("rep"), F.col(f"n{own}")).cast("int")
        df = df.join(counts, key).withColumn(own, mine).withColumn(met, F.explode(F.sequence(F.lit(0), F.col(f"n{met}") - 1)))
        return df.select(*key, "a", "b", "rep", "n", "embedding", F.lit(asks).alias("asks"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        queries, rest = pdf[asks], pdf[~asks]
        out = []
        if len(queries) and len(rest):
            qids, ids, weight = queries["rep"].to_numpy(), rest["rep"].to_numpy(), rest["n"].to_numpy(np.int64)
            q, x = unit(queries["embedding"]), unit(rest["embedding"])
            for lo in range(0, len(q), 512):
                hits = (q[lo : lo + 512] @ x.T >= threshold) & (qids[lo : lo + 512, None] != ids[None, :])
                out += [(i, None, k) for i, k in zip(qids[lo : lo + 512].tolist(), (hits @ weight).tolist()) if k]
                a, b = np.nonzero(hits)
                out += [(i, j, None) for i, j in forest(qids[lo : lo + 512][a], ids[b])]
        return pd.DataFrame(out, columns=["a", "b", "n"], dtype=object).astype("Int64")

    both = dealt(asked, "a", "b", True).union(dealt(others, "b", "a", False))
    return both.groupBy(*key, "a", "b").applyInPandas(meet, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, overlap: int = 4, shard_rows: int = SHARD_ROWS, block_rows: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, recall, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Two vectors link if their labels are equal and their cosine in double
    precision is at least ``threshold``. A vector that is null, empty, zero or
    has a null or non-finite component, a null label or a null id links with
    nothing and is its own component. Vectors of different length never link.
    Rows that repeat an id count as vectors of their own; ids are integers. ``recall`` is
    the share of their links that the searches of the vector's shard found before the exact check, null
    where a vector can't link. An empty table gives an empty table; other columns are ignored.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = cut(own.withColumn("fit", usable("embedding", "label") & F.col("vec_id").isNotNull()))
    copies = own.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    rows = cut(copies.withColumn("dims", F.size("embedding")))
    found, measured = found_links(rows, threshold, overlap, shard_rows, block_rows)
    found = cut(found)
    counts = cut(found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links")))
    nodes = components(found.where("b is not null"))
    info = rows.join(counts, "rep", "left").join(nodes.withColumnRenamed("node", "rep"), "rep", "left").join(measured, "rep", "left")
    info = info.select("label", "embedding", "recall", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    linked = own.where("fit").join(info, ["label", "embedding"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), "recall")
    alone = own.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    both = linked.union(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
