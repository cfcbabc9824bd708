"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into segments; an index lists the codes by segment and
value. A search of radius r looks up all values within r bits of the query's
in every segment, and so meets every code within ``segments * (r + 1) - 1`` bits
of the query (pigeonhole). The radius grows round by round; each round looks up
only the new shell. A query is done when the distance of its kth verified code
is covered, which proves that no closer code was missed, ties included.

Codes that are equal are collapsed to one index row with the k smallest ids, as
no answer needs more of them; they are found per map task before the shuffle.
The number of segments follows the number of codes, as the method's analysis
has it; where a shell grows too large to list, the queries still open go on with
segments half as long. Probes of one round are the
unfinished queries times the shell's values times the segments; both tables are
shuffled by segment and value.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmap.llm.shared import cut

BITS = 64
#: Largest shell that is listed; beyond it segments are halved.
MOST_SHELL = 200_000


def sign_code(vector: str, bits: int = BITS) -> Column:
    """A code of the signs of a vector's first ``bits`` components, bit i for
    component i; null components and missing ones give 0, a null vector null."""
    return F.expr(f"aggregate(transform(slice(`{vector}`, 1, {bits}), (v, i) -> if(v > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")


def shells(width: int, radius: int) -> list[int]:
    """All values with exactly ``radius`` of ``width`` bits."""
    return [sum(1 << i for i in c) for c in combinations(range(width), radius)]


def segments_for(n: int) -> int:
    """Segments of 8 bits up to 2**8 codes, of 16 up to 2**28, of 32 beyond: few codes a
    value, and shells small enough to list."""
    return BITS // (8 if n <= 1 << 8 else 16 if n <= 1 << 28 else 32)


def cuts(segments: int) -> Column:
    """An array of (seg, key): the segments of column ``code``."""
    width = BITS // segments
    return F.array(*[
        F.struct(F.lit(s).alias("seg"), (F.shiftrightunsigned("code", s * width) if s else F.col("code")).bitwiseAND(F.lit((1 << width) - 1)).alias("key"))
        for s in range(segments)
    ])


def search(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int | None = None) -> DataFrame:
    """The k nearest of ``codes`` (id, code) for each of ``queries`` (id, code).

    Returns (query_id, rank, id, distance), ordered by distance and then id; the
    query's own row is not its neighbour, equal codes of other ids are. Rows with
    a null id or code take no part; rows that repeat an id and a code count once,
    an id with two codes by its nearest. Fewer than k codes give fewer rows.
    """
    if k < 1:
        raise ValueError("k must be positive")
    base = codes.where("id is not null and code is not null").select("id", "code").distinct()
    asked = cut(queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("qcode")).distinct())
    # k + 1, as one of them may be the query itself
    first = Window.partitionBy("code").orderBy("id")
    lists = base.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    distinct = cut(lists.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    segments = segments or segments_for(max(distinct.count(), 2))
    index = cut(distinct.select("code", "ids", F.inline(cuts(segments))))
    open_, best, radius = asked, None, 0
    while True:
        width = BITS // segments
        probes = open_.select("query_id", "qcode", F.col("qcode").alias("code")).select("query_id", "qcode", F.inline(cuts(segments)))
        # one literal, folded once, instead of thousands of expressions
        shell = F.explode(F.split(F.lit(",".join(map(str, shells(width, radius)))), ",").cast("array<bigint>"))
        probes = probes.select("query_id", "qcode", "seg", "key", shell.alias("flip")).select("query_id", "qcode", "seg", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
        met = probes.join(index, ["seg", "key"]).select("query_id", "qcode", F.bit_count(F.col("qcode").bitwiseXOR(F.col("code"))).alias("distance"), "code", "ids")
        # a code met in several segments or rounds counts once; of it the k smallest other ids matter
        fresh = met.select("query_id", "distance", F.explode("ids").alias("id")).where("id != query_id")
        pool = fresh if best is None else fresh.unionByName(best.select("query_id", "distance", "id"))
        pool = pool.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
        near = Window.partitionBy("query_id").orderBy("distance", "id")
        best = cut(pool.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k))
        covered = segments * (radius + 1) - 1
        done = best.where((F.col("rank") == k) & (F.col("distance") <= covered)).select("query_id")
        open_ = cut(open_.join(done, "query_id", "left_anti"))
        radius += 1
        if radius > width or covered >= BITS or not open_.limit(1).count():
            return best.select("query_id", "rank", "id", "distance")
        if comb(width, radius) > MOST_SHELL:
            # what is still open starts again on shorter segments, keeping what it has found
            segments, radius = segments * 2, 0
            index = cut(distinct.select("code", "ids", F.inline(cuts(segments))))
