"""Exact top-k search over binary codes: incremental multi-index hashing.

A code of ``bits`` bits is cut into segments. Two codes at Hamming distance below
``segments * (r + 1)`` agree in some segment up to ``r`` bits. So the search probes, for each
segment, all values up to 1, then 2, 3, ... bits from the query's own, verifies what it
meets, and a query is done as soon as its kth verified distance is below ``segments * (r + 1)``:
nothing nearer, nor as near, can be missing. Every other query goes on to the next radius, the widest
of which covers every code. There is no other path.

Scale: the index holds each distinct code once, with its ``k`` least ids, found by a ranking
that keeps at most k rows a code in each task before the shuffle; so thousands of copies of a vector
are one entry. Segments have about log2(codes) bits, so that a value has about one code and few radii are
needed at any size. Each segment's table is dealt by the first bits of its values into parts of about ``PART``
codes. A query is sent to the parts whose first bits are within the radius, with what is left of it; the probes
themselves are made inside a part and are never rows. Parts with more codes or queries than that are cut, on both
sides. A part answers with at most k rows a query.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, settle

BITS = 64
PART = 1 << 16  # codes of a segment, or queries, that are compared in one task


def binary_code(embedding: Column, bits: int = BITS, seed: int = 9) -> Column:
    """Signs of seeded random projections as a long: bit i is set where projection i is positive.

    Null vectors, and vectors with null or non-finite parts, have no code (null). Vectors of
    different lengths use the same leading rows of the projection.
    """

    @F.arrow_udf("long")
    def of(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors), np.uint64)
        lists = vectors.to_pylist()
        ok = np.array([v is not None and None not in v and bool(np.isfinite(v).all()) for v in lists], bool)
        by_size: dict[int, list[int]] = {}
        for i in np.flatnonzero(ok).tolist():
            by_size.setdefault(len(lists[i]), []).append(i)
        for n, rows in by_size.items():
            plane = np.random.default_rng(seed).standard_normal((n, bits))
            for at in range(0, len(rows), 4096):
                some = rows[at : at + 4096]
                signs = np.array([lists[i] for i in some], float).reshape(len(some), n) @ plane > 0
                full = np.zeros((len(some), 64), bool)
                full[:, :bits] = signs
                out[some] = np.packbits(full, axis=1, bitorder="little").view("<u8")[:, 0]
        return pa.array(out.view(np.int64), mask=~ok)

    return of(embedding)


def segment_count(size: int, bits: int = BITS) -> int:
    """Segments of about log2(size) bits each, so a value of a segment has about one code on average."""
    return max(1, min(bits, round(bits / max(4.0, min(32.0, math.log2(max(size, 2)))))))


def _edges(bits: int, segments: int) -> list[int]:
    return [bits * i // segments for i in range(segments + 1)]


def _segments(code: Column, bits: int, segments: int, prefix: int) -> Column:
    """Array of (segment number, the first ``prefix`` bits of its value, the others) of a code."""
    edges = _edges(bits, segments)
    parts = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        value = F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        low = b - a - prefix
        parts.append(F.struct(F.lit(i).alias("s"), F.shiftrightunsigned(value, low).alias("p"), value.bitwiseAND(F.lit((1 << low) - 1)).alias("low")))
    return F.array(*parts)


@lru_cache(maxsize=64)
def flips(width: int, ones: int) -> np.ndarray:
    """All values of ``width`` bits with ``ones`` bits set."""
    if not 0 <= ones <= width:
        return np.empty(0, np.int64)
    if ones == 0:
        return np.zeros(1, np.int64)
    return np.concatenate([flips(width - 1, ones), flips(width - 1, ones - 1) | (1 << (width - 1))])


def _nearest(index: pa.Table, queries: pa.Table, widths: list[int], k: int) -> pa.Table:
    """One part of the index against the queries that probe it: the values of its table at ``least`` to ``most`` bits
    from each query's own are looked up, what they hold is verified, and each query keeps its k nearest."""
    out: tuple[list, list, list] = ([], [], [])
    if len(index) and len(queries):
        width = widths[queries["s"][0].as_py()]
        by = np.argsort(index["low"].to_numpy(), kind="stable")
        low, code = index["low"].to_numpy()[by], index["code"].to_numpy()[by].view(np.uint64)
        ids = index["ids"]
        values, begin = np.unique(low, return_index=True)
        end = np.append(begin[1:], len(low))
        for q, bound, own, least, most in zip(*(queries[c].to_pylist() for c in ("q", "bound", "low", "least", "most"))):
            probes = np.concatenate([np.empty(0, np.int64), *(own ^ flips(width, r) for r in range(max(least, 0), min(most, width) + 1))])
            slot = np.minimum(np.searchsorted(values, probes), len(values) - 1)
            slot = slot[values[slot] == probes]
            n = end[slot] - begin[slot]
            if not n.sum():
                continue
            met = np.repeat(begin[slot] - np.cumsum(n) + n, n) + np.arange(n.sum())
            far = np.bitwise_count(code[met] ^ np.int64(q).view(np.uint64)).astype(np.int64)
            if len(far) > k:
                bound = min(bound, int(np.partition(far, k - 1)[k - 1]))
            near = np.flatnonzero(far <= bound)
            best = sorted((int(far[i]), x) for i in near.tolist() for x in ids[int(by[met[i]])].as_py())[:k]
            for d, x in best:
                out[0].append(q)
                out[1].append(d)
                out[2].append(x)
    return pa.table({"q": pa.array(out[0], pa.int64()), "distance": pa.array(out[1], pa.int32()), "neighbor_id": pa.array(out[2], index["ids"].type.value_type)})


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS, segments: int | None = None, id: str = "id", code: str = "code", part: int = PART) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for each query its ``k`` nearest rows of ``index``.

    Nearest by Hamming distance, then by smaller id; a row is its own neighbour too where it is in
    the index. Rows with a null id or code take no part, on either side. Repeated index rows count once
    per (id, code); a repeated query row is answered once. With fewer than ``k`` rows all are returned; empty
    inputs give an empty result. Other columns are ignored. ``segments``: by default such that each has about
    log2 of the number of codes in bits.
    """
    # per code its k least ids, ranked before the shuffle and after it
    rows = index.select(F.col(f"`{id}`").alias("id"), F.col(f"`{code}`").alias("code")).where("id is not null and code is not null").distinct()
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    codes = settle(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "topk-codes")  # at most k a code
    size = codes.count()
    asked = queries.select(F.col(f"`{id}`").alias("query_id"), F.col(f"`{code}`").alias("q")).where("query_id is not null and q is not null").distinct()
    kind = dict(rows.dtypes)["id"]
    if not size:
        return asked.sparkSession.createDataFrame([], f"query_id {dict(asked.dtypes)['query_id']}, rank int, neighbor_id {kind}, distance int")
    segments = segments or segment_count(size, bits)
    edges = _edges(bits, segments)
    # the index is dealt by segment and the first bits of its value; the rest is looked up inside a part
    narrowest = min(b - a for a, b in zip(edges, edges[1:]))
    prefix = max(0, min(narrowest - 1, math.ceil(math.log2(max(1, size * segments / part)))))
    widths = [b - a - prefix for a, b in zip(edges, edges[1:])]
    widest = max(widths) + prefix
    parts = codes.select("code", "ids", F.explode(_segments(F.col("code"), bits, segments, prefix)).alias("x")).select("code", "ids", "x.*")
    # equal queries are answered once; nothing farther than ``bound`` can be among a query's k nearest
    todo = settle(asked.select("q").distinct().withColumn("bound", F.lit(bits)), "topk-queries")
    found, answers, done = None, [], -1
    for radius in range(min(1, widest), widest + 1):
        if todo.isEmpty():
            break
        # a part whose prefix is f bits away is probed at the rest of the radius
        ways = F.filter(F.sequence(F.lit(0), F.lit((1 << prefix) - 1)), lambda f: F.bit_count(f) <= radius)
        routes = todo.select("q", "bound", F.explode(_segments(F.col("q"), bits, segments, prefix)).alias("x")).select("q", "bound", "x.*", F.explode(ways).alias("f"))
        routes = routes.select("q", "bound", "s", F.col("p").bitwiseXOR(F.col("f").cast("long")).alias("p"), "low", (done + 1 - F.bit_count("f")).alias("least"), (radius - F.bit_count("f")).alias("most"))
        # both sides of a hot part are cut, and each cut of one meets each of the other
        pairs = routes.groupBy("s", "p").agg(F.count("*").alias("asking")).join(parts.groupBy("s", "p").agg(F.count("*").alias("held")), ["s", "p"])
        cuts = settle(pairs.select("s", "p", F.ceil(F.col("asking") / part).cast("int").alias("of_q"), F.ceil(F.col("held") / (2 * part)).cast("int").alias("of_c")), "topk-parts")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = parts.join(cuts, ["s", "p"]).withColumn("c", F.pmod(F.xxhash64("code"), F.col("of_c")).cast("int")).select("s", "p", "c", upto("of_q").alias("d"), "low", "code", "ids")
        right = routes.join(cuts, ["s", "p"]).withColumn("d", F.pmod(F.xxhash64("q"), F.col("of_q")).cast("int")).select("s", "p", upto("of_c").alias("c"), "d", "q", "bound", "low", "least", "most")
        keys = ["s", "p", "c", "d"]
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda key, x, y: _nearest(x, y, widths, k), f"q bigint, distance int, neighbor_id {kind}")
        if found is not None:
            hits = hits.unionByName(found.join(todo, "q", "left_semi"))
        # a code may be met in several segments; each query's rows are thinned in slices before they meet
        sliced = Window.partitionBy("q", "slice").orderBy("distance", "neighbor_id")
        thin = hits.distinct().withColumn("slice", F.pmod(F.xxhash64("neighbor_id"), F.lit(8))).withColumn("rank", F.row_number().over(sliced)).where(F.col("rank") <= k)
        by = Window.partitionBy("q").orderBy("distance", "neighbor_id")
        best = thin.select("q", "distance", "neighbor_id", F.row_number().over(by).alias("rank")).where(F.col("rank") <= k)
        then = settle(best, "topk-found")
        done = radius
        covered = segments * (radius + 1) - 1  # every code up to this distance has been met
        if covered >= bits or radius == widest:
            answers.append(then)
            break
        kth = then.where(F.col("rank") == k).select("q", F.col("distance").alias("kth"))
        answers.append(then.join(kth.where(F.col("kth") <= covered), "q", "left_semi"))
        rest = todo.join(kth, "q", "left").where(F.col("kth").isNull() | (F.col("kth") > covered)).select("q", F.coalesce("kth", "bound").alias("bound"))
        rest = settle(rest, "topk-queries")
        discard(todo)
        discard(cuts)
        todo, found = rest, then.drop("rank")
    if not answers:  # nothing was asked
        return asked.sparkSession.createDataFrame([], f"query_id {dict(asked.dtypes)['query_id']}, rank int, neighbor_id {kind}, distance int")
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return asked.join(out, "q").select("query_id", "rank", "neighbor_id", "distance")
