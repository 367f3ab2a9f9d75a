"""MinHash fingerprints: universal hash permutations over word shingles, in numpy.

A text's shingles are hashed to 32 bits; permutation j sends x to the upper half of
``a_j * x + b_j`` modulo 2^64 (multiply-add-shift, a universal family), and the fingerprint
holds the least value of each. The share of equal places estimates the Jaccard similarity
of two shingle sets. Equal texts have equal fingerprints.

``near_duplicates`` cuts fingerprints into bands, joins them in Spark and verifies
the Jaccard similarity of what meets. ``edited`` compares every text with the next one and
with an edit that borrows from it; texts are moved once, in ranges of ids and text hashes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..runtime import settle
from .common import partitions, shingles, words
from .simhash import _groups

PERMUTATIONS = 128
SHINGLE = 5
RANGE_BYTES = 64 << 20
EMPTY = np.uint32(0xFFFFFFFF)
TASK = 8  # a task takes buckets of up to this many times ``limit`` sets whole
WAYS = 8  # larger ones are cut into this many chunks at most (see ``_chunked``)


def coefficients(count: int = PERMUTATIONS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2)


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """32-bit hashes (as uint64) of the word shingles, repeats included."""
    return shingles(text, shingle) >> np.uint64(32)


def signature(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each permutation over hashes ``x``; all ones over none."""
    out = np.full(len(a), EMPTY, np.uint32)
    for at in range(0, len(x), 512):
        part = x[None, at : at + 512] * a[:, None] + b[:, None]
        np.minimum(out, (part.min(1) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


def fingerprints(text: Column, count: int = PERMUTATIONS, shingle: int = SHINGLE, seed: int = 1) -> Column:
    """The fingerprint as binary (``count`` big-endian 32-bit values); null is an empty text."""
    a, b = coefficients(count, seed)

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([signature(shingle_hashes(t, shingle), a, b).astype(">u4").tobytes() for t in texts.cast(pa.binary()).to_pylist()], pa.binary())

    return of(text)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def _ranges(rows: DataFrame, least: int) -> list:
    """The greatest key of each of at least about ``least`` ranges of about equal bytes, in descending order, for ``rows`` (key, bytes);
    more ranges where they would have more than ``RANGE_BYTES``. One row for a fine range is gathered."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    count = max(least, math.ceil(total / RANGE_BYTES))
    fine = rows.repartitionByRange(4 * count, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("top"), F.sum("bytes").alias("bytes"))
    tops, held = [], math.inf
    for row in sorted(fine.collect(), key=lambda r: -r.p):
        if held + row.bytes / 2 > total / count:
            tops.append(row.top)
            held = 0
        held += row.bytes
    return tops


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count: int = PERMUTATIONS, shingle: int = SHINGLE, seed: int = 1) -> DataFrame:
    """One row per document: ``doc_id``, ``n_chars`` (code points of its text), ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint`` (hexadecimal), ``near_edited``, ``near_next``.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document's, in descending order of ids (of any type that has an order); after the
    last comes the first. Null ids come last, ties are in descending order of the text's XXH64. A null text is
    empty. A single document is its own next. Repeated rows stay, an empty table gives
    an empty result, other columns are ignored.

    Texts move once, to ranges of (id, hash) of about equal bytes; so an id of many rows has many ranges, only rows that are equal
    share one. The first document of each range is also sent to the range before it, so every task sees
    its rows with their successors, in order and as a stream.
    """
    own, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    key = F.struct(own.alias("id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("h"))
    kind = dict(docs.select(own.alias("id")).dtypes)["id"]
    slim = docs.select(key.alias("key"), body.cast("binary").alias("text"))
    tops = _ranges(docs.select(key.alias("key"), (F.coalesce(F.octet_length(body), F.lit(0)) + 64).alias("bytes")), max(2, partitions(docs)))
    last = len(tops) - 1
    # range r holds the keys from tops[r] down to above tops[r + 1]; it is found among every wide-th top, then among those behind it
    wide = max(1, math.isqrt(len(tops)))
    bounds = F.array(*[F.struct(F.lit(t.id).cast(kind).alias("id"), F.lit(t.h).cast("bigint").alias("h")) for t in tops])
    some = F.array(*[F.struct(F.lit(t.id).cast(kind).alias("id"), F.lit(t.h).cast("bigint").alias("h")) for t in tops[::wide]])
    if not tops:
        bounds = some = F.array().cast(f"array<struct<id:{kind},h:bigint>>")
    reached = lambda these: F.size(F.filter(these, lambda t: t >= F.col("key")))
    ranged = slim.withColumn("coarse", F.greatest((reached(some) - 1) * wide, F.lit(0)))
    ranged = ranged.withColumn("r", F.col("coarse") + reached(F.slice(bounds, F.col("coarse") + 1, F.lit(wide))) - 1)
    # rows that may open their range go to the range before as guests; there the first of them counts
    here = F.struct(F.col("r").cast("int").alias("r"), F.lit(0).alias("guest"))
    before = F.struct(F.when(F.col("r") > 0, F.col("r") - 1).otherwise(last).cast("int").alias("r"), F.lit(1).alias("guest"))
    to = F.when(F.col("key").eqNullSafe(F.get(bounds, F.col("r"))), F.array(here, before)).otherwise(F.array(here))
    dealt = ranged.withColumn("to", F.explode(to)).select("to.r", "to.guest", "key", "text")
    dealt = dealt.repartitionById(max(1, len(tops)), "r").sortWithinPartitions("r", "guest", F.col("key").desc(), "text").select("r", "guest", F.col("key.id").alias("id"), "text")
    a, b = coefficients(count, seed)

    def run(batches):
        open_ = None  # the row whose successor comes next: (range, id, text, parts)
        rows: list[tuple] = []

        def view(raw: bytes | None):
            return (raw or b"").decode()

        def close(row, then_text: str, then_sig):
            _, id_, txt, sig, common, shared = row
            k = len(txt) // 3
            new = txt[: len(txt) - k] + then_text[:k]
            raw = new.encode()
            esig = sig if new == txt else np.minimum(common, signature(shingle_hashes(raw, shingle)[shared:], a, b))
            rows.append((id_, len(txt), hashlib.sha256(raw).hexdigest(), sig.astype(">u4").tobytes().hex(), esig.astype(">u4").tobytes().hex(), likeness(sig, esig), likeness(sig, then_sig)))

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, k or id_kind) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out

        for batch in batches:
            id_kind = batch.schema.field("id").type
            for r, guest, id_, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if guest and (open_ is None or open_[0] != r):
                    continue  # a later guest of a range that is closed
                txt = view(raw)
                x = shingle_hashes(raw, shingle)
                # the shingles before the edit are in both texts
                shared = max(0, len(words(txt[: len(txt) - len(txt) // 3].encode())) - shingle)
                common = signature(x[:shared], a, b)
                sig = np.minimum(common, signature(x[shared:], a, b))
                if open_ is not None and open_[0] == r:
                    close(open_, txt, sig)
                open_ = None if guest else (r, id_, txt, sig, common, shared)
                if len(rows) >= 500:
                    yield flush()
        if rows:
            yield flush()

    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _set(text: Column, shingle: int) -> Column:
    """The distinct shingle hashes of a text, sorted, as binary."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingles(t, shingle)).tobytes() for t in texts.cast(pa.binary()).to_pylist()], pa.binary())

    return of(text)


def _signed(text: Column, shingle: int, count: int, seed: int, key_bits: int) -> Column:
    """``key`` and ``check``, two hashes of the set of shingles (equal for equal sets), and ``sig``, its signature."""
    a, b = coefficients(count, seed)

    @F.arrow_udf("struct<key: long, check: long, sig: binary>")
    def of(texts: pa.Array) -> pa.Array:
        import xxhash

        sets = [np.unique(shingles(t, shingle)) for t in texts.cast(pa.binary()).to_pylist()]
        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes(), 5) for x in sets), np.int64).reshape(-1, 2)
        key = pa.array(both[:, 0] & ((1 << key_bits) - 1) if key_bits < 64 else np.ascontiguousarray(both[:, 0]))
        sigs = [signature(x >> np.uint64(32), a, b).astype(">u4").tobytes() for x in sets]
        return pa.StructArray.from_arrays([key, pa.array(np.ascontiguousarray(both[:, 1])), pa.array(sigs, pa.binary())], ["key", "check", "sig"])

    return of(text)


def _keyed(slim: DataFrame) -> DataFrame:
    """``slim`` with a ``key`` for each (key, check): where sets that differ share a key, of the two."""
    twice = slim.groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("key", F.lit(True).alias("twice"))
    if twice.isEmpty():
        return slim
    return settle(slim.join(twice, "key", "left").withColumn("key", F.when(F.col("twice"), F.xxhash64("key", "check")).otherwise(F.col("key"))).drop("twice"), "signatures")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether ``jaccard`` is at least ``threshold``; sizes alone often tell that it isn't."""
    less, more = sorted((len(a), len(b)))
    return (not more or less / more >= threshold) and jaccard(a, b) >= threshold


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): the pairs of keys (a, b) whose sets are alike."""

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        each = zip(x.to_pylist(), y.to_pylist())
        return pa.array([_alike(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), threshold) for s, t in each], pa.bool_())

    met = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
    return met.where(alike("x", "y")).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _chunked(rest: DataFrame, limit: int) -> DataFrame:
    """``rest`` (t, k, key, comp, n) as (t, k, lo, hi, side, key, comp): whole buckets, or pairs of chunks of a bucket of more than
    ``TASK`` times ``limit`` sets. A component that would fill chunks has its own, which are never paired with each other. Chunks grow
    with their bucket, so it has at most 3 times ``WAYS`` (``WAYS`` of large components, as many cut short, ``WAYS`` of the rest): a
    row is copied that often at most, however large its bucket is."""
    whole = rest.where(F.col("n") <= TASK * limit).select("t", "k", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side"), "key", "comp")
    per = F.greatest(F.lit(TASK * limit // 2), F.ceil(F.col("n") / WAYS))
    hot = rest.where(F.col("n") > TASK * limit).withColumn("per", per)
    sizes = hot.groupBy("t", "k", "comp").agg(F.count("*").alias("m"), F.first("per").alias("per")).withColumn("big", F.col("m") > F.col("per"))
    small = sizes.groupBy("t", "k").agg(F.sum(F.when(F.col("big"), 0).otherwise(F.col("m"))).alias("small"))
    big = F.col("big")
    into = F.ceil(F.when(big, F.col("m")).otherwise(F.col("small")) / F.col("per"))
    number = F.pmod(F.when(big, F.xxhash64("key")).otherwise(F.xxhash64("comp")), into)
    placed = hot.join(sizes.drop("per"), ["t", "k", "comp"]).join(small, ["t", "k"]).withColumn("c", F.struct(big.alias("big"), F.when(big, F.col("comp")).otherwise(0).alias("of"), number.alias("number")))
    lists = placed.groupBy("t", "k").agg(F.array_sort(F.collect_set("c")).alias("all"))  # a few entries for each bucket
    pairs = placed.join(lists, ["t", "k"]).withColumn("own", (F.array_position("all", F.col("c")) - 1).cast("int"))
    pairs = pairs.select("t", "k", "key", "comp", "own", "c", F.posexplode("all").alias("p", "d")).where(~(F.col("c.big") & F.col("d.big") & (F.col("c.of") == F.col("d.of"))))
    lo = F.least("own", "p")
    return whole.unionByName(pairs.select("t", "k", lo.alias("lo"), F.greatest("own", "p").alias("hi"), F.when(F.col("own") == lo, 0).otherwise(1).alias("side"), "key", "comp"))


def _joins(comp: np.ndarray, side: np.ndarray, across: bool, sets: list[np.ndarray], threshold: float, limit: int = 512) -> list[tuple[int, int]]:
    """Index pairs that are alike and connect components (of each side with the other only, if ``across``), as few as
    connect all that such pairs connect. ``limit`` sets at once are held against as many; each of them is counted against all of the
    others in one pass, as often as they have shingles."""
    comp, out = np.unique(comp, return_inverse=True)[1], []
    size = np.fromiter(map(len, sets), np.int64, len(sets))

    def blocks(at: np.ndarray) -> list[np.ndarray]:
        return [at[i : i + limit] for i in range(0, len(at), limit)]

    if across:
        met = [(a, b) for a in blocks(np.flatnonzero(side == 0)) for b in blocks(np.flatnonzero(side == 1))]
    else:
        every = blocks(np.arange(len(sets)))
        met = [(a, b) for i, a in enumerate(every) for b in every[i:]]
    for a, b in met:
        if (comp[a] == comp[b[0]]).all() and (comp[b] == comp[b[0]]).all():
            continue
        own = a if a is b else np.concatenate([a, b])
        _, word, times = np.unique(np.concatenate([sets[i] for i in own.tolist()]), return_inverse=True, return_counts=True)
        shared = times[word] > 1  # what a single set has is in no intersection
        ends = np.concatenate([[0], np.cumsum(shared)])[np.concatenate([[0], np.cumsum(size[own])])]
        word, mark, first = word[shared].astype(np.int32), np.zeros(len(times), bool), len(own) - len(b)
        for x, i in enumerate(a.tolist()):
            skip = x + 1 if a is b else 0
            then = b[skip:]
            able = (comp[then] != comp[i]) & (np.minimum(size[then], size[i]) >= threshold * np.maximum(size[then], size[i]) - 1e-6)
            if not able.any():
                continue
            cuts = ends[first + skip :]
            mine = word[ends[x] : ends[x + 1]]
            mark[mine] = True
            count = np.zeros(len(word) - cuts[0] + 1, np.int32)
            np.cumsum(mark[word[cuts[0] :]], out=count[1:])
            both = np.diff(count[cuts - cuts[0]])
            mark[mine] = False
            of = size[then] + size[i] - both
            hit = then[able & (np.divide(both, of, out=np.ones(len(then)), where=of > 0) >= threshold)]
            if len(hit):
                joined, which = np.unique(comp[hit], return_index=True)
                out += [(i, j) for j in hit[which].tolist()]
                comp[np.isin(comp, joined)] = comp[i]
    return out


def classes(docs: DataFrame, threshold: float = 0.8, bands: int = 25, rows: int = 5, shingle: int = SHINGLE, seed: int = 1, limit: int = 512, doc_id: str = "doc_id", text: str = "text", key_bits: int = 64) -> DataFrame:
    """One row per document: ``doc_id``, ``h`` (XXH64 of its text) and ``root``, which is equal for documents that links of
    a Jaccard similarity of at least ``threshold`` (over distinct shingles) connect.

    Signatures are cut into ``bands`` of ``rows`` values; equal shingle sets are one entry, so copies never meet (sets that
    share the key of 64 bits, ``key_bits`` in tests, are told apart by another 64). First the
    sets of each bucket are compared with one of them, which costs a large group of near copies one pass. Where more
    than one component is left in a bucket, all its pairs between components are compared. Every link is an exact
    similarity; a pair that shares a band is left out only when links already connect it.
    """
    own, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    slim = docs.select(own.alias("doc_id"), F.xxhash64(body).alias("h"), _signed(body, shingle, bands * rows, seed, key_bits).alias("x"))
    slim = _keyed(settle(slim.select("doc_id", "h", "x.key", "x.check", "x.sig"), "signatures"))
    each = F.array(*[F.struct(F.lit(i).alias("t"), F.xxhash64(F.substring("sig", 4 * rows * i + 1, 4 * rows)).alias("k")) for i in range(bands)])
    tables = slim.groupBy("key").agg(F.first("sig").alias("sig")).select("key", F.explode(each).alias("x")).select("key", "x.t", "x.k")
    shared = tables.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("key").alias("pivot")).where("n > 1")
    met = settle(tables.join(shared, ["t", "k"]), "minhash-bands")
    return verified_classes(docs, slim, met, threshold, shingle, limit, doc_id, text)


def verified_classes(docs: DataFrame, slim: DataFrame, met: DataFrame, threshold: float, shingle: int, limit: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``h`` and ``root`` for ``slim`` (doc_id, h, key) whose sets ``met`` in buckets (t, k, key, n, pivot): ``n`` sets
    are in a bucket, ``pivot`` is one of them. Links are pairs of a bucket whose Jaccard similarity, computed exactly, is at least ``threshold``."""
    own, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    named = slim.join(met.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("r"))
    named = named.select("key", F.col("r.doc_id").alias("__id"), F.col("r.h").alias("__h"))
    texts = docs.select(own.alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("text"))
    sets = texts.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")))
    sets = settle(sets.dropDuplicates(["key"]).select("key", _set(F.col("text"), shingle).alias("set")), "shingle-sets")

    first = settle(_verified(met.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct(), sets, threshold), "verified-links")
    comps = settle(connected_components(first).select(F.col("node").alias("key"), "component"), "verified-components")
    left = met.where("n > 2").join(comps, "key", "left").select("t", "k", "key", "n", F.coalesce("component", "key").alias("comp"))
    mixed = left.groupBy("t", "k").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("t", "k")
    rest = settle(left.join(mixed, ["t", "k"], "left_semi"), "unlinked")
    keys = ["t", "k", "lo", "hi"]
    dealt = _chunked(rest, limit).join(sets, "key").select(*keys, "side", "key", "comp", "set")

    def compare(batches):
        for part, cut in _groups(batches, keys):
            if not len(part):
                continue
            lo, hi, side, key, comp = (part.column(c).to_numpy() for c in ("lo", "hi", "side", "key", "comp"))
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in part.column("set")]
            src, dst = [], []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
                for i, j in _joins(comp[a:b], side[a:b], lo[a] != hi[a], sets[a:b], threshold, limit):
                    src.append(key[a + i])
                    dst.append(key[a + j])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    then = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "src long, dst long")
    roots = connected_components(first.unionByName(then)).select(F.col("node").alias("key"), "component")
    return slim.select("doc_id", "h", "key").join(roots, "key", "left").select("doc_id", "h", F.coalesce("component", "key").alias("root"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 25, rows: int = 5, shingle: int = SHINGLE, seed: int = 1, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``class_id``, the smallest id that links of a Jaccard similarity of at least
    ``threshold`` (over distinct shingles) reach, its own included.

    See ``classes``: sets that agree in a band meet and are verified exactly. A pair at the threshold of 0.8 misses all
    25 bands of 5 with a probability of 0.00005. Null and wordless texts have the empty set and are copies of each
    other. A null id is never a class unless all its class is. Repeated rows stay, an empty table gives an empty result.
    """
    placed = classes(docs, threshold, bands, rows, shingle, seed, limit, doc_id, text)
    heads = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return placed.join(heads, "root").select("doc_id", "class_id")
