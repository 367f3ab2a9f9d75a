"""SimHash near-duplicates: pigeonhole blocks, then verified Hamming distance.

A fingerprint has 64 bits; each is the majority vote of that bit over the XXH64 hashes of
the text's word shingles. Fingerprints at most ``distance`` bits apart agree in at least
``blocks - distance`` of ``blocks`` blocks of bits, so every such pair shares the value of
one of C(blocks, distance) choices of blocks. Distinct fingerprints are dealt by each such
choice, compared inside it, and linked; copies of a fingerprint never meet.

Scale: with 6 blocks and distance 3 there are 20 choices of about 32 bits each, so the
share of chance candidates stays small (n^2 / 2^32 a choice). A bucket with more than
``LIMIT`` fingerprints is cut into chunks whose pairs are compared in tasks of their own,
and every task emits a spanning forest of its links, not all of them: no link between
components is lost, no quadratic output is made.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..runtime import settle
from .common import fresh, shingles, words

BITS = 64
LIMIT = 2048  # fingerprints compared in one task at once


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; 0 for null and for texts without words."""
    import xxhash

    w = words(text)
    if not w:
        return 0
    if len(w) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    joined = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(w) - shingle + 1].tolist()
    hash_ = xxhash.xxh64_intdigest
    h = np.fromiter([hash_(joined[a:b], 42) for a, b in zip(start, end[shingle - 1 :].tolist())], np.uint64, len(start))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def simhash(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long column (whole texts; null gives 0)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = (fingerprint(t, shingle) for t in texts.cast(pa.binary()).to_pylist())
        return pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))

    return of(text)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def masks(blocks: int = 6, distance: int = 3) -> list[int]:
    """Bit masks (signed) of every choice of ``blocks - distance`` blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    full = [sum(c) for c in combinations(each, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in full]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs that span the components of ``fps`` (a row of words each, or one word) under Hamming distance <=
    ``distance``. Only what isn't reached yet is compared, so a group of copies costs one pass, not one for each."""
    rest, out = np.arange(len(fps)), []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            apart = np.bitwise_count(fps[rest] ^ fps[i])
            near = (apart if apart.ndim == 1 else apart.sum(1)) <= distance
            if near.any():
                new = rest[near].tolist()
                rest = rest[~near]
                out += [(i, j) for j in new]
                todo += new
    return out


def _groups(batches, keys: list[str]):
    """Tables of whole groups of rows that are sorted by ``keys``, across batch borders, and where groups begin."""
    kept = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if kept is not None:
            t = pa.concat_tables([kept, t])
        cols = [t.column(k).to_numpy() for k in keys]
        if not len(t):
            continue
        new = np.zeros(len(t), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(new)
        last = int(cut[-1]) if len(cut) else 0
        yield t.slice(0, last), cut[:-1] if len(cut) else cut
        kept = t.slice(last)
    if kept is not None:
        yield kept, np.array([], np.int64)


def _dealt(tables: DataFrame, limit: int, carried: list[str]) -> tuple[DataFrame, list[str]]:
    """``tables`` (t, k, and ``carried``, whose first column names a fingerprint) with chunk numbers lo and hi, and the keys of what is compared together: whole
    buckets, or pairs of chunks of a bucket with more than ``limit`` fingerprints."""
    counts = tables.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    hot = settle(counts, "hot-blocks")
    chunks = F.coalesce(F.ceil(F.col("n") / F.lit(limit // 2)), F.lit(1)).cast("int")
    dealt = (
        tables.join(hot, ["t", "k"], "left")
        .withColumn("of", chunks)
        .withColumn("c", F.pmod(F.xxhash64(carried[0]), F.col("of")).cast("int"))
        .withColumn("d", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        .select("t", "k", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), *carried)
    )
    return dealt, ["t", "k", "lo", "hi"]


def links(fps: DataFrame, distance: int = 3, blocks: int = 6, limit: int = LIMIT) -> DataFrame:
    """(src, dst) longs that connect the distinct ``fp`` values of ``fps`` which chains of
    steps of at most ``distance`` bits connect: a spanning subset of all links."""
    tables = fps.select("fp").distinct().select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(blocks, distance))])).alias("x")
    ).select("fp", "x.t", "x.k")
    dealt, keys = _dealt(tables, limit, ["fp"])

    def compare(batches):
        for rows, cut in _groups(batches, keys):
            fp = np.ascontiguousarray(rows.column("fp").to_numpy()).view(np.uint64)
            start = np.concatenate([[0], cut]).astype(np.int64)
            stop = np.concatenate([cut, [len(fp)]]).astype(np.int64)
            src, dst = [], []
            size = stop - start
            two = start[size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance] if len(two) else two
            src.append(fp[near])
            dst.append(fp[near + 1])
            for a, b in zip(start[size > 2].tolist(), stop[size > 2].tolist()):
                part = fp[a:b]
                if pairs := forest(part, distance):
                    i, j = np.array(pairs).T
                    src.append(part[i])
                    dst.append(part[j])
            s, d = np.concatenate(src), np.concatenate(dst)
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(d.view(np.int64))], ["src", "dst"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "src long, dst long")


def _components_of(slim: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``slim`` (doc_id, fp and more) with ``component_id``."""
    classes = slim.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comps = connected_components(links(classes, distance, blocks)).select(F.col("node").alias("fp"), "component")
    rooted = classes.join(comps, "fp", "left").withColumn("root", F.coalesce("component", "fp")).select("fp", "first", "root")
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return slim.join(rooted.join(heads, "root").select("fp", "component_id"), "fp", "left")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 3, blocks: int = 6) -> DataFrame:
    """One row per document: its id as ``doc_id``, ``fp`` (long) and ``component_id``.

    Documents are linked when their fingerprints differ in at most ``distance`` bits;
    ``component_id`` is the smallest id reachable through links, its own included. Null and
    wordless texts have fingerprint 0 and are linked like any other. A null id never becomes
    a component id unless all ids of a component are null, where it is null. Repeated rows
    stay; an empty table gives an empty result; other columns are ignored.
    """
    slim = settle(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text), shingle).alias("fp")), "fingerprints")
    return _components_of(slim, distance, blocks).select("doc_id", "fp", "component_id")


# Near-duplicates by Jaccard similarity: wide fingerprints, whose distance passes pairs on to an exact check. A pair of sets of similarity
# 0.8 differs in about 15 % of the bits, in at most 19 % on average where sets are as small as they can be (4 of 5 shingles).
WIDTH, NEAR, BLOCK = 256, 72, 6
PART = 4096  # fingerprints compared by all pairs
CROWD = 1 << 18  # fingerprints of a bucket that one task takes
_SALT = np.random.default_rng(11).integers(0, 1 << 63, WIDTH // BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(x: np.ndarray) -> np.ndarray:
    """SimHash of ``WIDTH`` bits, as words, of a set of shingle hashes; every other bit is 1 on a tie."""
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, len(x), 255 * 64):
        h = x[at : at + 255 * 64, None] * _SALT
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # sums that fit a byte
            ones += bits[part : part + 255].sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 + np.arange(WIDTH) % 2 > len(x), bitorder="little").view("<u8").astype(np.uint64)


def _wide(text: Column, shingle: int, key_bits: int = 64) -> Column:
    """``key`` and ``check``, two hashes of the set of shingles, ``size``, how many it has, and ``w0`` and on, the words of its wide fingerprint."""
    names = [f"w{i}" for i in range(WIDTH // BITS)]

    @F.arrow_udf(f"struct<key: long, check: long, size: long, {', '.join(f'{n}: long' for n in names)}>")
    def of(texts: pa.Array) -> pa.Array:
        import xxhash

        sets = [np.unique(shingles(t, shingle)) for t in texts.cast(pa.binary()).to_pylist()]
        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes(), 5) for x in sets), np.int64).reshape(-1, 2)
        fps = np.array([wide_fingerprint(x) for x in sets], np.uint64).reshape(-1, len(names)).view(np.int64)
        cols = [both[:, 0] & ((1 << key_bits) - 1) if key_bits < 64 else both[:, 0], both[:, 1], np.fromiter(map(len, sets), np.int64, len(sets)), *fps.T]
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["key", "check", "size", *names])

    return of(text)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all of ``a`` to all of ``b`` (a row of words each)."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def reach(fps: np.ndarray, near: int = NEAR, block: int = 64) -> np.ndarray:
    """For each of ``fps`` (a row of words each) the index of one that chains of at most ``near`` bits a step connect it with, the
    same for all that they connect. What is reached is compared only with what is not, so a group of near copies costs one pass."""
    label, open_, rest = np.arange(len(fps)), np.ones(len(fps), bool), np.arange(len(fps))
    while len(rest):
        seeds = rest[:block]
        close = _apart(fps[seeds], fps[rest]) <= near
        close[np.arange(len(seeds)), np.arange(len(seeds))] = False
        alone = ~close.any(1)
        open_[seeds[alone]] = False
        for seed in seeds[~alone].tolist():
            if not open_[seed]:
                continue
            open_[seed], todo = False, np.array([seed])
            while len(todo):
                rest = rest[open_[rest]]
                hit = rest[(_apart(fps[todo[:block]], fps[rest]) <= near).any(0)]
                label[hit], open_[hit] = seed, False
                todo = np.concatenate([todo[block:], hit])
        rest = rest[open_[rest]]
    return label


def reach_in(fps: np.ndarray, table: int, near: int = NEAR, part: int = PART) -> np.ndarray:
    """``reach`` among the fingerprints of one bucket of ``table``. Where they are more than ``part``, those are compared that
    share one of several further blocks of bits, as many as a pair 19 % apart misses with a probability of at most 0.05."""
    if len(fps) <= part:
        return reach(fps, near)
    bits = int(np.ceil(np.log2(len(fps) / part))) + 1
    times = int(np.ceil(np.log(0.05) / np.log(1 - 0.8125**bits)))
    free = np.setdiff1d(np.arange(WIDTH), 8 * table + np.arange(BLOCK))
    order = np.resize(np.random.default_rng(table).permutation(free), bits * times).reshape(times, bits)
    label = np.arange(len(fps))
    for places in order:
        value = np.zeros(len(fps), np.int64)
        for i, p in enumerate(places.tolist()):
            value |= (fps[:, p // BITS] >> np.uint64(p % BITS) & np.uint64(1)).astype(np.int64) << i
        by = np.argsort(value, kind="stable")
        for run in np.split(by, np.flatnonzero(np.diff(value[by])) + 1):
            label = _joined(label, run, run[reach(fps[run], near)])
    return label


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of classes, those of ``a`` and of ``b``, place by place, made one."""
    a, b = a[label[a] != label[b]], b[label[a] != label[b]]
    while len(a):
        least, most = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        to = np.arange(len(label))
        np.minimum.at(to, most, least)
        while (then := to[to] != to).any():
            to = np.where(then, to[to], to)
        label = to[label]
        a, b = a[label[a] != label[b]], b[label[a] != label[b]]
    return label


def wide_buckets(fps: DataFrame, near: int = NEAR, crowd: int = CROWD, part: int = PART) -> DataFrame:
    """(t, k, key, n, pivot): what pairs of the fingerprints ``fps`` (key, w0 and on) that share a block and are at most ``near`` bits apart
    connect, bucket by bucket: ``n`` keys, of which ``pivot`` is the nearest to their majority. Equal classes are one.

    The low ``BLOCK`` bits of each byte are a block, so there are 32 tables. A pair whose bits differ by 15 % misses them all with a
    calculated probability of 0.0000003, by 19 % of 0.00002. More than ``crowd`` fingerprints of a bucket are cut into chunks, whose pairs
    are tasks of their own.
    """
    words = [f"w{i}" for i in range(WIDTH // BITS)]
    each = [F.shiftrightunsigned(F.col(w), 8 * i).bitwiseAND(F.lit((1 << BLOCK) - 1)) for w in words for i in range(BITS // 8)]
    tables = fps.select("key", *words, F.posexplode(F.array(*each)).alias("t", "k"))
    dealt, keys = _dealt(tables, crowd, ["key", *words])

    def compare(batches):
        import xxhash

        for rows, cut in _groups(batches, keys):
            if not len(rows):
                continue
            key, table = rows.column("key").to_numpy(), rows.column("t").to_numpy()
            fp = np.stack([rows.column(w).to_numpy() for w in words], 1).view(np.uint64)
            out: list[list] = [[], [], [], []]
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
                label = reach_in(fp[a:b], int(table[a]), near, part)
                by = np.argsort(label, kind="stable")
                for own in np.split(by, np.flatnonzero(np.diff(label[by])) + 1):
                    if len(own) < 2:
                        continue
                    own = a + own[np.argsort(key[a + own])]
                    pivot = own[0]
                    if len(own) > 2:
                        bits = np.unpackbits(fp[own].view(np.uint8), axis=1)
                        most = np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(own)).view(np.uint64)
                        pivot = own[np.bitwise_count(fp[own] ^ most).sum(1, dtype=np.int64).argmin()]
                    for c, v in zip(out, (np.full(len(own), xxhash.xxh64_intdigest(key[own].tobytes()), np.uint64).view(np.int64), key[own], np.full(len(own), len(own)), np.full(len(own), key[pivot]))):
                        c.append(v)
            if out[0]:
                k, of, n, pivot = (pa.array(np.concatenate(c)) for c in out)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(k), np.int32)), k, of, n, pivot], ["t", "k", "key", "n", "pivot"])

    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "t int, k long, key long, n long, pivot long")
    return found.dropDuplicates(["k", "key"])


def classes(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, near: int = NEAR, limit: int = 512, crowd: int = CROWD, part: int = PART, key_bits: int = 64) -> DataFrame:
    """One row per document: ``doc_id``, ``h`` (XXH64 of its text) and ``root``, which is equal for documents that links connect: pairs whose
    wide fingerprints share a block and are at most ``near`` bits apart, and whose Jaccard similarity over distinct shingles, computed
    exactly, is at least ``threshold``. Equal shingle sets are one entry, told apart as in ``minhash.classes``."""
    from .minhash import _keyed, verified_classes

    body = F.col(f"`{text}`")
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("h"), _wide(body, shingle, key_bits).alias("x"))
    slim = _keyed(settle(slim.select("doc_id", "h", "x.*"), "wide-fingerprints"))
    words = [f"w{i}" for i in range(WIDTH // BITS)]
    able = slim.where(F.col("size") / (F.col("size") + 1) >= threshold - 1e-9)  # of smaller sets only equal ones are as similar
    met = settle(wide_buckets(able.groupBy("key").agg(*[F.first(w).alias(w) for w in words]), near, crowd, part), "simhash-buckets")
    return verified_classes(docs, slim, met, threshold, shingle, limit, doc_id, text)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all its columns kept.

    Near-duplicates have a Jaccard similarity of 0.8 or more over distinct shingles of five words. Pairs are found by wide SimHash
    fingerprints, which share a block and are at most ``NEAR`` bits apart, and each link is verified exactly (``classes``); groups are what the
    links connect. The one kept has the smallest id (among rows that repeat that id, the least text hash; whole
    repeats count once). Rows with a null id are grouped like any other; nothing names them, so each group also keeps one
    of its own, the one of the least text hash. Wordless and null texts are copies of each other. An empty table gives an
    empty result.
    """
    slim = classes(docs, shingle=shingle, doc_id=doc_id, text=text)
    keep = slim.groupBy("root", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "h")).alias("k"))
    i, h, kept_h = fresh(docs, "__id", "__h", "__kh")
    keep = keep.select(F.col("k.doc_id").alias(i), F.col("k.h").alias(kept_h))
    keyed = docs.withColumn(h, F.xxhash64(F.col(f"`{text}`")))
    kept = keyed.join(keep, F.col(f"`{doc_id}`").eqNullSafe(F.col(i)) & (F.col(h) == F.col(kept_h)), "left_semi")
    return kept.dropDuplicates([doc_id, h]).drop(h)
