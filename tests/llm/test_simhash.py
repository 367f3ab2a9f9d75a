import numpy as np
import pytest
import xxhash

from kinfold.llm import simhash

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (5, "ONE  two\n"), (6, "a b c d e f"), (7, "x" * 5000 + " y z"), (None, "one two"), (8, "é\x1cü b\x85c d")]


def brute(text, n):
    w = []
    for ch in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""):
        if ch in " \t\n\x0b\x0c\r":
            w.append("")
        elif w:
            w[-1] += ch
        else:
            w = [ch]
    w = [x for x in w if x]
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_fingerprints_equal_brute_force():
    for _, t in ODD:
        assert simhash.fingerprint(t.encode() if t is not None else None, 3) == brute(t, 3)


def test_components_equal_brute_force_with_hot_buckets(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for c in np.repeat(centre, 12)]
    fps += [int(centre[0]) ^ (1 << b) ^ (1 << c) for b in range(32) for c in range(b)]  # one large group of near copies
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3).tolist():
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    for limit in (8, simhash.LIMIT):
        links = simhash.links(df, limit=limit)
        from kinfold.operators.graph import connected_components

        comp = {r.node: r.component for r in connected_components(links).collect()}
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        groups = {}
        for i, f in enumerate(signed):
            groups.setdefault(comp.get(f, f), set()).add(find(i))
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(i) for i in range(len(fps))})


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in ODD], "doc_id long, text string, fp string, h int")
    got = [(r.doc_id, r.component_id) for r in simhash.components(df, shingle=3).collect()]
    by = dict(got)
    assert len(got) == len(ODD) and by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4 and by[None] == 4 and by[6] == 6 and by[7] == 7
    assert simhash.components(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 7, 8]


def test_near_copies_of_similarity_080_are_caught_and_others_kept(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(5000)]
    rows, copies, i = [], [], 0
    for _ in range(40):
        base = rng.choice(vocab, 300).tolist()
        rows.append((i, " ".join(base)))
        i += 1
        near = list(base)
        for at in range(10, 300, 60):  # five words: similarity about 0.84
            near[at] = f"new{i}"
        copies.append(i)
        rows.append((i, " ".join(near)))
        i += 1
        rows.append((i, " ".join(base[:120] + rng.choice(vocab, 180).tolist())))  # a shared passage: about 0.25
        i += 1
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(kept & set(copies)) <= 2 and len(kept) >= 80


def test_blocks_cover():
    assert len(simhash.masks()) == 20
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.choice(64, 3, replace=False)
        d = sum(1 << int(b) for b in x)
        assert any(d & (m & (1 << 64) - 1) == 0 for m in simhash.masks())


@pytest.mark.parametrize("n", [1, 2, 50])
def test_forest_spans(n):
    fps = np.arange(n, dtype=np.uint64)
    assert len(simhash.forest(fps, 64)) == n - 1


def pairs_at(shared, own, count, seed):
    """Texts of pairs of documents that have ``shared`` shingles of five words in common and ``own`` each besides."""
    rng, out = np.random.default_rng(seed), []
    for p in range(count):
        same = [f"p{p}s{x}" for x in rng.permutation(shared + 4)]
        out += [" ".join(same + [f"p{p}{side}{x}" for x in range(own)]) for side in "ab"]
    return out


def test_every_pair_at_080_is_caught(spark):
    texts = pairs_at(160, 20, 300, 5)  # 160 of 200: exactly 0.8
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(range(0, 600, 2))


def test_pairs_below_080_are_left_alone(spark):
    texts = pairs_at(150, 25, 100, 6) + pairs_at(159, 20, 100, 7)  # 0.75, and just below 0.8
    texts = [t.replace("p", f"g{i // 200}p") for i, t in enumerate(texts)]  # the two lists have no word in common
    kept = simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert kept == len(texts)


def test_copies_without_an_id_are_kept_once(spark):
    a, b, c, d = pairs_at(160, 20, 2, 8)  # a and b are near copies, and so are c and d
    rows = [(1, a)] + [(None, a)] * 3 + [(None, b)] + [(None, c)] * 4 + [(None, d)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept].count(1) == 1 and len(kept) == 3 and sum(r.text in (c, d) for r in kept) == 1


def test_the_stage_finds_its_pairs_by_simhash(spark, monkeypatch):
    from kinfold.llm import minhash

    def never(*_, **__):
        raise AssertionError("pairs must come from SimHash fingerprints")

    monkeypatch.setattr(minhash, "classes", never)
    monkeypatch.setattr(minhash, "_signed", never)
    texts = pairs_at(160, 20, 20, 9)
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(range(0, 40, 2))


def wide_clusters(count, size, seed):
    """Wide fingerprints around ``count`` centres, up to 30 bits from them."""
    rng, out = np.random.default_rng(seed), []
    for centre in rng.integers(0, 2, (count, simhash.WIDTH), dtype=np.uint8):
        for _ in range(size):
            own = centre.copy()
            own[rng.choice(simhash.WIDTH, rng.integers(0, 31), replace=False)] ^= 1
            out.append(own)
    return np.packbits(np.array(out), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def test_reach_equals_brute_force():
    fps = wide_clusters(40, 5, 2)
    for near in (0, 40, simhash.NEAR):
        close, seen = simhash._apart(fps, fps) <= near, np.arange(len(fps))
        for _ in range(len(fps)):
            seen = np.where(close, seen, len(fps)).min(1)
        label = simhash.reach(fps, near, block=3)
        assert ((label[:, None] == label) == (seen[:, None] == seen)).all()
    # further blocks miss a pair with a probability, and connect nothing else
    label, whole = simhash.reach_in(fps, 4, part=50), simhash.reach(fps)
    assert len(set(zip(label.tolist(), whole.tolist()))) == len(set(label.tolist())) <= 60


def test_buckets_hold_every_near_pair_of_a_block(spark):
    fps = wide_clusters(12, 8, 4)
    df = spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(fps.view(np.int64))], "key long, w0 long, w1 long, w2 long, w3 long")
    meet = (((fps.view(np.uint8)[:, None] ^ fps.view(np.uint8)) & 63) == 0).any(2) & (simhash._apart(fps, fps) <= simhash.NEAR)
    for crowd in (simhash.CROWD, 4):
        held, sizes = {}, {}
        for r in simhash.wide_buckets(df, crowd=crowd).collect():
            held.setdefault(r.k, set()).add(r.key)
            sizes[r.k] = r.n
            assert r.pivot // 8 == r.key // 8
        assert all(len(held[k]) == n for k, n in sizes.items())
        got = {(a, b) for s in held.values() for a in s for b in s}
        assert all((i, j) in got for i, j in np.argwhere(meet).tolist())


def test_rows_of_a_bucket_grow_with_its_size_not_its_square(spark):
    """Every pair of a bucket between components meets, though a row is copied a bounded number of times."""
    from kinfold.llm import minhash

    def bucket(n):  # a few large components, many of one set
        return spark.createDataFrame([(0, 7, i, i % 3 if i % 2 else i, n) for i in range(n)], "t int, k long, key long, comp long, n long")

    assert minhash._chunked(bucket(2000), 512).count() == 2000
    for n in (300, 1200):
        rows = minhash._chunked(bucket(n), 4).collect()
        assert n < len(rows) <= 3 * minhash.WAYS * n
        pairs, comp = set(), {r.key: r.comp for r in rows}
        sides = {}
        for r in rows:
            sides.setdefault((r.lo, r.hi), ([], []))[r.side].append(r.key)
        for (lo, hi), (a, b) in sides.items():
            pairs |= {frozenset((x, y)) for x in a for y in (a if lo == hi else b) if x != y}
        assert len(comp) == n and all(frozenset((x, y)) in pairs for x in range(n) for y in range(x) if comp[x] != comp[y])


def test_a_group_of_near_copies_has_the_classes_of_all_pairs(spark):
    from kinfold.llm import minhash
    from kinfold.llm.common import shingles

    rng = np.random.default_rng(12)
    base, texts = [f"b{i}" for i in range(120)], []
    for i in range(150):  # 0.6 to 0.9 alike, some linked by chains only
        own = list(base)
        for at in rng.choice(120, rng.integers(1, 5), replace=False):
            own[at] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(own))
    sets = [np.unique(shingles(t.encode(), 5)) for t in texts]
    root = np.arange(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if minhash.jaccard(sets[i], sets[j]) >= 0.8:
                root[root == root[j]] = root[i]
    assert 5 < len(set(root.tolist())) < 150
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (2, 512):
        got = {r.doc_id: r.root for r in simhash.classes(df, limit=limit).collect()}
        assert len(set(zip(root.tolist(), (got[i] for i in range(150))))) == len(set(root.tolist())) == len(set(got.values()))


@pytest.mark.parametrize("across", [False, True])
def test_joins_connect_what_all_pairs_connect(across):
    from kinfold.llm import minhash

    rng = np.random.default_rng(13)
    for limit in (1, 3, 512):
        for _ in range(30):
            n, words = int(rng.integers(1, 30)), rng.integers(0, 1 << 63, 20, dtype=np.uint64)
            sets = [np.unique(rng.choice(words, rng.integers(0, 20), replace=False)) for _ in range(n)]
            comp, side = rng.integers(0, n, n), rng.integers(0, 2, n)
            want = comp.copy()
            for i in range(n):
                for j in range(i):
                    if (not across or side[i] != side[j]) and minhash.jaccard(sets[i], sets[j]) >= 0.6:
                        want[want == want[j]] = want[i]
            got = comp.copy()
            for i, j in minhash._joins(comp, side, across, sets, 0.6, limit):
                assert minhash.jaccard(sets[i], sets[j]) >= 0.6 and got[i] != got[j] and (not across or side[i] != side[j])
                got[got == got[j]] = got[i]
            assert len(set(zip(want.tolist(), got.tolist()))) == len(set(want.tolist())) == len(set(got.tolist()))
