import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from kinfold.llm import lm, minhash, quality

TEXTS = ["a b c d e f g", None, "", " \n ", "A B\tc  d e f g", "x", "x y", "é ü " * 40, "a b c d e f g", "z " * 2000, "one two three four five six seven eight nine ten"]


def table(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "clash") for i, t in enumerate(texts)] + [(None, "null id here", "c")], "doc_id long, text string, score string")


def toks(t):
    return (t or "").encode().lower().split() + [None]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_scores_equal_a_plain_model(spark, order):
    rnd = random.Random(7)
    texts = TEXTS + [" ".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(30))) for _ in range(60)]
    df = table(spark, texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id here")]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    grams = [Counter() for _ in range(order)]
    for i, t in rows:
        if not held[i]:
            s = [None, *toks(t)]
            for m in range(1, order + 1):
                grams[m - 1].update(tuple(s[k - m + 1 : k + 1]) for k in range(max(1, m - 1), len(s)))
    n, v = sum(grams[0].values()), len(grams[0])
    got = {r.doc_id: r for r in lm.score(df, order=order, mu=5.0, power=0.6, block_bytes=3000).collect()}
    # ranges of shards, and cells of blocks that merge what they send there
    again = {r.doc_id: r for r in lm.score(df, order=order, mu=5.0, power=0.6, block_bytes=1000, fan=2).collect()}
    rounded = lambda rows: {k: (*r[:5], round(r[5], 9), round(r[6], 9)) for k, r in rows.items()}
    assert rounded(again) == rounded(got)
    assert len(got) == len(rows) and any(held.values())
    for i, t in rows:
        s, base, total = [None, *toks(t)], 0.0, 0.0
        for k in range(1, len(s)):
            p = (grams[0][(s[k],)] + 1) / (n + v + 1)
            base += math.log10(p)
            for m in range(2, order + 1):
                if k >= m - 1:
                    ctx = tuple(s[k - m + 1 : k])
                    mass = 5 * max(1, grams[m - 2][ctx]) ** 0.6
                    p = (grams[m - 1][(*ctx, s[k])] + mass * p) / (grams[m - 2][ctx] + mass)
            total += math.log10(p)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(s) - 1, sum(grams[0][(x,)] > 0 for x in s[1:]), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(total)


def test_scoring_without_rows_and_from_no_files(spark):
    df = table(spark, ["a b"])
    assert lm.score(df.limit(0)).count() == 0
    only = lm.score(df.where("doc_id = 0"), held_modulus=1, held_remainder=0).first()
    assert only.train_tokens == 0 and only.n_known == 0 and only.score == pytest.approx(0.0)


def jaccard(a, b):
    def sh(t):
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    a, b = sh(a), sh(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def signature_of(t):
    """The least of each permutation, one by one, over the hashes of the text's shingles."""
    x = [int(v) for v in minhash.shingle_hashes(t.encode())]
    a, b = (v.tolist() for v in minhash.coefficients())
    return "".join(f"{min(((p * v + q) % (1 << 64) >> 32 for v in x), default=0xFFFFFFFF):08x}" for p, q in zip(a, b))


def test_edited_fingerprints(spark):
    rnd = random.Random(8)
    texts = TEXTS + [" ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(5, 300))) for _ in range(80)]
    texts += [t + " tail" for t in texts[-20:]]
    more = [(5, "x")] + [(None, f"w{i} w{i + 1} w{i // 3}") for i in range(60)] + [(7, "same")] * 9
    df = table(spark, texts).unionByName(spark.createDataFrame([(*r, "") for r in more], "doc_id long, text string, score string"))
    plain = [(i, t) for i, t in enumerate(texts)] + more + [(None, "null id here")]
    rows = sorted(plain, key=lambda r: (r[0] is None, -(r[0] or 0), -xxhash.xxh64_intdigest((r[1] or "").encode(), 42) + ((1 << 64) if xxhash.xxh64_intdigest((r[1] or "").encode(), 42) >> 63 else 0)))
    texts_of = spark.createDataFrame([(None if i is None else f"{i:05d}", t) for i, t in plain], "k string, text string")
    for parts in ("2", "5", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {}
        for r in minhash.edited(df).collect():
            got.setdefault(r.doc_id, []).append(r)
        by_name = {}
        for r in minhash.edited(texts_of, doc_id="k").collect():
            by_name.setdefault(r.doc_id, []).append(tuple(r)[1:])
        assert {k and int(k): sorted(v) for k, v in by_name.items()} == {k: sorted(tuple(r)[1:] for r in v) for k, v in got.items()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sum(map(len, got.values())) == len(rows)
        for k, (i, t) in enumerate(rows):
            t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
            c = len(t) // 3
            e = t[: len(t) - c] + nxt[:c]
            own = [r for r in got[i] if r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()]
            assert own and own[0].fingerprint == signature_of(t) and own[0].edited_fingerprint == signature_of(e) and abs(own[0].near_edited - jaccard(t, e)) < 0.2 and any(abs(r.near_next - jaccard(t, nxt)) < 0.2 for r in own)
    a, b = minhash.coefficients()
    assert minhash.signature(minhash.shingle_hashes(b"a b c d e f"), a, b).tolist() == minhash.signature(minhash.shingle_hashes(b"A b c  d e F"), a, b).tolist()


def test_edited_of_one_and_of_no_document(spark):
    df = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    r = minhash.edited(df).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0 and minhash.edited(df.limit(0)).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(25):
        base = rng.choice(vocab, 200).tolist()
        texts.append(" ".join(base))
        for edits in (1, 3, 12):
            near = list(base)
            for at in rng.choice(200, edits, replace=False):
                near[at] = "new"
            texts.append(" ".join(near))
    hot = rng.choice(vocab, 100).tolist()
    texts += [" ".join([*hot[:50], f"v{i}", *hot[51:]]) for i in range(60)] + [" ".join(hot)] * 5 + ["", None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parent, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, limit=16).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    # keys of eight bits: most sets share theirs with another one, and are told apart
    few = minhash.classes(df, key_bits=8).collect()
    groups = {}
    for r in few:
        groups.setdefault(r.root, set()).add(find(r.doc_id))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(i) for i in range(len(texts))})
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    rnd = random.Random(10)
    good = lambda: " ".join(rnd.choice(["the", "river", "flows", "over", "stone", "and", "sand"]) for _ in range(rnd.randrange(5, 60)))
    bad = lambda: " ".join(rnd.choice(["WIN!!", "CASH$$$", "now|", "click###"]) for _ in range(rnd.randrange(5, 60)))
    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(400)]
    docs = table(spark, [r[1] for r in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    held = [r for r in out if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) == 401 and len(held) > 50 and all(r.predicted == int(r.doc_id % 4 > 0) for r in held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 3000), (3, "x" * 3000)], "doc_id long, text string")
    none = quality.classify(odd, labels.limit(0)).collect()
    assert len(none) == 4 and len({r.score for r in none}) == 1 and quality.classify(odd.limit(0), labels).count() == 0
    one = quality.classify(odd, labels.where("quality = 1")).collect()
    assert all(r.score > 0.6 for r in one)


def test_features_are_shared_by_training_and_scoring():
    rng = np.random.default_rng(1)
    m = quality.Model(rng.normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32), rng.normal(size=(2, quality.DIM)).astype(np.float32), np.array([0.1, 0.3], np.float32))
    each, bias = m.feature_scores()
    texts = [b"some words, some more", b"", None, b"x", "é é é".encode(), b"y" * 500]
    got = quality._Scorer(each, bias).odds(texts)
    for t, z in zip(texts, got):
        at, share = quality.features(t)
        assert z == pytest.approx(bias + float(each[at] @ share), abs=1e-4)
    again = quality.Model.load(m.dump())
    assert np.allclose(again.emb, m.emb) and np.allclose(again.bias, m.bias)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_traversal_in_lanes_equals_one_lane_and_the_definition(order):
    rng = np.random.default_rng(order)
    texts = [" ".join(rng.choice(list("abcdefgh"), n)).encode() for n in (0, 1, 2, 5, 40, 300)] + [None]
    h, size = lm.stream(texts)
    at = lm.grams(h, size, order)
    counts = [np.where(rng.random(len(np.unique(x[ok]))) < 0.3, 0, np.unique(x[ok], return_counts=True)[1]) for x, ok in at]
    for m in range(1, order):  # an n-gram is as frequent as its parts at most
        for i, x in enumerate(np.unique(at[m][0][at[m][1]])):
            p = int(np.flatnonzero((at[m][0] == x) & at[m][1])[0])
            low = np.unique(at[m - 1][0][at[m - 1][1]])
            parts = [counts[m - 1][np.searchsorted(low, at[m - 1][0][q])] for q in (p - 1, p)]
            counts[m][i] = min(counts[m][i], *parts)
    own = []
    for m in range(order):
        own.append(lm.Level(at[: m + 1], None, own[-1] if own else None))
        own[-1].answer(counts[m], np.ones(len(counts[m]), bool))
    machine = lm.Automaton(own, int(counts[0].sum()), int((counts[0] > 0).sum()), 3.0)
    word = np.searchsorted(machine.words, h)
    whole = machine.traverse(word, size, lane=10**6)
    for lane in (max(1, order - 1), 7, 64):
        assert np.allclose(machine.traverse(word, size, lane), whole)
    # one text at a time, word by word, with one state
    begin = np.cumsum(size) - size
    for i in range(len(texts)):
        state, total = np.array([machine.start]), 0.0
        for w in word[begin[i] + 1 : begin[i] + size[i]]:
            weight, state = machine.step(state, np.array([w]))
            total += weight[0]
        assert total == pytest.approx(whole[i])
    assert (machine.fail_to[1:] < np.arange(1, machine.states)).all() and machine.states == 1 + sum(int((c > 0).sum()) for c in counts[: order - 1])


def test_words_equal_a_plain_split():
    texts = [" a\tB\nc \x0b\x0c\r", "a\x85b\xa0c d", "", None, "\x1cx Y", "a  b", "ÄÖ é", " ", "x" * 9000]
    known, words, size = lm.numbered(lm.pa.array([None if t is None else t.encode() for t in texts], lm.pa.binary()))
    plain = [[lm.END, *(xxhash.xxh64_intdigest(w, 11) for w in (t or "").encode().lower().split()), lm.END] for t in texts]
    assert known[words].tolist() == [h for p in plain for h in p] and size.tolist() == [len(p) for p in plain] and known.tolist() == sorted({h for p in plain for h in p})
    assert [len(x) for x in lm.numbered(lm.pa.array([], lm.pa.binary()))] == [1, 0, 0]


def test_scores_do_not_depend_on_order_or_partitions(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(50)], rng.integers(0, 60)))) for i in range(300)]
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    other = spark.createDataFrame([(i, i) for i in range(300)], "k long, v long")

    def told(d, **how):
        return {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(d, **how).collect()}

    whole = told(df)
    assert len(whole) == 300
    for d in (df.repartition(7), df.orderBy("text"), df.join(other, df.doc_id == other.k, "left"), df.repartition(1), df.coalesce(1).sortWithinPartitions("text")):
        assert told(d) == whole and told(d, block_bytes=2000) == whole


def test_training_equals_plain_gradient_steps():
    texts = [b"a good text of words", b"bad BAD $$$ click", b"good words again", b"click click now", None, b"a b a b a"]
    labels, rate, seed = [1, 0, 1, 0, 1, 0], 1.5, 3
    got = quality.train(texts, labels, epochs=3, updates=1, rate=rate, seed=seed)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM)).astype(np.float32)
    vec = {int(b): [float(x) for x in emb[b]] for t in texts for b in quality.features(t)[0]}
    out = [[0.0] * quality.DIM for _ in range(2)]
    bias = [math.log(3.5 / 7), math.log(3.5 / 7)]
    done, steps = 0, 18
    for _ in range(3):
        for r in rng.permutation(6):
            at, share = (x.tolist() for x in quality.features(texts[r]))
            lr = rate * (1 - done / steps)
            done += 1
            hidden = [sum(s * vec[b][d] for b, s in zip(at, share)) for d in range(quality.DIM)]
            z = [sum(o * h for o, h in zip(out[c], hidden)) + bias[c] for c in range(2)]
            e = [math.exp(x - max(z)) for x in z]
            p = [x / sum(e) - (c == labels[r]) for c, x in enumerate(e)]
            back = [sum(p[c] * out[c][d] for c in range(2)) for d in range(quality.DIM)]
            for c in range(2):
                for d in range(quality.DIM):
                    out[c][d] -= lr * p[c] * hidden[d]
                bias[c] -= lr * 0.1 * p[c]
            for b, s in zip(at, share):
                for d in range(quality.DIM):
                    vec[b][d] -= lr * math.sqrt(s) * back[d]
    assert np.allclose(got.out, out, atol=1e-4) and np.allclose(got.bias, bias, atol=1e-4)
    assert all(np.allclose(got.emb[b], v, atol=1e-4) for b, v in vec.items())
