"""Quality classifier: supervised subword embeddings, trained by numpy SGD.

A document's features are hashed words, pairs of neighbouring words and character n-grams
(bytes 3 and 4 of each word between ``<`` and ``>``). Their learned vectors are averaged over the
document and a softmax layer gives the classes. Pairs are hashed without order, so a
word beside itself is one feature whatever the word.

The classifier is fitted on a bounded sample of labelled rows (``SAMPLE``, the rows whose
seeded id hash is least) in one task; scoring covers all rows and whole texts. Since the output is
linear in the average, a feature scores by one number and a word by the sum of its features', which
workers remember for a bounded number of words.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim

BUCKETS = 1 << 16
DIM = 8
SAMPLE = 4096  # labelled rows that training uses at most
GRAMS = (3, 4)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REMEMBERED = 300_000


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * _MIX
    x ^= x >> np.uint64(32)
    return ((x * _MIX) >> np.uint64(48)).astype(np.int64) % BUCKETS


class Words:
    """Hashes of words and the buckets of their features."""

    def __init__(self, new: list[bytes]):
        import xxhash

        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
        data = np.frombuffer(b"<" + b"><".join(new) + b">", np.uint8).astype(np.uint64)
        size = np.fromiter(map(len, new), np.int64, len(new)) + 2
        self.stop = np.cumsum(size)
        start = self.stop - size
        self.word = np.repeat(np.arange(len(new)), size)
        left = self.stop[self.word] - np.arange(len(data))
        at, where = [_bucket(self.hash, 1)], [np.arange(len(new))]
        padded = np.concatenate([data, np.zeros(max(GRAMS), np.uint64)])
        for n in GRAMS:
            x = np.zeros(len(data), np.uint64)
            for j in range(n):
                x |= padded[j : len(data) + j] << np.uint64(8 * j)
            ok = left >= n
            at.append(_bucket(x[ok], 100 + n))
            where.append(self.word[ok])
        self.buckets, self.of = np.concatenate(at), np.concatenate(where)
        self.count = np.bincount(self.of, minlength=len(new))
        del data, padded, left, start

    def lists(self) -> list[np.ndarray]:
        order = np.argsort(self.of, kind="stable")
        return np.split(self.buckets[order], np.cumsum(self.count)[:-1])


def _pairs(h: np.ndarray) -> np.ndarray:
    return _bucket(h[:-1] ^ h[1:], 2)


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares that sum to 1) of a whole text; empty for a wordless one."""
    w = (text or b"").split()
    if not w:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    kinds = {x: i for i, x in enumerate(dict.fromkeys(w))}
    own = Words(list(kinds))
    idx = np.fromiter(map(kinds.__getitem__, w), np.int64, len(w))
    times = np.bincount(idx, minlength=len(kinds))
    total = np.bincount(own.buckets, times[own.of], BUCKETS)
    if len(w) > 1:
        total += np.bincount(_pairs(own.hash[idx]), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, (total[at] / total.sum()).astype(np.float32)


class Model:
    """``emb`` (BUCKETS x DIM), ``out`` (2 x DIM), ``bias`` (2)."""

    def __init__(self, emb: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.emb, self.out, self.bias = emb, out, bias

    def dump(self) -> bytes:
        return b"".join(x.astype("<f4").tobytes() for x in (self.emb, self.out, self.bias))

    @classmethod
    def load(cls, raw: bytes) -> Model:
        x = np.frombuffer(raw, "<f4")
        n = BUCKETS * DIM
        return cls(x[:n].reshape(BUCKETS, DIM), x[n : n + 2 * DIM].reshape(2, DIM), x[n + 2 * DIM :])

    def feature_scores(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of class 1, and their bias."""
        return (self.emb @ (self.out[1] - self.out[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def train(texts: list[bytes | None], labels: list[int], epochs: int = 6, updates: int = 5_000, rate: float = 2.0, seed: int = 5) -> Model:
    """Stochastic gradient descent over the documents in a seeded order, the rate falling to 0, for ``epochs`` rounds, or
    more until ``updates`` steps are made where rows are few. Without
    rows, or with one class only, the bias holds the (smoothed) share of the classes."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    ones = sum(labels)
    bias = np.log(np.array([len(labels) - ones + 0.5, ones + 0.5], np.float32) / (len(labels) + 1))
    if 0 < ones < len(labels):
        rows = [features(t) for t in texts]
        epochs = max(epochs, -(-updates // len(rows)))
        steps, done = epochs * len(rows), 0
        for _ in range(epochs):
            for r in rng.permutation(len(rows)):
                at, share = rows[r]
                lr = np.float32(rate * (1 - done / steps))
                done += 1
                vec = emb[at]
                hidden = share @ vec
                z = out @ hidden + bias
                z -= z.max()
                p = np.exp(z)
                p /= p.sum()
                p[labels[r]] -= 1
                back = p @ out
                out -= lr * np.outer(p, hidden).astype(np.float32)
                bias -= lr * np.float32(0.1) * p.astype(np.float32)
                # a share of a document is small: its features step by sqrt(share), not by share
                emb[at] = vec - (lr * np.sqrt(share))[:, None] * back.astype(np.float32)
    return Model(emb, out, bias)


def learning_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, seed: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` labelled rows: those whose seeded hash of the id is
    least, of the rows whose crc32(doc_id as text) mod 5 is not 0."""
    marked = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label")).where("__id is not null and label in (0, 1)")
    marked = marked.where(~held_out(F.col("__id"), 5, 0)).distinct()
    least = marked.orderBy(F.xxhash64(F.lit(seed), "__id"), "__id", "label").limit(sample)
    some = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(least, "__id")
    return some.groupBy(F.col("__id").alias("doc_id"), "label").agg(F.min("text").alias("text"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, **how) -> Model:
    """The model, fitted in one task on the rows of ``learning_rows``; its size is fixed (about 2 MB)."""
    rows = learning_rows(docs, labels, **how).select("doc_id", "label", F.col("text").cast("binary").alias("text"))

    def run(batches):
        found = sorted((r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))), key=lambda r: (r[0], r[1], r[2] or b""))
        model = train([r[2] for r in found], [r[1] for r in found])
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return Model.load(bytes(got[0][0])) if got else train([], [])


class _Scorer:
    """Log odds of whole texts, remembering what words add."""

    kept: dict = {}

    def __init__(self, each: np.ndarray, bias: float):
        self.each, self.bias = each, bias
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.adds, self.count, self.hash = np.empty(0), np.empty(0, np.int64), np.empty(0, np.uint64)

    def odds(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for at in range(0, len(texts), 128):
            split = [(t or b"").split() for t in texts[at : at + 128]]
            flat = list(chain.from_iterable(split))
            if not flat:
                continue
            new = [w for w in dict.fromkeys(flat) if w not in self.index]
            if len(self.index) + len(new) > _REMEMBERED and self.index:
                self.forget()
                new = list(dict.fromkeys(flat))
            if new:
                own = Words(new)
                self.index.update(zip(new, range(len(self.adds), len(self.adds) + len(new))))
                self.adds = np.concatenate([self.adds, np.bincount(own.of, self.each[own.buckets], len(new))])
                self.count = np.concatenate([self.count, own.count])
                self.hash = np.concatenate([self.hash, own.hash])
            idx = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
            size = np.fromiter(map(len, split), np.int64, len(split))
            doc = np.repeat(np.arange(len(split)), size)
            total = np.bincount(doc, self.adds[idx], len(split))
            n = np.bincount(doc, self.count[idx], len(split))
            if len(flat) > 1:
                same = doc[1:] == doc[:-1]
                pair = _pairs(self.hash[idx])[same]
                total += np.bincount(doc[1:][same], self.each[pair], len(split))
                n += np.maximum(size - 1, 0)
            out[at : at + len(split)] += np.divide(total, n, out=np.zeros(len(split)), where=n > 0)
            for w in new:
                if len(w) > 64:
                    self.index.pop(w, None)
        return out


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 as a double column; a null or wordless text gets the bias's."""
    import uuid

    each, bias = model.feature_scores()
    key, each = uuid.uuid4().hex, each.astype(np.float32)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        claim("quality", _Scorer.kept.clear)
        if key not in _Scorer.kept:
            _Scorer.kept.clear()
            _Scorer.kept[key] = _Scorer(each.astype(np.float64), bias)
        z = _Scorer.kept[key].odds(texts.cast(pa.binary()).to_pylist())
        return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return of(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if ``score >= threshold``).

    Labels are learned from ``labels`` (doc_id, quality); only texts are inputs. Null, unknown and repeated
    labels: nulls and values other than 0 and 1 are ignored, a row counts once per distinct label. Without
    labels of both classes every score is the share of label 1 (smoothed). Repeated rows stay,
    an empty table gives an empty result, and input columns named ``score`` or ``predicted`` give way.
    """
    from .common import without

    model = model or fit(docs, labels, doc_id=doc_id, text=text)
    rows = without(docs, "score", "predicted").withColumn("score", score(F.col(f"`{text}`"), model))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
