"""LM scoring: n-grams smoothed by backoff, as a weighted automaton with failure arcs.

Every context seen in training is a state; the root is the empty context. A state has an arc for each word
seen after it, weighing ``(c(h w) + m p(w | h')) / (c(h) + m)``, and a failure arc, weighing
``m / (c(h) + m)``, to the state of the context less its first word, h'; the root has an arc for every word, the
add-one share. ``m`` is ``MU * c(h) ** POWER``, about as words after a context grow with its count; each state's
probabilities sum to one. A text is traversed once from
left to right: the state is carried over each word, a missing arc takes failure arcs down to a state that has
one, and the logarithms of the weights are summed.

Scale: no model of the corpus is gathered anywhere. Each task cuts the texts it reads into blocks of bounded bytes,
which are written once, as word numbers; all that follows reads these, so it doesn't matter how the
rows were ordered or dealt, nor whether they would come in the same order again. Each block sends its distinct
n-grams (64-bit hashes, with its own training counts) to shards of the hash range, a shard adds up the counts of
all blocks and answers each with the totals of what it sent, and whether any other block has it. Block and answer meet
again, the block builds the automaton of just its own n-grams, and its texts traverse it. So each n-gram moves once per
block, not once per occurrence; a frequent word is one entry of each block. Words and pairs are sent at once; longer
n-grams, order by order, only where both n-grams of one word less are in other blocks too: all others are in this
block alone, which then knows their totals. A block sends a row to each shard that it has an n-gram for. Where there would
be more than ``FAN`` shards, it sends to ranges of them, and cells of as many blocks merge what they have for a range before
it goes to the shards: rows grow with the input then, not with its square.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settle
from .common import partitions
from .quality import held_out

ORDER = 2
AT_ONCE = 2  # orders whose n-grams are all sent, in the first round
MU, POWER = 3.0, 0.8  # about where held-out likelihood is best on 10,000 documents
LEAST_BLOCK_BYTES, MOST_BLOCK_BYTES = 4 << 20, 8 << 20  # a block's automaton takes about 40 times as much memory
SHARD_BYTES = 32 << 20
FAN = 4096  # shards that a block sends to, and blocks that a cell merges
LANE = 256  # words that are traversed in one go; a longer text is traversed in several lanes at once
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
END = 0x243F6A8885A308D3  # the hash of the end of a text, which also precedes its first word


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 texts (binary; null is empty): the sorted distinct word hashes, all words as numbers into them, each text's preceded and
    followed by END, and each text's length with both."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    parts = lists.flatten()
    full = pc.greater(pc.binary_length(parts), 0).to_numpy(zero_copy_only=False)  # none before leading white space
    ends = np.concatenate([[0], np.cumsum(full)])
    offsets = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(ends[offsets - offsets[0]]) if len(texts) else np.empty(0, np.int64)
    coded = parts.filter(pa.array(full)).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.view(pa.binary()).to_pylist(), repeat(11)), np.uint64, len(coded.dictionary))
    known = np.unique(np.append(hashes, np.uint64(END)))
    words = np.full(int(size.sum()) + 2 * len(size), np.searchsorted(known, np.uint64(END)), np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    words[np.arange(len(doc)) + 2 * doc + 1] = np.searchsorted(known, hashes)[coded.indices.to_numpy()]
    return known, words, size + 2


def stream(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each preceded and followed by END, and each text's length with both."""
    known, words, size = numbered(pa.array(texts, pa.binary()))
    return known[words], size


def grams(h: np.ndarray, size: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For orders 1..n: hashes of the n-grams that end at each place, and the places that have one: those of
    predicted tokens (all but each text's opening END) with enough before them."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    out, x = [], h
    for m in range(1, order + 1):
        if m > 1:
            prev = np.zeros_like(x)
            prev[1:] = x[:-1]
            x = (prev * _M1) ^ h
            x ^= x >> np.uint64(31)
            x = x * _M2
            x ^= x >> np.uint64(29)
        out.append((x, place >= max(1, m - 1)))
    return out


def squeeze(x: np.ndarray, sorted_keys: bool = False) -> bytes:
    """Whole numbers as compressed byte planes; sorted keys as the differences between neighbours."""
    import zstandard

    if sorted_keys:
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(blob: bytes, kind: str, sorted_keys: bool = False) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    x = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(x, dtype=x.dtype) if sorted_keys else x


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values, an order that sorts ``x``, and where in it each value begins."""
    by = np.argsort(x)
    s = x[by]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    return s[begin], by, begin


def numbers(by: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each value its number among the distinct ones, from what ``distinct`` gives."""
    mark = np.zeros(len(by), np.int32)
    mark[begin[1:]] = 1
    out = np.empty(len(by), np.int32)
    out[by] = np.cumsum(mark, dtype=np.int32)
    return out


class Level:
    """The distinct n-grams of one order in a block: sorted ``keys``, a place ``first`` where each ends, the number of the n-gram that ends
    at each place (``number``), training counts ``own`` in the block, which are ``asked`` of the shards, and, once answered,
    ``totals`` and whether others have it (``shared``)."""

    def __init__(self, at: list[tuple[np.ndarray, np.ndarray]], free: np.ndarray | None, below: Level | None):
        x, ok = at[-1]
        where = np.flatnonzero(ok)
        self.keys, by, begin = distinct(x[where])
        self.first = where[by[begin]].astype(np.int32)
        self.number = np.zeros(len(x), np.int32)
        self.number[where] = numbers(by, begin)
        if below is None:
            # the opening END is no n-gram that is predicted, but a context
            self.number[~ok] = np.searchsorted(self.keys, np.uint64(END))
        if free is not None:
            self.own = np.add.reduceat(free[where[by]].astype(np.uint32), begin) if len(begin) else np.empty(0, np.uint32)
        self.asked = np.ones(len(self.keys), bool)
        if below is not None:
            self.before = below.number[self.first - 1]  # the context
            self.suffix = below.number[self.first]  # the n-gram less its first token
            if len(at) > AT_ONCE:
                self.asked = below.shared[self.before] & below.shared[self.suffix]

    def answer(self, totals: np.ndarray, shared: np.ndarray) -> None:
        if len(totals) != int(self.asked.sum()):
            raise RuntimeError("a block's answers are not for its n-grams")
        self.shared = np.zeros(len(self.keys), bool)
        self.shared[self.asked] = shared
        self.totals = totals if self.asked.all() else self.own
        if self.totals is not totals:
            self.totals[self.asked] = totals


def levels(at: list[tuple[np.ndarray, np.ndarray]], free: np.ndarray, answers: list[tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    """The levels that ``answers`` (totals, shared) are for, answered."""
    out: list[Level] = []
    for m, (totals, shared) in enumerate(answers):
        level = Level(at[: m + 1], free if m >= AT_ONCE else None, out[-1] if out else None)
        level.answer(totals, shared)
        out.append(level)
    return out


class Automaton:
    """States, arcs and failure arcs for the texts of one block.

    State 0 is the root. Every other state is an n-gram of at most ``order - 1`` tokens with a training count.
    ``arc_key`` holds ``state * words + word`` of all arcs but the root's, with ``arc_weight`` (log10) and ``arc_to``; ``slot`` is
    their hash table (open addressing). The root's are ``root_weight`` and ``root_to``, by word. ``fail_to`` and ``fail_weight`` are the
    failure arcs, by state. ``start`` is the state of the opening END.
    """

    def __init__(self, own: list[Level], tokens: int, types: int, mu: float, power: float = 0.0):
        """``own``: the block's n-grams by order, with their totals. States and n-grams are numbered in 32 bits."""
        order, keys, counts = len(own), [x.keys for x in own], [x.totals for x in own]
        self.words, n = keys[0], len(keys[0])
        self.root_weight = np.log10((counts[0] + 1.0) / (tokens + types + 1.0))
        # states: n-grams of each order below the last that training has seen
        state, made = [], 1
        for m in range(order - 1):
            s = np.zeros(len(keys[m]), np.int32)
            seen = counts[m] > 0
            s[seen] = np.arange(made, made + int(seen.sum()))
            made += int(seen.sum())
            state.append(s)
        self.states = made
        self.root_to = state[0] if state else np.zeros(n, np.int32)
        self.fail_to, self.fail_weight = np.zeros(made, np.int32), np.zeros(made)
        arc_key, arc_weight, arc_to, low = [], [], [], self.root_weight
        for m in range(1, order):  # n-grams of order m + 1 are arcs of the states of order m
            before, suffix = own[m].before, own[m].suffix
            word = suffix if m == 1 else own[m - 1].word[suffix]
            own[m].word = word
            mass = mu * np.maximum(counts[m - 1], 1.0) ** power
            weight = np.log10((counts[m] + mass[before] * 10.0 ** low[suffix]) / (counts[m - 1][before] + mass[before]))
            arc = counts[m] > 0
            to = state[m] if m < order - 1 else state[m - 1][suffix]
            arc_key.append(state[m - 1][before[arc]].astype(np.int64) * n + word[arc])
            arc_weight.append(weight[arc])
            arc_to.append(to[arc])
            seen = state[m - 1] > 0
            self.fail_weight[state[m - 1][seen]] = np.log10(mass[seen] / (counts[m - 1][seen] + mass[seen]))
            if m < order - 1:
                self.fail_to[state[m][arc]] = state[m - 1][suffix[arc]]
            low = weight
        self.arc_key, self.arc_weight, self.arc_to = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (arc_key, arc_weight, arc_to))
        self.bits = max(1, (2 * len(self.arc_key)).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(self.arc_key), dtype=np.int32), self._home(self.arc_key)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (len(self.slot) - 1)
        self.depth = order - 1
        end = np.searchsorted(keys[0], np.uint64(END))
        self.start = int(self.root_to[end]) if end < n and keys[0][end] == END else 0

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Number of the arc of each key, -1 where there is none."""
        at = self._home(key)
        out = self.slot[at]
        wrong = np.flatnonzero((out >= 0) & (self.arc_key[out] != key))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slot) - 1)
            out[wrong] = self.slot[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.arc_key[out[wrong]] != key[wrong])]
        return out

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of reading ``word`` in ``state`` (failure arcs included), and the states it leads to."""
        weight, to, n = np.zeros(len(state)), np.zeros(len(state), np.int32), len(self.words)
        open_, at = np.arange(len(state)), state
        while len(open_) and len(self.arc_key):
            inner = at > 0
            if not inner.all():
                rooted = open_[~inner]
                weight[rooted] += self.root_weight[word[rooted]]
                to[rooted] = self.root_to[word[rooted]]
                open_, at = open_[inner], at[inner]
            found = self.find(at.astype(np.int64) * n + word[open_])
            hit = found >= 0
            weight[open_[hit]] += self.arc_weight[found[hit]]
            to[open_[hit]] = self.arc_to[found[hit]]
            open_, at = open_[~hit], at[~hit]
            weight[open_] += self.fail_weight[at]
            at = self.fail_to[at]
        weight[open_] += self.root_weight[word[open_]]
        to[open_] = self.root_to[word[open_]]
        return weight, to

    def traverse(self, word: np.ndarray, size: np.ndarray, lane: int = LANE) -> np.ndarray:
        """Sum of log10 weights of each text. ``word``: word numbers of all texts, each with its opening END, one after
        another; ``size``: their lengths.

        Texts are lanes that advance together, one word a step, each carrying its state. A long text is cut into lanes of ``lane``
        words; a later one first reads, from the root and unweighed, the ``order - 1`` words before it, after which its
        state is the one that the lane before would have carried there.
        """
        begin = np.cumsum(size) - size
        many = np.maximum(-(-(size - 1) // lane), 1)
        text = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        a = begin[text] + 1 + nth * lane
        b = np.minimum(a + lane, (begin + size)[text])
        by = np.argsort(a - b, kind="stable")  # the longest first: those still open are the first ones
        a, b, text, nth = a[by], b[by], text[by], nth[by]
        state = np.where(nth == 0, self.start, 0).astype(np.int32)
        for back in range(self.depth, 0, -1):
            i = np.flatnonzero(nth > 0)
            at = a[i] - back
            ok = at > begin[text[i]]
            opening = at == begin[text[i]]
            state[i[opening]] = self.start
            i, at = i[ok], at[ok]
            if len(i):
                state[i] = self.step(state[i], word[at])[1]
        total = np.zeros(len(a))
        for t in range(int((b - a).max(initial=0))):
            live = int(np.searchsorted(-(b - a), -t, "left"))
            weight, state[:live] = self.step(state[:live], word[a[:live] + t])
            total[:live] += weight
        return np.bincount(text, total, len(size))


def block_bytes_for(total: int) -> int:
    return int(min(MOST_BLOCK_BYTES, max(LEAST_BLOCK_BYTES, math.sqrt(total * 128e3))))


def score(docs: DataFrame, order: int = ORDER, mu: float = MU, power: float = POWER, held_modulus: int = 7, held_remainder: int = 2, doc_id: str = "doc_id", text: str = "text", block_bytes: int | None = None, fan: int = FAN) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model learns from all documents that are not held out: those whose crc32(doc_id as text) modulo
    ``held_modulus`` is not ``held_remainder`` (a null id is not held out). A text's tokens are its words, A-Z
    lower-cased, and one end; a null text is empty. ``n_known`` counts tokens seen in training, ``base_score`` is the
    add-one unigram score, ``score`` the automaton's. The order and the partitions of ``docs`` don't matter. Repeated rows each
    count; without training rows all counts are 0; an empty table gives an empty result; other columns are ignored.
    """
    own = F.col(f"`{doc_id}`").alias("doc_id")
    rows = docs.select(own, F.col(f"`{text}`").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = block_bytes or block_bytes_for(total)
    shards = max(partitions(docs), math.ceil(total / SHARD_BYTES))
    rows = rows.withColumn("held", held_out(F.col("doc_id"), held_modulus, held_remainder))
    kind = dict(rows.dtypes)["doc_id"]
    # beyond ``fan`` shards, ranges of ``subs`` shards each
    subs = 1 if shards <= fan else math.ceil(math.sqrt(shards))
    shards = math.ceil(shards / subs)
    cells = max(1, math.ceil(total / most / fan))
    step = (1 << 64) // shards + 1
    bounds = np.array([step * i for i in range(1, shards)], np.uint64)

    def cut(batches):
        """Blocks of texts: their ids, and their words as numbers into the block's sorted word hashes."""
        parts, held_bytes, made = [], 0, TaskContext.get().partitionId() << 32

        def block():
            whole = pa.Table.from_batches(parts).combine_chunks()
            ids, texts, held = (whole.column(i).chunk(0) for i in range(3))
            known, word, size = numbered(texts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([squeeze(held.to_numpy(zero_copy_only=False).astype(np.uint8))], pa.binary()),
                    pa.array([squeeze(size)], pa.binary()), pa.array([squeeze(known, True)], pa.binary()), pa.array([squeeze(word.astype("<u4"))], pa.binary()),
                ],
                ["block", "ids", "held", "sizes", "known", "words"],
            )

        for b in batches:
            upto = held_bytes + np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
            at = 0
            for i in np.flatnonzero(np.diff(upto // most, prepend=held_bytes // most)).tolist():
                parts.append(b.slice(at, i + 1 - at))
                yield block()
                made, at = made + 1, i + 1
                parts.clear()
            if at < b.num_rows:
                parts.append(b.slice(at))
            held_bytes = int(upto[-1]) if len(upto) else held_bytes
        if parts:
            yield block()

    blocks = settle(rows.mapInArrow(cut, f"block long, ids array<{kind}>, held binary, sizes binary, known binary, words binary"), "lm-blocks")

    def opened(held: bytes, sizes: bytes, known: bytes, words: bytes, upto: int):
        """(n-grams by order, which words train, words as numbers, lengths, held) of a block."""
        size, out, word = expand(sizes, "<i8"), expand(held, "u1").astype(bool), expand(words, "<u4")
        return grams(expand(known, "<u8", True)[word], size, upto), np.repeat(~out, size), word, size, out

    def parted(each: list[tuple[np.ndarray, ...]], at: np.ndarray) -> list[tuple[int, list[tuple[np.ndarray, ...]]]]:
        """Sorted keys, and what goes with them, of each order, cut at ``at``: those cuts in which there are any."""
        ends = [[0, *np.searchsorted(x[0], at).tolist(), len(x[0])] for x in each]
        cuts = ((s, [tuple(c[e[s] : e[s + 1]] for c in x) for x, e in zip(each, ends)]) for s in range(len(at) + 1))
        return [(s, own) for s, own in cuts if any(len(x[0]) for x in own)]

    def sent(block: int, each: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Keys and counts of each order, cut by shard (or range of shards)."""
        out = [(s, [squeeze(k, True) for k, _ in own], [squeeze(c) for _, c in own]) for s, own in parted([(k, c.astype("<u4")) for k, c in each], bounds)]
        s, k, c = zip(*out) if out else ((), (), ())
        binary = pa.list_(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), pa.array(s, pa.int32()), pa.array(k, binary), pa.array(c, binary)], ["block", "shard", "keys", "counts"])

    def ask(batches):
        """Each block's n-grams of the first orders, all of them."""
        for b in batches:
            for number, *row in zip(*(b.column(i).to_pylist() for i in range(5))):
                at, free, *_ = opened(*row, min(order, AT_ONCE))
                first = [Level(at[:1], free, None)]
                first += [Level(at[: m + 1], free, first[0]) for m in range(1, len(at))]
                yield sent(number, [(x.keys, x.own) for x in first])

    def told(replies: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        """(totals, shared) by order, of a block's replies."""
        out = []
        for r in sorted(set(replies["round"].to_pylist())):
            own = replies.filter(pc.equal(replies["round"], r)).sort_by("shard").to_pylist()
            for m in range(len(own[0]["totals"])):
                totals = [expand(x["totals"][m], "<u4") for x in own]
                shared = [np.unpackbits(np.frombuffer(x["shared"][m], np.uint8), count=len(t)).astype(bool) for x, t in zip(own, totals)]
                out.append((np.concatenate(totals), np.concatenate(shared)))
        return out

    def ask_longer(upto):
        """Each block's n-grams of one more order, those that may be elsewhere."""

        def run(key, left, right):
            at, free, *_ = opened(*(left[c][0].as_py() for c in ("held", "sizes", "known", "words")), upto)
            answers = told(right)
            answers += [(np.empty(0, "<u4"), np.empty(0, bool))] * (upto - 1 - len(answers))  # nothing was asked of an order
            below = levels(at, free, answers)
            level = Level(at, free, below[-1])
            return pa.Table.from_batches([sent(key[0].as_py(), [(level.keys[level.asked], level.own[level.asked])])], schema=asked_schema)

        return run

    def add_up(key, sent_here):
        """One shard: totals of each n-gram over the blocks, and whether several have it, in the order in which each block sent."""
        got = list(zip(*(sent_here[c].to_pylist() for c in ("block", "keys", "counts"))))
        answers, others = [[] for _ in got], [[] for _ in got]
        stats = [0, 0]
        for m in range(len(got[0][1])):
            each = [expand(g[1][m], "<u8", True) for g in got]
            keys, by, begin = distinct(np.concatenate(each))
            inv = numbers(by, begin)
            counts = np.bincount(inv, np.concatenate([expand(g[2][m], "<u4") for g in got]), len(keys))
            if m == 0:
                stats = [int(counts.sum()), int((counts > 0).sum())]
            all_ = np.minimum(counts[inv], 0xFFFFFFFF).astype("<u4")
            shared = (np.bincount(inv, minlength=len(keys)) > 1)[inv]
            at = 0
            for a, o, e in zip(answers, others, each):
                a.append(squeeze(all_[at : at + len(e)]))
                o.append(np.packbits(shared[at : at + len(e)]).tobytes())
                at += len(e)
        shard, binary = key[0].as_py(), pa.list_(pa.binary())
        return pa.Table.from_arrays(
            [
                pa.array([g[0] for g in got] + [None], pa.int64()), pa.array([shard] * (len(got) + 1), pa.int32()), pa.array([*answers, None], binary), pa.array([*others, None], binary),
                pa.array([None] * len(got) + [stats[0]], pa.int64()), pa.array([None] * len(got) + [stats[1]], pa.int64()),
            ],
            ["block", "shard", "totals", "shared", "tokens", "types"],
        )

    def united(rows: list[dict], m: int):
        """(distinct keys, their order and beginnings, counts, whether several have them) of what rows hold of one order."""
        keys, by, begin = distinct(np.concatenate([expand(r["keys"][m], "<u8", True) for r in rows]))
        counts = np.concatenate([expand(r["counts"][m], "<u4") for r in rows]).astype(np.int64)[by]
        counts = np.add.reduceat(counts, begin) if len(begin) else counts
        return keys, by, begin, np.minimum(counts, 0xFFFFFFFF).astype("<u4"), np.diff(begin, append=len(by)) > 1

    def merge(key, sent_here):
        """One cell's n-grams of a range of shards, cut by shard."""
        shard, cell, rows = key[0].as_py(), key[1].as_py(), sent_here.to_pylist()
        each = [(k, c, several) for k, _, _, c, several in (united(rows, m) for m in range(len(rows[0]["keys"])))]
        inner = np.array([step * shard + step // subs * i for i in range(1, subs)], np.uint64)
        out = [(shard, cell, s, [squeeze(k, True) for k, _, _ in own], [squeeze(c) for _, c, _ in own], [np.packbits(v).tobytes() for _, _, v in own]) for s, own in parted(each, inner)]
        return pa.Table.from_pylist([dict(zip(merged_schema.names, r)) for r in out], schema=merged_schema)

    def add_cells(key, sent_here):
        """One shard: totals over the cells, answered in the order in which each cell sent."""
        shard, sub, rows = key[0].as_py(), key[1].as_py(), sent_here.to_pylist()
        out = [{"shard": shard, "cell": r["cell"], "sub": sub, "totals": [], "shared": []} for r in rows]
        stats = {"shard": shard, "sub": sub, "tokens": 0, "types": 0}
        for m in range(len(rows[0]["keys"])):
            keys, by, begin, counts, several = united(rows, m)
            size = [len(expand(r["keys"][m], "<u8", True)) for r in rows]
            inv = numbers(by, begin)
            flags = np.concatenate([np.unpackbits(np.frombuffer(r["several"][m], np.uint8), count=n) for r, n in zip(rows, size)])
            shared = several | (np.bincount(inv, flags, len(keys)) > 0)
            if m == 0:
                stats |= {"tokens": int(counts.sum(dtype=np.int64)), "types": int((counts > 0).sum())}
            for o, i in zip(out, np.split(inv, np.cumsum(size)[:-1])):
                o["totals"].append(squeeze(counts[i]))
                o["shared"].append(np.packbits(shared[i]).tobytes())
        return pa.Table.from_pylist([*out, stats], schema=summed_schema)

    def hand_back(key, sent_here, summed):
        """The totals of a cell's n-grams, for each of its blocks in the order in which it sent."""
        rows, sums = sent_here.to_pylist(), summed.sort_by("sub").to_pylist()
        out = [{"block": r["block"], "shard": r["shard"], "totals": [], "shared": []} for r in rows]
        for m in range(len(rows[0]["keys"])):
            _, by, begin, _, _ = united(rows, m)
            totals = [expand(x["totals"][m], "<u4") for x in sums]
            shared = np.concatenate([np.unpackbits(np.frombuffer(x["shared"][m], np.uint8), count=len(t)) for x, t in zip(sums, totals)])
            totals, inv = np.concatenate(totals), numbers(by, begin)
            size = [len(expand(r["keys"][m], "<u8", True)) for r in rows]
            for o, i in zip(out, np.split(inv, np.cumsum(size)[:-1])):
                o["totals"].append(squeeze(totals[i]))
                o["shared"].append(np.packbits(shared[i]).tobytes())
        return pa.Table.from_pylist(out, schema=reply_schema)

    binary = pa.list_(pa.binary())
    merged_schema = pa.schema([("shard", pa.int32()), ("cell", pa.int32()), ("sub", pa.int32()), ("keys", binary), ("counts", binary), ("several", binary)])
    summed_schema = pa.schema([("shard", pa.int32()), ("cell", pa.int32()), ("sub", pa.int32()), ("totals", binary), ("shared", binary), ("tokens", pa.int64()), ("types", pa.int64())])
    reply_schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("totals", binary), ("shared", binary), ("tokens", pa.int64()), ("types", pa.int64())])
    asked_schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("keys", binary), ("counts", binary)])
    question = "block long, shard int, keys array<binary>, counts array<binary>"
    columns = ["held", "sizes", "known", "words"]
    tasks = max(partitions(docs), math.ceil(total / most / 4))  # a few blocks each, at any size

    def answered(asked: DataFrame, number: int) -> DataFrame:
        reply = "block long, shard int, totals array<binary>, shared array<binary>, tokens long, types long"
        if subs == 1:
            found = asked.repartition(shards, "shard").groupBy("shard").applyInArrow(add_up, reply)
        else:
            asked = settle(asked.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")), "lm-asked")
            merged = asked.repartition(shards * cells, "shard", "cell").groupBy("shard", "cell").applyInArrow(merge, "shard int, cell int, sub int, keys array<binary>, counts array<binary>, several array<binary>")
            sums = merged.repartition(shards * subs, "shard", "sub").groupBy("shard", "sub").applyInArrow(add_cells, "shard int, cell int, sub int, totals array<binary>, shared array<binary>, tokens long, types long")
            sums = settle(sums, "lm-sums")
            back = sums.where("cell is not null").repartition(shards * cells, "shard", "cell").groupBy("shard", "cell")
            found = asked.repartition(shards * cells, "shard", "cell").groupBy("shard", "cell").cogroup(back).applyInArrow(hand_back, reply)
            none = F.lit(None)
            found = found.unionByName(sums.where("cell is null").select(none.cast("long").alias("block"), "shard", none.cast("array<binary>").alias("totals"), none.cast("array<binary>").alias("shared"), "tokens", "types"))
        return settle(found.withColumn("round", F.lit(number)), "lm-answers")

    first = answered(blocks.select("block", *columns).mapInArrow(ask, question), 0)
    tokens, types = first.where("block is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    reply = ["block", "shard", "round", "totals", "shared"]
    replies = first.where("block is not null").select(*reply)
    for m in range(AT_ONCE + 1, order + 1):
        dealt = blocks.select("block", *columns).repartition(tasks, "block").groupBy("block")
        asked = dealt.cogroup(replies.repartition(tasks, "block").groupBy("block")).applyInArrow(ask_longer(m), question)
        replies = replies.unionByName(answered(asked, m).where("block is not null").select(*reply))

    def read(key, left, right):
        at, free, word, size, held = opened(*(left[c][0].as_py() for c in columns), order)
        answers = told(right)
        answers += [(np.empty(0, "<u4"), np.empty(0, bool))] * (order - len(answers))
        own, ok = levels(at, free, answers), at[0][1]
        del at, answers
        machine, trained = Automaton(own, tokens, types, mu, power), own[0].totals > 0
        del own
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        base = np.bincount(doc[ok], machine.root_weight[word[ok]], len(size))
        seen = np.bincount(doc[ok], trained[word[ok]], len(size)).astype(np.int64)
        return pa.Table.from_arrays(
            [left["ids"].combine_chunks().flatten(), pa.array(held), pa.array(size - 1), pa.array(seen), pa.array(np.full(len(size), tokens, np.int64)), pa.array(base), pa.array(machine.traverse(word, size))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.repartition(tasks, "block").groupBy("block").cogroup(replies.repartition(tasks, "block").groupBy("block")).applyInArrow(read, schema)
