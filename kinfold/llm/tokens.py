"""Token ids by a public byte-level BPE file, and token counts that follow edits.

``Encoder`` gives exactly the tokenizer's ids. The pre-tokenizer starts a new pre-token at
every space that precedes a character other than white space, whatever stands around it,
so a text can be cut there and each part, or its pre-tokens where their ends are sure, looked up in a bounded cache; those
that miss are encoded together.

``EditedCount`` keeps the pre-tokens of one document as leaves of a sum tree: those between two such spaces
are one leaf unless they are long. An edit re-encodes the leaves that it touches plus the boundary context that the
pre-tokenizer looks at, and updates the sums above them.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import claim

CUT = re.compile(r" (?=\S)")
ODD = re.compile(r" \s| \Z")
#: The same for RE2, whose \s is ASCII.
ODD_RE2 = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| \z"
BATCH_BYTES = 8 << 20
CACHE = 300_000
LONG = 64  # characters

# Characters whose class (letter, digit, other) every version of the pre-tokenizer's tables agrees on: ASCII, and ranges that
# Unicode has had from its start.
_L = "A-Za-zÀ-ÖØ-öø-ǵΑ-ΡΣ-ωА-яא-תء-غف-يぁ-ゔァ-ヺ一-龥가-힣"
_D = "0-9"
_P = "!-&(-/:-@\\[-`{-~、。〈-』！，：；？"  # without the apostrophe
#: Places where a pre-token ends whatever stands around, told by the two characters before and the one behind. The last
#: character of a longer run of white space is a pre-token of its own, so no cut is made after one.
FIRM = re.compile(rf"(?<=\S)(?=[\n\t\r])|(?<=\S[\n\t\r])(?=\S)|(?<=[{_L}])(?=[{_P}{_D}'])|(?<=[{_D}])(?=[{_L}{_P}'])|(?<=[{_P}])(?=[{_L}{_D}])")
#: What lies in one pre-token.
ONE = re.compile(f" ?(?:[{_L}]+|[{_D}]+|[{_P}]+)")
#: Parts, less their space, of such characters and single line feeds between them, and their pre-tokens.
SURE_RE2 = rf"\A[{_L}{_D}{_P}]+(?:\n[{_L}{_D}{_P}]+)*\z"
UNIT = re.compile(f" ?[{_L}]+| ?[{_D}]+| ?[{_P}]+|\n")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(texts: pa.Array) -> list[tuple[int, int]]:
    """(start, number) of runs of texts of about ``BATCH_BYTES``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // BATCH_BYTES)) + 1).tolist(), len(texts)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, as many as ``n`` says; in a slice they are far fewer than 2^31."""
    out = np.repeat((begin - (np.cumsum(n) - n)).astype(np.int32), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Encoder:
    """Ids (as little-endian unsigned 32-bit bytes) of whole UTF-8 texts.

    Special tokens' strings in a text are ordinary text. About twice ``CACHE`` parts are remembered, those used last, and
    none that is longer than 64 characters.
    """

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        path = path or default_path()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = Tokenizer(self.tokenizer.model)  # the same, for pre-tokens cut already and written in the vocabulary's characters
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        self.parts: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # an older generation
        with open(path) as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # byte-level vocabularies write each byte as one character
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for word, i in vocabulary.items():
            self.bytes_of[i] = len(word)
        # printable bytes are their own characters, the others those from 256 on; a zero byte stands between pre-tokens
        self.letters = np.arange(256, dtype="<u2")
        other = [*range(33), *range(127, 161), 173]
        self.letters[other] = np.arange(256, 256 + len(other))
        self.letters[0] = ord("\n")

    @classmethod
    def cached(cls, path: str | None = None) -> Encoder:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        claim("tokens", cls._forget)
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    @classmethod
    def _forget(cls) -> None:
        for e in cls._kept.values():
            e.parts, e.before = {}, {}

    def split(self, text: str) -> list[str]:
        """Parts whose ids don't depend on one another: each later part starts with a space."""
        parts = CUT.split(text) if ODD.search(text) else text.split(" ")
        return parts[:1] + [" " + p for p in parts[1:]]

    def _keep(self, found: dict[str, bytes]) -> None:
        if len(self.parts) + len(found) > CACHE:
            self.before, self.parts = self.parts, {}
        self.parts.update(found)
        for p in [p for p in found if len(p) > LONG]:
            del self.parts[p]

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """The ids of parts that ``parts`` doesn't have."""
        out = {p: v for p in missing if (v := self.before.get(p)) is not None} if self.before else {}
        out.update(self._encoded([p for p in missing if p not in out] if out else list(missing)))
        self._keep(out)
        return out

    def _encoded(self, parts: list[str]) -> dict[str, bytes]:
        """Short parts are encoded together: those that are one pre-token by the model alone, others that start with a space as
        one text in which each is its own run of pre-tokens."""
        single, spaced, rest = [], [], []
        for p in parts:
            if len(p) > LONG or not p:
                rest.append(p)
            elif ONE.fullmatch(p):
                single.append(p)
            else:
                (rest if p[0] != " " or len(p) < 2 or p[1].isspace() else spaced).append(p)
        out = {}
        for some, together in ((single, self._single), (spaced, self._spaced)):
            for at in range(0, len(some), 20_000):
                own = some[at : at + 20_000]
                ids, stop = together(own)
                last = (np.searchsorted(np.cumsum(self.bytes_of[ids]), stop, "left") + 1) * 4
                data, a = ids.tobytes(), 0
                for p, b in zip(own, last.tolist()):
                    out[p] = data[a:b]
                    a = b
        out.update(zip(rest, self.plain(rest)))
        return out

    def _single(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all, and the bytes up to the end of each."""
        raw = np.frombuffer("\0".join(parts).encode(), np.uint8)
        stop = np.append(np.flatnonzero(raw == 0), len(raw)) - np.arange(len(parts))
        return self._ids(self.model, self.letters[raw].tobytes().decode("utf-16-le")), stop

    def _spaced(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._ids(self.tokenizer, "".join(parts)), np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)))

    @staticmethod
    def _ids(tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def values(self, parts: list[str]) -> list[bytes]:
        """The ids of each part of a text or several."""
        out = list(map(self.parts.get, parts))
        if None in out:
            got = self.learn({p for p, v in zip(parts, out) if v is None})
            out = [got[p] if v is None else v for p, v in zip(parts, out)]
        return out

    def counts(self, parts: list[str]) -> list[int]:
        """Number of ids of each part of a text."""
        return [len(v) // 4 for v in self.values(parts)]

    def many(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text; null has none."""
        ids, size = self.column(pa.array(texts, pa.binary()))
        data, ends = ids.tobytes(), (np.cumsum(size) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has; null has none. ``end`` is put behind each."""
        each = [self.slice(texts.slice(a, n), end) for a, n in slices(texts)]
        if not each:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        return np.concatenate([x for x, _ in each]), np.concatenate([n for _, n in each])

    def slice(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts of few bytes, at once."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, ODD_RE2).to_numpy(zero_copy_only=False)
        even = np.flatnonzero(~odd)
        size = np.zeros(len(texts), np.int64)
        ids, size[even] = self._even(texts.take(pa.array(even)))
        rest = [self.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        values = self.values(list(chain.from_iterable(rest)))
        a, joined = 0, []
        for s in rest:
            joined.append(b"".join(values[a : a + len(s)]))
            a += len(s)
        size[odd] = [len(x) // 4 for x in joined]
        more = int(end is not None)
        begin = np.cumsum(size + more) - size - more
        out = np.full(int((size + more).sum()), end or 0, "<u4")
        for where, own in ((even, ids), (np.flatnonzero(odd), np.frombuffer(b"".join(joined), "<u4"))):
            n = size[where]
            out[ranges(begin[where], n)] = own
        return out, size + more

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that are cut at every space: each distinct part is looked up once."""
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        lists = pc.split_pattern(texts, " ")
        parts, first = lists.flatten(), lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
        coded = parts.dictionary_encode()
        at = coded.indices.to_numpy()
        later = np.ones(len(at), bool)
        later[first] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[at[later]] = True
        names = coded.dictionary.filter(pa.array(used))
        sure = pc.match_substring_regex(names, SURE_RE2).to_numpy(zero_copy_only=False)
        # sure parts come first, then the others, then the first part of each text, which has no space before it
        place = np.zeros(len(used), np.int32)
        place[used] = np.where(sure, np.cumsum(sure), sure.sum() + np.cumsum(~sure)) - 1
        at = place[at]
        at[first] = len(names) + np.arange(len(texts), dtype=np.int32)
        ids, size = self._sure(names.filter(pa.array(sure)))
        values = self.values([" " + p for p in names.filter(pa.array(~sure)).to_pylist()] + parts.take(pa.array(first)).to_pylist())
        ids = np.concatenate([ids, np.frombuffer(b"".join(values), "<u4")])
        size = np.concatenate([size, np.fromiter(map(len, values), np.int32, len(values)) // 4])
        n = size[at]
        return ids[ranges((np.cumsum(size) - size)[at], n)], np.add.reduceat(n, first, dtype=np.int64)

    def _sure(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts that ``SURE_RE2`` matches, a space before each, and how many each has: each distinct pre-token is
        looked up once."""
        if not len(parts):
            return np.empty(0, "<u4"), np.empty(0, np.int32)
        units = UNIT.findall(" " + pc.binary_join(pa.ListArray.from_arrays([0, len(parts)], parts), " ")[0].as_py())
        known = {u: i for i, u in enumerate(dict.fromkeys(units))}
        at = np.fromiter(map(known.__getitem__, units), np.int32, len(units))
        first = np.flatnonzero(np.array([u[0] == " " for u in known])[at])  # a part has no other space
        values = self.values(list(known))
        size = np.fromiter(map(len, values), np.int32, len(values)) // 4
        n = size[at]
        ids = np.frombuffer(b"".join(values), "<u4")[ranges((np.cumsum(size) - size)[at], n)]
        return ids, np.add.reduceat(n, first, dtype=np.int32)

    def pieces(self, run: str, size: int = 32) -> list[tuple[str, int]]:
        """One long pre-token cut between tokens into pieces of about ``size`` tokens, with their counts. Any stretch of
        a BPE encoding is the encoding of its own text."""
        raw = run.encode()
        ids = np.frombuffer(self.plain([run])[0], "<u4")
        ends = np.cumsum(self.bytes_of[ids]).tolist()
        out, a, k = [], 0, 0
        for i, b in enumerate(ends, 1):
            if i == len(ends) or (i - k >= size and raw[b] & 0xC0 != 0x80):  # no character is cut
                out.append((raw[a:b].decode(), i - k))
                a, k = b, i
        return out


class EditedCount:
    """Token count of one document that follows its edits.

    A leaf is (text, tokens, inside). Leaves end at spaces, so a leaf is one word's pre-tokens; where that is longer than
    ``LONG`` characters (lines, tabs, scripts without spaces) it ends at every place where a pre-token surely ends; a longer pre-token
    still, of letters, digits or marks, is cut between its tokens, and all its pieces but the first are ``inside``. Two such
    neighbours stay valid where they are encoded together as they are apart, since a BPE encoding is valid if every two
    adjacent tokens are; else the next pieces are encoded again too (all of them where a pattern's phase shifts). Only a long run of white space, or of characters whose class is
    uncertain, is one leaf.

    Leaves are kept in chunks, the leaves of an array-shaped sum tree of code points and
    tokens. ``edit`` finds its chunks by descending the tree, re-encodes the leaves that the edit touches and the
    one or two beside it whose end the pre-tokenizer could now see otherwise, and updates the sums above. A chunk
    that has grown eight times as large makes the tree be laid out anew, which encodes nothing. ``reencoded`` counts leaves,
    ``chars`` characters that edits have had encoded, comparisons included.
    """

    CHUNK = 32

    def __init__(self, encoder: Encoder, text: str):
        self.encoder = encoder
        self.reencoded = self.reread = 0
        self._lay_out(self._count(text))
        self.first = self.leaves

    def _count(self, text: str) -> list[tuple[str, int, bool]]:
        parts = [p for p in self.encoder.split(text) if p]
        if not any(len(p) > LONG for p in parts):
            return list(zip(parts, self.encoder.counts(parts), (False,) * len(parts)))
        out: list = []
        for p in parts:
            for x in FIRM.split(p) if len(p) > LONG else (p,):
                if len(x) > LONG and ONE.fullmatch(x):
                    out += [(y, n, i > 0) for i, (y, n) in enumerate(self.encoder.pieces(x))]
                else:
                    out.append(x)
        plain = [x for x in out if isinstance(x, str)]
        counts = iter(self.encoder.counts(plain))
        return [(x, next(counts), False) if isinstance(x, str) else x for x in out]

    def _lay_out(self, leaves: list[tuple[str, int, bool]]) -> None:
        self.chunks = [leaves[i : i + self.CHUNK] for i in range(0, len(leaves), self.CHUNK)] or [[]]
        m = 1 << (len(self.chunks) - 1).bit_length()
        self.m, self.leaves = m, len(leaves)
        self.chars, self.sums = [0] * (2 * m), [0] * (2 * m)
        for i, c in enumerate(self.chunks):
            self.chars[m + i] = sum(len(x[0]) for x in c)
            self.sums[m + i] = sum(x[1] for x in c)
        for i in range(m - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def text(self) -> str:
        return "".join(x[0] for c in self.chunks for x in c)

    def _find(self, at: int) -> tuple[int, int, int]:
        """(chunk, leaf, its first code point) of the leaf that holds code point ``at``, or of the last one."""
        i, before = 1, 0
        while i < self.m:
            i *= 2
            if at - before >= self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        chunk = i - self.m
        own = self.chunks[chunk]
        for k, x in enumerate(own):
            if at - before < len(x[0]) or k == len(own) - 1:
                return chunk, k, before
            before += len(x[0])
        return chunk, 0, before

    def _update(self, chunk: int) -> None:
        i = self.m + chunk
        self.chars[i] = sum(len(x[0]) for x in self.chunks[chunk])
        self.sums[i] = sum(x[1] for x in self.chunks[chunk])
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def _apart(self, left: str, right: str) -> bool:
        """Whether two texts inside a pre-token are encoded together as they are apart."""
        self.reread += 2 * (len(left) + len(right))
        both, a, b = self.encoder.plain([left + right, left, right])
        return both == a + b

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the code points from ``start`` up to ``end`` by ``new``; places beyond the text mean its end, an
        ``end`` before ``start`` means ``start``."""
        n = self.chars[1]
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        if start == end and not new:
            return
        # whether a cut is one depends on the two characters before it and the two behind it
        c0, k0, a = self._find(max(0, start - 2))
        c1, k1, b = self._find(max(0, min(end + 1, n - 1)))
        if self.chunks[c1]:
            b += len(self.chunks[c1][k1][0])
        wider = 1  # leaves; doubled, so where all of a long pre-token changes, that costs no more than twice its length
        while True:
            if c0 == c1:
                old = self.chunks[c0][k0 : k1 + 1]
            else:
                old = self.chunks[c0][k0:] + [x for c in range(c0 + 1, c1) for x in self.chunks[c]] + self.chunks[c1][: k1 + 1]
            was = "".join(x[0] for x in old)
            fresh = self._count(was[: start - a] + new + was[end - a :])
            self.reencoded += len(fresh)
            self.reread += len(was) - (end - start) + len(new)
            if old and old[0][2]:  # the pre-token began before
                c, k, at = self._find(a - 1)
                if not self._apart(self.chunks[c][k][0], fresh[0][0]):
                    for _ in range(wider):
                        c0, k0, a = c, k, at
                        if not self.chunks[c][k][2]:
                            break
                        c, k, at = self._find(a - 1)
                    wider *= 2
                    continue
                fresh[0] = (*fresh[0][:2], True)
            if b < n:
                c, k, at = self._find(b)
                if self.chunks[c][k][2] and not self._apart(fresh[-1][0], self.chunks[c][k][0]):
                    for _ in range(wider):
                        c1, k1, b = c, k, at + len(self.chunks[c][k][0])
                        if b == n:
                            break
                        c, k, at = self._find(b)
                        if not self.chunks[c][k][2]:
                            break
                    wider *= 2
                    continue
            break
        self.leaves += len(fresh) - len(old)
        if c0 == c1:
            self.chunks[c0][k0 : k1 + 1] = fresh
        else:
            self.chunks[c0][k0:] = fresh
            for c in range(c0 + 1, c1):
                self.chunks[c] = []
            del self.chunks[c1][: k1 + 1]
        if len(self.chunks[c0]) > 8 * self.CHUNK:
            self._lay_out([x for c in self.chunks for x in c])
        else:
            for c in range(c0, c1 + 1):
                self._update(c)


EDIT = "array<struct<start:bigint,end:bigint,text:string>>"


def edited_counts(docs, edits, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text"):
    """One row per document: ``doc_id``, ``tokens`` of its text, ``edited_tokens`` after its edits, ``edited_chars`` (code
    points), ``leaves`` (of the tree, before), ``reencoded`` (leaves encoded for the edits) and ``reencoded_chars`` (their characters, with
    those compared).

    ``edits``: a column of array<struct<start, end, text>>, applied in order, each at code points of the text as the
    ones before left it: from ``start`` up to ``end`` is replaced by ``text``. A null array has none, a null edit or one with a
    null place is skipped, a null text is empty, places beyond the text mean its end. A null document text is empty.
    Repeated rows are counted each, an empty table gives an empty result, other columns are ignored.
    """
    from pyspark.sql import functions as F

    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"), edits.cast(EDIT).alias("edits"))
    names = ["tokens", "edited_tokens", "edited_chars", "leaves", "reencoded", "reencoded_chars"]

    def run(batches):
        encoder = Encoder.cached(tokenizer)
        for batch in batches:
            out = [[] for _ in names]
            for raw, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tree = EditedCount(encoder, (raw or b"").decode())
                before = tree.tokens
                for e in changes or []:
                    if e is not None and e["start"] is not None and e["end"] is not None:
                        tree.edit(e["start"], e["end"], e["text"] or "")
                for c, v in zip(out, (before, tree.tokens, tree.chars[1], tree.first, tree.reencoded, tree.reread)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out)], ["doc_id", *names])

    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names))
