"""What the text operators share: word rules, column housekeeping, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but space and \x09-\x0D. ``bytes.split()`` cuts at exactly these six
#: bytes and ``bytes.lower()`` changes exactly A-Z, so both work on UTF-8 without decoding it.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


_holder: list = [None, None]


def claim(name: str, forget: Callable[[], object]) -> None:
    """A worker process serves many stages, and remembers words for the operator that it serves now only: what another one
    remembered is forgotten as soon as this one starts."""
    if _holder[0] != name:
        if _holder[1] is not None:
            _holder[1]()
            release()
        _holder[:] = name, forget


def release() -> None:
    """Give the memory that this worker has freed back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class _WordHash(dict):
    """Hashes of the words seen last, as many as a worker may remember."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_hashes = _WordHash()


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """64-bit hashes of a text's word shingles, repeats included; a text with fewer words has one
    shingle of all of them, a wordless one none."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    claim("shingles", _hashes.clear)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    k = min(size, len(w))
    n = len(w) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = (acc ^ h[j : n + j]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return acc


def word_count(text: Column) -> Column:
    """Number of words, JVM-side; null has none. White space is made one kind, then runs of anything else are counted."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(flat, F.lit("[^ ]+")).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator is about to give (case-insensitively, as
    Spark resolves them)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind as make it unlike every column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
