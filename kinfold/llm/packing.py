"""Best-fit packing: bounded-space online best-fit into sequences of a fixed length.

A fixed number of bins is open. They are kept on stacks by free space, and an integer with
one bit per free space that some open bin has serves as the index: the tightest bin that
takes a piece is the lowest set bit at or above the piece's length. When a new bin would
exceed the limit, the fullest open bin closes first.

Each task packs the documents it reads as they come, with no shuffle and bounded memory. The pieces of the bins that are
still open at its end, at most ``OPEN`` bins a task, are not placed yet: a second pass, which sees their lengths and no text, deals
them out to tasks of about ``REST`` tokens and packs them there, the longest first. So the number of sequences hardly depends
on how many tasks have read the documents.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from ..runtime import settle
from .common import release
from .tokens import Encoder, slices

LENGTH = 1024
OPEN = 1024
REST = 32 << 20  # tokens that a task of the second pass packs, all its bins open
MADE = {
    "piece": IntegerType(), "start": LongType(), "length": LongType(), "ids_crc32": LongType(), "sequence_id": LongType(), "offset": LongType(), "ids": ArrayType(IntegerType())
}


class BestFit:
    """Places lengths of at most ``length``; ``put`` gives (bin number, offset)."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN):
        self.length, self.limit = length, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits = self.open = self.made = 0

    def put(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            stack = self.stacks[free]
            bin_ = stack.pop()
            if not stack:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            free, bin_ = self.length, self.made
            self.made += 1
        left = free - n
        if left:
            if self.open == self.limit:
                self._close()
            self.stacks[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.length - free

    def opened(self) -> np.ndarray:
        """Numbers of the bins that are open."""
        return np.array([b for s in self.stacks for b in s], np.int64)

    def _close(self) -> None:
        """The fullest open bin closes."""
        least = (self.bits & -self.bits).bit_length() - 1
        stack = self.stacks[least]
        stack.pop()
        if not stack:
            self.bits ^= 1 << least
        self.open -= 1


def pieces(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits; else the remainder first, then
    full pieces."""
    if n <= length:
        return [(0, n)]
    head = n % length
    return ([(0, head)] if head else []) + [(a, length) for a in range(head, n, length)]


def pack(docs: DataFrame, tokenizer: str | None = None, keep: list[str] | None = None, length: int = LENGTH, open_bins: int = OPEN, text: str = "text", end_id: int = 2, ids: bool = False, rest: int = REST) -> DataFrame:
    """One row per piece: the columns ``keep`` of its document, then ``piece``, ``start``,
    ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and, if ``ids``, ``ids`` (array of int).

    A document's ids are its text's, by the tokenizer file ``tokenizer``, then ``end_id``; a null
    text is empty, so it has that one id. Documents longer than ``length`` are cut, the first piece
    taking the remainder; others stay whole. ``ids_crc32`` is of the ids as little-endian
    unsigned 32-bit. ``sequence_id`` is unique in the result; pieces fill a sequence gapless
    from offset 0. Repeated rows are packed each; an empty table gives an empty result; columns
    not in ``keep`` are dropped, so their names can't clash, and ``keep`` may not name a column made here.
    """
    keep = ["doc_id"] if keep is None else keep
    if clash := {c.lower() for c in keep} & MADE.keys():
        raise ValueError(f"columns to keep have names of columns made: {sorted(clash)}")
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("text"))
    schema = StructType(src.schema.fields[:-1])
    for name, kind in MADE.items() if ids else list(MADE.items())[:-1]:
        schema = schema.add(name, kind)
    made = len(keep)  # the first column made
    seq_at, off_at = made + 4, made + 5

    def run(batches):
        encode = Encoder.cached(tokenizer)
        bins, part = BestFit(length, open_bins), TaskContext.get().partitionId() << 40
        kept = None  # rows of open bins

        def placed(table: pa.Table, close: bool) -> pa.Table:
            """``table`` with ids of sequences in place of numbers of bins, or null where the bins are not ``close``d."""
            seq = table.column(seq_at).to_numpy() + part if close else pa.nulls(len(table), pa.int64())
            return table.set_column(seq_at, "sequence_id", pa.array(seq, pa.int64()))

        for batch in (b.slice(a, n) for b in batches for a, n in slices(b.column(made))):
            row, out, parts = [], [[] for _ in range(6)], []
            data, size = encode.slice(batch.column(made), end_id)
            for r, (begin, total) in enumerate(zip((np.cumsum(size) - size).tolist(), size.tolist())):
                for k, (start, n) in enumerate(pieces(total, length)):
                    own = data[begin + start : begin + start + n]
                    row.append(r)
                    for c, v in zip(out, (k, start, n, zlib.crc32(own), *bins.put(n))):
                        c.append(v)
                    if ids:
                        parts.append(own.view("<i4"))
            take = pa.array(row, pa.int32())
            cols = [batch.column(i).take(take) for i in range(made)] + [pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(out)]
            if ids:
                cols.append(pa.array(parts, pa.list_(pa.int32())))
            now = pa.Table.from_arrays(cols, schema.names)
            now = now if kept is None else pa.concat_tables([kept, now])
            open_ = np.isin(now.column(seq_at).to_numpy(), bins.opened())
            kept = now.filter(pa.array(open_)).combine_chunks()
            yield from placed(now.filter(pa.array(~open_)), True).to_batches()
            del data, now, cols, out
            release()
        if kept is not None:
            full = np.isin(kept.column(seq_at).to_numpy(), bins.opened(), invert=True)
            yield from placed(kept.filter(pa.array(full)), True).to_batches()
            yield from placed(kept.filter(pa.array(~full)), False).to_batches()

    def again(batches):
        bins, part = BestFit(length, rest), (1 << 62) | (TaskContext.get().partitionId() << 40)
        for batch in batches:
            where = [bins.put(n) for n in batch.column(made + 2).to_pylist()]
            cols = batch.columns
            cols[seq_at] = pa.array([part | b for b, _ in where], pa.int64())
            cols[off_at] = pa.array([o for _, o in where], pa.int64())
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    first = settle(src.mapInArrow(run, schema), "packed")
    left = first.where("sequence_id is null")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    tail = left.repartition(max(1, math.ceil(tokens / rest))).sortWithinPartitions(F.col("length").desc()).mapInArrow(again, schema)
    return first.where("sequence_id is not null").unionByName(tail)
