"""Token-ID output: packed id matrices with segment bounds and position resets.

Each task tokenises its own rows and packs them in pools of `pool_tokens` ids by best-fit decreasing, where a segment tree over room
finds the fullest open sequence that an item fits into; nothing is shuffled, and memory is bounded by the pool. A document over
`capacity` ids (its end id included) is cut losslessly: the remainder first, full pieces after it.

A row is one sequence: input_ids (little-endian, padded with `pad` to capacity), n_tokens, cu_seqlens (0, end of each segment),
position_ids (0, 1, ... from each segment's start and in the padding), and doc_id, piece and start of each segment. Null text
is empty (one id, the end). Repeated rows are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import column, small_batches
from quillmill.llm.tokens import cuts, default_vocabulary, document_ids

CAPACITY, POOL_TOKENS = 2048, 6_000_000
TYPE = "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, pieces array<int>, starts array<long>"


class RoomTree:
    """A segment tree over room 0..capacity that counts open bins; first(s): the least room of at least s with a bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def first(self, s: int) -> int:
        i = s + self.leaves
        if self.count[i]:
            return s
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Items of each bin, by best-fit decreasing; equal items go into a bin together."""
    order = np.argsort(-lengths, kind="stable")
    tree, bins = RoomTree(capacity), [[] for _ in range(capacity + 1)]
    i, n = 0, len(order)
    while i < n:
        s = int(lengths[order[i]])
        j = i + int(np.searchsorted(-lengths[order[i:]], -s, "right"))
        items = order[i:j].tolist()
        i, at = j, 0
        while at < len(items):
            room = tree.first(s)
            if room < 0:
                room, held = capacity, []
            else:
                held = bins[room].pop()
                tree.add(room, -1)
            put = items[at : at + room // s]
            at += len(put)
            held.extend(put)
            bins[room - s * len(put)].append(held)
            tree.add(room - s * len(put), 1)
    return [b for group in bins for b in group]


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, pool_tokens: int = POOL_TOKENS, path: str | None = None, pad: int = 0, dtype: str = "<u2") -> DataFrame:
    """docs packed; a row per sequence (see the module's text)."""
    small_batches(docs.sparkSession)
    path = path or default_vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple[int, int, int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            bins = best_fit(np.array([len(x[3]) for x in held], np.int64), capacity)
            for k in range(0, len(bins), 512):
                cols: list[list] = [[] for _ in range(8)]
                for b in bins[k : k + 512]:
                    ids = np.full(capacity, pad, dtype)
                    pos = np.empty(capacity, "<u2" if capacity <= 65536 else "<u4")
                    ends = [0]
                    for x in b:
                        a, z = ends[-1], ends[-1] + len(held[x][3])
                        ids[a:z] = held[x][3]
                        pos[a:z] = np.arange(z - a)
                        ends.append(z)
                    pos[ends[-1] :] = np.arange(capacity - ends[-1])
                    for to, v in zip(cols, (sequence, ends[-1], ids.tobytes(), ends, pos.tobytes(), [held[x][0] for x in b], [held[x][1] for x in b], [held[x][2] for x in b]), strict=True):
                        to.append(v)
                    sequence += 1
                types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in TYPE.split(", ")])

        for b in it:
            for doc, text in zip(column(b, "doc_id").to_pylist(), column(b, "text"), strict=True):
                ids = document_ids(text.as_py(), path)
                if int(ids.max()) > np.iinfo(dtype).max:
                    raise ValueError("ids do not fit the type of the matrix")
                ids = ids.astype(dtype)
                held += [(doc, k, a, ids[a : a + n]) for k, (a, n) in enumerate(cuts(len(ids), capacity))]
                size += len(ids)
                if size >= pool_tokens:
                    yield from flush()
                    held.clear()
                    size = 0
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TYPE)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the matrices as Parquet files, one row group a batch of sequences."""
    packed_sequences(docs, **options).write.mode("errorifexists").parquet(path)
