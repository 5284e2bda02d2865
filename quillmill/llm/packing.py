"""Best-fit packing with Martello-Toth dominance reduction.

Items are the pieces of documents, sizes 1 to capacity, so an instance is a histogram of at most `capacity` counts, whatever the
corpus: this is all the driver gets. The reduction permanently fixes sets that dominate every other set with their largest
item (a perfect pair; the largest partner where no two others fit; the best pair where no three fit), all bins of
an equal set at once, and shrinks the histogram; best-fit decreasing packs the remainder, again all equal bins at
once. The plan is at most a few thousand bin classes; each piece finds its place from its rank among pieces of its size.

Ranks: a tokenising task numbers its own pieces of each size; the counts of earlier tasks are added by a window over
(size, task), so no task holds a size's pieces. Null text is empty (one id, the end). Repeated rows and doc_ids are packed as
they come; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import column, materialize, small_batches
from quillmill.llm.tokens import cuts, default_vocabulary, document_ids

CAPACITY = 2048


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets; counts[s] (number of items of size s) is shrunk in place. Gives (sizes of a bin, number of such bins)."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(sizes: tuple[int, ...], times: int) -> None:
        for s in sizes:
            counts[s] -= times
        fixed.append((sizes, times))

    def smallest(n: int, without: int) -> list[int]:
        """The n least sizes left, with one item of size `without` set aside."""
        out: list[int] = []
        for s in np.flatnonzero(counts).tolist():
            out += [s] * min(n - len(out), int(counts[s]) - (s == without))
            if len(out) >= n:
                break
        return out

    if counts[capacity]:
        take((capacity,), int(counts[capacity]))
    for s in range(capacity - 1, (capacity + 1) // 2 - 1, -1):  # perfect pairs
        t = capacity - s
        pairs = int(counts[s]) // 2 if s == t else int(min(counts[s], counts[t]))
        if pairs:
            take((s, t), pairs)
    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            least = smallest(3, j)
            if not least or least[0] > room:
                take((j,), int(counts[j]))  # nothing fits beside it (items of its own size neither)
                continue
            below = counts[: room + 1].copy()
            if j <= room:
                below[j] -= 1
            k = int(np.flatnonzero(below)[-1])  # the largest partner
            if k == room or len(least) < 2 or least[0] + least[1] > room:
                times = int(counts[j]) // 2 if j == k else int(min(counts[j], counts[k]))
                take((j, k), max(1, times) if k == room or len(least) < 2 else 1)
                continue
            if len(least) >= 3 and sum(least) <= room:
                break  # three or more fit beside it: no rule decides
            below[k] -= 1
            under = np.flatnonzero(below[: max(0, room - k) + 1])
            if len(under):
                b = int(under[-1])
                over = below.copy()
                over[: b + 1] = 0
                over[k] += 1
                larger = [s for s in np.flatnonzero(over).tolist() for _ in range(min(2, int(over[s])))][:2]
                if len(larger) < 2 or sum(larger) > room:  # no pair has its smaller item over b, so {k, b} dominates all
                    take((j, k, b), 1)
                    continue
            elif sum(least[:2]) <= room:
                pass
            break
    return fixed


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of a histogram, equal bins together."""
    open_bins: dict[int, list[list]] = {}  # room left: [sizes, bins]
    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            room = next((r for r in range(s, capacity) if open_bins.get(r)), capacity)
            each = room // s
            if room == capacity:
                sizes, bins = [], n // each or 1
            else:
                sizes, bins = open_bins[room].pop()
            full = min(bins, n // each)
            if full:
                put = each
            else:
                full, put = 1, n
            if room < capacity and bins > full:
                open_bins[room].append([sizes, bins - full])
            open_bins.setdefault(room - put * s, []).append([[*sizes, *[s] * put], full])
            n -= full * put
    return [(tuple(sizes), bins) for group in open_bins.values() for sizes, bins in group]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(sizes of a bin, number of such bins) that use every item once."""
    left = counts.astype(np.int64).copy()
    return [*reduce_by_dominance(left, capacity), *best_fit_decreasing(left, capacity)]


def placement(bins: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the items of each size go, by rank: rows sorted by (size, first rank)."""
    rows, used, base = [], {}, 0
    for sizes, times in bins:
        offset, i = 0, 0
        while i < len(sizes):
            s = sizes[i]
            m = 1
            while i + m < len(sizes) and sizes[i + m] == s:
                m += 1
            r = used.get(s, 0)
            rows.append((s, r, base, m, offset))
            used[s] = r + m * times
            offset += m * s
            i += m
        base += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("size", "rank", "base", "each", "offset"))}


def tokenized_pieces(docs: DataFrame, capacity: int, path: str) -> DataFrame:
    """A row per piece with its task and its rank among that task's pieces of its length."""
    small_batches(docs.sparkSession)
    out_type = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("local", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in it:
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(column(b, "doc_id").to_pylist(), column(b, "text"), strict=True):
                ids = document_ids(text.as_py(), path)
                for k, (a, n) in enumerate(cuts(len(ids), capacity)):
                    for to, v in zip(out, (doc, k, a, n, zlib.crc32(ids[a : a + n].astype("<u4").tobytes()), task, int(seen[n])), strict=True):
                        to.append(v)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out_type)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    pieces = materialize(tokenized_pieces(docs, capacity, path or default_vocabulary()), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("length", "task", F.coalesce("before", F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    where = placement(plan(counts, capacity))
    key = where["size"] << 40 | where["rank"]  # ranks under 2 ** 40

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length, rank = column(b, "length").to_numpy(), column(b, "rank").to_numpy()
            at = np.searchsorted(key, length << 40 | rank, "right") - 1
            local = rank - where["rank"][at]
            each = where["each"][at]
            cols = [column(b, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(where["base"][at] + local // each), pa.array(where["offset"][at] + local % each * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
