"""Counts of 32-bit keys over all documents, and bitmaps of ids: what is small enough to be sent to every task.

What is large goes to the tasks as a file of Spark's own (`sent`), from the driver's disk: the driver's heap and Python never hold it whole.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import column, discard, lean, materialize

#: least count of a frequent key; most frequent keys (the bound rises until they fit)
FREQUENT, MAX_FREQUENT = 64, 1 << 22
_RANGE_BITS = 10
_RANGES, _WIDTH = 1 << _RANGE_BITS, 32 - _RANGE_BITS
_SHIFT = np.uint64(32)
#: arrays of more bytes go to the tasks as files; most bytes of a bitmap that a task sends to the driver at once
SENT_AS_FILE, AT_ONCE = 4 << 20, 2 << 20
_folder: tempfile.TemporaryDirectory | None = None
_mapped: dict[str, np.ndarray] = {}


def _file() -> Path:
    """A new file on the driver; all go when it ends."""
    global _folder
    if _folder is None:
        _folder = tempfile.TemporaryDirectory(prefix="quillmill-sent-")
    return Path(_folder.name) / uuid.uuid4().hex


class Sent:
    """An array for tasks, which call it: in the closure if small, else a file that each executor fetches once and its tasks map."""

    def __init__(self, spark: SparkSession, x: np.ndarray):
        self.x, self.name, self.kind = x, None, x.dtype.str
        if x.nbytes > SENT_AS_FILE:
            path = getattr(x, "filename", None)
            if path is None:
                path = _file()
                x.tofile(path)
            spark.sparkContext.addFile(str(path))
            self.x, self.name = None, Path(path).name

    def __call__(self) -> np.ndarray:
        if self.name is None:
            return self.x
        if self.name not in _mapped:
            _mapped[self.name] = np.asarray(np.memmap(SparkFiles.get(self.name), self.kind, "r"))
        return _mapped[self.name]


def sent(spark: SparkSession, *arrays: np.ndarray) -> list[Sent]:
    return [Sent(spark, x) for x in arrays]


def _delta16(keys: np.ndarray) -> bytes:
    """Sorted uint32 keys as 16-bit steps; 65535 is a step without a key."""
    step = np.diff(keys.astype(np.int64), prepend=0)
    step[0] = keys[0] & 0xFFFFFF
    skip = step // 65535
    if not skip.any():
        return step.astype("<u2").tobytes()
    out = np.full(len(step) + int(skip.sum()), 65535, "<u2")
    out[np.cumsum(skip) + np.arange(len(step))] = step % 65535
    return out.tobytes()


def _undelta16(blob: bytes) -> np.ndarray:
    step = np.frombuffer(blob, "<u2")
    return np.cumsum(step, dtype=np.uint32)[step != 65535]


def _planes(blob: bytes) -> bytes:
    """16-bit steps with their low and high bytes apart, compressed: the high ones hold few values."""
    return zstandard.ZstdCompressor(level=1).compress(np.frombuffer(blob, np.uint8).reshape(-1, 2).T.tobytes())


def _unplanes(blob: bytes) -> bytes:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(2, -1).T.tobytes()


def key_statistics(docs: DataFrame, hashes: Callable[[pa.Array], Iterator[np.ndarray]], frequent: int = FREQUENT, bits_per_key: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
    """hashes: 64-bit keys of a column of texts, whose upper half is counted. Gives (sorted frequent 32-bit keys, bitmap of keys that occur more than once, its number of bits as a power of 2: bits_per_key or more for each such key, 2 ** 30 at most).

    Tasks send each key once, with its count where that is over 1, so a very common key is a row of each task and not of each place. A range of keys
    is summed in an array of 2 ** 22 counters, whatever the number of keys. With more repeated keys than the bitmap has room for, more
    keys pass it that occur once: those that use it send more, with the same results.
    """

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(keys))).astype(np.int32)
            keys = keys[first]
            at = np.searchsorted(keys >> np.uint32(_WIDTH), np.arange(_RANGES + 1))
            some = [r for r in range(_RANGES) if at[r + 1] > at[r]]
            blobs, more = [], []
            for r in some:
                blobs.append(_planes(_delta16(keys[at[r] : at[r + 1]] & np.uint32((1 << _WIDTH) - 1))))
                n = times[at[r] : at[r + 1]]
                again = np.flatnonzero(n > 1).astype(np.int32)
                more.append(np.concatenate([again, n[again]]).astype("<i4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary()), pa.array(more, pa.binary())], names=["range", "keys", "more"])

        for b in it:
            for s in hashes(column(b, "text")):
                held.append((s >> _SHIFT).astype(np.uint32))
                size += len(s)
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        yield flush()

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range. Few keys are sorted, more are added up in the counters."""
        counts, at, held, size = None, None, [], 0

        def fold() -> None:
            nonlocal counts, held, size
            if counts is None:
                counts = np.zeros(1 << _WIDTH, np.int64)
            for keys, again, n in held:
                counts[keys] += 1
                counts[keys[again]] += n - 1
            held, size = [], 0

        def total() -> pa.RecordBatch:
            nonlocal counts, held, size
            if counts is None:
                every = np.concatenate([k for k, _, _ in held] + [k[again] for k, again, _ in held])
                n = np.concatenate([np.ones(size, np.int64)] + [n - 1 for _, _, n in held])
                order = np.argsort(every, kind="stable")
                every, n = every[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                keys, n = every[first].astype(np.int64), np.add.reduceat(n, first)
                keys, n = keys[n > 1], n[n > 1]
            else:
                fold()
                keys = np.flatnonzero(counts > 1)
                n = counts[keys]
            counts, held, size = None, [], 0
            often = n >= frequent
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([len(keys)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys.astype("<u4"), keys[often].astype("<u4"), np.minimum(n[often], 2**31 - 1).astype("<i4")))],
                names=["range", "n", "repeated", "often", "times"],
            )

        for b in it:
            for r, blob, more in zip(*(column(b, c).to_pylist() for c in ("range", "keys", "more")), strict=True):
                if r != at:
                    if at is not None:
                        yield total()
                    at = r
                keys = _undelta16(_unplanes(blob))
                again, n = np.frombuffer(more, "<i4").reshape(2, -1)
                held.append((keys, again, n.astype(np.int64)))
                size += len(keys)
                if size > 1 << (_WIDTH - 2):
                    fold()
        if at is not None:
            yield total()

    ranged = docs.select("text").mapInArrow(lean(send), "range int, keys binary, more binary").repartition("range").sortWithinPartitions("range")
    merged = materialize(ranged.mapInArrow(lean(merge), "range int, n long, repeated binary, often binary, times binary"), "keys")
    total = merged.agg(F.sum("n")).first()[0] or 0
    bits = min(30, max(16, int(bits_per_key * total).bit_length()))

    def slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for x in column(b, "repeated").to_pylist():
                flags = np.zeros(1 << (bits - _RANGE_BITS), np.uint8)
                flags[np.frombuffer(x, "<u4") >> (32 - bits)] = 1
                out.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([column(b, "range"), pa.array(out, pa.binary())], names=["range", "bits"])

    def levels(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many keys occur `frequent` times 1, 2, 4 and so on or more, up to the next."""
        n = np.zeros(32, np.int64)
        for b in it:
            for x in column(b, "times").to_pylist():
                n += np.bincount(np.frexp(np.frombuffer(x, "<i4") // frequent)[1] - 1, minlength=32)[:32]
        yield pa.RecordBatch.from_arrays([pa.array(range(32), pa.int32()), pa.array(n)], names=["level", "n"])

    def chosen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [np.frombuffer(k, "<u4")[np.frombuffer(t, "<i4") >= frequent].tobytes() for k, t in zip(column(b, "often").to_pylist(), column(b, "times").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "range"), pa.array(out, pa.binary())], names=["range", "often"])

    width = 1 << (bits - 3 - _RANGE_BITS)
    parts = merged.select("range", "repeated").mapInArrow(slices, "range int, bits binary")
    if width << _RANGE_BITS > AT_ONCE:  # a partition at a time comes to the driver
        parts = parts.repartition((width << _RANGE_BITS) // AT_ONCE, "range")
    path = _file()
    with path.open("wb") as f:
        f.truncate(1 << (bits - 3))
        for r in parts.toLocalIterator():
            f.seek(r["range"] * width)
            f.write(r["bits"])
    bitmap = np.memmap(path, np.uint8, "r")
    path = _file()  # of keys by ranges as they come
    found: dict[int, tuple[int, int]] = {}
    with path.open("wb") as f:
        if frequent < 1 << 31:
            n = {r["level"]: r["n"] for r in merged.select("times").mapInArrow(levels, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()}
            above = np.cumsum([n.get(i, 0) for i in range(32)][::-1])[::-1]
            frequent <<= int((above > 2 * MAX_FREQUENT).sum())  # a greater bound for "frequent" is as right
            for r in merged.select("range", "often", "times").mapInArrow(chosen, "range int, often binary").toLocalIterator():
                found[r["range"]] = f.tell(), len(r["often"])
                f.write(r["often"])
    discard(merged)
    ordered = _file()
    with path.open("rb") as f, ordered.open("wb") as g:
        for r in sorted(found):
            f.seek(found[r][0])
            g.write((np.frombuffer(f.read(found[r][1]), "<u4") + np.uint32(r << _WIDTH)).astype("<u4").tobytes())
    path.unlink()
    return _held(ordered, np.uint32), bitmap, bits


def _held(path: Path, kind: type) -> np.ndarray:
    """The array in a file: mapped if it will be sent as that file, else read."""
    return np.memmap(path, kind, "r") if path.stat().st_size > SENT_AS_FILE else np.fromfile(path, kind)


def bitmap_of(df: DataFrame, col: str, most: int = 27) -> tuple[np.ndarray, int]:
    """Flags of the leading bits of the long column's values (at most 2 ** most of them) and how many bits lead. Tasks build it by ranges, which go through the driver into a file."""
    bits = min(most, max(16, int(16 * df.count()).bit_length()))
    width = 1 << (bits - 3 - _RANGE_BITS)

    def slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in it:
            p = column(b, "p").to_numpy()
            ranges = p >> (bits - _RANGE_BITS)
            by = np.argsort(ranges, kind="stable")
            p, ranges = p[by], ranges[by]
            first = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(p) else []
            for i, j in zip(first, [*first[1:], len(p)], strict=True):
                flags = held.setdefault(int(ranges[i]), np.zeros(width, np.uint8))
                at = p[i:j] & ((width << 3) - 1)
                np.bitwise_or.at(flags, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        for r, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([flags.tobytes()], pa.binary())], names=["range", "bits"])

    places = df.select(F.expr(f"shiftrightunsigned({col}, {64 - bits})").alias("p"))
    parts = places.repartition(max(1, (width << _RANGE_BITS) // AT_ONCE), F.shiftright("p", bits - _RANGE_BITS)).mapInArrow(lean(slices), "range int, bits binary")
    path = _file()
    with path.open("wb") as f:
        f.truncate(1 << (bits - 3))
        for r in parts.toLocalIterator():
            f.seek(r["range"] * width)
            f.write(r["bits"])
    return _held(path, np.uint8), bits


def flagged(bitmap: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values have their leading bits flagged."""
    at = (values.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def parted(df: DataFrame, col: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """df's rows whose long column is among the keys, with a few others, and the rest: rows that no key can meet need not go through the shuffle of a join with them. keys: written already."""
    bitmap, bits = bitmap_of(keys.select(key).distinct(), key)
    (bitmap,) = sent(df.sparkSession, bitmap)
    at = df.columns.index(col)

    def rows(flag: bool) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                yield b.filter(pa.array(flagged(bitmap(), bits, b.column(at).to_numpy()) == flag))

        return df.mapInArrow(run, df.schema)

    return rows(True), rows(False)
