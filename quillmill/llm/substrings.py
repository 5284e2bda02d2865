"""Exact substring dedup: every byte covered by a `length`-byte string that also starts elsewhere is removed.

Prefix doubling with names: the rank of a string is its name (64-bit hash), the name of a longer string comes from
those of its parts (prefix sums), and Spark sorts names to find those that are not unique. Ranks at growing lengths:

1. a window of `length` bytes has a least gram of GRAM bytes, the same wherever the window occurs; neighbouring windows with the same least
   gram form an interval, about one per (length - GRAM) / 2 bytes. Intervals whose gram occurs once in the corpus hold no repeat.
2. names of whole intervals (all their windows' bytes) are sorted; those that occur again are repeats, window by window.
3. what is left, intervals whose gram repeats while their whole does not (the ends of shared passages), and one interval of each repeated whole
   with such a gram, have the names of all their windows counted, and those that repeat sorted.

Unique positions leave after each step, past `length` the ranking stops. Copies within a task meet there, so a string sends two
rows a task at most, however often it occurs.

Rows are told apart by a hash of doc_id and text. Nulls count as empty, texts under `length` bytes lose nothing, matches never
cross documents. Repeated rows repeat each other. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.bytewindows import Names, intervals
from quillmill.llm.common import column, materialize, pieces, small_batches, text_buffer
from quillmill.llm.keystats import bitmap_of, flagged, key_statistics, sent

LENGTH, GRAM, STEP = 200, 96, 8 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def steps(texts: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place of the first byte in its row) of parts of a column; a very long text is cut so that no window is lost."""
    for i, j in pieces(texts):
        buf, off = text_buffer(texts.slice(i, j - i))
        if len(buf) <= STEP or j > i + 1:
            yield i, buf, off, 0
        else:
            for a in range(0, len(buf), STEP):
                part = buf[a : a + STEP + length - 1]
                yield i, part, np.array([0, len(part)]), a


def row_ids(batch: pa.RecordBatch) -> np.ndarray:
    """A 64-bit id of each row's doc_id and text."""
    buf, off = text_buffer(column(batch, "text"))
    data = memoryview(np.ascontiguousarray(buf))
    ids = column(batch, "doc_id").to_pylist()
    return np.array([xxhash.xxh3_64_intdigest(data[a:z], seed=(i if i is not None else 1 << 63) & (1 << 64) - 1) for i, a, z in zip(ids, off[:-1].tolist(), off[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def _spread(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((x.view(np.uint64) ^ y.astype(np.uint64)) * _GOLD).view(np.int64)


def _merged(rid: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring spans of a row as one, of at most 65535 windows: rid and packed span."""
    if not len(rid):
        return rid, start
    total = np.cumsum(n)
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (total[1:] // 32_768 != total[:-1] // 32_768)
    first = np.flatnonzero(new)
    return rid[first], start[first] << 16 | np.add.reduceat(n, first)


def _local(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which occur more than once here, and which are to be sent: the first two of each."""
    order = np.argsort(names, kind="stable")
    s = names[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    third = np.zeros(len(s), bool)
    third[2:] = same[1:] & same[:-1]
    again, send = np.zeros(len(s), bool), np.ones(len(s), bool)
    again[order], send[order] = twice, ~third
    return again, send


def _runs(it: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Sorted batches cut so that no key is split."""
    rest: list[np.ndarray] | None = None
    for b in it:
        x = [column(b, c).to_numpy(zero_copy_only=False) for c in names]
        if rest is not None:
            x = [np.concatenate(v) for v in zip(rest, x, strict=True)]
        if not len(x[0]):
            continue
        last = int(np.searchsorted(x[0], x[0][-1], "left"))
        if last:
            yield [v[:last] for v in x]
        rest = [v[last:] for v in x]
    if rest is not None and len(rest[0]):
        yield rest


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(rid, start, n): windows start .. start + n - 1 of row rid occur elsewhere too. Spans may repeat or overlap."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def grams(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, buf, off, _ in steps(texts, length):
            yield intervals(buf, off, length, gram)[4]

    _, bitmap, bits = key_statistics(docs, grams, 1 << 62, 64)
    (bitmap,) = sent(docs.sparkSession, bitmap)

    def wholes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rid = row_ids(b)
            cols: list[list[np.ndarray]] = [[] for _ in range(4)]
            for i, buf, off, at in steps(column(b, "text"), length):
                row, first, last, place, g, names = intervals(buf, off, length, gram)
                k = flagged(bitmap(), bits, g)
                row, first, last, place, g = row[k], first[k], last[k], place[k], g[k]
                with np.errstate(over="ignore"):
                    whole = names.of(first, last + length) ^ ((place - first).astype(np.uint64) * _GOLD)
                for to, v in zip(cols, (whole.view(np.int64), g.view(np.int64), rid[i + row], (first - off[row] + at) << 16 | (last - first + 1)), strict=True):
                    to.append(v)
            whole, g, r, span = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
            again, send = _local(whole)
            kr, ks = _merged(r[~send], span[~send] >> 16, span[~send] & 0xFFFF)
            cols = [np.concatenate(v) for v in ((whole[send], _spread(kr, ks)), (g[send] >> 32, np.zeros_like(kr)), (r[send], kr), (span[send], ks), (again[send].astype(np.int8), np.full(len(kr), 2, np.int8)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int8()), strict=True)], names=["key", "gram", "rid", "span", "kind"])

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: found once in its task, 1: more often, 2: no question, already known. state 1: repeated, 2: open, 3: repeated, one for its name."""
        for key, g, r, span, kind in _runs(it, ["key", "gram", "rid", "span", "kind"]):
            asked = kind < 2
            order = np.argsort(np.where(asked, 0, 1), kind="stable")
            key, g, r, span, kind, asked = (v[order] for v in (key, g, r, span, kind, asked))
            state = np.ones(len(key), np.int8)
            n = int(asked.sum())
            _, first, inverse, count = np.unique(key[:n], return_index=True, return_inverse=True, return_counts=True)
            state[:n] = np.where(count[inverse] > 1, 1, 2)
            state[first[count > 1]] = 3
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r, span, g, state)], names=["rid", "span", "gram", "state"])

    keyed = rows.mapInArrow(wholes, "key long, gram int, rid long, span long, kind byte").repartition("key").sortWithinPartitions("key")
    spans = materialize(keyed.mapInArrow(judge, "rid long, span long, gram int, state byte"), "spans")
    opened = spans.where("state = 2")
    open_grams = materialize(opened.select("gram").distinct(), "grams")
    asked = opened.select("rid", "span", F.lit(True).alias("want")).union(spans.where("state = 3").join(open_grams, "gram", "left_semi").select("rid", "span", F.lit(False).alias("want")))
    asked = materialize(asked.groupBy("rid").agg(F.collect_list(F.struct("span", "want")).alias("asks")), "asked")
    some, some_bits = bitmap_of(asked, "rid")
    (some,) = sent(docs.sparkSession, some)

    def texts_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rid = row_ids(b)
            k = pa.array(np.flatnonzero(flagged(some(), some_bits, rid)))
            yield pa.RecordBatch.from_arrays([pa.array(rid).take(k), column(b, "text").take(k)], names=["rid", "text"])

    def name_windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The names of all windows that are asked for, a row for each row of documents."""
        for b in it:
            buf, off = text_buffer(column(b, "text"))
            asks = column(b, "asks")
            inner, cut = asks.flatten(), np.concatenate([[0], np.cumsum(asks.value_lengths().to_numpy(zero_copy_only=False))])
            span, want = inner.field("span").to_numpy(), inner.field("want").to_numpy(zero_copy_only=False)
            out: list[list] = [[] for _ in range(3)]
            for r in range(b.num_rows):
                sp, first = np.unique(span[cut[r] : cut[r + 1]], return_index=True)
                wa = want[cut[r] : cut[r + 1]][first]
                start, n = sp >> 16, sp & 0xFFFF
                size = n + length - 1
                to = np.concatenate([[0], np.cumsum(size)])
                part = np.concatenate([buf[off[r] + s : off[r] + s + z] for s, z in zip(start.tolist(), size.tolist(), strict=True)])
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                for c, v in zip(out, (sp.astype("<i8").tobytes(), np.packbits(wa).tobytes(), Names(part).fixed(length)[np.repeat(to[:-1], n) + at].astype("<u8").tobytes()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([column(b, "rid"), *(pa.array(c, pa.binary()) for c in out)], names=["rid", "spans", "want", "names"])

    joined = rows.mapInArrow(texts_of, "rid long, text string").join(asked, "rid")
    named = materialize(joined.mapInArrow(name_windows, "rid long, spans binary, want binary, names binary"), "names")
    _, again_map, again_bits = key_statistics(named.select(F.col("names").alias("text")), lambda col: (np.frombuffer(x.as_buffer(), "<u8") for x in col), 1 << 62, 32)
    (again_map,) = sent(docs.sparkSession, again_map)

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each window whose name repeats."""
        for b in it:
            cols: list[list[np.ndarray]] = [[] for _ in range(4)]
            for rid, sp, wa, names in zip(*(column(b, c).to_pylist() for c in ("rid", "spans", "want", "names")), strict=True):
                sp, name = np.frombuffer(sp, "<i8"), np.frombuffer(names, "<u8")
                start, n = sp >> 16, sp & 0xFFFF
                wa = np.unpackbits(np.frombuffer(wa, np.uint8), count=len(sp)).astype(bool)
                k = flagged(again_map(), again_bits, name)
                pos = (np.repeat(start, n) + np.arange(len(name)) - np.repeat(np.cumsum(n) - n, n))[k]
                for c, v in zip(cols, (name[k], np.full(len(pos), rid, np.int64), pos, np.repeat(wa, n)[k]), strict=True):
                    c.append(v)
            if not cols[0]:
                continue
            name, rid, pos, want = (np.concatenate(c) for c in cols)
            again, send = _local(name)
            known = ~send & want
            kr, ks = _merged(rid[known], pos[known], np.ones(int(known.sum()), np.int64))
            out = [np.concatenate(v) for v in ((name[send].view(np.int64), _spread(kr, ks)), (rid[send], kr), (pos[send] << 16 | 1, ks), (want[send].astype(np.int8), np.full(len(kr), 2, np.int8)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["key", "rid", "span", "kind"])

    def repeats(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: only a counterpart, 1: asked, 2: known."""
        for key, r, span, kind in _runs(it, ["key", "rid", "span", "kind"]):
            asked = np.flatnonzero(kind < 2)
            _, inverse, count = np.unique(key[asked], return_inverse=True, return_counts=True)
            yes = kind == 2
            yes[asked] = (count[inverse] > 1) & (kind[asked] == 1)
            yield pa.RecordBatch.from_arrays([pa.array(r[yes]), pa.array(span[yes] >> 16), pa.array(span[yes] & 0xFFFF)], names=["rid", "start", "n"])

    single = named.mapInArrow(windows, "key long, rid long, span long, kind byte").repartition("key").sortWithinPartitions("key").mapInArrow(repeats, "rid long, start long, n long")
    return spans.where("state != 2").select("rid", F.shiftright("span", 16).alias("start"), F.expr("span & 65535").alias("n")).union(single)


def cover(start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the windows."""
    order = np.argsort(start, kind="stable")
    a, z = start[order], np.maximum.accumulate((start + n - 1 + length)[order])
    new = np.concatenate([[True], a[1:] > z[:-1]])
    firsts = np.flatnonzero(new)
    return a[firsts], z[np.concatenate([firsts[1:] - 1, [len(a) - 1]])]


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text: kept (the bytes left) and spans (removed runs) too."""
    spans = materialize(repeated_spans(docs, length, gram), "repeats")
    found = materialize(spans.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "removed")
    some, some_bits = bitmap_of(found, "rid")
    (some,) = sent(docs.sparkSession, some)
    head = "doc_id long, rid long, n_bytes long, sha string, text string"

    def untouched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rid = row_ids(b)
            text = column(b, "text").fill_null("")
            buf, off = text_buffer(text)
            data = memoryview(np.ascontiguousarray(buf))
            hit = flagged(some(), some_bits, rid)
            sha = [None if h else hashlib.sha256(data[a:z]).hexdigest() for h, a, z in zip(hit.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True)]
            import pyarrow.compute as pc

            kept = text if with_text else pc.if_else(pa.array(hit), text, pa.scalar(None, text.type))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(rid), pa.array(np.diff(off)), pa.array(sha, pa.string()), kept], names=["doc_id", "rid", "n_bytes", "sha", "text"])

    extra = ", kept string, spans array<struct<start:long,end:long>>" if with_text else ""

    def remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[list] = [[] for _ in range(6)]
            shas, texts, spans = column(b, "sha").to_pylist(), column(b, "text"), column(b, "spans")
            for r, known in enumerate(shas):
                mine = spans[r]
                if known is not None or not mine.is_valid:
                    text = texts[r].as_py()
                    row = (0, 0, known or hashlib.sha256((text or "").encode()).hexdigest(), text, [])
                else:
                    data = texts[r].as_buffer() if texts[r].is_valid else b""
                    buf = np.frombuffer(data, np.uint8)
                    v = mine.values
                    a, z = cover(v.field("start").to_numpy(), v.field("n").to_numpy(), length)
                    drop = np.zeros(len(buf) + 1, np.int32)
                    np.add.at(drop, a, 1)
                    np.add.at(drop, z, -1)
                    left = buf[np.cumsum(drop[:-1]) == 0].tobytes()
                    row = (len(buf) - len(left), len(a), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None, [{"start": int(x), "end": int(y)} for x, y in zip(a, z, strict=True)] if with_text else [])
                for to, x in zip(out, row, strict=False):
                    to.append(x)
            cols = [column(b, "doc_id"), column(b, "n_bytes"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols += [pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(untouched, head)
    return rows.join(found, "rid", "left").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)
