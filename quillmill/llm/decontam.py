"""Benchmark decontamination by SimHash windows.

Words are runs of letters and digits, lower case; a kana or Han character is a word. Items of like length share a window size (that of the shortest, within
CLASS_RATIO); an item's fingerprint is the 64-bit SimHash of the word pairs in its middle window. Every window of that size of
every document is fingerprinted (sums of bits over the window come from running sums) and looked up in four
16-bit blocks: a distance of at most RADIUS leaves one block with at most RADIUS // 4 bits changed, and all such values are
in the block's table, so no fingerprint within the radius is lost. As edits may put a window beyond the radius, all shingles of the items
are looked up too: a row that has 0.8 of an item's weight, as every match must, is a candidate where they stand. Candidates are verified exactly: the Jaccard similarity, weighted
by how rare a shingle is among all items (a shingle that the item does not have weighs as much as one that no item has), of the item's 5-word shingles
(with multiplicity) and those of the item-sized window, best over small shifts, must be 0.8 or more.

The benchmark is the query set: it is sent to the tasks in blocks of about MAX_ITEMS items and MAX_BYTES of text (a longer item is a block's only one); weights
come from all items, so results don't depend on the blocks. Documents aren't shuffled.

Null items and items of one word are skipped (a word is no evidence of an item), items of 2 to 4 words have one shingle. Null and empty texts, and texts shorter
than every window, match nothing, but a text of 0.8 of an item's length or more is one window. Repeated doc_ids give their own rows, equal
items each match. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import column, materialize, pieces, small_batches, text_buffer
from quillmill.llm.textvec import mix, shingles, words

RADIUS, WORDS, SIMILARITY, CLASS_RATIO, MAX_ITEMS, MAX_BYTES = 11, 5, 0.8, 1.25, 20_000, 16 << 20


def pairs_of(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)


def item_shingles(h: np.ndarray) -> np.ndarray:
    return shingles(h, WORDS) if len(h) >= WORDS else shingles(np.concatenate([h, np.full(WORDS - len(h), 0x5BF03635, np.uint64)]), WORDS)


def bit_sums(g: np.ndarray) -> np.ndarray:
    """Running sums of the bits of 64-bit features: 8 rows of longs, each of 8 byte-wide counters.

    As whole numbers they may wrap, yet the difference of two sums less than 256 features apart is exact in every byte.
    """
    out = np.zeros((8, len(g) + 1), np.uint64)
    bits = np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
    np.cumsum(np.ascontiguousarray(bits.T), axis=1, out=out[:, 1:])
    return out


def simhash(sums: np.ndarray, at: np.ndarray | slice, n: int) -> np.ndarray:
    """SimHash of the n features from each start (all starts for a slice); the sums are added up where n is over 255."""
    if isinstance(at, slice):
        at = np.arange(sums.shape[1] - n) if n > 255 else at
    if n <= 255:
        ones = np.ascontiguousarray(sums[:, n:] - sums[:, : sums.shape[1] - n] if isinstance(at, slice) else sums[:, at + n] - sums[:, at]).view(np.uint8)
    else:
        ones = sum(np.ascontiguousarray(sums[:, np.minimum(at + k + 255, at + n)] - sums[:, at + k]).view(np.uint8).astype(np.int32) for k in range(0, n, 255))
    planes = np.packbits((ones > n // 2).reshape(-1)).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


@dataclass
class SizeClass:
    """Items that share a window size."""

    size: int
    items: list[int] = field(default_factory=list)
    fingerprints: list[int] = field(default_factory=list)
    skips: list[int] = field(default_factory=list)  # words of the item before its window

    def index(self, radius: int) -> SizeClass:
        self.prints = np.array(self.fingerprints, np.uint64)
        flips = [sum(1 << b for b in c) for n in range(radius // 4 + 1) for c in combinations(range(16), n)]
        flips = np.array(flips)
        blocks = self.prints.view(np.uint16).reshape(-1, 4).astype(np.int64)
        self.starts, self.counts, self.listed = [], [], []
        for b in range(4):  # the items of every value of a block
            values = (blocks[:, b, None] ^ flips[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            count = np.bincount(values, minlength=1 << 16)
            self.counts.append(np.minimum(count, 1).astype(np.uint8))
            self.starts.append(np.concatenate([[0], np.cumsum(count)]))
            self.listed.append((order // len(flips)).astype(np.int32))
        return self

    def candidates(self, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in fp, place in items) of all within the radius; a pair may come more than once."""
        blocks = np.ascontiguousarray(fp.view(np.uint16).reshape(-1, 4).T)
        found, which = [], []
        for b in range(4):
            at = np.flatnonzero(self.counts[b].take(blocks[b]).view(bool))
            value = blocks[b].take(at).astype(np.int64)
            first = self.starts[b].take(value)
            n = self.starts[b].take(value + 1) - first
            if n.max(initial=0) > 1:
                at, first, extra = np.repeat(at, n), np.repeat(first, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                first = first + extra
            item = self.listed[b].take(first)
            near = np.flatnonzero(np.bitwise_count(fp.take(at) ^ self.prints.take(item)) <= radius)
            found.append(at[near])
            which.append(item[near])
        return np.concatenate(found), np.concatenate(which)


class Benchmark:
    """Fingerprints, shingle counts and weights of a block of items. frequency: number of all items, a sorted array of shingles and how many items have each; None: the block is all."""

    def __init__(self, ids: list[int], texts: list[str], radius: int, frequency: tuple[int, np.ndarray, np.ndarray] | None = None):
        buf, off = text_buffer(pa.array(texts, pa.string()))
        h, _, _, row = words(buf, off, loose=True)
        mine = [h[row[i] : row[i + 1]] for i in range(len(ids))]
        self.ids, self.radius = ids, radius
        self.sizes = [len(x) for x in mine]
        self.counts = [Counter(item_shingles(x).tolist()) if len(x) else Counter() for x in mine]
        n = len(ids)
        if frequency is None:
            df, total = Counter(s for c in self.counts for s in c), n
        else:
            total, df = frequency[0], dict(zip(frequency[1].tolist(), frequency[2].tolist(), strict=True))
        self.unseen = float(np.log1p(total))
        self.weight = {s: float(np.log1p(total / k)) for s, k in df.items()}
        self.mass = [sum(self.weight[s] * k for s, k in c.items()) for c in self.counts]
        self.classes: list[SizeClass] = []
        for i in sorted((i for i in range(n) if self.sizes[i] >= 2), key=lambda i: self.sizes[i]):
            if not self.classes or self.sizes[i] > self.classes[-1].size * CLASS_RATIO:
                self.classes.append(SizeClass(self.sizes[i]))
            c = self.classes[-1]
            skip = (self.sizes[i] - c.size) // 2
            g = pairs_of(mine[i][skip : skip + c.size])
            c.items.append(i)
            c.skips.append(skip)
            c.fingerprints.append(int(simhash(bit_sums(g), np.array([0]), len(g))[0]))
        for c in self.classes:
            c.index(radius)
        have = [i for i in range(n) if self.sizes[i] >= WORDS]  # a shorter item has to be there as it is, at distance 0
        sh = [shingles(mine[i], WORDS) for i in have]
        every = np.concatenate(sh) if sh else np.zeros(0, np.uint64)
        self.keys, kind = np.unique(every, return_inverse=True)
        order = np.argsort(kind, kind="stable")
        self.post_item = np.repeat(np.array(have, np.int64), [len(x) for x in sh])[order]
        self.post_place = np.concatenate([np.arange(len(x)) for x in sh])[order] if sh else np.zeros(0, np.int64)
        self.post = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=len(self.keys)))])
        self.known = np.zeros(1 << 20, bool)
        self.known[self.keys >> np.uint64(44)] = True

    def sharing(self, h: np.ndarray, row: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """(row, item): where the item would start, by each shingle they share, if those are SIMILARITY of its weight."""
        sh = shingles(h, WORDS)
        at = np.flatnonzero(self.known[sh >> np.uint64(44)])
        which = np.searchsorted(self.keys, sh[at])
        r = np.searchsorted(row, at, "right") - 1
        ok = (which < len(self.keys)) & (at + WORDS <= row[r + 1])
        ok[ok] = self.keys[which[ok]] == sh[at[ok]]
        at, which, r = at[ok], which[ok], r[ok]
        n = self.post[which + 1] - self.post[which]
        at, r, key = np.repeat(at, n), np.repeat(r, n), np.repeat(which, n)
        entry = np.repeat(self.post[which], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        item, start = self.post_item[entry], at - self.post_place[entry]
        order = np.lexsort((start, item, r))
        r, item, start, key = (v[order] for v in (r, item, start, key))
        cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (item[1:] != item[:-1])])) if len(r) else np.zeros(0, np.int64)
        out = {}
        for a, z in zip(cut.tolist(), np.append(cut[1:], len(r)).tolist()):
            i = int(item[a])
            shared = sum(self.weight[s] * self.counts[i][s] for s in self.keys[np.unique(key[a:z])].tolist())
            if shared >= SIMILARITY * self.mass[i] * (1 - 1e-9):
                out[int(r[a]), i] = np.unique(start[a:z]).tolist()
        return out

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and a window's word hashes."""
        have = Counter(item_shingles(window).tolist())
        mine = self.counts[item]
        both = sum(self.weight[s] * min(k, have[s]) for s, k in mine.items() if s in have)
        strange = self.unseen * sum(k for s, k in have.items() if s not in mine)
        more = sum(self.weight[s] * max(0, have[s] - k) for s, k in mine.items() if s in have)
        return both / (self.mass[item] + strange + more)

    def best(self, h: np.ndarray, row: np.ndarray, most: int = 1 << 19) -> dict[tuple[int, int], tuple[float, int, int]]:
        """`matches`; a row of over `most` words, which comes alone, in parts that overlap by two windows."""
        if len(row) > 2 or len(h) <= most:
            return self.matches(h, row)
        over = 2 * max(self.sizes, default=0) + 8
        out: dict[tuple[int, int], tuple[float, int, int]] = {}
        for a in range(0, len(h), most):
            part = h[a : a + most + over]
            for at, (like, x, z) in self.matches(part, np.array([0, len(part)])).items():
                if like > out.get(at, (0.0, 0, 0))[0]:
                    out[at] = (like, x + a, z + a)
        return out

    def matches(self, h: np.ndarray, row: np.ndarray) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(row, item): (similarity, first word, past the last) of the best verified window; h: word hashes, row: first word of each row (n + 1)."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        if len(h) < 2 or not self.classes:
            return best
        sums = bit_sums(pairs_of(h))
        starts, ends = row[:-1], row[1:]
        starts_at: dict[tuple[int, int], set[int]] = defaultdict(set)
        for c in self.classes:
            n = c.size - 1  # word pairs in a window
            tried: dict[tuple[int, int], list[int]] = defaultdict(list)
            if len(h) >= c.size:
                at, which = c.candidates(simhash(sums, slice(None), n), self.radius)
                r = np.searchsorted(row, at, "right") - 1
                ok = at + c.size <= ends[r]
                for p, k, x in sorted(set(zip(at[ok].tolist(), which[ok].tolist(), r[ok].tolist(), strict=True))):
                    tried[x, k].append(p)
            short = np.flatnonzero((ends - starts < c.size) & (ends - starts >= max(2, SIMILARITY * c.size)))
            for x in short.tolist():
                m = int(ends[x] - starts[x]) - 1
                _, which = c.candidates(simhash(sums, np.array([starts[x]]), m), self.radius)
                for k in which.tolist():
                    tried[x, k].append(int(starts[x]))
            for (x, k), places in tried.items():
                starts_at[x, c.items[k]].update(p - c.skips[k] for p in places)
        for (x, item), places in self.sharing(h, row).items():
            starts_at[x, item].update(places)
        for (x, item), places in starts_at.items():
            lo, hi = int(starts[x]), int(ends[x])
            top = (0.0, 0, 0)
            seen: set[tuple[int, int]] = set()
            for p in sorted(places):
                for shift in (0, -1, 1, -2, 2):
                    a = max(lo, p + shift)
                    z = min(hi, a + self.sizes[item])
                    if (a, z) in seen or z <= a:
                        continue
                    seen.add((a, z))
                    like = self.similarity(item, h[a:z])
                    if like > top[0]:
                        top = (like, a, z)
            if top[0] >= SIMILARITY:
                best[x, item] = top
        return best


def item_frequencies(items: DataFrame) -> DataFrame:
    """(block, s, k): shingle s of an item in the block is in k of all items."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            h, _, _, row = words(*text_buffer(column(b, "text")), loose=True)
            mine = [np.unique(item_shingles(h[x:z])) if z > x else np.zeros(0, np.uint64) for x, z in zip(row[:-1].tolist(), row[1:].tolist(), strict=True)]
            blocks = np.repeat(column(b, "block").to_numpy(zero_copy_only=False).astype(np.int32), [len(x) for x in mine])
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.concatenate([np.zeros(0, np.uint64), *mine]).view(np.int64))], names=["block", "s"])

    of = items.mapInArrow(run, "block int, s long").groupBy("block", "s").agg(F.count("*").alias("k"))
    every = of.groupBy("s").agg(F.sum("k").alias("k"))
    return of.select("block", "s").join(every, "s")


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id, start, end, similarity): the best window (bytes) of each document that holds an item."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_blocks = max(1, -(-n // max_items), -(-size // MAX_BYTES))
    if n_blocks == 1:
        got = items.orderBy("item_id", "text").collect()
        return _contaminated(docs, [r["item_id"] for r in got], [r["text"] for r in got], radius, None)
    items = materialize(items.withColumn("block", F.expr(f"cast(pmod(xxhash64(item_id, text), {n_blocks}) as int)")), "items")
    often = materialize(item_frequencies(items.select("block", "text")), "often")
    out = None
    for block in range(n_blocks):
        got = items.where(F.col("block") == block).orderBy("item_id", "text").collect()  # about max_items
        if not got:
            continue
        t = often.where(F.col("block") == block).select("s", "k").orderBy("s").toArrow()
        found = _contaminated(docs, [r["item_id"] for r in got], [r["text"] for r in got], radius, (n, t["s"].to_numpy().view(np.uint64), t["k"].to_numpy()))
        out = found if out is None else out.union(found)
    return out


def _contaminated(docs: DataFrame, ids: list[int], texts: list[str], radius: int, frequency: tuple[int, np.ndarray, np.ndarray] | None) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(ids, texts, radius, frequency)
        for b in it:
            doc, arr = column(b, "doc_id").to_pylist(), column(b, "text")
            out: list[list] = [[] for _ in range(5)]
            for i, j in pieces(arr, 1 << 19):
                buf, off = text_buffer(arr.slice(i, j - i))
                h, s, e, row = words(buf, off, loose=True)
                for (r, item), (like, a, z) in bench.best(h, row).items():
                    for to, v in zip(out, (doc[i + r], ids[item], int(s[a] - off[r]), int(e[z - 1] - off[r]), like), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in out[:4]), pa.array(out[4], pa.float64())], names=["doc_id", "item_id", "start", "end", "similarity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, start long, end long, similarity double")
