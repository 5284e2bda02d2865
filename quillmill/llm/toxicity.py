"""Toxicity by maximum-scoring segments.

A word's tokens are itself and its first 3, 4 and 5 characters. Every token gets a log-odds of toxic against other documents, shrunk by a Dirichlet prior of a half and a part in proportion to its
share of all learned documents; a word scores by the token with the most evidence. A linear scan finds every maximal scoring segment of a text (words without evidence cost a
little), and extreme-value statistics (lambda from the scores of clean words, k from clean documents' best segments) turn segment scores into bits above what a clean text of that length would reach by chance. A
logistic curve over a document's best segment and its sum of significant ones gives the score.

Null and empty texts have no segment and get the curve's value there. Labels that are null, or without a document, teach
nothing; with no toxic or no other label learned, every score is 0. Repeated rows get equal results; a doc_id labelled
twice counts with its greater label; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import column, crc_mod, materialize, pieces, small_batches, text_buffer
from quillmill.llm.textvec import WORDISH, lower_latin, span_hashes, spans

#: labelled rows that are learned from at most (those of least hash); the model's tokens are those of these rows that tell the labels apart
MAX_LABELLED = 50_000
PRIOR, LEAST_Z, DRIFT, CLIP = 500.0, 3.3, 0.15, 6.0
#: bits of a significant segment: one in 2 ** SIGNIFICANT clean texts has such by chance
SIGNIFICANT = 3.0
#: best bits of a text without a segment, and the least of any
NO_SEGMENT = -20.0
PREFIXES = (3, 4, 5)


def maximal_segments(scores: list[float], at: list[int]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) by the linear-time scan of Ruzzo and Tompa.

    scores: of runs, positive and negative; at: their positions. Positions in the result are those of the first and last run.
    """
    found: list[list] = []  # first, last, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(at[a], at[b], r - l) for a, b, l, r in found]


def word_tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """63-bit token hashes of every word (itself, its prefixes; 0 for none), start, end, and first word of each row (n + 1)."""
    folded = lower_latin(buf)
    s, e, row = spans(WORDISH[buf], off)
    lead = (buf & 0xC0) != 0x80
    at = np.concatenate([np.flatnonzero(lead), np.full(max(PREFIXES) + 1, len(buf))])
    cp = np.cumsum(lead)[s] - 1 if len(s) else s
    out = np.zeros((len(PREFIXES) + 1, len(s)), np.uint64)
    out[0] = span_hashes(folded, s, e) >> np.uint64(1)
    for i, k in enumerate(PREFIXES, 1):
        to = at[np.minimum(cp + k, len(at) - 1)]
        long = to <= e
        out[i, long] = (span_hashes(folded, s[long], to[long]) ^ np.uint64(0xA0761D6478BD642F * k % 2**64)) >> np.uint64(1)
    return out, s, e, row


@dataclass(frozen=True)
class Lexicon:
    hashes: np.ndarray  # sorted uint64
    weights: np.ndarray
    z: np.ndarray
    lam: float
    k: float = 1.0  # of the extreme-value distribution: a text of n words has a score over s with the chance k n exp(-lam s)


def _lambda(weights: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the words of clean documents."""
    s, q = np.concatenate([weights, [-DRIFT]]), np.concatenate([p, [max(1e-9, 1 - p.sum())]])
    q = q / q.sum()
    lo, hi = 1e-6, 1.0
    f = lambda x: float(q @ np.exp(x * s)) - 1
    if float(q @ s) >= 0 or not (weights > 0).any():
        return 0.1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def learn(docs: DataFrame, labels: DataFrame, where=None, max_labelled: int = MAX_LABELLED) -> tuple[Lexicon, dict[int, int]] | None:
    """The word weights and the labelled ids used."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = (chosen if where is None else chosen.where(where)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    got = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()  # bounded by max_labelled
    known = {r["doc_id"]: int(r["toxic"] > 0) for r in got}
    if len(set(known.values())) < 2:
        return None
    ids = np.array(sorted(known), np.int64)
    toxic = np.array([known[i] for i in ids.tolist()], np.int64)
    schema = pa.schema([("h", pa.int64()), ("pos", pa.int64()), ("neg", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            everything = np.concatenate(held) if held else np.zeros(0, np.uint64)
            h, inverse, n = np.unique(everything >> np.uint64(1), return_inverse=True, return_counts=True)
            pos = np.bincount(inverse, weights=(everything & np.uint64(1)).astype(float), minlength=len(h)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(pos), pa.array(n.astype(np.int64) - pos)], schema=schema)

        for b in it:
            doc = column(b, "doc_id").to_numpy(zero_copy_only=False)
            spot = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
            mine = np.flatnonzero(ids[spot] == doc)
            if not len(mine):
                continue
            texts = column(b, "text").take(pa.array(mine))
            label = toxic[spot[mine]]
            for i, j in pieces(texts):
                h, _, _, row = word_tokens(*text_buffer(texts.slice(i, j - i)))
                for r in range(j - i):  # a token counts once a document
                    held.append((np.unique(h[:, row[r] : row[r + 1]]) << np.uint64(1)) | np.uint64(label[i + r]))
                    size += len(held[-1])
                if size > 1_500_000:
                    yield flush()
                    held, size = [], 0
        yield flush()

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(count, "h long, pos long, neg long")
    counts = materialize(rows.groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "words")
    n_pos, n_neg = (float(x or 0) for x in counts.agg(F.sum("pos"), F.sum("neg")).first())
    if not n_pos or not n_neg:
        return None
    prior = 0.5 + F.lit(PRIOR) * (F.col("pos") + F.col("neg")) / F.lit(n_pos + n_neg)
    odds = lambda y, n: F.log((y + prior) / (F.lit(n + PRIOR) - y))
    delta = odds(F.col("pos"), n_pos) - odds(F.col("neg"), n_neg)
    z = delta / F.sqrt(1 / (F.col("pos") + prior) + 1 / (F.col("neg") + prior))
    top = counts.where("h != 0").select("h", "neg", delta.alias("delta"), z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy("h").toArrow()  # of at most max_labelled rows' tokens
    weights = np.clip(top["delta"].to_numpy(), -1.0, CLIP)
    lam = _lambda(weights, top["neg"].to_numpy().astype(float) / n_neg)
    return Lexicon(top["h"].to_numpy().view(np.uint64), weights, np.abs(top["z"].to_numpy()), lam), known


def word_scores(tokens: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Each word's score: that of its token with the greatest z; 0 where no token is in the lexicon."""
    best, score = np.zeros(tokens.shape[1]), np.zeros(tokens.shape[1])
    if len(lexicon.hashes):
        for h in tokens:
            spot = np.minimum(np.searchsorted(lexicon.hashes, h), len(lexicon.hashes) - 1)
            more = (lexicon.hashes[spot] == h) & (lexicon.z[spot] > best)
            best[more], score[more] = lexicon.z[spot[more]], lexicon.weights[spot[more]]
    return score


def segments_of(word_score: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal scoring segments of a text's words: first word, last word, score."""
    hit = np.flatnonzero(word_score)
    w = word_score[hit]
    if not (w > 0).any():
        return []
    scores, at, last = [], [], -1
    for p, s in zip(hit.tolist(), w.tolist(), strict=True):
        if p - last > 1 and scores:
            scores.append(-DRIFT * (p - last - 1))
            at.append(p - 1)
        scores.append(s)
        at.append(p)
        last = p
    return maximal_segments(scores, at)


def passages(docs: DataFrame, lexicon: Lexicon, least_bits: float = SIGNIFICANT) -> DataFrame:
    """A row per document: doc_id, best and total (bits of its best segment, and what all significant ones have over least_bits), spans (byte offsets and bits of these)."""
    small_batches(docs.sparkSession)
    out_type = "doc_id long, n_words long, best double, total double, spans array<struct<start:long,end:long,bits:double>>"
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("best", pa.float64()), ("total", pa.float64()), ("spans", pa.list_(span))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            doc, texts = column(b, "doc_id"), column(b, "text")
            n_words, best, total, spans = [], [], [], []
            for i, j in pieces(texts):
                buf, off = text_buffer(texts.slice(i, j - i))
                tokens, s, e, row = word_tokens(buf, off)
                ws = word_scores(tokens, lexicon)
                for r in range(j - i):
                    a, z = int(row[r]), int(row[r + 1])
                    chance = math.log(lexicon.k * max(1, z - a))
                    found = [(p, q, (lexicon.lam * x - chance) / math.log(2)) for p, q, x in segments_of(ws[a:z])]
                    good = [x for x in found if x[2] > least_bits]
                    n_words.append(z - a)
                    best.append(max((max(x[2], NO_SEGMENT) for x in found), default=NO_SEGMENT))
                    total.append(sum(x[2] - least_bits for x in good))
                    spans.append([{"start": int(s[a + p] - off[r]), "end": int(e[a + q] - off[r]), "bits": x} for p, q, x in good])
            yield pa.RecordBatch.from_arrays([doc, pa.array(n_words, pa.int64()), pa.array(best, pa.float64()), pa.array(total, pa.float64()), pa.array(spans, pa.list_(span))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out_type)


def _features(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(best), np.clip(best, NO_SEGMENT, 60) / 10, np.log1p(np.maximum(total, 0))], 1)


def fit_curve(best: np.ndarray, total: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x, w = _features(best, total), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_extremes(best: np.ndarray, n_words: np.ndarray, some: np.ndarray) -> float:
    """k of the extreme-value distribution: its likeliest value for clean texts' best bits under k = 1 (2 ** -best is then n exp(-lam s)); some: which have a segment, the others are censored at a score of 0."""
    chances = np.where(some, np.exp2(-best), n_words).sum()
    return float(min(1e3, max(1e-9, max(1, int(some.sum())) / max(1e-300, float(chances)))))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document; learned from labels whose crc32(doc_id) mod 5 is not 0."""
    held_out = F.coalesce(crc_mod("doc_id") == 0, F.lit(True)).alias("held_out")
    model = learn(docs, labels, crc_mod("doc_id") != 0)
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    lexicon, known = model
    ids = docs.sparkSession.createDataFrame([(int(i), int(t)) for i, t in known.items()], "doc_id long, toxic int")
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")  # ids: at most MAX_LABELLED
    found = materialize(passages(labelled, lexicon, -1e9).join(F.broadcast(ids), "doc_id"), "labelled")

    def per_document(shift: float) -> pa.Table:
        """A row for each labelled id, of the text with the best segment where an id repeats."""
        some = F.size("spans") > 0
        best = F.when(some, F.greatest(F.lit(NO_SEGMENT), F.col("best") - F.lit(shift))).otherwise(F.lit(NO_SEGMENT))
        total = F.aggregate("spans", F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), x["bits"] - F.lit(shift + SIGNIFICANT)))
        rows = found.groupBy("doc_id").agg(F.max(F.struct(best.alias("best"), total.alias("total"), "n_words", some.alias("some"))).alias("x"), F.first("toxic").alias("toxic"))
        return rows.select("x.*", "toxic").toArrow()

    t = per_document(0.0)
    clean = t["toxic"].to_numpy() == 0
    lexicon = replace(lexicon, k=fit_extremes(*(t[c].to_numpy()[clean] for c in ("best", "n_words", "some"))))
    t = per_document(math.log2(lexicon.k))
    w = [float(v) for v in fit_curve(*(t[c].to_numpy().astype(float) for c in ("best", "total", "toxic")))]
    z = F.lit(w[0]) + F.lit(w[1]) * F.greatest(F.lit(NO_SEGMENT), F.least(F.lit(60.0), F.col("best"))) / 10 + F.lit(w[2]) * F.log1p(F.greatest(F.lit(0.0), F.col("total")))
    p = 1 / (1 + F.exp(-z))
    return passages(docs, lexicon).select("doc_id", held_out, p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_passages"), F.col("best").alias("best_bits"))
