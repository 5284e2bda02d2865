"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1; a trigram's vector binds (multiplies) the permuted (rolled) vectors of its
letters; a document's vector bundles (adds) those of its trigrams, and a language's prototype those of all learned
documents. A document gets the language whose prototype has the greatest cosine with it (ties: first by name).

Runs of other characters count as one blank, and texts begin and end with one. Null and empty texts, and those without a
letter, are "und" with score 0. With nothing to learn from, every text is "und". Repeated rows get equal results;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmill.llm.common import column, crc_mod, pieces, small_batches

DIM, SYMBOLS, SEED = 512, 64, 7
_TABLE = 0x3000
_state: dict = {}


def _symbol(cp: int) -> int:
    ch = chr(cp)
    if not ch.isalpha():
        return 0
    low = ch.lower()[0]
    return ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 2654435761 >> 16) % 37


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _state:
        letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
        pair = (np.roll(letters, 2, 1)[:, None, :] * np.roll(letters, 1, 1)[None, :, :]).reshape(SYMBOLS * SYMBOLS, DIM)
        _state.update(symbols=np.array([_symbol(c) for c in range(_TABLE)], np.uint8), pair=pair, last=letters)
    return _state["symbols"], _state["pair"], _state["last"]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of all texts, where each begins (n + 1), and whether it has a letter."""
    symbols, _, _ = _tables()
    cps = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = symbols[np.minimum(cps, _TABLE - 1)]
    for i in np.flatnonzero(cps >= _TABLE).tolist():
        sym[i] = _symbol(int(cps[i]))
    ends = np.cumsum(np.array([1, *(len(t) + 1 for t in texts)], np.int64))  # ends[r]: first character of row r; its last blank is ends[r + 1] - 1
    keep = sym > 0
    keep[1:] |= sym[:-1] > 0
    keep[0] = True
    keep[ends - 1] = True  # the blank before each row, so that no trigram reaches over
    at = np.concatenate([[0], np.cumsum(keep)])
    s = sym[keep].astype(np.int32)
    codes = s[:-2] * 4096 + s[1:-1] * 64 + s[2:] if len(s) > 2 else np.zeros(0, np.int32)
    first = at[ends[:-1] - 1]
    last = at[ends[1:]] - 2  # the trigram that begins at the row's last letter would reach over
    letters = np.concatenate([[0], np.cumsum(sym > 0)])
    return codes, np.stack([first, np.maximum(first, last)], 1), letters[ends[1:]] > letters[ends[:-1]]


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    _, pair, last = _tables()
    out = np.zeros(DIM, np.float64)
    for i in range(0, len(codes), 4096):
        c = codes[i : i + 4096]
        out += counts[i : i + 4096].astype(np.float32) @ (pair[c >> 6] * last[c & 63]).astype(np.float32)
    return out


def learn(docs: DataFrame, where=None, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """A prototype for each value of lang; where: which rows to learn from. The driver gets DIM numbers for each language from at most 32 tasks."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = (rows if where is None else rows.where(where)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    schema = pa.schema([("lang", pa.string()), ("v", pa.binary())])

    def emit(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype(np.float64).tobytes() for v in sums.values()], pa.binary())], schema=schema)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def vectors() -> pa.RecordBatch:
            return emit({k: bundle(nz := np.flatnonzero(c).astype(np.int32), c[nz]) for k, c in counts.items()})

        for b in it:
            texts, langs = column(b, "text"), column(b, "lang").to_pylist()
            for i, j in pieces(texts):
                codes, at, _ = trigrams(texts.slice(i, j - i).to_pylist())
                by: dict[str, list] = {}
                for r, k in enumerate(langs[i:j]):
                    by.setdefault(k, []).append(codes[at[r, 0] : at[r, 1]])
                for k, parts in by.items():
                    if k not in counts:
                        if len(counts) >= 32:
                            yield vectors()
                            counts.clear()
                        counts[k] = np.zeros(SYMBOLS**3, np.int64)
                    counts[k] += np.bincount(np.concatenate(parts), minlength=SYMBOLS**3)
        yield vectors()

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in it:
            for k, v in zip(column(b, "lang").to_pylist(), column(b, "v").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(v, np.float64)
        yield emit(sums)

    parts = rows.mapInArrow(count, "lang string, v binary").repartition(32).mapInArrow(add, "lang string, v binary").collect()
    out: dict[str, np.ndarray] = {}
    for r in sorted(parts, key=lambda r: (r["lang"], bytes(r["v"]))):
        out[r["lang"]] = out.get(r["lang"], 0) + np.frombuffer(bytes(r["v"]), np.float64)
    return {k: v / max(np.linalg.norm(v), 1e-12) for k, v in sorted(out.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score (cosine, at least 0); a column of docs with one of these names is replaced."""
    small_batches(docs.sparkSession)
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, DIM))
    keep = docs.drop("lang_pred", "score")
    schema = StructType([*keep.schema.fields]).add("lang_pred", "string").add("score", "double")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = column(b, text)
            langs, scores = [], []
            for i, j in pieces(texts):
                codes, at, letters = trigrams(texts.slice(i, j - i).fill_null("").to_pylist())
                for r in range(j - i):
                    if not letters[r] or not names:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    u, n = np.unique(codes[at[r, 0] : at[r, 1]], return_counts=True)
                    v = bundle(u, n)
                    cos = matrix @ v / max(np.linalg.norm(v), 1e-12)
                    k = int(np.argmax(cos))
                    langs.append(names[k])
                    scores.append(float(min(1.0, max(0.0, cos[k]))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return keep.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 5 is not 0, predict for all."""
    held_out = crc_mod("doc_id") == 0
    prototypes = learn(docs.select("doc_id", "text", "lang"), ~F.coalesce(held_out, F.lit(True)))
    return predict(docs.select("doc_id", "text"), prototypes).select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "lang_pred", "score")
