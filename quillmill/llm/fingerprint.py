"""Document fingerprints: one-permutation MinHash with optimal densification and packed 4-bit values (DataFrame functions only).

The 5-word shingles of a text (lower case, split at white space) are hashed once; the top 8 bits of a hash
choose one of 256 bins, each keeps its least hash. An empty bin tries bins drawn by universal hashing until one is
not empty (after 12 draws: the filled bin with the least hash of the pair). 4 of the low 56 bits of each bin, by its number, so that
bins with one value do not all show the same bits, are packed, 16 to a long. Two fingerprints that agree in m of 256 places have a likeness of
(m / 256 - 1/16) / (1 - 1/16), at least 0: the share of agreement by chance is taken off.

A text of fewer than 5 words is one shingle; one without words (null counts as empty) has the hash of the text
itself as its only shingle, so equal texts, empty ones too, have equal fingerprints. Repeated rows get equal
results, rows of one doc_id are neighbours in an order of their text; extra columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, BITS, WORDS, TRIES = 256, 4, 5, 12
_LONGS = BINS * BITS // 64
_rng = random.Random(1)
_DRAWS = [(_rng.randrange(1, 2**31 - 1), _rng.randrange(2**31 - 1)) for _ in range(TRIES)]


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _shingle_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of(w: Column) -> Column:
        return F.when(F.size(w) >= WORDS, F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(WORDS - 1)), lambda i: F.xxhash64(F.slice(w, i, WORDS)))).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array(F.xxhash64(text)))

    return let(words, of)


def _bin(x: Column) -> Column:
    return (F.shiftright(x, 56) + 128).cast("int")


def _minima(sorted_hashes: Column) -> Column:
    return let(sorted_hashes, lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))


def _dense(minima: Column) -> Column:
    null = F.lit(None).cast("bigint")

    def spread(m: Column) -> Column:
        runs = F.transform(m, lambda x, i: F.concat(F.array_repeat(null, F.when(i == 0, _bin(x)).otherwise(_bin(x) - _bin(F.get(m, i - 1)) - 1)), F.array(x)))
        return F.concat(F.flatten(runs), F.array_repeat(null, F.lit(BINS - 1) - _bin(F.element_at(m, -1))))

    def fill(m: Column, d: Column) -> Column:
        def at(i: Column) -> Column:
            drawn = [F.get(d, F.pmod(F.pmod(i * F.lit(a).cast("long") + F.lit(b).cast("long"), F.lit(2**31 - 1).cast("long")), F.lit(BINS)).cast("int")) for a, b in _DRAWS]
            nearest = F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(i, _bin(x)).alias("h"), x.alias("x"))))["x"]
            return F.coalesce(F.get(d, i), *drawn, nearest)

        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), at)

    return let(minima, lambda m: let(spread(m), lambda d: fill(m, d)))


def packed(text: Column) -> Column:
    """The fingerprint as an array of longs."""
    per = 64 // BITS

    def pack(d: Column) -> Column:
        def one(w: Column) -> Column:
            bits = F.transform(F.slice(d, w * per + 1, per), lambda x, j: F.call_function("shiftrightunsigned", x, F.pmod(w * per + j, F.lit(14)) * BITS).bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")))
            return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x))

        return F.transform(F.sequence(F.lit(0), F.lit(_LONGS - 1)), one)

    return let(_dense(_minima(F.sort_array(_shingle_hashes(text)))), pack)


def as_hex(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    ones = F.lit(0x1111111111111111).cast("bigint")

    def unequal(x: Column, y: Column) -> Column:
        return let(x.bitwiseXOR(y), lambda z: F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3)).bitwiseAND(ones)))

    same = F.lit(BINS) - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)
    c = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - c) / (1 - c))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' doc_id and text with the packed fingerprint."""
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("fp", packed(F.col("text")))


def edited_fingerprints(docs: DataFrame, rows_per_bucket: int = 500, max_buckets: int = 1 << 20) -> DataFrame:
    """Fingerprints of every text and of the text with its last quarter replaced by the start of the next document's.

    Next is by doc_id. Rows are dealt into ranges of doc_id (at most max_buckets, so that the table of their first ids, which is
    broadcast, has a bound); the rows with the first id of a range are also sent to the range before it.
    """
    spark = docs.sparkSession
    n = docs.count()
    n_buckets = max(1, min(max_buckets, n // rows_per_bucket))
    splits = sorted(set(docs.select("doc_id").approxQuantile("doc_id", [i / n_buckets for i in range(1, n_buckets)], max(1e-6, min(0.01, 1 / (4 * n_buckets)))))) if n_buckets > 1 else []
    splits = [int(x) for x in splits]
    root = max(1, int(len(splits) ** 0.5))
    fine = [splits[i : i + root] for i in range(0, len(splits), root)]
    doc_id = F.col("doc_id")
    if splits:
        sql = "array(" + ",".join("array(" + ",".join(f"{x}L" for x in part) + ")" for part in fine) + ")"
        coarse = F.expr("array(" + ",".join(f"{part[0]}L" for part in fine) + ")")
        at = F.size(F.filter(coarse, lambda s: s <= doc_id))
        inner = let(F.get(F.expr(sql), at - 1), lambda part: F.size(F.filter(part, lambda s: s <= doc_id)))
        bucket = F.when(at > 0, (at - 1) * root + inner).otherwise(0)
    else:
        bucket = F.lit(0)
    bucket = F.coalesce(bucket, F.lit(0))
    firsts = docs.select(doc_id, bucket.alias("b")).groupBy("b").agg(F.min(F.struct(doc_id.isNotNull().alias("k"), doc_id)).alias("f")).select("b", F.col("f.doc_id").alias("doc_id")).orderBy("b").collect()  # a row for each bucket
    sends = [(firsts[i]["doc_id"], firsts[i - 1]["b"]) for i in range(len(firsts))]
    before = spark.createDataFrame(sends, "first_id bigint, before int")
    rows = fingerprints(docs).join(F.broadcast(before), doc_id.eqNullSafe(F.col("first_id")), "left")
    to = F.when(F.col("before").isNull(), F.array(F.struct(bucket.alias("b"), F.lit(0).alias("extra")))).otherwise(F.array(F.struct(bucket.alias("b"), F.lit(0).alias("extra")), F.struct(F.col("before").alias("b"), F.lit(1).alias("extra"))))
    dealt = rows.select("doc_id", "text", "fp", F.length("text").cast("long").alias("n_chars"), F.inline(to))
    w = "over (partition by b order by extra, doc_id asc nulls first, n_chars, xxhash64(text))"
    led = dealt.withColumn("next", F.expr(f"lead(struct(text, fp)) {w}")).where("extra = 0")
    m = F.floor(F.col("n_chars") / 4).cast("int")
    edited = led.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - m), F.substring(F.col("next.text"), F.lit(1), m)))
    out = edited.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fp", packed(F.col("edited")).alias("fe"), F.col("next.fp").alias("fn"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("fe")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("fe")).alias("near_edited"), likeness(F.col("fp"), F.col("fn")).alias("near_next"))
