"""Joins, passages and substrings against brute force on the fixture."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from quillmill.llm import common, decontam, graph, jaccard, passages, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    ids = [r[0] for r in rows]
    s = [shingle_set(r[1], k) for r in rows]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i in range(len(ids)):
        low[find(i)].append(ids[i])
    return sorted((ids[i], len(s[i]), min(low[find(i)])) for i in range(len(ids)))


def test_components_are_those_of_all_pairs(docs, empty, rows):
    got = sorted(tuple(r) for r in jaccard.components(docs).collect())
    assert got == brute_components(rows, 4, 85)
    assert jaccard.components(empty).count() == 0


def test_many_near_copies_share_frequent_tokens(spark):
    """Over 64 variants of one text: their tokens are frequent, and the pairs of such tokens are the keys."""
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(60, rng.integers(0, 4), replace=False):
            w[j] = f"v{rng.integers(5)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.components(docs, k=2, percent=80).collect())
    assert got == brute_components(rows, 2, 80)


def test_index_shares_a_key_for_every_link():
    rng = np.random.default_rng(2)
    pool = np.sort(rng.integers(1, 1 << 63, 400).astype(np.uint64))
    often = np.unique((pool[::3] >> np.uint64(32)).astype(np.uint32))
    bitmap, bits = np.full(1 << 13, 255, np.uint8), 16
    for _ in range(300):
        n = int(rng.integers(2, 120))
        a = np.sort(rng.choice(pool, n, replace=False))
        b = a[rng.random(n) > 0.08]
        b = np.unique(np.concatenate([b, rng.choice(pool, int(rng.integers(0, max(1, n // 12) + 1)))]))
        inter = len(np.intersect1d(a, b))
        if len(b) < 2 or 100 * inter < 80 * (len(a) + len(b) - inter):
            continue
        ka, fa = jaccard.index_keys(a, 80, often, bitmap, bits)
        kb, fb = jaccard.index_keys(b, 80, often, bitmap, bits)
        need = jaccard.least_common(min(len(a), len(b)))
        assert len(np.intersect1d(ka[fa], kb[fb])) or len(np.intersect1d(ka[~fa], kb[~fb])) >= need - 1


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (5, 5), (3, 9), (11, 10), (10, 12), (12, 20), (20, 21)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7, 10: 10, 11: 10, 12: 10, 20: 10, 21: 10}


def brute_substrings(rows, n):
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[p : p + n] for t in texts for p in range(len(t) - n + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - n + 1):
            if seen[t[p : p + n]] > 1:
                gone[p : p + n] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        out.append((r[0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings_are_those_of_brute_force(docs, empty, rows, monkeypatch):
    monkeypatch.setattr(substrings, "STEP", 40_000)  # the long text is cut into steps
    got = sorted(tuple(r) for r in substrings.dedup(docs).collect())
    assert got == brute_substrings(rows, 200)
    assert substrings.dedup(empty).count() == 0


def test_substring_texts_and_spans(spark):
    a, b = "abc" * 5, "".join(chr(97 + i * 7 % 26) + chr(97 + i % 25) for i in range(150))
    docs = spark.createDataFrame([(1, f"1{b}2"), (2, f"{a}{b}")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.dedup(docs, with_text=True).collect()}
    assert got[1]["kept"] == "12" and got[2]["kept"] == a and [tuple(s) for s in got[1]["spans"]] == [(1, 301)]


def test_passages_find_every_exact_repeat(docs, empty, rows):
    got = passages.near_passages(docs).collect()
    split = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
    seen = collections.defaultdict(set)
    for i, t, *_ in rows:
        w = split.findall((t or "").lower())
        for p in range(len(w) - 49):
            seen[tuple(w[p : p + 50])].add(i)
    later = {i for s in seen.values() for i in s if i != min(s)}
    found = {r["doc_id"] for r in got}
    assert later <= found and all(r["source_doc_id"] < r["doc_id"] or r["doc_id"] == 3 for r in got)
    near = 43  # the copy with a changed word
    assert near in found
    clean = {i for i, *_ in rows} - {i for s in seen.values() if len(s) > 1 for i in s} - {near, 2, 3}
    assert not clean & found
    assert passages.near_passages(empty).count() == 0


def test_compact_windows_cover_all_long_subsequences():
    rng = np.random.default_rng(4)
    sh = rng.integers(1, 1 << 63, 120).astype(np.uint64)
    row = np.array([0, 124])
    r, c, key, node = passages.compact_windows(sh, row, 0, 30)
    left, right = passages.extents(c, node, row[r], row[r + 1] - 5)
    value = dict(zip(c.tolist(), zip(left.tolist(), right.tolist())))
    x = np.array(passages.mix(sh ^ passages._SEEDS[0]) & np.uint64(0xFFFFFFFFFF000000)) | np.arange(120, dtype=np.uint64)
    for i in range(120):
        for j in range(i + 29, 120):
            at = int(x[i : j + 1].argmin()) + i
            a, z = value[at]
            assert a <= i <= at <= j <= z


def test_benchmark_items_are_found_where_they_stand(spark, docs, empty, rows):
    words = rows[10][1].split()
    item = " ".join(words[5:45])
    long = rows[11][1].split()[:60]
    changed = list(long)
    changed[-3] = "other"
    texts = [(100, "Lead in. " + item.upper() + ". and more words follow here"), (101, item), (102, " ".join(long)), (103, "nothing of it"), (104, None), (105, "")]
    bench = spark.createDataFrame([(1, item, 0), (2, " ".join(changed), 0), (3, None, 0), (4, "one", 0), (5, item, 1)], "item_id long, text string, radius int")
    some = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, similarity string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(some, bench).collect()}
    assert set(got) == {(100, 1), (100, 5), (101, 1), (101, 5), (102, 2)}
    r = got[100, 1]
    assert texts[0][1][r["start"] : r["end"]] == item.upper() and r["similarity"] > 0.999
    assert decontam.contaminated(docs, bench).where("item_id = 1").count() == 1
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(some, bench.limit(0)).count() == 0
    blocks = decontam.contaminated(some, bench, max_items=1)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == set(got)


def test_hamming_blocks_lose_nothing_within_the_radius():
    rng = np.random.default_rng(6)
    c = decontam.SizeClass(10, [0, 1, 2], [int(v) for v in rng.integers(0, 1 << 63, 3)], [0, 0, 0]).index(11)
    fp = []
    for k in range(400):
        flips = rng.choice(64, int(rng.integers(0, 16)), replace=False)
        fp.append(c.fingerprints[k % 3] ^ sum(1 << int(b) for b in flips))
    fp = np.array(fp, np.uint64)
    at, which = c.candidates(fp, 11)
    want = {(i, j) for i in range(400) for j in range(3) if (int(fp[i]) ^ c.fingerprints[j]).bit_count() <= 11}
    assert set(zip(at.tolist(), which.tolist())) == want


def brute_near_stretch(x, y, least, similarity):
    """Whether any stretches of `least` words or more on both sides have that Jaccard similarity of 5-word shingles."""
    sx, sy = ([tuple(v[i : i + 5]) for i in range(len(v) - 4)] for v in (x, y))
    n = least - 4
    for a in range(len(sx) - n + 1):
        for b in range(a + n, len(sx) + 1):
            one = set(sx[a:b])
            for c in range(max(0, a - 2), min(len(sy) - n, a + 2) + 1):  # about one shift
                for d in range(max(c + n, b - 2), min(len(sy), b + 2) + 1):
                    two = set(sy[c:d])
                    both = len(one & two)
                    if both >= similarity * (len(one) + len(two) - both):
                        return True
    return False


def test_passages_with_one_changed_word_are_those_of_brute_force():
    rng = np.random.default_rng(8)
    for n in (50, 55, 60, 79, 90):
        base = rng.integers(1, 1 << 32, n)
        for at in range(n):
            x = base.copy()
            x[at] = 7
            x_doc, y_doc = (np.concatenate([rng.integers(1, 1 << 32, 20), v, rng.integers(1, 1 << 32, 20)]) for v in (x, base))
            shared = n - 4 - len(range(max(0, at - 4), min(n - 4, at + 1)))
            got = passages.matching_segments(x_doc, y_doc, 50, 0.8)
            if shared / (2 * (n - 4) - shared) >= 0.8:
                assert got, (n, at)
            assert all(like >= 0.8 and words >= 50 and j - i == words for i, j, words, like in got)
            if n == 55 and at % 9 == 0:
                assert bool(got) == brute_near_stretch(x_doc.tolist(), y_doc.tolist(), 50, 0.8), at


def test_passages_with_an_insertion_are_one_stretch():
    rng = np.random.default_rng(9)
    x = rng.integers(1, 1 << 32, 120)
    y = np.concatenate([x[:60], rng.integers(1, 1 << 32, 12), x[60:]])
    assert [g[:2] for g in passages.matching_segments(x, y, 50, 0.8)] == [(0, 120)]
    assert [g[:2] for g in passages.matching_segments(y, x, 50, 0.8)] == [(0, 132)]
    twice = np.concatenate([x, rng.integers(1, 1 << 32, 30), x])  # in y once
    assert sorted(g[:2] for g in passages.matching_segments(twice, x, 50, 0.8)) == [(0, 120), (150, 270)]


def drawn(rng, n):
    return " ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(n))


def test_passages_of_two_documents_beyond_a_frequent_line(spark):
    rng = np.random.default_rng(10)
    texts, want = [], {}
    for _ in range(10):
        line, own = drawn(rng, 49), drawn(rng, 3)
        texts += [f"{drawn(rng, 15)} {line} {drawn(rng, 15)}" for _ in range(6)]
        for _ in range(2):
            lead = drawn(rng, 15)
            texts.append(f"{lead} {line} {own} {drawn(rng, 15)}")
        want[len(texts) - 1] = (len(lead) + 1, len(lead) + 1 + len(line) + 1 + len(own))
    got = passages.near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    for doc, span in want.items():
        assert [r for r in got if r["doc_id"] == doc and r["source_doc_id"] == doc - 1 and r["start"] <= span[0] and r["end"] >= span[1]], doc


def test_passages_that_stand_twice_in_a_later_document(spark):
    rng = np.random.default_rng(11)
    texts, want = [], []
    for _ in range(8):
        p, a, b = drawn(rng, 60), drawn(rng, 20), drawn(rng, 30)
        texts += [f"{drawn(rng, 20)} {p} {drawn(rng, 20)}", f"{a} {p} {b} {p} {drawn(rng, 20)}"]
        want += [(len(texts) - 1, len(a) + 1, len(a) + 1 + len(p)), (len(texts) - 1, len(a) + len(p) + len(b) + 3, len(a) + 2 * len(p) + len(b) + 3)]
    got = passages.near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert set(want) <= {(r["doc_id"], r["start"], r["end"]) for r in got}


def test_benchmark_items_with_a_replaced_block_are_all_found():
    rng = np.random.default_rng(12)
    for size, least, block in ((200, 135, 17), (300, 201, 28), (100, 68, 6)):
        items = [drawn(rng, least)] + [drawn(rng, size) for _ in range(30)]
        bench = decontam.Benchmark(list(range(31)), items, decontam.RADIUS)
        for i in range(1, 31):
            w = items[i].split()
            at = (size - block) // 2
            w[at : at + block] = drawn(rng, block).split()
            text = f"{drawn(rng, 20)} {' '.join(w)} {drawn(rng, 20)}"
            buf, off = decontam.text_buffer(decontam.pa.array([text]))
            h, _, _, row = decontam.words(buf, off, loose=True)
            got = bench.matches(h, row)
            want = max(bench.similarity(i, h[p : p + size]) for p in range(len(h) - size + 1))
            assert ((0, i) in got) == (want >= 0.8) and ((0, i) not in got or got[0, i][0] >= want - 1e-12)


def test_benchmark_results_do_not_depend_on_the_blocks(spark):
    """Items that share a lead-in: a block's items alone would weigh it otherwise."""
    rng = np.random.default_rng(13)
    lead = drawn(rng, 25)
    items, texts = [], []
    for i in range(60):
        own = drawn(rng, 70).split()
        items.append((i, f"{lead} {' '.join(own)}"))
        own[int(rng.integers(70))] = "changed"
        texts.append((i, f"{drawn(rng, 10)} {lead} {' '.join(own)} {drawn(rng, 10)}"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in decontam.contaminated(docs, bench, max_items=m).collect()) for m in (1000, 7)]
    assert found[0] == found[1] and len(found[0]) > 10


def test_benchmark_items_without_blanks_are_found(spark):
    rng = np.random.default_rng(14)
    item = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 40)))
    other = "".join(map(chr, rng.integers(0x3041, 0x30F0, 200)))
    docs = spark.createDataFrame([(1, f"{other[:50]}{item}{other[50:]}"), (2, other), (3, f"mixed words {item}")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3}
    assert docs.where("doc_id = 1").first()["text"].encode()[got[1]["start"] : got[1]["end"]].decode() == item


def test_long_texts_are_searched_in_parts():
    rng = np.random.default_rng(15)
    items = [drawn(rng, 30) for _ in range(3)]
    bench = decontam.Benchmark([0, 1, 2], items, decontam.RADIUS)
    text = f"{drawn(rng, 90)} {items[0]} {drawn(rng, 64)} {items[1]} {drawn(rng, 300)}"
    h, _, _, row = decontam.words(*decontam.text_buffer(decontam.pa.array([text])), loose=True)
    whole = bench.matches(h, row)
    assert set(whole) == {(0, 0), (0, 1)}
    for most in (100, 128, 150):
        assert bench.best(h, row, most) == whole


def test_passages_with_two_words_replaced_are_found(spark):
    """Planted passages of 100 words with 0 to 2 words replaced, half of them about a line that many documents have, held against the Jaccard similarity itself."""
    rng = np.random.default_rng(16)
    texts, want, line = [], collections.defaultdict(list), drawn(rng, 30).split()
    for edits in range(3):
        for k in range(20):
            base = drawn(rng, 100).split()
            if k % 2:
                base[35:65] = line
            other = list(base)
            for at in rng.choice(100, edits, replace=False):
                other[at] = "changed"
            one, two = ({tuple(v[i : i + 5]) for i in range(96)} for v in (base, other))
            texts += [f"{drawn(rng, 40)} {' '.join(v)} {drawn(rng, 40)}" for v in (base, other)]
            if len(one & two) >= 0.8 * len(one | two):
                want[edits].append(len(texts) - 1)
    texts += [f"{drawn(rng, 60)} {' '.join(line)} {drawn(rng, 60)}" for _ in range(60)]
    got = {r["doc_id"] for r in passages.near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    for edits, docs in want.items():
        assert docs and len(got & set(docs)) >= 0.95 * len(docs), edits
    assert not got & set(range(120, 180))  # thirty words are no passage


def test_passages_of_repeated_and_unnamed_rows(spark):
    rng = np.random.default_rng(17)
    p = drawn(rng, 60)
    rows = [(1, f"{drawn(rng, 20)} {p}"), (2, f"{p} {drawn(rng, 20)}"), (2, f"{drawn(rng, 30)}"), (None, f"{drawn(rng, 10)} {p}"), (None, None), (3, "")]
    rows.append(rows[1])
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({(r["doc_id"], r["start"], r["end"]) for r in got}) == len(got) == 2
    by_row = passages.near_passages(spark.createDataFrame([(1, p), (1, f"{p} {drawn(rng, 9)}")], "doc_id long, text string"), by_row=True).collect()
    assert len(by_row) == 1 and by_row[0]["doc_id"] == by_row[0]["source_doc_id"] == 1


def test_large_families_meet_in_blocks(spark, monkeypatch):
    """Blocks of 8 sets, so that a family of 150 takes hubs and the second round."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "HUBS", 2)
    rng = np.random.default_rng(18)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(150):
        w = list(base)
        for j in rng.choice(60, rng.integers(0, 6), replace=False):
            w[j] = f"v{rng.integers(5)}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), k=2, percent=80).collect())
    want = brute_components(rows, 2, 80)
    assert got == want and len({c for _, _, c in want}) > 3


def test_one_row_of_each_group_stays(docs, rows):
    got = sorted((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs, k=5, percent=80).select("doc_id", "text").collect() if r["text"] is not None)
    first = {}
    for i, _, c in brute_components(rows, 5, 80):
        first[c] = min(first.get(c, i), i)
    stay = {i for i, t, *_ in rows if i in first.values() or t is None or not t.split()}
    assert [i for i, _ in got] == sorted(i for i in stay if next(t for j, t, *_ in rows if j == i) is not None)


def test_key_counts_are_those_of_all_tasks(spark):
    """A key in every row, keys that occur twice in a row or in two rows, and keys that occur once."""
    from quillmill.llm import keystats

    rng = np.random.default_rng(19)
    some = rng.integers(0, 1 << 32, 400, dtype=np.uint64)
    rows = [" ".join(map(str, [int(some[0]), int(some[1 + i % 150]), int(some[200 + i]), *([int(some[199])] * (2 * (i == 3)))])) for i in range(190)]
    docs = spark.createDataFrame([(r,) for r in rows], "text string").repartition(5)

    def hashes(texts):
        for t in texts.to_pylist():
            yield np.array([int(v) << 32 for v in t.split()], np.uint64)

    count = collections.Counter(int(v) for r in rows for v in r.split())
    often, bitmap, bits = keystats.key_statistics(docs, hashes, frequent=3)
    assert often.tolist() == sorted(k for k, n in count.items() if n >= 3)
    assert keystats.flagged(bitmap, bits, np.array([k << 32 for k, n in count.items() if n > 1], np.uint64)).all()
    assert keystats.flagged(bitmap, bits, np.array([k << 32 for k, n in count.items() if n == 1], np.uint64)).mean() < 0.2


def test_large_bitmaps_go_to_tasks_as_files(spark, monkeypatch):
    """Their pickled form stays small, and tasks get the same results; a bitmap comes to the driver in parts."""
    import pickle

    from quillmill.llm import keystats

    monkeypatch.setattr(keystats, "SENT_AS_FILE", 1 << 10)
    monkeypatch.setattr(keystats, "AT_ONCE", 1 << 11)
    rng = np.random.default_rng(20)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 300, 40)) for _ in range(60)]
    texts += [t + " z" for t in texts[:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    _, bitmap, bits = keystats.key_statistics(docs, lambda col: jaccard.document_sets(col, 3))
    (bitmap_sent,) = keystats.sent(spark, bitmap)
    assert len(pickle.dumps(bitmap_sent)) < 1000 < bitmap.nbytes and (bitmap_sent() == bitmap).all()
    count = collections.Counter(int(v) >> 32 for s in jaccard.document_sets(pa.array(texts), 3) for v in s)
    assert keystats.flagged(bitmap, bits, np.array([k << 32 for k, n in count.items() if n > 1], np.uint64)).all()
    got = sorted(tuple(r) for r in jaccard.components(docs, k=3, percent=80).collect())
    assert got == brute_components(list(enumerate(texts)), 3, 80)


def test_the_bound_of_frequent_keys_rises_until_they_fit(spark, monkeypatch):
    from quillmill.llm import keystats

    monkeypatch.setattr(keystats, "MAX_FREQUENT", 2)
    docs = spark.createDataFrame([(" ".join(str(k) for k in range(1, 9) if i < 3 * 2**k),) for i in range(800)], "text string").repartition(4)
    often, _, _ = keystats.key_statistics(docs, lambda col: (np.array([int(v) << 32 for v in t.split()], np.uint64) for t in col.to_pylist()), frequent=3)
    assert often.tolist() == [5, 6, 7, 8]  # those of 3 * 2 ** 5 rows and more are 4


def test_passages_and_substrings_take_bitmaps_from_files(spark, docs, monkeypatch):
    """As the pipeline's stages do at size: no bitmap in a closure, equal results."""
    from quillmill.llm import keystats

    files = []
    add = type(spark.sparkContext).addFile
    monkeypatch.setattr(type(spark.sparkContext), "addFile", lambda sc, path, **k: (files.append(path), add(sc, path, **k))[1])
    some = docs.where("doc_id < 150")
    want = [sorted(map(str, f(some).collect())) for f in (passages.near_passages, substrings.dedup)]
    monkeypatch.setattr(keystats, "SENT_AS_FILE", 0)
    assert [sorted(map(str, f(some).collect())) for f in (passages.near_passages, substrings.dedup)] == want
    assert len(files) >= 4


def test_texts_that_no_join_can_change_are_not_shuffled(spark, rows, docs, monkeypatch):
    """parted's first part holds every row with a key; stages shuffle texts of such rows only, with no join small enough to be broadcast."""
    import corpus_pipeline
    from quillmill.llm.keystats import parted

    keys = spark.range(0, 3000, 7).selectExpr("xxhash64(id) as k")
    every = spark.range(3000).selectExpr("id", "xxhash64(id) as h")
    some, rest = ([r["id"] for r in x.collect()] for x in parted(every, "h", keys, "k"))
    assert set(range(0, 3000, 7)) <= set(some) and len(some) < 800 and sorted(some + rest) == list(range(3000))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (corpus_pipeline.jaccard_join, corpus_pipeline.substring_dedup):
            plan = stage(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
            for join in plan.split("Join Left")[1:]:  # the join's left side has texts
                assert "MapInArrow" in join.split("Join ")[0], plan
        test_one_row_of_each_group_stays(docs, rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_pairs_within_groups():
    one, two, large = passages._all_pairs(np.array([3, 5, 5, 5, 8, 8, 9, 9, 9, 9]), 3)
    assert list(zip(one.tolist(), two.tolist())) == [(2, 1), (3, 1), (3, 2), (5, 4)] and large.tolist() == [False] * 6 + [True] * 4


def test_near_passages_about_a_line_whose_first_row_is_not_near(spark):
    """Two later documents share 52 words with one replaced, of them a line of 42 words that 12 earlier documents have; no 45 words in a row are shared."""
    rng = np.random.default_rng(21)
    texts, want = [], []
    for _ in range(40):
        line, a, z = drawn(rng, 42).split(), drawn(rng, 2).split(), drawn(rng, 8).split()
        texts += [f"{drawn(rng, 30)} {' '.join(line)} {drawn(rng, 30)}" for _ in range(12)]
        one = [*a, *line, *z]
        two = list(one)
        two[44] = "changed"
        texts += [f"{drawn(rng, 30)} {' '.join(v)} {drawn(rng, 30)}" for v in (one, two)]
        want.append(len(texts) - 1)
    got = {r["doc_id"] for r in passages.near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert not got - set(want) and len(got) >= 38, len(got)


def test_a_slice_goes_to_the_joins_of_its_side_only(spark, monkeypatch):
    """Slices that are only sources carry no places in the text; each side's join gets its own slices."""
    rng = np.random.default_rng(8)
    shared = [drawn(rng, 70) for _ in range(3)]
    texts = [f"{drawn(rng, 30)} {s} {drawn(rng, 30)}" for s in shared for _ in range(2)]
    written = {}

    def kept(df, name="t", large=True):
        written[name] = common.materialize(df, name, large)
        return written[name]

    monkeypatch.setattr(passages, "materialize", kept)
    got = {r["doc_id"]: r["source_doc_id"] for r in passages.near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {1: 0, 3: 2, 5: 4}
    sides = {(r["side"], len(r["bytes"]) > 0) for r in written["slices"].collect()}
    assert sides == {(passages._SOURCE, False), (passages._PASSAGE, True)}


def test_segments_are_those_of_words_shingled_anew():
    """Shingles that are kept for the next comparison, and runs bounded in steps, change no segment."""
    rng = np.random.default_rng(31)
    x = rng.integers(0, 1 << 32, 600).astype("<u4")
    x[300:360] = x[100:160]
    mine = passages.Shingled(x)
    for part in range(0, 500, 50):
        y = x[part : part + 300].copy()
        y[::45] = rng.integers(0, 1 << 32, len(y[::45]))
        want = passages.matching_segments(x, y, 50, 0.8)
        assert want and passages.matching_segments(mine, y, 50, 0.8) == want


def test_op4_repeats_of_a_row_of_its_own_are_not_counted(spark, monkeypatch):
    class Seen(Exception):
        pass

    def stop(rows, hashes, *_):
        raise Seen(hashes)

    monkeypatch.setattr(passages, "key_statistics", stop)
    with pytest.raises(Seen) as seen:
        passages.near_passages(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    own = " ".join(f"w{i}" for i in range(60))
    for keys in seen.value.args[0](pa.array([" ".join([own] * 20), None, " ".join([own] * 2)])):
        _, n = np.unique(keys, return_counts=True)
        assert len(n) and n.max() <= 2  # once for each of the two rows
    assert [len(keys) for keys in seen.value.args[0](pa.array([], pa.string()))] in ([], [0] * passages.HASHES)


def test_op4_words_and_edges_are_coded_without_loss():
    rng = np.random.default_rng(5)
    often = rng.permutation(1 << 20)[:65535].astype("<u4")
    for table in (often, often[:3], often[:0]):
        for h in (often[:500], rng.integers(0, 1 << 32, 500, dtype=np.uint64).astype("<u4"), np.concatenate([often[-7:], [0, 2**32 - 1]]).astype("<u4"), often[:0]):
            code = passages.WordCode(table)
            assert np.array_equal(code.unpack(code.pack(h)), h)
    texts = ["", None, "é ü 語 " * 50]
    assert common.unsqueezed(common.squeezed(pa.array(texts, pa.string()))).to_pylist() == texts
    c = np.array([0, 5, 1 << 30, 7])
    w, w2 = passages._pack(c, np.array([9, 1, 5000, 0]), np.array([0, 3, 2, 1]), 4), passages._pack(np.array([3, 0, 2, 7]), np.array([4, 2, 9, 0]), np.array([1, 2, 8, 0]), 4)
    met, shift = passages.edges_of(w, w2, np.array([0, 1, 0, 1]))
    got, left, right, f = passages._unpack(met)
    assert np.array_equal(shift >> 1 ^ -(shift & 1), [3, -5, 2 - (1 << 30), 0])
    assert np.array_equal(got, c) and left.tolist() == [4, 1, 9, 0] and right.tolist() == [0, 2, 2, 0] and f.tolist() == [4, 12, 4, 12]
