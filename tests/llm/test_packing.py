from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import packing, token_output, tokens


def brute_bins(items: list[int], capacity: int) -> int:
    items, best = sorted(items, reverse=True), [len(items)]

    def put(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in sorted(set(bins)):
            if k + items[i] <= capacity:
                more = list(bins)
                more.remove(k)
                put(i + 1, [*more, k + items[i]])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 25).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=8))))
def test_reduction_loses_no_bin(case):
    capacity, items = case
    counts = np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, int)
    left = counts.copy()
    fixed = packing.reduce_by_dominance(left, capacity)
    rest = [s for s in range(capacity + 1) for _ in range(left[s])]
    assert sum(n for _, n in fixed) + brute_bins(rest, capacity) == brute_bins(items, capacity)


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plan_places_every_item_once(case):
    capacity, items = case
    counts = np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, int)
    used = np.zeros_like(counts)
    for sizes, n in packing.plan(counts, capacity):
        assert n > 0 and sum(sizes) <= capacity
        for s in sizes:
            used[s] += n
    assert (used == counts).all()


def test_segment_tree_finds_the_least_room_that_fits():
    tree, rooms = token_output.RoomTree(20), {}
    for r in (3, 9, 9, 20):
        tree.add(r, 1)
        rooms[r] = rooms.get(r, 0) + 1
    assert [tree.first(s) for s in (1, 3, 4, 10, 20)] == [3, 3, 9, 20, 20]
    tree.add(20, -1)
    assert tree.first(10) == -1
    bins = token_output.best_fit(np.array([5, 5, 5, 3, 2, 7]), 10)
    assert sorted(i for b in bins for i in b) == list(range(6)) and len(bins) == 3


def test_fast_ids_are_the_library_s():
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    slow = Tokenizer.from_file(path)
    for text in ("", "Hello  world\n\n", "Ünï cödé ñ é", "<|endoftext|> inside", "a" * 5000, "\t 12 345.6 \u3042 \U0001f600"):
        assert tokens.document_ids(text, path).tolist() == [*slow.encode(text, add_special_tokens=False).ids, 0]


def test_pack_is_gapless_and_whole(docs, empty, rows):
    path = tokens.default_vocabulary()
    got = packing.pack(docs).toPandas()
    want = {i: tokens.document_ids(t, path) for i, t, *_ in rows}
    for doc, g in got[got.doc_id != 3].groupby("doc_id"):
        g = g.sort_values("piece")
        ids = want[doc]
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids) and (g.length <= 2048).all() and g.piece.tolist() == list(range(len(g)))
        assert all(zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32 for r in g.itertuples())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert len(got[got.doc_id == 3]) == 2 and packing.pack(empty).count() == 0
    assert got.sequence_id.nunique() == -(-int(got.length.sum()) // 2048)


def test_packed_matrices_give_the_documents_back(docs, empty, rows, spark, tmp_path):
    path = tokens.default_vocabulary()
    token_output.write_packed(docs, str(tmp_path / "out"), pool_tokens=5000)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    parts: dict[int, list] = {}
    for r in got:
        ids, pos, cu = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(pos) == 2048 and cu[0] == 0 and cu[-1] == r["n_tokens"]
        for a, z, doc, start in zip(cu, cu[1:], r["doc_ids"], r["starts"]):
            assert (pos[a:z] == np.arange(z - a)).all()
            parts.setdefault(doc, []).append((start, ids[a:z]))
    for doc, text, *_ in rows:
        if doc != 3:
            whole = np.concatenate([x for _, x in sorted(parts[doc], key=lambda p: p[0])])
            assert (whole == tokens.document_ids(text, path)).all()
    assert len({r["sequence_id"] for r in got}) == len(got) and token_output.packed_sequences(empty).count() == 0
    with pytest.raises(Exception, match="fit"):
        token_output.packed_sequences(docs, dtype="u1").collect()


def test_pack_with_columns_of_its_own_names(spark):
    rows = [(i, f"some words {i}", i, i, i, "x") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, piece long, length long, task long, sequence_id string")
    got = packing.pack(d).collect()
    want = packing.pack(d.select("doc_id", "text")).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got)) == sorted(map(key, want))
