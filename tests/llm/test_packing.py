import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logsift.llm import matrices, packing, tokens
from logsift.llm.common import table

from .conftest import ODD


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected_ids(rows):
    encode = library().encode
    return [(doc, encode(text or "", add_special_tokens=False).ids + [2]) for doc, text in rows]


def check_packing(rows, packed, capacity=1024):
    want = []
    for doc, ids in expected_ids(rows):
        sizes = [len(ids)] if len(ids) <= capacity else [len(ids) % capacity] * (len(ids) % capacity > 0) + [capacity] * (len(ids) // capacity)
        at = 0
        for i, n in enumerate(sizes):
            want.append((doc, i, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())))
            at += n
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=key) == sorted(want, key=key)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return sequences, sum(w[3] for w in want)


def test_odd_documents(odd):
    check_packing([r[:2] for r in ODD], packing.pack_documents(odd).collect())


def test_whole_table_is_packed_tightly(spark, small):
    docs = table(spark, small, "documents")
    sequences, total = check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack_documents(docs).collect())
    assert len(sequences) <= -(-total // 1024) * 1.02 + 1


def test_sequences_put_ids_together(spark, small):
    docs = table(spark, small, "documents").limit(40)
    pieces = packing.token_pieces(docs, 256, with_ids=True)
    packed = packing.pack(pieces, "length", ["doc_id", "piece"], 256)
    want = dict(expected_ids([(r.doc_id, r.text) for r in docs.collect()]))
    back = {}
    for r in packing.sequences(packed).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        for doc, piece, lo, hi in zip(r.doc_ids, r.pieces, r.offsets, [*r.offsets[1:], len(ids)]):
            back.setdefault(doc, []).append((piece, ids[lo:hi]))
    assert {d: [i for _, p in sorted(ps) for i in p] for d, ps in back.items()} == want


def test_clashing_columns(spark):
    items = spark.createDataFrame([(5, 1, "a", 7), (3, 2, "b", 8), (4, 3, "c", 9)], "length long, pos long, range_id string, range_pos long")
    rows = packing.pack(items, "length", ["pos"], 8).collect()
    assert sorted((r.length, r.pos, r.range_id, r.range_pos) for r in rows) == [(3, 2, "b", 8), (4, 3, "c", 9), (5, 1, "a", 7)]
    assert len({r.sequence_id for r in rows}) == 2


def test_empty(empty):
    assert packing.pack_documents(empty).count() == 0
    assert matrices.token_matrices(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_rounds_place_every_item_once(counts):
    matches, used = packing.best_fit_rounds(counts, 40)
    placed, rows = {}, {}
    for length, first, n, seq, offset in matches:
        for i in range(n):
            placed.setdefault(length, []).append(first + i)
            rows.setdefault(seq + i, []).append((offset, length))
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert set(rows) == set(range(used))
    for parts in rows.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 40
    lengths = [k for k, n in counts.items() for _ in range(n)]
    assert used <= len(matrices.best_fit_decreasing(lengths, 40)) * 1.1 + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_segment_tree_gives_best_fit_decreasing(lengths):
    rooms, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in rooms if r >= lengths[i]]
        room = min(fits) if fits else 40
        if fits:
            rooms.remove(room)
        rooms.append(room - lengths[i])
        want[i] = room
    rows = matrices.best_fit_decreasing(lengths, 40)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in r) <= 40 for r in rows)
    assert len(rows) == len(rooms)
    assert sorted(40 - sum(lengths[i] for i in r) for r in rows) == sorted(rooms)


@pytest.mark.parametrize("width", [64, 2048])
def test_matrices_round_trip(odd, width):
    back, names = {}, set()
    for r in matrices.token_matrices(odd, width=width, rows=8).collect():
        assert (r.block, r.block_start, r.row) not in names and r.row < 24
        names.add((r.block, r.block_start, r.row))
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == width and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids
        assert not ids[r.n_ids:].any()
        for doc, start, lo, hi in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[lo:hi].tolist() == list(range(hi - lo))
            back.setdefault(doc, []).append((start, ids[lo:hi].tolist()))
    want = {}
    for doc, ids in expected_ids([r[:2] for r in ODD]):
        want.setdefault(doc, []).extend(ids)            # the repeated row 6 comes twice
    got = {doc: [i for _, part in sorted(parts) for i in part] for doc, parts in back.items()}
    six = got.pop(6), want.pop(6)
    assert got == want and sorted(six[0]) == sorted(six[1])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc AB'sd19 \n\t!?é漢🙂 <|endoftext|>", max_size=60))
def test_ids_are_the_library_s(text):
    assert ENCODE(text) == LIBRARY.encode(text, add_special_tokens=False).ids


ENCODE, LIBRARY = tokens.load_encoder(), library()
