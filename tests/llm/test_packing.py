import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tagflow.llm import packing
from tagflow.llm.tokens import ChunkEncoder


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("text", ["", " ", "a  b", "It's <|endoftext|> x", "don't-stop…  ÉÀ ﬁ x y", "é ́a", "ΑΣ ΑΣ. Σ", "a\tb\nc\r\n d", "😀😀 12 345", "İ İ ß",
                                  "<|startoftext|>a <|endoftext|>", "\x1c a\x1d b \x85c", "中文 字 符"])
def test_chunks_give_the_ids_of_the_whole_text(tokenizer, text):
    ids, at = ChunkEncoder.of("word_bpe_49k.json").encode(pa.array([text, None, text]))
    want = ids_of(tokenizer, text)[:-1]
    assert ids[at[0]:at[1]].tolist() == want and at[2] == at[1] and ids[at[2]:].tolist() == want


def checked(rows, texts, tokenizer, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, own in by_doc.items():
        ids = ids_of(tokenizer, texts[i])
        own.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, s, min(capacity, len(ids) - s)) for k, s in enumerate(range(0, len(ids), capacity))]
        assert all(r.ids_crc32 == crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) for r in own)
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) <= capacity
    return len(by_seq), sum(r.length for r in rows)


@pytest.mark.parametrize("capacity", [4096, 300])
def test_pieces_and_sequences(documents, rows, tokenizer, capacity):
    got = packing.pack(packing.pieces(documents, capacity), capacity).collect()
    assert {r.doc_id for r in got} == set(rows)
    n, total = checked(got, rows, tokenizer, capacity)
    assert n <= -(-total // capacity) + 1


def test_payload_makes_the_sequences(documents, rows, tokenizer):
    packed = packing.pack(packing.pieces(documents, 500, with_ids=True), 500)
    seq = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert seq[r.sequence_id][r.offset:r.offset + r.length] == r.ids == ids_of(tokenizer, rows[r.doc_id])[r.start:r.start + r.length]


def test_fullest_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 7))}
        room = rng.randint(0, 60)
        reach = {0}
        for x, n in counts.items():
            reach = {r + x * k for r in reach for k in range(n + 1) if r + x * k <= room}
        got = packing.fullest(counts, room)
        assert sum(got) == max(reach) and all(got.count(x) <= counts.get(x, 0) for x in got)


def test_plan_places_every_piece_and_equals_one_bin_at_a_time():
    rng = random.Random(2)
    counts = {rng.randint(1, 100): rng.randint(1, 2000) for _ in range(60)}
    made, single = packing.plan(dict(counts), 100), 0
    left = dict(counts)
    while left:
        first = max(left)
        bin_ = [first, *packing.fullest({x: n - (x == first) for x, n in left.items() if n > (x == first)}, 100 - first)]
        for x in bin_:
            left[x] -= 1
        left = {x: n for x, n in left.items() if n}
        single += 1
    assert sum(t for _, t in made) <= single + len(made) // 10 and len(made) <= 100
    for x, n in counts.items():
        assert sum(b.count(x) * t for b, t in made) == n


def test_edges(edges, nothing, tokenizer):
    got = packing.pack(packing.pieces(edges)).collect()
    assert sum(r.piece == 0 for r in got) == edges.count() and packing.pack(packing.pieces(nothing)).count() == 0
    assert {r.length for r in got if r.doc_id in (1, 2, 3)} == {1}
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(v)[0][0] == 0 and sum(n for _, n in v) <= 4096 for v in seq.values())
