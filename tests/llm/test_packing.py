import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioflow.llm import packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("seed", range(40))
def test_placements(seed):
    rng = random.Random(seed)
    size = rng.choice([2, 8, 64, 1024])
    lengths = rng.sample(range(1, size), rng.randint(1, size - 1))
    histogram = {n: rng.choice([1, 2, 3, 50, 700]) for n in lengths[:80]}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for length, first, count, start, cut, seq, offset in packing.placements(histogram, size).tolist():
        for i in range(count):
            pieces[length, first + i].append((start, cut))
            sequences[seq + i].append((offset, cut))
    assert set(pieces) == {(n, i) for n, c in histogram.items() for i in range(c)}
    whole = lambda parts: all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
    for (n, _), parts in pieces.items():
        parts.sort()
        assert whole(parts) and sum(p[1] for p in parts) == n
    filled = []
    for parts in sequences.values():
        parts.sort()
        assert whole(parts)
        filled.append(sum(p[1] for p in parts))
    assert max(filled) <= size and sum(f < size for f in filled) <= 1
    assert sorted(sequences) == list(range(len(sequences)))


def test_shortest_pack_first_places_longest_first():
    groups = packing.shortest_pack_first({700: 2, 300: 3, 24: 1}, 1024)
    packs = sorted((tuple(s[0] for s in g.slots), g.count) for g in groups)
    assert packs == [((300, 24), 1), ((700, 300), 2)]


def test_plan_does_not_grow_with_the_corpus():
    rng = random.Random(3)
    lengths = rng.sample(range(1, 1024), 300)
    small, large = ({n: rng.randint(1, most) for n in lengths} for most in (10**4, 10**9))
    assert len(packing.placements(large, 1024)) < 6 * len(packing.placements(small, 1024)) < 10**6


def test_round_trip(docs, texts):
    slow = Tokenizer.from_file(JSON)
    pieces = packing.pack(docs.repartition(3), JSON, RANKS, size=64).collect()
    want = sorted(tuple([*slow.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in texts)
    held, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        held[r.id].append(r)
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(p[1] for p in parts) <= 64
    assert sum(sum(p[1] for p in parts) < 64 for parts in sequences.values()) <= 1
    assert sum(r.length for r in pieces) == sum(map(len, want))
    unique = {d for d, _ in texts if sum(x == d for x, _ in texts) == 1}
    for d, t in texts:
        if d in unique:
            ids = [i for r in sorted(held[d], key=lambda r: r.start) for i in r.ids]
            assert ids == [*slow.encode(t or "", add_special_tokens=False).ids, 0] and {r.doc_tokens for r in held[d]} == {len(ids)}


def test_empty_table(docs):
    assert packing.pack(docs.limit(0), JSON, RANKS).count() == 0


@pytest.mark.parametrize("text", ["", "Hello world", "  spaces  and\n\nlines\t", "日本語 😀 é́", "<|endoftext|> as text", "it's we'll", "x" * 3000, "1234567890 12.5%", "a b c"])
def test_fast_ids_equal_the_tokenizer(text):
    assert packing.token_ids(text, JSON, RANKS).tolist() == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids
