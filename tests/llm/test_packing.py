import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import packing
from graphloom.llm.queries import tokenizer

from .conftest import prose


def check(sizes, tiers=packing.TIERS):
    pieces = list(packing.Packer(tiers, 5 << 40, 16 * max(tiers)).pack(sizes))
    ends, covered, tier_of = {}, defaultdict(list), {}
    for row, start, length, sequence, offset, tier, group in pieces:
        assert length > 0 and ends.get(sequence, 0) == offset
        ends[sequence] = offset + length
        tier_of[sequence] = (tier, group)
        covered[row].append((start, length))
    for row, n in enumerate(sizes):
        at = 0
        for start, length in sorted(covered[row]):
            assert start == at
            at += length
        assert at == n
    groups = defaultdict(int)
    for sequence, n in ends.items():
        tier, group = tier_of[sequence]
        assert n == tier and n & (n - 1) == 0 and n <= max(tiers)
        groups[group, tier] += n
    assert all(v <= 16 * max(tiers) for v in groups.values())
    return pieces


@pytest.mark.parametrize("sizes", [[], [1], [4096], [4097], [5] * 2000, [511, 513, 1024, 2047, 9000], [1] * 7])
def test_every_token_lies_in_one_full_window(sizes):
    check(sizes)


def test_random_sizes():
    rng = random.Random(1)
    for _ in range(30):
        check([rng.choice([1, 7, 300, 700, 1500, 3000, 9000]) + rng.randrange(50) for _ in range(rng.randrange(1, 200))])


def test_long_documents_keep_whole_windows():
    pieces = check([40_000])
    assert [p[2] for p in pieces].count(4096) == 9


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer()
    plain, mine = Tokenizer.from_file(path), packing.ChunkIds(path)
    texts = ["", " ", "a b", "x\u0301 \u0301y", "<|endoftext|> foo<|STARTOFTEXT|>bar.", "It's  WE'LL\t\tgo,\n", "\u03a3\u03b1\u03c2 \u039f\u0394\u039f\u03a3,", "\x1cA\x1d b\x85c d", "a" * 500 + ",", ".,", "a.,", "e\n\u0301", "'s 't ' s", "\uff11 \u00bd", "\u200b \ufeff zz", "\u0130I."]
    for text in [*texts, prose(3, 500)]:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_operator_returns_all_documents(odd_docs, no_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer())
    rows = packing.pack_documents(odd_docs, tokenizer()).collect()
    docs = odd_docs.select("doc_id", "text").collect()
    assert sum(r["length"] for r in rows) == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    text = next(t for i, t in docs if i == 11)
    ids = plain.encode(text, add_special_tokens=False).ids + [2]
    for r in rows:
        if r["doc_id"] == 11:
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(piece) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
    assert packing.pack_documents(no_docs, tokenizer()).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd_docs, tokenizer(), tiers=(100,))
