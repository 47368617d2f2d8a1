import random

import numpy as np
import pytest
from helpers import words
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm.jump_hash import jump_hash
from cohortlens.llm.range_coder import Frequencies, _blocks, checksum, decode, encode, pack_block, unpack_block
from cohortlens.llm.tokens import PieceEncoder
from cohortlens.llm.words import Words

TEXT = st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab \n\t\x0b\x0c\r\x1c  Éß😀|#1'"), max_size=60), st.text(max_size=40))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_the_regex_words(texts):
    w = Words([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts])
    got = [[w.buf[w.start[j]:w.end[j]].tobytes().decode("utf-8", "surrogatepass") for j in range(w.first[i], w.first[i + 1])]
           for i in range(len(texts))]
    assert got == [words(t) for t in texts]
    flat = [x for t in texts for x in words(t)]
    # equal words have equal hashes wherever they lie, different ones differ
    assert len(set(zip(flat, w.hash.tolist(), strict=True))) == len(set(flat)) == len(set(w.hash.tolist()))


def test_grams_depend_on_content_only():
    a, b = Words([b"x y z u", b"p q"]), Words([b"q q q q q q", None, b"x  y\tz u"])
    assert a.grams(3)[1].tolist() == b.grams(3)[1].tolist()[-2:]
    assert a.whole(0) == b.whole(2) != a.whole(1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.integers(1, 40))
def test_coder_round_trip(ids, lanes):
    ids = np.array(ids, np.uint32)
    table = Frequencies.of_counts({int(s): int(n) for s, n in zip(*np.unique(ids, return_counts=True), strict=True)})
    if len(ids):
        assert table.scaled.sum() == 1 << table.bits
    states, stream = encode(ids, table, lanes)
    assert decode(len(ids), states, stream, table, table.slots()).tolist() == ids.tolist()


def test_skewed_table_and_block_round_trip():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 200_000), 49_000).astype(np.uint32)
    table = Frequencies.of_counts({int(s): int(n) for s, n in zip(*np.unique(ids, return_counts=True), strict=True)})
    table = Frequencies.from_bytes(table.to_bytes())
    sizes = np.array([0, 100_000, 1, 99_999])
    raw = pack_block([5, None, 7, 7], sizes, ids, table)
    assert len(raw) < 2 * len(ids)
    keys, n, back = unpack_block(raw, table, table.slots())
    assert keys == [5, None, 7, 7] and n.tolist() == sizes.tolist() and (back == ids).all()
    assert checksum(back) == checksum(ids)
    broken = bytearray(raw)
    broken[-9] ^= 4
    with pytest.raises(ValueError):
        if (unpack_block(bytes(broken), table, table.slots())[2] != ids).any():
            raise ValueError("differs")


def test_blocks_hold_whole_documents():
    rng = random.Random(3)
    sizes = [rng.choice([1, 5, 40, 200]) for _ in range(200)]
    ids = np.arange(sum(sizes), dtype=np.uint32)
    chunks, at = [], 0
    for a in range(0, 200, 23):
        part = np.array(sizes[a:a + 23])
        chunks.append((list(range(a, a + len(part))), part, ids[at:at + part.sum()]))
        at += part.sum()
    blocks = list(_blocks(iter(chunks), 100))
    assert [k for keys, _, _ in blocks for k in keys] == list(range(200))
    assert np.concatenate([x for _, _, x in blocks]).tolist() == ids.tolist()
    assert all(n.sum() == len(x) for _, n, x in blocks)
    assert all(100 <= len(x) < 300 for _, _, x in blocks[:-1])


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.arange(-5000, 5000).astype(np.int64).view(np.uint64)
    old, new = jump_hash(keys, 40), jump_hash(keys, 41)
    assert set(new[old != new].tolist()) == {40} and abs((old != new).mean() - 1 / 41) < 0.01
    assert (jump_hash(keys, 1) == 0).all() and np.bincount(old, minlength=40).min() > 180


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_plain_loop():
    keys = [0, 1, 2 ** 64 - 1, 12345678901234567, 2 ** 63]
    for n in (1, 2, 40, 1000):
        assert jump_hash(np.array(keys, np.uint64), n).tolist() == [slow_jump(k, n) for k in keys]


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    return Tokenizer.from_str(definition), PieceEncoder(definition, cache_pieces=50)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(TEXT, st.sampled_from(["<|endoftext|> a<|startoftext|>b", "don't ΣΑΣ Σ  é x", "İI ﬁ"])), max_size=5))
def test_piece_by_piece_is_the_same_as_whole(tokenizer, texts):
    whole, by_word = tokenizer
    ids, n = by_word.encode([None if t is None else t.encode("utf-8", "ignore") for t in texts])
    each = np.split(ids, np.cumsum(n)[:-1]) if texts else []
    clean = [(t or "").encode("utf-8", "ignore").decode() for t in texts]
    assert [x.tolist() for x in each] == [whole.encode(t, add_special_tokens=False).ids for t in clean]
