import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import packing
from quarry.llm.catalogue import QUERIES

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return tokenizers.Tokenizer.from_file(PATH)


def check(pieces, want, length):
    """pieces: (doc, start, ids, doc_tokens, sequence, offset). Every id in exactly one piece; windows gapless, full or a power of two."""
    by, windows = {}, {}
    for doc, start, ids, total, seq, offset in pieces:
        by.setdefault(doc, []).append((start, list(ids)))
        windows.setdefault(seq, []).append((offset, len(ids)))
        assert total == len(want[doc]) and len(ids)
    assert {d: [x for _, p in sorted(v) for x in p] for d, v in by.items()} == want
    for v in windows.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= length and (at == length or at & (at - 1) == 0)


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_query_round_trip(spark, plain):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: [*plain.encode(r.text, add_special_tokens=False).ids, 2] for r in rows}
    got = QUERIES["op8_packing"](spark, SF).collect()
    pieces = [
        (r.doc_id, r.start, want[r.doc_id][r.start : r.start + r.length], r.doc_tokens, r.sequence_id, r.offset) for r in got
    ]
    check(pieces, want, 4096)
    assert all(r.ids_crc32 == zlib.crc32(np.array(p[2], "<u4").tobytes()) for r, p in zip(got, pieces, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=150), st.integers(1, 40))
def test_packer_keeps_every_id(sizes, max_open):
    packer = packing.Packer(32, max_open)
    want = {d: list(range(d * 1000, d * 1000 + n)) for d, n in enumerate(sizes)}
    for d, n in enumerate(sizes):
        packer.add((d, n), np.array(want[d], "<u4").tobytes())
        assert packer.n_open <= max_open and packer.count.sum() == packer.n_open
    packer.finish()
    pieces = []
    for s, w in enumerate(packer.closed):
        at = 0
        for (d, n), start, raw in w:
            pieces.append((d, start, ids_of(raw), n, s, at))
            at += len(raw) // 4
    check(pieces, want, 32)


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(2)
    packer, levels = packing.Packer(16, 10_000), []
    for i, size in enumerate(rng.integers(1, 16, 300).tolist()):
        before = sorted(levels)
        packer.add((i, size), np.zeros(size, "<u4").tobytes())
        after = sorted(level for level, w in packer.open.items() for _ in w)
        cost = lambda ls: sum(ls.count(h) ** 2 for h in set(ls) if h < 16)
        choices = [cost([*before, size])]
        for h in set(before):
            if h + size <= 16:
                rest = list(before)
                rest.remove(h)
                choices.append(cost([*rest, h + size]))
        assert cost(after) == min(choices)
        levels = after


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aZé \n\t\r\x0b\x1c\x85 ́ ßΣσ'sdlv1٣.,<|>endoftxarE😀你"), max_size=40))
def test_remembered_words_have_the_tokenizers_ids(text):
    text = text.replace("E", "<|endoftext|>")
    got = packing.encoder(PATH).encode([text])[0]
    assert ids_of(got) == TOKENIZER.encode(text, add_special_tokens=False).ids


TOKENIZER = tokenizers.Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_simple_texts_have_the_tokenizers_ids(text):
    assert ids_of(packing.encoder(PATH).encode([text])[0]) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs, PATH, 2).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0)[:5] == [(0, 4), (1, 8), (2, 8), (2, 8), (3, 1)]
    assert sum(r.length for r in rows if r.doc_id == 6) == rows[[r.doc_id for r in rows].index(6)].doc_tokens
    assert packing.pack(no_docs, PATH, 2).count() == 0


def test_placement_goes_on_by_the_sum_of_squares_after_windows_are_settled():
    rng = np.random.default_rng(3)
    packer, settled = packing.Packer(64, 12), 0
    for i, size in enumerate(rng.integers(1, 64, 600).tolist()):
        before = packer.count.copy()
        choices = {0: 2 * before[size] + 1}
        for h in np.flatnonzero(before).tolist():
            if h + size <= 64:
                after = before.copy()
                after[h] -= 1
                after[h + size] += h + size < 64
                choices[h] = int((after**2).sum() - (before**2).sum())
        packer.add((i, size), np.zeros(size, "<u4").tobytes())
        levels = np.zeros(65, int)
        for windows in packer.open.values():
            for w in windows:
                levels[sum(len(p[2]) for p in w) // 4] += 1
        assert (levels == packer.count).all() and packer.n_open == levels.sum() <= 12
        if packer.n_open < before.sum():
            settled += 1
            continue
        assert (packer.count**2).sum() - (before**2).sum() == min(choices.values())
    assert 5 < settled < 300


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_every_tokenizer_file(name):
    texts = ["Hello World, it's 2024!", "a\nb  c", "É ß 你好", "<|endoftext|> x", ""]
    plain = tokenizers.Tokenizer.from_file(public.path(name))
    got = [ids_of(x) for x in packing.encoder(public.path(name)).encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.encoder(public.path(name)).by_words == name.startswith("word")
