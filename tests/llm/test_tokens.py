"""Token counts, byte-level BPE and packing against the tokenizer libraries."""

import hashlib
import os
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
public_tokenizers = pytest.importorskip("public_tokenizers")

from corpora import corpus, empty, odd_texts  # noqa: E402
from hypothesis import given, settings, strategies as st  # noqa: E402
from rasterledger.llm import byte_bpe, packing, pretokens, token_counts, vocabulary  # noqa: E402
from rasterledger.llm.texts import Texts  # noqa: E402

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def splitter():
    return pretokens.Splitter()


@pytest.fixture(scope="module")
def transducer():
    return token_counts.CountingTransducer(vocabulary.from_json(JSON))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aserlvtmd'' \n\t  1é!?x9𝔸", max_size=600), min_size=1, max_size=5))
def test_splitter_equals_the_pattern(texts):
    import regex

    found = pretokens.words_of(Texts.of([t.encode() for t in texts]), _SPLITTER)
    at = 0
    for text, count in zip(texts, found.counts.tolist(), strict=True):
        mine = [found.distinct[k].decode() for k in found.which[at : at + count]]
        at += count
        assert mine == regex.findall(public_tokenizers.PATTERN, text)


_SPLITTER = pretokens.Splitter()


def test_prefix_scan_equals_one_by_one():
    maps = np.random.default_rng(0).integers(0, 7, (37, 7)).astype(np.uint8)
    state, expected = np.arange(7), []
    for row in maps:
        state = row[state]
        expected.append(state)
    assert np.array_equal(pretokens.composed(maps), np.array(expected))


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=40))
def test_transducer_equals_the_library(word):
    model = vocabulary.from_json(JSON) if not _MODEL else _MODEL[0]
    _MODEL[:] = [model]
    if len(_MODEL) < 2:
        _MODEL.append(token_counts.CountingTransducer(model))
        _MODEL.append(vocabulary.Encoder(model))
    pieces = pretokens.words_of(Texts.of([word.encode()]), _SPLITTER).distinct
    assert [_MODEL[1].count(p) for p in pieces] == [len(_MODEL[2]._word(p)) // 4 for p in pieces]


_MODEL: list = []


def test_token_counts(spark, library):
    expected = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(odd_texts()))
    rows = token_counts.token_counts(corpus(spark), JSON).collect()
    assert sorted({(r.doc_id, r.n_bytes, r.n_tokens) for r in rows}) == expected
    assert len(rows) == len(expected) + 1
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert token_counts.token_counts(empty(spark), JSON).count() == 0


def test_compiled_part_may_be_dropped(transducer):
    before = [transducer.count(w) for w in (b" hello", b"unbelievable", b"zzz")]
    transducer.reset()
    assert [transducer.count(w) for w in (b" hello", b"unbelievable", b"zzz")] == before


def test_round_trip(spark):
    import tiktoken

    model = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.from_ranks(RANKS), special_tokens={})
    rows = byte_bpe.round_trip(corpus(spark), RANKS, with_ids=True).collect()
    texts = odd_texts()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert list(r.ids) == model.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len(rows) == len(texts) + 1
    assert byte_bpe.round_trip(empty(spark), RANKS).count() == 0


def test_model_needs_all_ranks():
    with pytest.raises(ValueError):
        byte_bpe.model_of({b"a": 0, b"b": 2})


def test_packing(spark, library):
    texts = odd_texts()
    rows = packing.packed(corpus(spark), JSON, capacity=128, open_windows=5, with_ids=True).collect()
    windows, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids)
    for pieces in windows.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces])
        assert [r.offset for r in pieces] == [0, *ends[:-1].tolist()] and ends[-1] <= 128
        assert ends[-1] == 128 or ends[-1] & (ends[-1] - 1) == 0  # nothing is padded
    for i, text in enumerate(texts):
        whole = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        copies = 2 if i == 25 else 1
        assert sum(r.length for r in docs[i]) == copies * len(whole)
        for r in docs[i]:
            assert list(r.ids) == whole[r.start : r.start + r.length] and r.doc_tokens == len(whole)
    assert packing.packed(empty(spark), JSON).count() == 0


def test_square_packer_takes_the_level_of_least_squares():
    packer = packing.SquarePacker(10)
    rng = np.random.default_rng(1)
    for k in range(300):
        size = int(rng.integers(1, 10))
        before = packer.counts.copy()

        def cost(level):
            after = before.copy()
            after[level] -= level > 0
            after[level + size] += 1
            return int((after[1:10] ** 2).sum())

        levels = [0] + [h for h in range(1, 11 - size) if before[h]]
        best = min(map(cost, levels))
        assert packer.level_for(size) == max(h for h in levels if cost(h) == best)
        packer.add(k, np.arange(size, dtype=np.uint32))
