import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketlens.llm import packing
from marketlens.llm.queries import tokenizer

SLOW = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
SLOW.encode_special_tokens = True
ids_of = lambda t: SLOW.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab Aé\n\t'st.,9漢 \u0085\x1c<|>endoftx 　ü", max_size=40) | st.text(max_size=30))
def test_ids_equal_the_tokenizer(text):
    assert np.frombuffer(packing.text_ids(tokenizer(), text), "<u4").tolist() == ids_of(text)


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_patterns_fit_and_keep_the_demand(histogram):
    sizes, demand = np.array(sorted(histogram), np.int64), np.array([histogram[s] for s in sorted(histogram)], np.int64)
    patterns, times = packing.cutting_stock(sizes, demand, 64)
    if len(sizes):
        assert (patterns @ sizes <= 64).all() and (times @ patterns <= demand).all()


def test_program_reaches_its_bound():
    """Sizes 3 and 5 in room 8: every sequence can be filled, which first-fit misses."""
    patterns, times = packing.cutting_stock(np.array([3, 5]), np.array([100, 100]), 8)
    assert times.sum() == 100 and (patterns @ [3, 5] == 8).all()
    best, _ = packing.knapsack(np.array([0.3, 0.5, 0.61]), np.array([3, 5, 6]), 11)
    assert best[11] == pytest.approx(1.11) and best[2] == 0


def check(rows, docs):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    padded = 0
    for i, text in docs.items():
        ids = [*ids_of(text or ""), 0]
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    return padded


@pytest.mark.parametrize("parts", [1, 5])
def test_every_id_lies_in_one_piece(spark, docs, parts):
    draw = np.random.default_rng(4)
    texts = [None, "", " ", "a", "word " * 9000, "x" * 5000, *(" ".join(["the cat", "sat"] * n) for n in draw.integers(1, 700, 250)), *["same text again"] * 120]
    found = packing.pack(docs(*texts).repartition(parts), tokenizer())
    assert check(found.collect(), dict(enumerate(texts))) == 0


def test_padding_may_be_allowed_and_ids_missing(spark, docs):
    texts = [" ".join(["the"] * n) for n in [300] * 60 + [411] * 50 + [700] * 31]
    rows = packing.pack(docs(*texts), tokenizer(), most_padding=30).collect()
    check(rows, dict(enumerate(texts)))
    rows = packing.pack(docs("a b", "c", ids=[None, None]), tokenizer()).collect()
    assert sum(r.length for r in rows) == 5
    assert packing.pack(docs(), tokenizer()).count() == 0


def test_added_tokens_are_those_of_the_unmodified_tokenizer(spark, docs):
    plain = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [mark, f"a {mark} b", f"a{mark}{mark}\n", f"  {mark}  x", "<|endoftext|", f"word {mark} " * 700, "no mark", f"<{mark}> 漢{mark}ü"]
    added = packing.added_tokens(tokenizer())
    for text in texts:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packing.text_ids(tokenizer(), text, added), "<u4").tolist() == ids
    whole = {r.doc_id: r for r in packing.pack(docs(*texts), tokenizer()).collect() if r.start == 0}
    for i, text in enumerate(texts):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        assert whole[i].doc_tokens == len(ids)
        assert whole[i].ids_crc32 == zlib.crc32(np.array(ids[: whole[i].length], "<u4").tobytes())
    assert packing.text_ids(tokenizer(), mark) != packing.text_ids(tokenizer(), mark, added)
