"""Chunks of ordinary text: counts and ids are the library's, whatever the chunks hold."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sonagrid.llm import packing, pretokens, queries, token_counts
from sonagrid.llm.textarrays import blocks

TEXTS = [
    "It's what they'd say: we'll, I'm, you've, DON'T, they're 'quoted' and ''s odd'''s.",
    "“Curly quotes” don’t end — nor do dashes–like this…",
    "Καλημέρα κόσμε, Σίσυφος ΟΔΟΣ. Привет, мир! Ёлка ёлка",
    "<|endoftext|>a<|startoftext|> <|endoftext|>'s <| endoftext|> <|endoftext| > x<|ENDOFTEXT|>",
    "é ́x å Å Å İstanbul ẞ straße ×÷ªºµ",
    "no break wide　ideographic \u0085 next​zero﻿mark",
    "中文没有空格的句子'带引号' 日本語テキスト 한국어 한 ½ ١٢٣ ①",
    "tab\tand\x0bvertical\x0cform\rreturn\x1cgroup\x00nul '\n'",
    "x" * 300 + "'" + "y" * 300 + " " + "'s" * 200,
    "",
    " ' ",
    "👍🏽👩‍👩‍👧 it's",
]
PARTS = ["'", "s", "t", "ll", "re", "D", "É", "é", "́", "̣", "ß", "İ", "Σ", "ж", "中", "7", "½", "×", "—", "’", " ", "\n", " ", " ", "\x1c", "<", "|", "<|endoftext|>", "<|", "_", "!", "h", "̱", "ᄒ", "ᅡ"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(queries.tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(queries.tokenizer_path(), None)


def check(texts, tokenizer, counter, encoder):
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counter(pa.array(texts)).tolist() == [len(x) for x in want]
    assert [x.tolist() for x in encoder(pa.array(texts))] == want


def test_ordinary_texts_have_the_librarys_ids(tokenizer, counter, encoder):
    for texts in (TEXTS, TEXTS[::-1], ["plain words only", *TEXTS, "and again"] * 3):
        check(texts, tokenizer, counter, encoder)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=5))
def test_any_mixture_has_the_librarys_ids(tokenizer, counter, encoder, texts):
    check(texts, tokenizer, counter, encoder)


def test_what_is_forgotten_is_cut_again(monkeypatch, tokenizer):
    monkeypatch.setattr(pretokens, "CHUNKS", 3)
    check(TEXTS * 2, tokenizer, token_counts.Counter(queries.tokenizer_path()), packing.Encoder(queries.tokenizer_path(), None))


def test_little_is_remembered(monkeypatch):
    monkeypatch.setattr(pretokens, "CHUNKS", 50)
    counter = token_counts.Counter(queries.tokenizer_path())
    counter(pa.array([f"it's n’{i} " + "é—" * 200 + str(i) for i in range(500)]))
    assert len(counter.pre.pieces.held) <= 50


def test_only_chunks_that_need_it_go_to_the_library():
    pre = pretokens.Pretokenizer(queries.tokenizer_path())
    (block,) = blocks(pa.array(["it's an ordinary été, isn't it", "a<|b <c| d"]))
    at, easy = pre.chunks(block)
    hard = [block.data[s:e].tobytes().decode() for s, e in zip(at.start[~easy], at.end[~easy], strict=True)]
    assert hard == ["it's", "isn't", "a<|b"]
    assert pre(block).text.tolist() == sorted(pre(block).text.tolist())


def test_a_file_of_other_rules_is_refused(tmp_path):
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="normalise"):
        pretokens.Pretokenizer(str(path))
