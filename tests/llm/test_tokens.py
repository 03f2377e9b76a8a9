"""Token ids of chunked texts against the tokenizers library over the whole text."""

from __future__ import annotations

import random

import numpy as np
import pytest

from passrate.llm import tokens
from tests.llm.conftest import odd_rows, prose, table_of

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def bpe():
    return tokens.byte_bpe(tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))


def odd_texts():
    rng = random.Random(6)
    atoms = ["word", "it's", "  ", "\n\n", "\t", "漢字", "naïve", "12345", "!!!", "\xa0", " ", "🙂", "<|endoftext|>", "'ll", "a" * 30, "\r\n", " \x85 "]
    texts = ["".join(rng.choice(atoms) + (" " if rng.random() < 0.5 else "") for _ in range(rng.randrange(0, 400))) for _ in range(40)]
    return [*texts, "", " ", " " * 500, "x" * 700, "漢" * 400, prose(rng, 500)]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (50, 1), (200, 64), (1 << 16, 256)])
def test_chunked_ids_are_the_librarys(bpe, library, chunk, overlap):
    for text in odd_texts():
        assert bpe.encode(text, chunk, overlap).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_without_ranks(library):
    exact = tokens.ByteBpe(tokens.tokenizer_path("byte_bpe_50k.json"))
    for text in odd_texts()[::4]:
        assert exact.encode(text, 64, 8).tolist() == library.encode(text, add_special_tokens=False).ids


def test_rows(spark, library):
    rows = odd_rows() + [(None, "a <|endoftext|> b"), (None, None), (100, "twice"), (100, "twice")]
    got = sorted((tuple(r) for r in tokens.token_counts(table_of(spark, rows), chunk_chars=500, overlap_chars=32).collect()), key=str)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((d, len((t or "").encode()), count(t), count(t) > 1024) for d, t in rows), key=str)
    assert tokens.token_counts(table_of(spark, rows).where("doc_id < 0")).count() == 0


def test_overlaps_widen_until_a_boundary_is_proven(bpe, library):
    text = "y" * 300 + " end " + "z" * 5000 + " and " + "q" * 90
    ids = bpe.encode(text, 80, 2)
    assert ids.dtype == np.uint32 and ids.tolist() == library.encode(text, add_special_tokens=False).ids
