"""Piece ids against the sentencepiece library and, for unigram models, against the best of all segmentations."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from passrate.llm import pieces
from passrate.llm.tokens import tokenizer_path
from tests.llm.conftest import odd_rows, prose, table_of

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_ids_and_decoding_are_the_librarys(library):
    rng = random.Random(2)
    model = pieces.piece_model(tokenizer_path("piece_bpe_32k.model"))
    atoms = ["the", " ", "  ", "\n", "漢字", "naïve", "0x1F", "🙂", "▁", "ing", "zzz", "\t", "É", "ffi", "internationalisation"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(1, 40))) for _ in range(400)] + [prose(rng, 400), " ", "", "a" * 300]
    for text in texts:
        ids = model.encode(text)
        assert ids == library.encode(text), text
        assert model.decode(ids) == library.decode(ids), text


def test_small_caches_and_slices_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "_CACHED_UNITS", 5)
    monkeypatch.setattr(pieces, "_CACHED_CHARS", 6)
    monkeypatch.setattr(pieces, "_UNITS_AT_ONCE", 3)
    model, rng = pieces.PieceModel(tokenizer_path("piece_bpe_32k.model")), random.Random(4)
    for text in [prose(rng, 60) for _ in range(20)] + ["abcdefghij " * 9, "a"]:
        assert model.encode(text) == library.encode(text)
        assert len(model.cache) <= 5 + 3 and len(model.before) <= 5 + 3
        assert all(len(unit) <= 6 for unit in model.cache)


def test_one_pass_viterbi_finds_the_best_sum():
    """A small unigram model made by hand: the automaton's segmentation has the score of an exhaustive search."""
    import ahocorasick

    rng = random.Random(3)
    model = object.__new__(pieces.PieceModel)
    vocabulary = {p: -rng.random() * 5 - 0.1 * len(p) for p in ["a", "b", "ab", "ba", "aab", "abab", "bbb", "c", "ca", "abc"]}
    model.pieces, model.automaton, model.unknown, model.unknown_score = list(vocabulary), ahocorasick.Automaton(), 99, -20.0
    model.bytes_of = np.full(256, -1, np.int64)
    for i, (p, s) in enumerate(vocabulary.items()):
        model.automaton.add_word(p, (len(p), s, i))
    model.automaton.make_automaton()
    for _ in range(300):
        text = "".join(rng.choice("aabbcx") for _ in range(rng.randrange(1, 14)))
        best = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            for size in range(1, min(4, end) + 1):
                piece = text[end - size : end]
                score = vocabulary.get(piece, -20.0 if size == 1 else -np.inf)
                best[end] = max(best[end], best[end - size] + score)
        got = sum(vocabulary[model.pieces[i]] if i != 99 else -20.0 for i in model.best(text))
        assert got == pytest.approx(best[-1])


def test_rows(spark, library):
    rows = odd_rows() + [(None, "no id"), (None, None), (100, "twice"), (100, "twice")]
    got = sorted((tuple(r) for r in pieces.encoded(table_of(spark, rows)).collect()), key=str)
    want = []
    for d, t in rows:
        ids = library.encode(t or "")
        back = library.decode(ids)
        want.append((d, len((t or "").encode()), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (t or "")))
    assert got == sorted(want, key=str)
    assert pieces.encoded(table_of(spark, rows).where("doc_id < 0")).count() == 0
