"""The pipeline against the stages by brute force, each on what the one before it kept."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

pytest.importorskip("tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from passrate.llm import packing, quality  # noqa: E402
from tests.llm.conftest import prose  # noqa: E402
from tests.llm.test_pii import plain_spans  # noqa: E402
from tests.llm.test_similar import kept_by_hand  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = []
    shared = prose(rng, 70)
    for i in range(150):
        junk = i % 5 == 4
        words = " ".join(rng.choice(["CLICK", "$$$", "free", "win", ">>>"]) + str(rng.randrange(10)) for _ in range(80)) if junk else prose(rng, 90)
        texts.append((i, words + ("\n" + shared if i % 11 == 0 else "") + (f" Quillfeather write mail{i % 14}@site.org {prose(rng, 6)}" if i % 7 == 0 else ""), "en", f"s{i % 3}"))
    texts += [(500 + k, texts[k][1], "en", "copy") for k in range(6)] + [(600, None, "en", None), (601, "", None, "s")]
    docs = [(*r, len(r[1]) if r[1] is not None else None) for r in texts]
    out = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 4), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def scores_by_hand(model, texts):
    """Both dictionaries' compressed sizes, by zstandard itself, and the logistic model of their normalised values."""
    out = []
    for t in texts:
        raw = (t or "").encode()
        if not model.weights or not raw:
            out.append(model.prior)
            continue
        good, bad = (len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw)) for d in (model.good, model.bad))
        difference, least = (bad - good) / (len(raw) + 1), min(good, bad) / (len(raw) + 1)
        z = sum(w * x for w, x in zip(model.weights, (1, 10 * difference, least, least * least, math.log(least + 0.01)), strict=True))
        out.append(1 / (1 + math.exp(-z)))
    return out


def sanitised_by_hand(rows, support=3, generalise_at=0.8, remove_at=0.95):
    """The plain patterns, and the disclosure ratio counted in dictionaries."""
    word = re.compile(r"[^\W\d_]{3,}")
    name = lambda t, a, k, b: (k, t[a:b].lower() if k == 0 else re.sub(r"[^0-9]" if k > 1 else r"[^0-9.]", "", t[a:b]))
    spans = [plain_spans(t or "") for _, t in rows]
    contexts, near, held = {}, {}, []
    for i, (_, t) in enumerate(rows):
        inside = lambda m, i=i: any(a < m.end() and m.start() < b for a, _, b in spans[i])
        held.append({m.group().lower() for m in word.finditer(t or "") if not inside(m)})
        for a, k, b in spans[i]:
            around = [*list(word.finditer(t, max(0, a - 400), a))[-8:], *list(word.finditer(t, b, min(len(t), b + 400)))[:8]]
            terms = [m.group().lower() for m in around if not inside(m)]
            for term in terms:
                contexts.setdefault(name(t, a, k, b), {}).setdefault(" ".join(terms), set()).add(i)
                near.setdefault((name(t, a, k, b), term), {}).setdefault(" ".join(terms), set()).add(i)
    told = {}
    for (e, term), found in near.items():
        if len(found) >= support:
            n_et, n_e = len(found), len(contexts[e])
            n_t = n_et + sum(term in h for h in held) - len(set().union(*found.values()))
            n = n_e + len(rows) - len(set().union(*contexts[e].values()))
            ratio = math.log(n_et * n / (n_e * n_t)) / math.log(n / n_e) if n > n_e else 0
            if ratio >= generalise_at:
                told[e, term] = ratio
    out = {}
    for (d, t), own in zip(rows, spans, strict=True):
        entities = {name(t, *s) for s in own}
        marks = [(a, b, ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")[k]) for a, k, b in own]
        for m in word.finditer(t or "") if own else ():
            ratio = max((told.get((e, m.group().lower()), 0) for e in entities), default=0)
            if ratio and not any(a < m.end() and m.start() < b for a, _, b in own):
                marks.append((m.start(), m.end(), "" if ratio >= remove_at else "<NAME>" if m.group()[0].isupper() else "<TERM>"))
        for a, b, mark in sorted(marks, reverse=True):
            t = t[:a] + mark + t[b:]
        out[d] = t
    return out


def by_hand(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [r for r, s in zip(rows, scores_by_hand(quality.fit(docs, labels), [t for _, t in rows]), strict=True) if s >= 0.3]
    rows = kept_by_hand(rows)
    count = Counter(w for _, t in rows for raw in [(t or "").encode()] for w in (raw[p : p + 200] for p in range(len(raw) - 199)))
    kept = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 199):
            if count[raw[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept.append((d, None if t is None else bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return sanitised_by_hand(kept)


def test_rows(checkpoints, spark, folder):
    want = by_hand(spark, folder)
    got = corpus_pipeline.run(spark, folder).collect()
    bpe = packing.byte_bpe(packing.tokenizer_path("byte_bpe_50k.json"), None)
    assert {r["doc_id"] for r in got} == set(want)
    assert 100 < len(want) < 140 and not any(d in want for d in range(500, 506))
    assert not any("@" in (t or "") for t in want.values()) and "<EMAIL>" in want[0]
    for d, text in want.items():
        pieces = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"])
        ids = [i for r in pieces for i in r["ids"]]
        assert ids == bpe.once(text or "") + [0]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in pieces)


def test_stages_keep_the_columns(checkpoints, spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20).cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
