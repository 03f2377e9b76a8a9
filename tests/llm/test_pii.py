"""Identifiers against the plain patterns; disclosure by co-occurrence; redaction."""

from __future__ import annotations

import hashlib
import random
import re

from passrate.llm import pii
from tests.llm.conftest import odd_rows, table_of

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def holds(kind: int, match: str) -> bool:
    digits = [int(c) for c in match if c.isdigit()]
    if kind == 1:
        return all(int(p) <= 255 for p in match.split("."))
    if kind == 2:
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if holds(k, m.group()))


def random_text(rng: random.Random) -> str:
    atoms = ["a.b@c-d.org", "@", "x@y", ".com", "10.0.0.1", "256.1.1.1", "1.2.3", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 (0)20 7946 0018", "+1", " ", "-", "7", "é", "٣", "+", "000.00.0000255.1", "a_b@c.d.e.", "\n"]
    return "".join(rng.choice(atoms) for _ in range(rng.randrange(0, 14)))


def test_spans_against_plain_patterns():
    rng = random.Random(5)
    for _ in range(6000):
        text = random_text(rng)
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "@" + "b" * 300_000) == []
    assert pii.base_spans("1." * 200_000) == [(8 * i, 1, 8 * i + 7) for i in range(50_000)]


def _base(text):
    spans = plain_spans(text or "")
    return [sum(k == kind for _, k, _ in spans) for kind in range(4)], hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_query_rows(checkpoints, spark):
    """Counts and digests of odd rows; a name that stands only beside one address is a term, common words are not."""
    rng = random.Random(9)
    rows = [(d, t) for d, t in odd_rows()] + [(None, "write to a@b.cd"), (None, None), (400, "write to a@b.cd"), (400, "write to a@b.cd")]
    fill = ["please", "write", "about", "order", "today", "soon", "again", "never", "maybe", "often"]
    for i in range(60):
        who, mail = ("Quillfeather", "quill@site.org") if i % 10 == 0 else (rng.choice(fill), f"u{i}@site.org")
        rows.append((500 + i, " ".join(rng.sample(fill, 4)) + f" {who} {mail} " + " ".join(rng.sample(fill, 4))))
    got = {}
    for r in pii.pii_spans(table_of(spark, rows)).collect():
        got.setdefault((r["doc_id"], r["base_sha256"]), []).append(r)
    text_of = {}
    for d, t in rows:
        counts, digest = _base(t)
        found = got[(d, digest)]
        assert [found[0][f"n_{k}"] for k in pii.KINDS[:4]] == counts
        text_of[d] = t
    assert sum(map(len, got.values())) == len(rows)
    terms = {text_of[d][int(a) : int(b)] for (d, _), rs in got.items() for r in rs for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "term"}
    assert terms == {"Quillfeather"}
    clean = {r["doc_id"]: r for r in pii.sanitise(table_of(spark, rows)).collect()}
    assert len(clean) == len({d for d, _ in rows})
    assert "Quillfeather" not in clean[500]["text"] and "<EMAIL>" in clean[500]["text"] and "@" not in clean[507]["text"]
    assert clean[300]["text"] is None and clean[301]["text"] == "" and clean[310]["text"] == text_of[310] and clean[310]["tie"] == "t"
    assert pii.pii_spans(table_of(spark, rows).where("doc_id < 0")).count() == 0


def test_words_common_in_the_corpus_disclose_nothing(checkpoints, spark):
    """A word that stands near one identifier only, but in many clean texts, is no term; a name that is nowhere else is."""
    rows = [(i, f"alpha{chr(97 + i)} Quillfeather invoice beta{chr(97 + i)} quill@site.org") for i in range(5)]
    rows += [(20 + i, f"other words {chr(97 + i)}xyz u{i}@site.org") for i in range(20)]
    rows += [(100 + i, f"the invoice number {i} " + "clean prose " * 5) for i in range(200)]
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_spans(table_of(spark, rows)).collect()}
    assert len(spans) == len(rows)
    marked = {t[int(a) : int(b)] for d, t in rows for k, a, b in (s.split(":") for s in spans[d].split(",") if s) if k == "term"}
    assert marked == {"Quillfeather"}


def test_terms_are_marked_throughout_the_texts_of_their_entity(checkpoints, spark):
    """Far from the identifier, and beside another one, a name goes wherever the text mentions its entity; elsewhere it stays."""
    far = " ".join(["plain filler text"] * 60)
    rows = [(i, f"alpha{chr(97 + i)} Quillfeather beta{chr(97 + i)} quill@site.org") for i in range(4)]
    rows += [(10, f"quill@site.org {far} Then quillfeather and Quillfeather left. {far}"), (11, f"Quillfeather alone, {far}")]
    rows += [(100 + i, f"clean prose {i} {far}") for i in range(100)]
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_spans(table_of(spark, rows)).collect()}
    text = dict(rows)
    marked = {d: [text[d][int(a) : int(b)] for k, a, b in (s.split(":") for s in spans[d].split(",") if s) if k == "term"] for d in text}
    assert marked[10] == ["quillfeather", "Quillfeather"] and marked[11] == [] and marked[0] == ["Quillfeather"]
    assert not any(marked[100 + i] for i in range(100))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table_of(spark, rows)).collect()}
    assert "uillfeather" not in clean[10] and clean[11] == text[11]
