"""Personal data: direct identifiers by pattern, and the terms that give them away by corpus co-occurrence.

Direct identifiers (e-mail and IP addresses, card and phone numbers) are found
by pattern in every whole text.  Each is a protected entity.  The words around
an entity's mentions are counted against the whole corpus: of N contexts, n_e
are of the entity, n_t hold the term and n_et are both.  The entity's distinct
contexts count one each, and so does every document that has the term elsewhere
only.  The term discloses

    log(n_et N / (n_e n_t)) / log(N / n_e)

of the entity's information (pointwise mutual information over information
content, at most 1).  Copies of a passage are one context, so repetition alone
never makes a word disclosing.  A term that discloses at least `generalise_at`
of an entity is generalised wherever it stands in a text that mentions the
entity, and from `remove_at` removed.

Two passes: the texts that can hold identifiers give the contexts; then all
texts are counted for the terms that enough contexts of one entity share, which
a bitmap of fixed size lets through (others that it lets through meet no
partner in the join that follows).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passrate.llm.common import CHUNK_BYTES, by_batch, give_back, spans_of_rows, stored, unused, utf8

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
#: Every text with an identifier matches; the JVM keeps the others from Python.
_MAYBE = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){11}|\+[0-9]"
#: Bits of the map of candidate terms: 2 MB on the driver and in each task.
BITMAP_BITS = 1 << 24


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from the @ signs: linear however long a run without one is."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        got = _DOMAIN.match(text, at + 1) if start < at else None
        if got:
            out.append((start, got.end()))
            last = got.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every direct identifier, by start and kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for run in _DOTTED.finditer(text):
            if run.group().count(".") >= 3:
                for m in _IP.finditer(text, run.start(), run.end()):
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                        out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(value: str) -> int:
    h = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def entity_of(text: str, span: tuple[int, int, int]) -> int:
    """The hash of an identifier, whatever its case or punctuation."""
    start, kind, end = span
    value = text[start:end].lower() if kind == 0 else "".join(c for c in text[start:end] if c.isdigit() or kind == 1)
    return _hash(f"{KINDS[kind]}:{value}")


def contexts(text: str, spans: list[tuple[int, int, int]], words: int, reach: int = 400) -> list[tuple[int, int, int]]:
    """The words around each identifier: entity, term and context."""
    out = []
    covered = [(a, b) for a, _, b in spans]
    for start, kind, end in spans:
        entity = entity_of(text, (start, kind, end))
        before = list(_WORD.finditer(text, max(0, start - reach), start))[-words:]
        after = list(_WORD.finditer(text, end, min(len(text), end + reach)))[:words]
        terms = [m for m in before + after if not any(a < m.end() and m.start() < b for a, b in covered)]
        context = _hash(" ".join(m.group().lower() for m in terms))
        out += [(entity, _hash(m.group().lower()), context) for m in terms]
    return out


def words_of(text: str, spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """The words of a whole text outside its identifiers."""
    at = 0
    for start, _, end in [*spans, (len(text), 0, len(text))]:
        if at < start:
            yield from _WORD.finditer(text, at, start)
        at = max(at, end)


def text_key():
    """A null text is an empty one."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def may_identify():
    return F.coalesce(F.col("text").rlike(_MAYBE), F.lit(False))


def _near(docs: DataFrame, words: int) -> DataFrame:
    """e, t, c of every context word, with 1 where a document shows the pair (e, t), or e, for the first time."""

    def run(batch: pa.RecordBatch):
        rows = []
        for value in batch.column("text"):
            text, seen = value.as_py(), set()
            for e, t, c in contexts(text, base_spans(text), words):
                rows.append((e, t, c, int((e, t) not in seen), int(e not in seen)))
                seen |= {e, (e, t)}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["e", "t", "c", "pair", "entity"])

    return docs.where(may_identify()).select("text").mapInArrow(by_batch(run), "e long, t long, c long, pair long, entity long")


def _bitmap(terms: DataFrame) -> bytes:
    """Bit t modulo BITMAP_BITS is set for every term t; at most BITMAP_BITS / 64 rows reach the driver."""
    rows = terms.select(F.pmod("t", F.lit(BITMAP_BITS)).alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.tobytes()


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_WORDS = pa.list_(pa.struct([("t", pa.int64()), ("s", pa.int32()), ("d", pa.int32())]))
_FOUND = "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, entities array<long>, words array<struct<t:long,s:int,d:int>>, t long, n long"
_NAMES = ["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "words", "t", "n"]
#: Terms a task counts before it hands them on, and words it hashes at a time.
_VOCABULARY, _AT_ONCE = 1 << 19, 1 << 18


def _terms_in(words: list[str], owners: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """(owner, t) of the words that the bitmap lets through; each distinct word is hashed once."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    t = np.array([_hash(w.lower()) for w in coded.dictionary.to_pylist()], np.int64)
    at = t & (BITMAP_BITS - 1)
    hit = (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    index = coded.indices.to_numpy()
    where = np.flatnonzero(hit[index])
    return np.stack([owners[where], t[index[where]]], axis=1)


def _found(docs: DataFrame, bits: bytes) -> DataFrame:
    """A row a document: base counts, digest and spans, entities, and the places of candidate terms where it has entities; and rows (t, n) of documents with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def find(batches):
        flags, bitmap = shared.value, np.frombuffer(shared.value, np.uint8)
        counted: Counter = Counter()

        def vocabulary():
            kinds = [*[pa.int64()] * 6, pa.string(), _SPAN, pa.list_(pa.int64()), _WORDS]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(counted), k) for k in kinds), pa.array(counted.keys(), pa.int64()), pa.array(counted.values(), pa.int64())], _NAMES)

        def part(ids: pa.Array, keys: pa.Array, texts: list[str]):
            counts, digests, base, entities, places = [[], [], [], []], [], [], [], []
            words: list[str] = []
            owners: list[int] = []
            pairs = [np.zeros((0, 2), np.int64)]
            for k, text in enumerate(texts):
                spans = base_spans(text)
                for kind in range(4):
                    counts[kind].append(sum(x == kind for _, x, _ in spans))
                digests.append(hashlib.sha256(",".join(f"{KINDS[x]}:{a}:{b}" for a, x, b in spans).encode()).hexdigest())
                base.append([{"start": a, "kind": x, "end": b} for a, x, b in spans])
                entities.append(list({entity_of(text, s) for s in spans}))
                here = []
                if spans:
                    for m in words_of(text, spans):
                        t = _hash(m.group().lower())
                        at = t & (BITMAP_BITS - 1)
                        if flags[at >> 3] >> (at & 7) & 1:
                            here.append({"t": t, "s": m.start(), "d": m.end()})
                    pairs.append(np.array([(k, w["t"]) for w in here], np.int64).reshape(-1, 2))
                else:
                    every = (m.group() for m in _WORD.finditer(text)) if len(text) > _AT_ONCE else iter(_WORD.findall(text))
                    while got := list(islice(every, _AT_ONCE)):
                        words += got
                        owners += [k] * len(got)
                        if len(words) >= _AT_ONCE:
                            pairs.append(_terms_in(words, np.array(owners), bitmap))
                            words, owners = [], []
                places.append(here)
            pairs.append(_terms_in(words, np.array(owners, np.int64), bitmap))
            t, n = np.unique(np.unique(np.concatenate(pairs), axis=0)[:, 1], return_counts=True)
            counted.update(dict(zip(t.tolist(), n.tolist(), strict=True)))
            blank = pa.nulls(len(texts), pa.int64())
            return pa.RecordBatch.from_arrays([ids, keys, *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(base, _SPAN), pa.array(entities, pa.list_(pa.int64())), pa.array(places, _WORDS), blank, blank], _NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            for a, b in spans_of_rows(utf8(batch.column("text"))[1], 2 * CHUNK_BYTES):
                yield part(batch.column("doc_id").slice(a, b - a), batch.column("text_key").slice(a, b - a), batch.column("text").slice(a, b - a).to_pylist())
                if len(counted) > _VOCABULARY:
                    yield vocabulary()
                    counted.clear()
        if counted:
            yield vocabulary()
        counted.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(find, _FOUND)


#: The texts of a term, and the copies of a text, are dealt to so many joins.
_SALTS = 8


def _measured(docs: DataFrame, context_words: int = 8, support: int = 3, generalise_at: float = 0.8, remove_at: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """The rows of `_found`, and per text that mentions an entity with telling terms: text_key, told (term -> whether it is removed)."""
    near = stored(_near(docs, context_words))
    pairs = near.groupBy("e", "t", "c").agg(F.sum("pair").alias("docs")).groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_et"), F.sum("docs").alias("docs_et"))
    pairs = stored(pairs.where(F.col("n_et") >= support))
    of_entity = near.groupBy("e", "c").agg(F.sum("entity").alias("docs")).groupBy("e").agg(F.count(F.lit(1)).alias("n_e"), F.sum("docs").alias("docs_e"))
    every = stored(_found(docs, _bitmap(pairs.select("t"))))
    found = every.where("t IS NULL").drop("t", "n")
    of_term = every.where("t IS NOT NULL").groupBy("t").agg(F.sum("n").alias("docs_t"))
    n_t = F.col("n_et") + F.col("docs_t") - F.col("docs_et")
    total = F.col("n_e") + F.lit(float(found.count())) - F.col("docs_e")
    told = F.log(F.col("n_et") * total / (F.col("n_e") * n_t)) / F.log(total / F.col("n_e"))
    telling = (
        pairs.join(of_entity, "e").join(of_term, "t").where(F.col("n_e") < total)
        .select("e", "t", told.alias("told")).where(F.col("told") >= generalise_at)
    )
    held = found.where(F.size("words") > 0).groupBy("text_key").agg(F.first("entities").alias("entities"), F.first(F.array_distinct(F.transform("words", lambda w: w["t"]))).alias("ts"))
    telling = telling.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))  # a telling term may be in a third of all texts
    met = held.select("text_key", "entities", F.explode("ts").alias("t")).withColumn("salt", F.pmod(F.hash("text_key"), F.lit(_SALTS)))
    met = met.join(telling, ["t", "salt"]).where(F.array_contains("entities", F.col("e")))
    told_of = met.groupBy("text_key", "t").agg(F.max("told").alias("told")).groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("t", F.col("told") >= remove_at))).alias("told"))
    return found, told_of


def findings(docs: DataFrame, **params) -> DataFrame:
    """Per row of `docs`: doc_id, text_key, the base counts and digest, base spans, and `terms` (start, end, remove).

    Null and empty texts have no spans.
    """
    found, told_of = _measured(docs, **params)
    place = lambda w: F.struct(w["s"].alias("start"), w["d"].alias("end"), F.element_at("told", w["t"]).alias("remove"))
    terms = F.when(F.col("told").isNotNull(), F.transform(F.filter("words", lambda w: F.map_contains_key("told", w["t"])), place))
    plain, worded = found.where(F.size("words") == 0), found.where(F.size("words") > 0).join(told_of, "text_key", "left")
    none = F.lit(None).cast("array<struct<start:int,end:int,remove:boolean>>")
    names = ["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base"]
    return plain.select(*names, none.alias("terms")).unionByName(worded.select(*names, terms.alias("terms")))


def spans_string(base, terms):
    """All spans as kind:start:end, by start and kind."""
    more = F.array_distinct(F.transform(F.coalesce(terms, F.array()), lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end"))))
    every = F.array_sort(F.concat(base, more))
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(every, lambda s: F.concat(F.get(name, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def pii_spans(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per row of `docs`.

    Repeated rows each get their row; a null doc_id stays null; other columns
    are ignored; an empty table gives an empty result.
    """
    return findings(docs, **params).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans_string(F.col("base"), F.col("terms")).alias("spans"))


def redact(text: str, base, terms) -> str:
    """Identifiers give way to their kind, generalised terms to their shape; removed terms go."""
    marks = [(s["start"], s["end"], f"<{KINDS[s['kind']].upper()}>") for s in base or ()]
    marks += [(t["start"], t["end"], "" if t["remove"] else "<NAME>" if text[t["start"]].isupper() else "<TERM>") for t in terms or ()]
    out, at = [], 0
    for start, end, mark in sorted(marks, key=lambda m: (m[0], -m[1])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **params) -> DataFrame:
    """`docs` in all its columns, whatever their names, texts redacted.

    A null text stays null and a row without spans is unchanged; repeated rows
    each stay; an empty table gives an empty result.
    """
    names, schema, at = docs.columns, docs.schema, docs.columns.index("text")
    key, salt, told = unused("key", names), unused("salt", names), unused("told", names)
    told_of = _measured(docs.select("doc_id", "text"), **params)[1]
    told_of = told_of.select(F.col("text_key").alias(key), F.col("told").alias(told), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias(salt))
    keyed = docs.where(may_identify()).withColumn(key, text_key()).withColumn(salt, F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(_SALTS)))

    def cleaned(text: str, terms: dict[int, bool]) -> str:
        spans = base_spans(text)
        if not spans:
            return text
        found = [(m, _hash(m.group().lower())) for m in words_of(text, spans)] if terms else []
        return redact(text, [{"start": a, "kind": k, "end": b} for a, k, b in spans], [{"start": m.start(), "end": m.end(), "remove": terms[t]} for m, t in found if t in terms])

    def clean(batch: pa.RecordBatch):
        texts = [cleaned(v.as_py(), dict(t.as_py() or ())) for v, t in zip(batch.column(at), batch.column(len(names)), strict=True)]
        columns = list(batch.columns[: len(names)])
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(columns, names)

    joined = keyed.join(told_of, [key, salt], "left").select(*names, told)
    return joined.mapInArrow(by_batch(clean), schema).unionByName(docs.where(~may_identify()))
