"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton holds every piece of the model.  One pass over a text visits, at
each end position, the pieces that end there along the output links, longest
first, and relaxes what is known of the prefix that ends there.

* A unigram model: the best total score of a segmentation of the prefix.  A
  character that no piece covers costs the unknown penalty.
* A BPE model, whose scores are merge ranks and do not add up to a quality: the
  last piece of the prefix's own encoding.  A piece is it when it and the last
  piece of the prefix before it encode, side by side, to just these two; a
  sequence of pieces is an encoding exactly when all its neighbours are.

A character without a piece becomes its bytes' pieces.  No piece crosses from a
non-blank to a blank, so the pass may restart there and units seen before need
no second pass.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passrate.llm.common import by_batch
from passrate.llm.tokens import tokenizer_path

BLANK = "▁"
_UNKNOWN_PENALTY = 10.0
_CACHED_UNITS, _CACHED_CHARS, _CACHED_PAIRS = 200_000, 48, 1_000_000
_UNITS_AT_ONCE = 1 << 15


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields; fixed-size ones are passed over."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 2:
            size, at = _varint(data, at)
            yield tag >> 3, data[at : at + size]
            at += size
        elif tag & 7 == 0:
            value, at = _varint(data, at)
            yield tag >> 3, value
        else:
            at += 4 if tag & 7 == 5 else 8


def is_bpe(path: str) -> bool:
    """Whether the model file's trainer settings (field 2) name the BPE type (field 3 is 2)."""
    with open(path, "rb") as file:
        return any(n == 3 and v == 2 for number, body in _fields(file.read()) if number == 2 for n, v in _fields(body))


class PieceModel:
    def __init__(self, path: str, bpe: bool | None = None):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [library.id_to_piece(i) for i in range(library.vocab_size())]
        self.bytes_of = np.full(256, -1, np.int64)
        self.automaton = ahocorasick.Automaton()
        self.unknown = library.unk_id()
        self.surface: list[bytes] = []
        self.sizes = [len(p) for p in self.pieces]
        self.bpe = is_bpe(path) if bpe is None else bpe
        self.score_of: dict[str, float] = {}
        self.pairs: dict[int, bool] = {}  # by (piece before + 1) * pieces + piece
        lowest, crosses = 0.0, False
        for i, piece in enumerate(self.pieces):
            if library.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes_of[value] = i
                self.surface.append(bytes([value]))
            elif library.is_control(i) or library.is_unknown(i):
                self.surface.append(b"" if library.is_control(i) else " ⁇ ".encode())
            else:
                self.surface.append(piece.replace(BLANK, " ").encode())
                lowest = min(lowest, library.get_score(i))
                self.score_of[piece] = library.get_score(i)
                if not library.is_unused(i):
                    self.automaton.add_word(piece, (len(piece), library.get_score(i), i))
                    crosses |= BLANK in piece.lstrip(BLANK)
        self.automaton.make_automaton()
        self.unknown_score = lowest - _UNKNOWN_PENALTY
        self.unit = re.compile(".+" if crosses else f"{BLANK}*[^{BLANK}]+|{BLANK}+", re.DOTALL)
        self.cache: dict[str, tuple[int, ...]] = {}  # the units met last, and in `before` those before them
        self.before: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition, for short strings: the best-scored neighbours merge, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            score, at = max((self.score_of.get(parts[i] + parts[i + 1], -np.inf), -i) for i in range(len(parts) - 1))
            if score == -np.inf:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def fits(self, before: int, piece: int) -> bool:
        """Do these two pieces, side by side, encode to themselves?  (before -1: nothing, or an unknown character.)"""
        both = [self.pieces[i] for i in (before, piece) if i >= 0]
        known = self.merged("".join(both)) == both
        if len(self.pairs) >= _CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[(before + 1) * len(self.pieces) + piece] = known
        return known

    def by_merges(self, text: str) -> tuple[int, ...]:
        """The BPE ids of one unit, in one pass."""
        last = [-1] * (len(text) + 1)  # the last piece of each prefix; -1: an unknown character
        known, count = self.pairs.get, len(self.pieces)
        for at, (size, _, piece) in self.automaton.iter(text):
            if last[at + 1] < 0:
                before = last[at + 1 - size]
                fit = known((before + 1) * count + piece)
                if fit or fit is None and self.fits(before, piece):
                    last[at + 1] = piece
        ids: list[int] = []
        end = len(text)
        while end:
            piece = last[end]
            if piece < 0:
                end -= 1
                ids += self._bytes(text[end])
            else:
                ids.append(piece)
                end -= self.sizes[piece]
        ids.reverse()
        return tuple(ids)

    def _bytes(self, character: str) -> list[int]:
        """The byte pieces of an unknown character, last first."""
        return [int(self.bytes_of[b]) if self.bytes_of[b] >= 0 else self.unknown for b in reversed(character.encode())]

    def best(self, text: str) -> tuple[int, ...]:
        """The ids of the segmentation of one unit with the best total score, in one pass."""
        n = len(text)
        score, back = [0.0] * (n + 1), [(-1, 0)] * (n + 1)
        done, single = 0, -1
        for last, (size, value, piece) in self.automaton.iter(text):
            end = last + 1
            while done < end - 1:  # characters at which no single piece ended
                done += 1
                if single != done:
                    self._unknown(score, back, done)
            start = end - size
            got = score[start] + value
            if back[end][1] == 0 or got > score[end]:
                score[end], back[end] = got, (piece, size)
            if size == 1:
                single = end
                done = end
        while done < n:
            done += 1
            if single != done:
                self._unknown(score, back, done)
        ids: list[int] = []
        end = n
        while end:
            piece, size = back[end]
            if piece < 0:
                ids += self._bytes(text[end - 1])
            else:
                ids.append(piece)
            end -= size
        return tuple(reversed(ids))

    def _unknown(self, score, back, end: int) -> None:
        got = score[end - 1] + self.unknown_score
        if back[end][1] == 0 or got > score[end]:
            score[end], back[end] = got, (-1, 1)

    def encode(self, text: str) -> list[int]:
        """The ids of a text, blanks made visible and one put in front; an empty text has none."""
        if not text:
            return []
        out: list[int] = []
        segment = self.by_merges if self.bpe else self.best
        units = self.unit.findall(BLANK + text.replace(" ", BLANK))
        for at in range(0, len(units), _UNITS_AT_ONCE):
            some = units[at : at + _UNITS_AT_ONCE]
            if len(self.cache) >= _CACHED_UNITS:  # what is met again soon comes over from the cache before
                self.before, self.cache = self.cache, {}
            cache, before, long = self.cache, self.before, []
            for unit in set(some).difference(cache):
                cache[unit] = before.get(unit) or segment(unit)
                if len(unit) > _CACHED_CHARS:
                    long.append(unit)
            out += chain.from_iterable(map(cache.__getitem__, some))
            for unit in long:
                del cache[unit]
        return out

    def decode(self, ids) -> str:
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encoded(docs: DataFrame, model_name: str = "piece_bpe_32k.model", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_crc32 (little-endian 32-bit ids), decoded_sha256, round_trip (and ids with `keep_ids`).

    Whole texts, encoded and decoded again.  A null text is empty and has no
    pieces; a null doc_id stays null; repeated rows each get a row; other
    columns are ignored; an empty table gives an empty result.  No shuffle.
    """

    def run(batch: pa.RecordBatch):
        model = piece_model(tokenizer_path(model_name))
        rows = []
        for value in batch.column("text"):
            text = value.as_py() or ""
            ids = model.encode(text)
            decoded = model.decode(ids)
            rows.append((len(text.encode()), len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text, ids if keep_ids else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))[: 5 + keep_ids]
        names = ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip", "ids"][: 6 + keep_ids]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)

    schema = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(by_batch(run), schema)
