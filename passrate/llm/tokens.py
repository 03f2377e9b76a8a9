"""Token ids and counts of byte-level BPE, whole texts, by overlap resynchronisation.

A text of at most `chunk_chars` characters is encoded at once.  A longer one is
encoded in overlapping chunks.  Two neighbours are spliced at a byte offset
where both have a token boundary and the text goes from a non-blank to a blank:
the pre-tokeniser's pattern has no alternative that holds a blank after a
non-blank and looks only ahead, so such an offset is a boundary in every
encoding of the text, and what follows it does not depend on what precedes it.
The last offset of this kind in the left chunk's overlap still has the whole of
the boundary's right neighbourhood in both chunks.  When the overlap holds
none, it is widened until it does or the rest of the text is in one chunk.
"""

from __future__ import annotations

import base64
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passrate.llm.common import by_batch

BLANKS = " \t\n\r\x0b\x0c"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """The encoding that `tokenizers` gives for a byte-level BPE file.

    Ordinary text goes through the equal rank table with tiktoken, which is
    several times as fast; a text that holds a special token's string goes
    through the `tokenizers` library itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        import json

        self.json_path = json_path
        with open(json_path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self.lengths = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.lengths = np.zeros(max(ranks.values()) + 2, np.int64)
            for token, rank in ranks.items():
                self.lengths[rank] = len(token)

    @cached_property
    def exact(self):
        """The library's own tokenizer, loaded when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def once(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def with_ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the character offset at which each token ends."""
        if self.fast is None or any(s in text for s in self.special):
            got = self.exact.encode(text, add_special_tokens=False)
            return np.asarray(got.ids, np.int64), np.asarray([b for _, b in got.offsets], np.int64)
        ids = np.asarray(self.fast.encode_ordinary(text), np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        return ids, chars[np.cumsum(self.lengths[ids])]

    def encode(self, text: str, chunk_chars: int, overlap_chars: int) -> np.ndarray:
        n = len(text)
        if n <= chunk_chars:
            return np.asarray(self.once(text), np.uint32)
        out, start = [], 0
        while True:
            end, overlap = min(n, start + chunk_chars), overlap_chars
            left_ids, left_ends = self.with_ends(text[start:end])
            if end == n:
                out.append(left_ids)
                return np.concatenate(out).astype(np.uint32)
            while True:
                if overlap >= end - start:  # no proven boundary in the whole chunk: take a longer one
                    end = min(n, start + 2 * (end - start))
                    left_ids, left_ends = self.with_ends(text[start:end])
                    if end == n:
                        out.append(left_ids)
                        return np.concatenate(out).astype(np.uint32)
                low = end - overlap
                right_ends = self.with_ends(text[low:end])[1] + low
                cut = self._stable(text, left_ends + start, right_ends, end)
                if cut is not None:
                    break
                overlap *= 2
            out.append(left_ids[left_ends + start <= cut])
            start = cut

    @staticmethod
    def _stable(text: str, left: np.ndarray, right: np.ndarray, end: int) -> int | None:
        """The last offset before `end` that bounds tokens on both sides and goes from non-blank to blank."""
        for cut in np.intersect1d(left, right)[::-1].tolist():
            if 0 < cut < end and text[cut] in BLANKS and not text[cut - 1].isspace():
                return cut
        return None


@lru_cache(maxsize=4)
def byte_bpe(json_path: str, ranks_path: str | None) -> ByteBpe:
    return ByteBpe(json_path, ranks_path)


def token_counts(docs: DataFrame, json_name: str = "byte_bpe_50k.json", ranks_name: str | None = "byte_bpe_50k.tiktoken", limit: int = 1024, chunk_chars: int = 65536, overlap_chars: int = 256) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Whole texts, no truncation.  Null and empty texts have 0 bytes and tokens;
    a null doc_id stays null; repeated rows each get their row; other columns
    are ignored; an empty table gives an empty result.  No shuffle.
    """

    def count(batch: pa.RecordBatch):
        bpe = byte_bpe(tokenizer_path(json_name), tokenizer_path(ranks_name) if ranks_name else None)
        n_bytes, n_tokens = [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            n_bytes.append(len(text.encode()))
            n_tokens.append(len(bpe.once(text)) if len(text) <= chunk_chars else len(bpe.encode(text, chunk_chars, overlap_chars)))
        tokens = np.asarray(n_tokens, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(by_batch(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
