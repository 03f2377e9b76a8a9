"""Suffix-array dedup of long byte strings: front-coded sorted suffix runs, merged by loser trees.

A byte goes when a `length`-byte string that covers it starts anywhere else.
Each such string (a window) belongs to one anchor: the leftmost smallest, by
hash, of the `gram`-byte strings inside it.  Equal windows have equal anchors
at equal places, so windows need comparing only where their anchors' grams are
equal, and all windows of one anchor lie in its context, from the first one's
start to the last one's end.

1. Blocks send each anchor's gram and context digests to buckets.  A gram that
   occurs once settles its windows as unique.  A gram that repeats in one and
   the same context settles them as repeated.  The rest are contested.
2. Blocks sort the contested suffixes (an anchor's context from the anchor on)
   and send them front-coded, with the reversed text before the anchor.  A
   bucket merges the runs with a loser tree that carries common-prefix lengths
   and never compares a known prefix again; this gives the sparse suffix array
   and its LCP array.  Windows that start o bytes before their anchors are equal
   where the suffixes share length - o bytes and the texts before share o: two
   thresholds on LCP arrays, one of suffixes and one of reversed prefixes.
3. A gram with very many different contexts (a passage of many documents, at its
   edges) would fill one bucket.  Its windows are sent singly instead, as
   128-bit digests, each once a block.

A block sends a digest once however often it holds it, so no group of copies,
however large, meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from passrate.llm.blocks import Block, dealt, exchange, received
from passrate.llm.common import CHUNK_BYTES, U64, RollingHash, byte_codes, digests, mix64, sliding_min, spans_of_rows

_BITS = 21  # of a place in a segment; segments hold under 2**21 bytes
_PLACE = U64((1 << _BITS) - 1)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs of strings, each given with the common-prefix length to its predecessor.

    Returns (run, index) in order and each string's common-prefix length with
    the one before.  Every entrant of the tree carries its common-prefix length
    with the last output; a match is compared from there on only if they tie.
    """
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    now: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    shared = [0] * size

    def beats(a: int, b: int) -> bool:
        x, y = now[a], now[b]
        if x is None or y is None:
            return y is None
        h, k = shared[a], shared[b]
        if h != k:
            return h > k
        if x == y:
            shared[max(a, b)] = len(x)
            return a < b
        end = min(len(x), len(y))
        step = 16
        while h < end and x[h : h + step] == y[h : h + step]:
            h += step
            step *= 2
        while step > 1:
            step //= 2
            if x[h : h + step] == y[h : h + step]:
                h += step
        h = min(h, end)
        won = x[h:] < y[h:]
        shared[b if won else a] = h
        return won

    tree = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        won = beats(a, b)
        winners[node], tree[node] = (a, b) if won else (b, a)
    top = winners[1] if size > 1 else 0
    order, lcp = [], []
    while now[top] is not None:
        i = at[top]
        order.append((top, i))
        lcp.append(shared[top])
        strings, known = runs[top]
        at[top] = i = i + 1
        if i < len(strings):
            now[top], shared[top] = strings[i], known[i]
        else:
            now[top], shared[top] = None, 0
        node = (top + size) // 2
        while node:
            other = tree[node]
            if beats(other, top):
                tree[node], top = top, other
            node //= 2
    return order, lcp


def neighbour_lcp(strings: list[bytes], width: int) -> np.ndarray:
    """Common-prefix length of each string with the one before it (the first: 0)."""
    out = np.zeros(len(strings), np.int64)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    for at in range(1, len(strings), 8192):
        part = strings[at - 1 : at + 8192]
        grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in part), np.uint8).reshape(-1, width)
        differ = grid[1:] != grid[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        ends = lengths[at - 1 : at + 8192]
        out[at : at + 8192] = np.minimum(first, np.minimum(ends[1:], ends[:-1]))
    return out


class Anchors:
    """The anchors of a block: place, first and last window, gram and context digests."""

    def __init__(self, block: Block, length: int, gram: int):
        parts = [self._segment(block, *s, length, gram) for s in _segments(block.offsets, length)]
        self.a, self.low, self.high, self.gram, self.context = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(zip(*parts, strict=True) if parts else [()] * 5, (np.int64, np.int64, np.int64, U64, U64), strict=True))

    @staticmethod
    def _segment(block: Block, lo: int, hi: int, rows: tuple[int, int], length: int, gram: int):
        data = block.data[lo:hi]
        rolling = RollingHash(byte_codes(7)[data], 5)
        grams = mix64(rolling.all(gram))
        least = sliding_min(grams & ~_PLACE | np.arange(len(grams), dtype=U64), length - gram + 1)
        n = len(least)
        valid = np.ones(n + 1, bool)
        valid[n] = False
        ends = block.offsets[rows[0] + 1 : rows[1] + 1] - lo
        begins = np.maximum(block.offsets[rows[0] : rows[1]] - lo, 0)
        cut = np.zeros(len(data) + 1, np.int32)  # a row's last length - 1 starts hold no window
        np.add.at(cut, np.clip(np.maximum(ends - length + 1, begins), 0, len(data)), 1)
        np.add.at(cut, np.clip(ends, 0, len(data)), -1)
        valid[:n] &= np.cumsum(cut)[:n] == 0
        place = (least & _PLACE).astype(np.int64)
        new = valid[:n].copy()
        new[1:] &= (place[1:] != place[:-1]) | ~valid[: n - 1]
        low = np.flatnonzero(new)
        last = valid[:n].copy()
        last[:-1] &= new[1:] | ~valid[1:n]
        high = np.flatnonzero(last)
        a = place[low]
        raw = data.tobytes()
        shape = mix64(((a - low) * 1024 + (high - low)).astype(U64))
        context = mix64(digests(raw, low, high + length)[:, 0] ^ shape)
        return a + lo, low + lo, high + lo, digests(raw, a, a + gram)[:, 0], context


def _segments(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """Byte ranges that hold every window once: groups of short rows, and pieces of long ones."""
    for a, b in spans_of_rows(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo < length:
            continue
        if b - a > 1 or hi - lo <= CHUNK_BYTES + length:
            yield lo, hi, (a, b)
            continue
        for start in range(lo, hi - length + 1, CHUNK_BYTES):
            yield start, min(hi, start + CHUNK_BYTES + length - 1), (a, b)


def _pairs(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)


class SuffixDedup:
    """The two rounds, for `blocks.exchange`.  Kinds of message are named by what they hold."""

    ONCE, OFTEN, MANY, SETTLED, CONTESTED, HOT, RUN, WINDOW_ONCE, WINDOW_OFTEN, MASKS, WINDOWS = range(1, 12)

    def __init__(self, length: int = 200, gram: int = 56, hot: int = 4096):
        if not 1 <= gram < length <= 255:
            raise ValueError("1 <= gram < length <= 255 is needed")
        self.length, self.gram, self.hot, self.reach = length, gram, hot, length - gram + 1

    # -- round one: which grams repeat, and in how many contexts

    def sketch(self, block: Block, n: int):
        anchors = Anchors(block, self.length, self.gram)
        order = np.lexsort((anchors.context, anchors.gram))
        gram, context = anchors.gram[order], anchors.context[order]
        new = np.ones(len(order), bool)
        new[1:] = gram[1:] != gram[:-1]
        other = new.copy()
        other[1:] |= context[1:] != context[:-1]
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(order)))
        different = np.add.reduceat(other.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        gram, context = gram[first], context[first]
        for kind, pick in ((self.ONCE, counts == 1), (self.OFTEN, (counts > 1) & (different == 1)), (self.MANY, different > 1)):
            g, c = gram[pick], context[pick] if kind != self.MANY else different[pick].astype(U64)
            order, buckets, starts = dealt(g, n)
            for i, bucket in enumerate(buckets.tolist()):
                part = order[starts[i] : starts[i + 1]]
                yield bucket, block.number, kind, _pairs(g[part], c[part])

    def sketch_merge(self, table: pa.Table):
        bucket = table.column("bucket")[0].as_py()
        blocks, kinds, grams, contexts = [], [], [], []
        for kind in (self.ONCE, self.OFTEN, self.MANY):
            for b, blob in received(table, kind):
                g, c = np.frombuffer(blob, U64).reshape(2, -1)
                blocks.append(np.full(len(g), b))
                kinds.append(np.full(len(g), kind))
                grams.append(g)
                contexts.append(c)
        block, kind, gram, context = map(np.concatenate, (blocks, kinds, grams, contexts))
        order = np.lexsort((kind == self.MANY, gram))
        block, kind, gram, context = block[order], kind[order], gram[order], context[order]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        total = np.add.reduceat(np.where(kind == self.ONCE, 1, 2), first)
        many = kind == self.MANY
        unlike = np.logical_or.reduceat(many | (context != context[first][group]), first)
        contexts_in = np.add.reduceat(np.where(many, context.astype(np.int64), 1), first)
        answer = np.where(total < 2, 0, np.where(~unlike, self.SETTLED, np.where(contexts_in <= self.hot, self.CONTESTED, self.HOT)))[group]
        for b in np.unique(block[answer > 0]).tolist():
            here = block == b
            for kind_out in (self.SETTLED, self.CONTESTED, self.HOT):
                if (pick := here & (answer == kind_out)).any():
                    yield bucket, b, kind_out, gram[pick].tobytes()

    @staticmethod
    def _answered(answers: pa.Table, kind: int) -> np.ndarray:
        got = [np.frombuffer(d, U64) for _, d in received(answers, kind)]
        return np.sort(np.concatenate(got)) if got else np.zeros(0, U64)

    # -- round two: suffix runs of the contested, single windows of the hot

    def detail(self, block: Block, answers: pa.Table, n: int):
        contested, hot = self._answered(answers, self.CONTESTED), self._answered(answers, self.HOT)
        if not len(contested) and not len(hot):
            return
        anchors = Anchors(block, self.length, self.gram)
        yield from self._runs(block, anchors, np.flatnonzero(_isin(anchors.gram, contested)), n)
        yield from self._singles(block, anchors, np.flatnonzero(_isin(anchors.gram, hot)), n)

    def _runs(self, block: Block, anchors: Anchors, chosen: np.ndarray, n: int):
        _, first, count = np.unique(np.stack([anchors.gram[chosen], anchors.context[chosen]], axis=1), axis=0, return_index=True, return_counts=True) if len(chosen) else (None, chosen, chosen)
        chosen = chosen[first]
        order, buckets, starts = dealt(anchors.gram[chosen], n)
        raw = block.data.tobytes()
        for i, bucket in enumerate(buckets.tolist()):
            part = order[starts[i] : starts[i + 1]]
            picked = chosen[part]
            a, low, high = anchors.a[picked].tolist(), anchors.low[picked].tolist(), anchors.high[picked].tolist()
            suffixes = [raw[x : y + self.length] for x, y in zip(a, high, strict=True)]
            rank = sorted(range(len(picked)), key=lambda k: (suffixes[k], raw[low[k] : a[k]]))
            suffixes = [suffixes[k] for k in rank]
            lcp = neighbour_lcp(suffixes, self.length)
            tails = b"".join(s[h:] for s, h in zip(suffixes, lcp.tolist(), strict=True))
            before = b"".join(raw[low[k] : a[k]][::-1] for k in rank)
            picked, times = picked[rank], np.minimum(count[part][rank], 2)
            small = np.stack([times, anchors.a[picked] - anchors.high[picked] + self.length - 1, anchors.a[picked] - anchors.low[picked], lcp]).astype(np.uint16)
            head = np.array([len(picked), len(tails)], np.int64)
            yield bucket, block.number, self.RUN, zstandard.ZstdCompressor(level=1).compress(_pairs(head, anchors.context[picked], small) + tails + before)

    def _read_run(self, blob: bytes):
        blob = zstandard.ZstdDecompressor().decompress(blob)
        m, tails = np.frombuffer(blob[:16], np.int64).tolist()
        context = np.frombuffer(blob[16 : 16 + 8 * m], U64)
        small = np.frombuffer(blob[16 + 8 * m : 16 + 16 * m], np.uint16).reshape(4, m).astype(np.int64)
        times, least, most, lcp = small[0], small[1] - self.length + 1, small[2], small[3]
        sizes = self.length - least  # from the anchor to the last window's end
        suffixes, previous, at = [], b"", 16 + 16 * m
        for size, h in zip(sizes.tolist(), lcp.tolist(), strict=True):
            previous = previous[:h] + blob[at : at + size - h]
            suffixes.append(previous)
            at += size - h
        prefixes = []
        for size in most.tolist():
            prefixes.append(blob[at : at + size])
            at += size
        return context, times, least, most, suffixes, lcp.tolist(), prefixes

    def _singles(self, block: Block, anchors: Anchors, chosen: np.ndarray, n: int):
        if not len(chosen):
            return
        one, two = self._digests(block, anchors, chosen)[1:]
        pairs, count = np.unique(np.stack([one, two], axis=1), axis=0, return_counts=True)
        for kind, pick in ((self.WINDOW_ONCE, count == 1), (self.WINDOW_OFTEN, count > 1)):
            part = pairs[pick]
            order, buckets, starts = dealt(part[:, 0], n)
            for i, bucket in enumerate(buckets.tolist()):
                yield bucket, block.number, kind, part[np.sort(order[starts[i] : starts[i + 1]])].tobytes()

    def _digests(self, block: Block, anchors: Anchors, chosen: np.ndarray):
        """Start and 128-bit digest of every window of the chosen anchors."""
        starts, one, two = [], [], []
        low, high = anchors.low[chosen], anchors.high[chosen]
        at = 0
        while at < len(chosen):
            to = max(at + 1, int(np.searchsorted(high, low[at] + CHUNK_BYTES)))
            base = int(low[at])
            p = np.concatenate([np.arange(x, y + 1) for x, y in zip(low[at:to].tolist(), high[at:to].tolist(), strict=True)]) - base
            piece = block.data[base : int(high[to - 1]) + self.length]
            both = digests(piece.tobytes(), p, p + self.length)
            one.append(both[:, 0])
            two.append(both[:, 1])
            starts.append(p + base)
            at = to
        return np.concatenate(starts), np.concatenate(one), np.concatenate(two)

    def detail_merge(self, table: pa.Table):
        bucket = table.column("bucket")[0].as_py()
        yield from ((bucket, b, self.MASKS, d) for b, d in self._settle_runs(received(table, self.RUN)))
        yield from ((bucket, b, self.WINDOWS, d) for b, d in self._settle_singles(table))

    def _settle_runs(self, got: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        if not got:
            return
        runs = [self._read_run(blob) for _, blob in got]
        order, lcp = merge_runs([(r[4], r[5]) for r in runs])
        sizes = np.array([len(r[4]) for r in runs])
        base = np.cumsum(sizes) - sizes
        index = np.array([base[r] + i for r, i in order])
        context, times, least, most = (np.concatenate([r[k] for r in runs])[index] for k in range(4))
        prefixes = [p for r in runs for p in r[6]]
        repeated = self.equal_windows(np.array(lcp), [prefixes[i] for i in index.tolist()], times, least, most)
        owner = np.repeat(np.arange(len(runs)), sizes)[index]
        for r, (block, _) in enumerate(got):
            mine = np.flatnonzero((owner == r) & repeated.any(axis=1))
            if len(mine):
                yield block, _pairs(np.array([len(mine)], np.int64), context[mine], np.packbits(repeated[mine], axis=1))

    def equal_windows(self, lcp: np.ndarray, prefixes: list[bytes], times: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For suffixes in order and each offset o: does the window that starts o bytes before the anchor occur again?"""
        m = len(lcp)
        group = np.cumsum(lcp < self.gram)
        keyed = [int(g).to_bytes(8, "big") + p for g, p in zip(group, prefixes, strict=True)]
        left = np.array(sorted(range(m), key=keyed.__getitem__))
        left_lcp = neighbour_lcp([keyed[i] for i in left.tolist()], self.reach + 8) - 8  # below 0: another gram
        left_lcp[:1] = -1
        out = np.zeros((m, self.reach), bool)
        before = np.empty(m, np.int64)
        for o in range(self.reach):
            here = np.flatnonzero((least <= o) & (o <= most))
            if not len(here):
                continue
            after = np.cumsum(lcp < self.length - o)
            before[left] = np.cumsum(left_lcp < o)
            _, same = np.unique(after[here] * (m + 1) + before[here], return_inverse=True)
            out[here, o] = np.bincount(same, weights=times[here])[same] > 1
        return out

    def _settle_singles(self, table: pa.Table) -> Iterator[tuple[int, bytes]]:
        got = [(b, kind, np.frombuffer(d, U64).reshape(-1, 2)) for kind in (self.WINDOW_ONCE, self.WINDOW_OFTEN) for b, d in received(table, kind)]
        if not got:
            return
        pairs, same = np.unique(np.concatenate([p for _, _, p in got]), axis=0, return_inverse=True)
        weight = np.repeat([1 if kind == self.WINDOW_ONCE else 2 for _, kind, _ in got], [len(p) for _, _, p in got])
        often = np.bincount(same.ravel(), weights=weight)[same.ravel()] > 1
        owner = np.repeat([b for b, _, _ in got], [len(p) for _, _, p in got])
        every = np.concatenate([p for _, _, p in got])
        for b in np.unique(owner).tolist():
            if (pick := often & (owner == b)).any():
                yield b, every[pick].tobytes()

    # -- the answers, applied to the block's own text

    def removed(self, block: Block, answers: pa.Table) -> np.ndarray:
        """Which bytes of the block go."""
        size = len(block.data)
        starts = np.zeros(size + 1, np.int32)
        settled, contested, hot = (self._answered(answers, k) for k in (self.SETTLED, self.CONTESTED, self.HOT))
        if not len(settled) and not len(contested) and not len(hot):
            return np.zeros(size, bool)
        anchors = Anchors(block, self.length, self.gram)
        pick = _isin(anchors.gram, settled)
        np.add.at(starts, anchors.low[pick], 1)
        np.add.at(starts, anchors.high[pick] + 1, -1)
        window = np.cumsum(starts)[:-1] > 0
        masks = {}
        for _, blob in received(answers, self.MASKS):
            m = int(np.frombuffer(blob[:8], np.int64)[0])
            rows = np.frombuffer(blob[8 + 8 * m :], np.uint8).reshape(m, -1)
            masks.update(zip(np.frombuffer(blob[8 : 8 + 8 * m], U64).tolist(), rows, strict=True))
        if masks:
            chosen = np.flatnonzero(_isin(anchors.gram, contested))
            rows = [(i, mask) for i, c in zip(chosen.tolist(), anchors.context[chosen].tolist(), strict=True) if (mask := masks.get(c)) is not None]
            if rows:
                which, offset = np.nonzero(np.unpackbits(np.stack([r for _, r in rows]), axis=1, count=self.reach))
                window[anchors.a[np.array([i for i, _ in rows])][which] - offset] = True
        chosen = np.flatnonzero(_isin(anchors.gram, hot))
        found = [np.frombuffer(d, U64).reshape(-1, 2) for _, d in received(answers, self.WINDOWS)]
        if len(chosen) and found:
            p, one, two = self._digests(block, anchors, chosen)
            known = np.concatenate(found)
            known = known[np.argsort(known[:, 0])]
            at = np.minimum(np.searchsorted(known[:, 0], one), len(known) - 1)
            window[p[(known[at, 0] == one) & (known[at, 1] == two)]] = True
        cover = np.zeros(size + 1, np.int32)
        p = np.flatnonzero(window)
        cover[p] += 1
        cover[p + self.length] -= 1
        return np.cumsum(cover)[:-1] > 0


def _isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _kept(block: Block, gone: np.ndarray) -> Iterable[tuple[bytes, int, int, int]]:
    """Per row: the bytes that stay, and the counts of bytes, removed bytes and removed runs."""
    for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
        part, out = block.data[a:b], gone[a:b]
        n = int(out.sum())
        if not n:
            yield part.tobytes(), b - a, 0, 0
        else:
            yield part[~out].tobytes(), b - a, n, int(out[0]) + int((out[1:] & ~out[:-1]).sum())


def repeated_bytes(docs: DataFrame, length: int = 200, **params) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what is left of each text when every byte covered by a
    `length`-byte string that starts anywhere else too, in the same text or another, is removed.

    Strings are judged on the input and never cross texts.  A null text is
    empty; texts below `length` bytes lose nothing; repeated rows remove each
    other; a null doc_id stays null; other columns are ignored; an empty table
    gives an empty result.
    """
    dedup = SuffixDedup(length, **params)

    def finish(block: Block, answers: pa.Table, n: int) -> pa.Table:
        rows = list(_kept(block, dedup.removed(block, answers)))
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
        return pa.table([block.table.column("doc_id"), *columns, pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return exchange(docs, dedup.sketch, dedup.sketch_merge, dedup.detail, dedup.detail_merge, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeated_bytes(docs: DataFrame, length: int = 200, **params) -> DataFrame:
    """`docs` in all its columns with those bytes removed from `text`; of a character cut in two no byte stays.

    A null text stays null; repeated rows remove each other; an empty table
    gives an empty result; doc_id keeps its type and other columns their names.
    """
    dedup = SuffixDedup(length, **params)
    names = [f.name for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    fields = [StructField("doc_id", LongType()), StructField("text", StringType()), *(docs.schema[n] for n in names)]

    def finish(block: Block, answers: pa.Table, n: int) -> pa.Table:
        texts = [r[0].decode("utf-8", "ignore") for r in _kept(block, dedup.removed(block, answers))]
        null = block.table.column("text").is_null().to_pylist()
        texts = [None if gone else t for t, gone in zip(texts, null, strict=True)]
        carried = block.table.column("carried").combine_chunks() if names else None
        return pa.table([block.table.column("doc_id"), pa.array(texts, pa.string()), *(carried.field(i) for i in range(len(names)))], ["doc_id", "text", *names])

    return exchange(docs, dedup.sketch, dedup.sketch_merge, dedup.detail, dedup.detail_merge, finish, StructType(fields), carry=names).select(*(F.col(c).cast(docs.schema[c].dataType) if c == "doc_id" else c for c in docs.columns))
