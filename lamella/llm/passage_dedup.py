"""Removal of repeated byte strings by prefix-free parsing.

A byte of a text goes if a string of ``length`` bytes that covers it also starts anywhere else in the
corpus, the same text included. Matches never cross texts.

A rolling hash over ``TRIGGER`` bytes cuts each text into phrases; a phrase reaches back over the trigger
before it, so that equal stretches are cut alike wherever they stand (the prefix-free parse). All strings
that start in one phrase lie in the phrase's reach: the phrase and the bytes after it that its last string
needs. Suffixes are then brought into classes level by level, as their order in the suffix array of the
corpus would have them, phrases (the dictionary) first and what follows (the parse) next:

1. Phrases whose whole reach occurs twice: every string that starts in them repeats. This settles all
   but the edges of repeated stretches, at one hash a phrase.
2. Elsewhere a string can repeat only if all neighbouring pairs of phrases inside it do. Strings with at
   most one whole phrase inside are always looked at.
3. What is left is compared string by string, together with one representative of each class of step 1
   that has a pair of phrases in common with what is left.

Only whether another suffix shares ``length`` bytes matters, so that classes of equal prefixes take the
place of sorted ranks; they are the suffix array's intervals with a common prefix of that length.
Equality is by 64-bit polynomial hashes. Hashes travel packed, a block of texts at a time, to buckets by
value, and come back as flags; equal hashes of one block are merged before they travel, so that a phrase
that fills the corpus costs its bucket 8 bytes a block, and no text meets another in a task. In a task, a
block is worked in pieces of whole texts, so that what a byte costs in hashes and places is held for a piece.

Beside the removal, a text's shared stretches are given: maximal runs of phrases of which all neighbouring
pairs occur elsewhere, where they hold ``PASSAGE`` bytes or more. They show passages that are repeated but
shorter than ``length``, of which nothing is removed; they are exact to a phrase (about ``PHRASE`` bytes).

Passages of over ``WORDS`` words that another text has, too, are given exactly: ``n_passage`` counts the bytes in runs of
``WORDS`` + 1 words (with the white space between them, byte for byte) that occur in another text. They go through the same
three steps: a run inside a reach that two texts have is sure, others are compared where all their pairs of phrases repeat.

Defined results: null text counts as empty; texts shorter than ``length`` lose nothing; repeated rows
repeat each other; null ids stay; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, small_batches

LENGTH = 400
TRIGGER = 16
PHRASE = 48  # the mean distance of triggers
PASSAGE = 256
WORDS = 50
BLOCK_BYTES = 3 << 20
PIECE_BYTES = 3 << 17  # of a block are hashed at a time
BUCKET_HASHES = 1_500_000
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) | np.uint64(1)
_RUN = np.uint64(0xD6E8FEB86659FD93)  # sets the hashes of runs of words apart from those of strings
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
REPEATED, FIRST, WANTED, ACROSS = 1, 2, 4, 8
# what a sender says of a hash: nobody in the block asks for it; the block has it twice; two texts of the block have it
UNASKED, TWICE, TEXTS = 1, 2, 4


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size != n:
        return tuple(x[:n] for x in _powers(size))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Parse:
    """A block of texts: its phrases, their reaches, and string hashes."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int = LENGTH):
        self.data, self.ends, self.length = data, ends, length
        n = len(data)
        self.n = n
        self.up, self.down = _powers(n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * self.up[:n], dtype=np.uint64)])
        trigger = np.zeros(n, bool)
        if n >= TRIGGER:
            h = _mix((self.sums[TRIGGER:] - self.sums[: n - TRIGGER + 1]) * self.down[: n - TRIGGER + 1])
            trigger[TRIGGER - 1 :] = (h >> np.uint64(20)) % np.uint64(PHRASE) == 0
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        for k in range(TRIGGER - 1):  # a trigger lies within its text
            at = starts + k
            trigger[at[at < ends]] = False
        natural = trigger.copy()
        trigger[ends[ends > starts] - 1] = True
        self.last = np.flatnonzero(trigger)  # of each phrase
        self.natural = natural[self.last]  # cut by a trigger, not by the text's end
        m = len(self.last)
        self.first = np.concatenate([[0], self.last[:-1] + 1])[:m]
        text = np.searchsorted(ends, self.last, "right")
        self.text_start, self.text_end = starts[text], ends[text]
        self.begin = np.maximum(self.text_start, self.first - TRIGGER)
        # a string belongs to the phrase that holds its byte TRIGGER - 1
        self.low = np.maximum(self.first - TRIGGER + 1, self.text_start)
        self.low[self.first == self.text_start] = self.text_start[self.first == self.text_start]
        self.high = np.minimum(self.last - TRIGGER + 1, self.text_end - length)  # last start; below low: none
        reach = self.reach_end = np.minimum(self.last + 1 + length - TRIGGER, self.text_end)
        self.reach_hash = _mix(self.hash(self.begin, reach) + (reach - self.begin).astype(np.uint64) + (self.text_end == reach).astype(np.uint64) * np.uint64(77 << 40) + (self.first == self.text_start).astype(np.uint64) * np.uint64(5 << 44))
        nxt = np.minimum(np.arange(m) + 1, m - 1)
        self.pair_ok = (np.arange(m) + 1 < m) & (self.text_end[nxt] == self.text_end) if m else np.zeros(0, bool)
        stop = self.last[nxt] + 1 if m else np.zeros(0, np.int64)
        self.pair_hash = _mix(self.hash(self.begin, stop) + (stop - self.begin).astype(np.uint64) + np.uint64(3 << 50)) if m else np.zeros(0, np.uint64)

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the bytes from a up to b."""
        return _mix((self.sums[b] - self.sums[a]) * self.down[a])

    def level_one(self) -> np.ndarray:
        return np.concatenate([self.reach_hash, self.pair_hash])

    def settle(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per phrase: its strings all repeat; it represents a class; another text has its reach; per pair: repeated."""
        m = len(self.last)
        some = self.high >= self.low
        reach, pair = flags[:m], flags[m:]
        return (reach & REPEATED > 0) & some, (reach & REPEATED > 0) & (reach & FIRST > 0), reach & ACROSS > 0, pair & REPEATED > 0

    def texts(self, starts: np.ndarray) -> np.ndarray:
        """The text of each start."""
        return np.searchsorted(self.ends, starts, "right")

    def strings(self, phrases: np.ndarray, pair_repeats: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the strings of these phrases that may repeat, and the phrase of each.

        With wanted, strings that hold a pair of whole phrases are kept only where the first pair is wanted.
        """
        n = np.maximum(0, self.high[phrases] - self.low[phrases] + 1)
        own = np.repeat(phrases, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.low[phrases], n)
        ok = self.may(own, at + self.length - 1, np.searchsorted(self.last, at + self.length - 1, "left"), pair_repeats, wanted)
        return at[ok], own[ok]

    def may(self, own: np.ndarray, end: np.ndarray, holds: np.ndarray, pair_repeats: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """Whether strings may repeat, of their phrases, their last bytes and these bytes' phrases."""
        # a phrase that a trigger ends with the string is whole, too
        whole_end = np.where((self.last[holds] == end) & self.natural[holds], holds + 1, holds)
        inside = whole_end - own - 1
        bad = np.concatenate([[0], np.cumsum(~pair_repeats)])
        few = inside <= 1
        ok = few | (bad[np.maximum(whole_end - 1, 0)] - bad[np.minimum(own + 1, len(self.last))] == 0)
        if wanted is not None:
            ok &= few | wanted[np.minimum(own + 1, len(self.last) - 1)]
        return ok

    @cached_property
    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of WORDS + 1 words, the phrase of each and that of its last byte."""
        none = np.zeros(0, np.int64)
        if self.n == 0:
            return none, none, none, none
        space = _SPACE[self.data]
        before, after = np.append(True, space[:-1]), np.append(space[1:], True)
        edges = self.ends[self.ends > 0]
        before[edges[edges < self.n]] = True
        after[edges - 1] = True
        start, stop = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        start, stop = start[: max(0, len(start) - WORDS)], stop[WORDS:]
        phrase = np.repeat(np.arange(len(self.last)), np.diff(self.last, prepend=-1))
        own, holds = phrase[np.minimum(start + TRIGGER - 1, stop - 1)], phrase[stop - 1]
        ok = self.text_end[own] >= stop  # in one text
        ok &= start >= self.text_start[own]
        return start[ok], stop[ok], own[ok], holds[ok]

    def ask_runs(self, across: np.ndarray, pair_repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per run of words: a reach that another text has holds it and the bytes beside it; else: it may repeat."""
        start, stop, own, holds = self.runs
        sure = across[own] & (start > self.begin[own]) & ((stop < self.reach_end[own]) | (stop == self.text_end[own]))
        return sure, ~sure & self.may(own, stop - 1, holds, pair_repeats)

    def run_hash(self, which: np.ndarray) -> np.ndarray:
        start, stop, _, _ = self.runs
        return self.hash(start[which], stop[which]) ^ _RUN

    def in_runs(self, which: np.ndarray) -> np.ndarray:
        """Per text: bytes in these runs of words."""
        start, stop, own, _ = (x[which] for x in self.runs)
        fresh = np.maximum(start, np.append(0, stop[:-1])) if len(start) else start  # starts and stops ascend
        return np.bincount(self.texts(self.last[own]), stop - fresh, len(self.ends)).astype(np.int64)

    def shared(self, pairs: np.ndarray) -> np.ndarray:
        """Per text: bytes in shared stretches."""
        m, out = len(self.last), np.zeros(len(self.ends), np.int64)
        ok = pairs & self.pair_ok
        head = np.flatnonzero(ok & ~np.append(False, ok[:-1])) if m else np.zeros(0, np.int64)
        tail = np.flatnonzero(ok & ~np.append(ok[1:], False)) if m else head
        size = self.last[np.minimum(tail + 1, m - 1)] + 1 - self.begin[head]
        np.add.at(out, np.searchsorted(self.ends, self.last[head], "right"), np.where(size >= PASSAGE, size, 0))
        return out

    def pieces(self, starts: np.ndarray):
        """Per text: bytes, kept bytes, removed bytes, maximal removed runs, from the starts of repeated strings."""
        change = np.zeros(self.n + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.length, -1)
        gone = np.cumsum(change[:-1]) > 0
        a = 0
        for b in self.ends.tolist():
            g = gone[a:b]
            yield b - a, self.data[a:b][~g].tobytes(), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            a = b


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def pieces(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, size: int = PIECE_BYTES) -> Iterator[Parse]:
    """A block's texts, whole ones of at most so many bytes, or a single one, at a time."""
    a = start = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, start + size, "right")))
        stop = int(ends[b - 1])
        yield Parse(data[start:stop], ends[a:b] - start, length)
        a, start = b, stop


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, text) rows to blocks of texts: block, ids, ends, data, n_hashes."""

    def run(batches):
        ids, texts, size = [], [], 0

        def out():
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends.tobytes()], pa.binary()), pa.array([_pack(data)], pa.binary()), pa.array([sum(2 * len(p.last) for p in pieces(data, ends))], pa.int64())], ["block", "ids", "ends", "data", "n_hashes"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append((t or "").encode())
                size += len(texts[-1])
                if size >= BLOCK_BYTES or len(texts) >= 20_000:
                    yield out()
                    ids, texts, size = [], [], 0
        if texts:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block string, ids array<long>, ends binary, data binary, n_hashes long")


def exchange(sent: DataFrame) -> DataFrame:
    """(bucket, block, hashes, kinds) to one row a block: block, flags: a list of (bucket, flags).

    REPEATED: the hash was sent twice at least; FIRST: this is its first sender; WANTED: some sender asks for it;
    ACROSS: two texts have it.
    """

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        parts = [_unpack(x, "<u8") for x in pdf["hashes"]]
        h = np.concatenate(parts)
        kind = np.concatenate([np.full(len(p), x[0], np.uint8) if len(x) == 1 else _unpack(x, np.uint8) for x, p in zip(pdf["kinds"], parts, strict=True)])
        order = np.argsort(h, kind="stable")
        s, k = h[order], kind[order]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        size = np.diff(np.append(starts, len(s)))
        said = np.bitwise_or.reduceat(k, starts)
        repeated, across = (size > 1) | (said & TWICE > 0), (size > 1) | (said & TEXTS > 0)
        wanted = np.bitwise_and.reduceat(k, starts) & UNASKED == 0
        flags = np.empty(len(h), np.uint8)
        flags[order] = np.repeat((repeated * REPEATED + wanted * WANTED + across * ACROSS).astype(np.uint8), size)
        flags[order[starts]] |= FIRST
        cuts = np.cumsum([len(p) for p in parts])
        pdf = pdf[["block", "bucket"]].copy()
        pdf["flags"] = [_pack(x) for x in np.split(flags, cuts[:-1])]
        return pdf

    return sent.groupBy("bucket").applyInPandas(meet, "block string, bucket long, flags binary").groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias("flags"))


def _distinct(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes by value, which a bucket has a range of: the order, the first of each run of equal ones, the distinct ones, their buckets' ends, and each one's number."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    lead = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
    starts = np.flatnonzero(lead)
    s = s[starts]
    return order, starts, s, np.searchsorted((s >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1)), np.cumsum(lead) - 1


def _send(block: str, h: np.ndarray, kinds: np.ndarray | None, buckets: int, texts: np.ndarray | None = None):
    order, starts, distinct, cuts, _ = _distinct(h, buckets)
    said = np.diff(np.append(starts, len(h))) > 1
    said = said * np.uint8(TWICE) | (np.full(len(starts), UNASKED, np.uint8) if kinds is None else np.bitwise_and.reduceat(kinds[order], starts) if len(starts) else np.zeros(0, np.uint8))
    if texts is not None and len(starts):
        own = texts[order]
        said |= (np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts)) * np.uint8(TEXTS)
    used = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
    hashes = [_pack(distinct[cuts[k] : cuts[k + 1]]) for k in used]
    parts = [said[cuts[k] : cuts[k + 1]] for k in used]
    sent = [p[:1].tobytes() if (p == p[0]).all() else _pack(p) for p in parts]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([block] * len(used), pa.string()), pa.array(hashes, pa.binary()), pa.array(sent, pa.binary())], ["bucket", "block", "hashes", "kinds"])


def _receive(h: np.ndarray, got: list[dict] | None, buckets: int) -> np.ndarray:
    order, starts, distinct, cuts, own = _distinct(h, buckets)
    flags = np.zeros(len(distinct), np.uint8)
    for x in got or ():
        flags[cuts[x["bucket"]] : cuts[x["bucket"] + 1]] = _unpack(x["flags"], np.uint8)
    out = np.empty(len(h), np.uint8)
    out[order] = flags[own] & np.uint8(255 - FIRST)
    out[order[starts]] = flags  # of equal hashes in a block, one is the first
    return out


_SENT = "bucket long, block string, hashes binary, kinds binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text) rows to doc_id, n_bytes, n_removed, n_spans, kept (binary), n_shared, n_passage."""
    small_batches(docs.sparkSession)
    table = materialise(blocks(docs), "texts")
    buckets = max(1, -(-(table.agg(F.sum("n_hashes")).first()[0] or 0) // BUCKET_HASHES))

    def parses(row: dict) -> Iterator[Parse]:
        return pieces(_unpack(row["data"], np.uint8), np.frombuffer(row["ends"], "<i8"), length, PIECE_BYTES)

    def rows(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield b.slice(i, 1).to_pylist()[0]

    def received(h: list[np.ndarray], got: list[dict] | None) -> list[np.ndarray]:
        """The flags of each piece's hashes."""
        return np.split(_receive(np.concatenate(h), got, buckets), np.cumsum([len(x) for x in h])[:-1])

    def numbered(of: list[np.ndarray], own: list[Parse]) -> np.ndarray:
        """The texts' numbers in the block, of those in each piece."""
        before = np.cumsum([0] + [len(p.ends) for p in own])
        return np.concatenate([x + n for x, n in zip(of, before[:-1], strict=True)])

    def one(batches):
        for r in rows(batches):
            h, of, n = [], [], 0
            for p in parses(r):
                h.append(p.level_one())
                of.append(np.tile(p.texts(p.last) + n, 2).astype(np.int32))
                n += len(p.ends)
            yield _send(r["block"], np.concatenate(h), None, buckets, np.concatenate(of))

    first = materialise(exchange(table.select("block", "ends", "data").mapInArrow(one, _SENT)), "flags").withColumnRenamed("flags", "one")

    def settled(r: dict) -> list[tuple]:
        """Each piece, what its flags of level one say, the pairs that it asks for or stands for, its runs of words."""
        own, out = list(parses(r)), []
        for p, flags in zip(own, received([p.level_one() for p in own], r["one"]), strict=True):
            all_repeat, stands, across, pairs = p.settle(flags)
            left = np.flatnonzero(~all_repeat & (p.high >= p.low))
            ask_at, ask_own = p.strings(left, pairs)
            sure, ask_run = p.ask_runs(across, pairs)
            asked = np.unique(np.concatenate([ask_own, p.runs[2][ask_run]]))
            asked = asked[asked + 1 < len(p.last)] + 1  # the first pair inside starts with the next phrase
            stand = np.flatnonzero(stands)
            stand = stand[stand + 1 < len(p.last)] + 1
            out.append((p, all_repeat, stands, pairs, ask_at, asked, stand, sure, ask_run))
        return out

    def two(batches):
        for r in rows(batches):
            h, kinds = [], []
            for p, _, _, _, _, asked, stand, _, _ in settled(r):
                h += [p.pair_hash[asked], p.pair_hash[stand]]
                kinds += [np.zeros(len(asked), np.uint8), np.full(len(stand), UNASKED, np.uint8)]
            yield _send(r["block"], np.concatenate(h), np.concatenate(kinds), buckets)

    known = table.join(first, "block", "left")
    second = materialise(exchange(known.select("block", "ends", "data", "one").mapInArrow(two, _SENT)), "flags").withColumnRenamed("flags", "two")

    def level_three(found: list[tuple], got: list[dict] | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each piece the hashes of the strings and runs of words that it asks for, then of those that its classes stand for; their texts."""
        out, of = [], []
        sent = [np.concatenate([p.pair_hash[asked], p.pair_hash[stand]]) for p, _, _, _, _, asked, stand, _, _ in found]
        for (p, _, stands, _, ask_at, asked, stand, sure, ask_run), flags in zip(found, received(sent, got), strict=True):
            every, wanted = np.ones(len(p.last), bool), np.zeros(len(p.last), bool)
            wanted[stand[flags[len(asked) :] & WANTED > 0]] = True
            at, _ = p.strings(np.flatnonzero(stands), every, wanted)
            start, stop, own, holds = p.runs
            ask_run, stand_run = np.flatnonzero(ask_run), np.flatnonzero(sure & stands[own])
            stand_run = stand_run[p.may(own[stand_run], stop[stand_run] - 1, holds[stand_run], every, wanted)]
            out.append(np.concatenate([p.hash(ask_at, ask_at + p.length), p.run_hash(ask_run), p.hash(at, at + p.length), p.run_hash(stand_run)]))
            of.append(p.texts(np.concatenate([ask_at, start[ask_run], at, start[stand_run]])).astype(np.int32))
        return out, of

    def three(batches):
        for r in rows(batches):
            found = settled(r)
            h, of = level_three(found, r["two"])
            yield _send(r["block"], np.concatenate(h), None, buckets, numbered(of, [x[0] for x in found]))

    known = known.join(second, "block", "left")
    third = materialise(exchange(known.select("block", "ends", "data", "one", "two").mapInArrow(three, _SENT)), "flags").withColumnRenamed("flags", "three")

    def last(batches):
        for r in rows(batches):
            found, done = settled(r), 0
            for (p, all_repeat, _, pairs, ask_at, _, _, passage, ask_run), own in zip(found, received(level_three(found, r["two"])[0], r["three"]), strict=True):
                sure = np.flatnonzero(all_repeat)
                n = p.high[sure] - p.low[sure] + 1
                whole = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(p.low[sure], n)
                out = list(p.pieces(np.concatenate([whole, ask_at[own[: len(ask_at)] & REPEATED > 0]])))
                passage[ask_run] = own[len(ask_at) : len(ask_at) + ask_run.sum()] & ACROSS > 0
                shared, passages, ids = p.shared(pairs), p.in_runs(passage), r["ids"][done : done + len(p.ends)]
                done += len(p.ends)
                for a in range(0, len(out), 500):
                    size, kept, removed, spans = zip(*out[a : a + 500], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 500], pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(shared[a : a + 500], pa.int64()), pa.array(passages[a : a + 500], pa.int64())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_shared", "n_passage"])

    known = known.join(third, "block", "left")
    return known.mapInArrow(last, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_shared long, n_passage long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeats(documents(spark, sf_dir))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), "n_shared", "n_passage")
