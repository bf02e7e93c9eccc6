"""Language model scores by Katz backoff over words.

Tokens are words (runs of bytes other than white space, A-Z lower-cased) and one end mark a text; the
first token follows a start mark. A k-gram is a token after the k - 1 before it; at the start of a text it has
what there is. A k-gram seen r times in training has probability d(r) r / c(context); an unseen one backs off to the
shorter context, scaled by the context's weight, which makes the context's probabilities sum to exactly one:
mass left over by the discounts, over the shorter context's mass of the unseen. A context that training lacks has
weight one. Single words are discounted alike; what they leave is the probability of the one unknown word. d is the
Good-Turing ratio up to ``TOP``, from counts of counts of each order over the whole training part; where those give none
between 0 and 1, and above TOP, an absolute discount takes its place (0.5, and 0.01 above TOP), so that every
context keeps some mass.

Texts travel as blocks of token numbers. Order by order, each block sends its distinct k-grams, with counts and what
their shorter probabilities need, to buckets by context; a bucket counts its contexts' followers, normalises them and
answers. The blocks with the answers of all orders so far are a stored table, bucketed by block, which the next order
reads: probabilities are evaluated by recursion over it. An order is exchanged in ``WAVES`` parts by context, whose
shuffle files go before the next part is sent, so that a part of the k-grams is on disk at a time.
A context with over ``HOT`` occurrences is split over buckets by follower and its sums are added up afterwards. At most
``HOT_CONTEXTS`` contexts an order are that hot, which bounds what is broadcast (64 bytes each).

Contexts are known by 64-bit hashes, followers of a context by 40 bits. Defined results: null text counts as empty (an end
mark only); without training texts every token has probability one under the model; null ids count as training; repeated
rows count and are scored one by one; other columns pass by.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import ASCII_LOWER, bucketed, documents, drop, id_mod, materialise, remove, session

TOP = 5
HIGH_DISCOUNT = 0.01
BLOCK_TOKENS = 700_000
BUCKET_KEYS = 1_000_000
HOT = 200_000
HOT_CONTEXTS = 1 << 20
ORDER = 3
WAVES = 4
END, START = 0, 1  # local numbers of the marks in every block
_MARKS = (b"\n<end>", b"\n<start>")  # no word holds a newline


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(0) unused, d(1) to d(TOP), then d's absolute part above: from the numbers of types seen 1 to TOP + 1 times."""
    n = [0, *counts_of_counts]
    out = np.array([0.0] + [1 - 0.5 / r for r in range(1, TOP + 1)])
    high = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        if n[r] and high < 1:
            d = ((r + 1) * n[r + 1] / n[r] / r - high) / (1 - high)
            if 0 < d < 1:
                out[r] = d
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts after discounting; 0 stays 0."""
    c = c.astype(np.float64)
    return np.where(c > TOP, c - HIGH_DISCOUNT, d[np.minimum(c, TOP).astype(np.int64)] * c)


def left_over(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Mass that discounts take, from numbers of types seen 1 to TOP times and more often (last axis)."""
    r = np.arange(1, TOP + 1)
    return n[..., :TOP] @ ((1 - d[1:]) * r) + HIGH_DISCOUNT * n[..., TOP]


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out) rows to blocks: block, ids, held, sizes, words, tokens, n_words."""

    def run(batches):
        ids, held, sizes, number, tokens = [], [], [], {}, []

        def out():
            words = np.fromiter((xxh64_intdigest(w, 1) for w in (*_MARKS, *number)), np.uint64, len(number) + 2)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
            row = [uuid.uuid4().hex], [ids], [np.array(held, np.uint8).tobytes()], [np.array(sizes, "<i8").tobytes()], [words.tobytes()], [_pack(flat)], [len(words)]
            kinds = (pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["block", "ids", "held", "sizes", "words", "tokens", "n_words"])

        total = 0
        for b in batches:
            for i, t, h in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ws = (t or "").encode().translate(ASCII_LOWER).split()
                for w in ws:
                    if w not in number:
                        number[w] = len(number) + 2
                ids.append(i)
                held.append(h)
                sizes.append(len(ws) + 1)
                tokens.append(np.fromiter((*map(number.__getitem__, ws), END), np.uint32, len(ws) + 1))
                total += len(ws) + 1
                if total >= BLOCK_TOKENS:
                    yield out()
                    ids, held, sizes, number, tokens, total = [], [], [], {}, [], 0
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(run, "block string, ids array<long>, held binary, sizes binary, words binary, tokens binary, n_words long")


class Block:
    """A block's tokens, their texts, and its distinct k-grams, order by order."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.words = np.frombuffer(row["words"], "<u8")
        self.tokens = _unpack(row["tokens"], "<u4").astype(np.int64)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = ~self.held[self.text]
        starts = np.cumsum(self.sizes) - self.sizes
        self.begins = np.zeros(len(self.tokens), bool)
        self.begins[starts] = True
        self.place = np.arange(len(self.tokens)) - np.repeat(starts, self.sizes)  # within the text
        self.own, self.hash = self.tokens, self.words  # each token's k-gram, by number, or -1; each k-gram's hash

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens, self.train, minlength=len(self.words)).astype(np.uint32)

    def before(self, k: int) -> np.ndarray:
        """The number of the (k - 1)-gram before each token, or -1 where the text has none that long."""
        out = np.empty_like(self.own)
        out[1:] = self.own[:-1]
        out[self.begins] = START if k == 2 else -1
        return out

    def grams(self, k: int, wave: int | None = None) -> dict:
        """The distinct k-grams, by context, of one wave or all; ``self.own`` and ``self.hash`` hold the order below."""
        context = self.before(k)
        some = context >= 0
        if wave is not None:
            some &= (_wave(self.hash) == wave)[context]
        at = np.flatnonzero(some)
        pairs, own = np.unique(context[at] << 32 | self.tokens[at], return_inverse=True)
        sample = np.zeros(len(pairs), np.int64)
        sample[own] = at
        first, then = pairs >> 32, pairs & 0xFFFFFFFF
        return {"first": first, "then": then, "at": at, "own": own, "shorter": self.own[sample], "seen": np.bincount(own, self.train[at], minlength=len(pairs)).astype(np.uint32), "context": self.hash[first], "follower": self.words[then]}

    def climb(self, g: dict) -> None:
        """Goes from order k - 1 to the k-grams of g, which holds all of them."""
        self.own = np.full(len(self.tokens), -1, np.int64)
        self.own[g["at"]] = g["own"]
        self.hash = _blend(g["context"] * np.uint64(0x9E3779B97F4A7C15) + g["follower"])


def _blend(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _wave(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(51)) % np.uint64(WAVES)


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _cut(part: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(buckets + 1))
    return order, [(k, int(cuts[k]), int(cuts[k + 1])) for k in range(buckets) if cuts[k] < cuts[k + 1]]


def _word_part(words: np.ndarray, buckets: int) -> np.ndarray:
    return (words >> np.uint64(20)) % np.uint64(buckets)


def _pair_part(h1: np.ndarray, h2: np.ndarray, c1: np.ndarray, hot: int, buckets: int) -> np.ndarray:
    salt = h2 % (np.uint64(1) + c1.astype(np.uint64) // np.uint64(hot))
    return ((h1 ^ (salt * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(17)) % np.uint64(buckets)


def _classes(c: np.ndarray) -> np.ndarray:
    """Numbers of entries that are 1 to TOP + 1."""
    return np.bincount(np.minimum(c, TOP + 2), minlength=TOP + 3)[1 : TOP + 2]


def word_table(table: DataFrame) -> tuple[DataFrame, dict]:
    """Corpus counts of each block's words, by block, and the training totals."""
    buckets = max(1, -(-(table.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_KEYS))

    def send(batches):
        for r in _rows(batches):
            b = Block(r)
            c = b.word_counts()
            order, cuts = _cut(_word_part(b.words, buckets), buckets)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in cuts], pa.int64()), pa.array([r["block"]] * len(cuts), pa.string()), pa.array([b.words[order[x:y]].tobytes() for _, x, y in cuts], pa.binary()), pa.array([_pack(c[order[x:y]]) for _, x, y in cuts], pa.binary())], ["bucket", "block", "words", "counts"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, "<u8") for x in pdf["words"]]
        c = np.concatenate([_unpack(x, "<u4") for x in pdf["counts"]]).astype(np.int64)
        keys, own = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(own, c, minlength=len(keys)).astype(np.int64)
        back = np.split(total[own], np.cumsum([len(p) for p in parts])[:-1])
        stats = [int(total.sum()), int((total > 0).sum()), int((total > TOP).sum()), *_classes(total).tolist()]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "back": [_pack(x.astype("<u4") if x.max(initial=0) < 1 << 32 else x.astype("<u8")) for x in back], "wide": [bool(x.max(initial=0) >= 1 << 32) for x in back], "stats": [stats] + [None] * (len(pdf) - 1)})

    back = materialise(table.select(*_TEXTS).mapInArrow(send, "bucket long, block string, words binary, counts binary").groupBy("bucket").applyInPandas(meet, "block string, bucket long, back binary, wide boolean, stats array<long>"), "word-counts")
    s = back.filter("stats IS NOT NULL").agg(*[F.sum(F.col("stats")[i]).alias(str(i)) for i in range(3 + TOP + 1)]).first()
    s = [x or 0 for x in s]
    d = discounts(s[3:])
    n = np.array([*s[3 : 3 + TOP], s[2]], np.float64)
    info = {"buckets": buckets, "tokens": s[0], "types": s[1], "d": d, "unknown": float(left_over(n, d) / s[0]) if s[0] else 1.0}
    return back, info


def _counts(b: Block, got: list[dict], buckets: int) -> np.ndarray:
    order, cuts = _cut(_word_part(b.words, buckets), buckets)
    at = {k: order[x:y] for k, x, y in cuts}
    c = np.zeros(len(b.words), np.int64)
    for x in got:
        c[at[x["bucket"]]] = _unpack(x["back"], "<u8" if x["wide"] else "<u4")
    return c


def _unigram(c: np.ndarray, info: dict) -> np.ndarray:
    return np.where(c > 0, discounted(c, info["d"]) / max(info["tokens"], 1), info["unknown"])


_TEXTS = ("block", "ids", "held", "sizes", "words", "tokens")
_BACK = ("block string, bucket long, wave int, back binary, asks binary, seen binary, mass binary, stats array<long>, "
         "hot array<struct<key: long, sums: array<double>>>")  # fmt: skip


class Climb:
    """A block brought up to an order: counts of its k-grams, counts of their contexts, what their probabilities need."""

    def __init__(self, row: dict, info: dict):
        self.block, self.info = Block(row), info
        self.counts = _unpack(row["counts"][0], "<i8")
        self.total = np.zeros(0, np.int64)  # of the context of each k-gram of the present order, from order 2 on
        self.rest = b""
        self.order = 1
        for k, (counts, rest) in enumerate(zip(row["counts"][1:], row["rest"], strict=True), 2):
            g = self.block.grams(k)
            self.total, self.counts = self.contexts(k)[g["first"]], _unpack(counts, "<i8")
            self.order, self.rest = k, rest
            self.block.climb(g)
            self.ends = g["then"] == END

    def probabilities(self) -> np.ndarray:
        """Of the k-grams of the present order."""
        if self.order == 1:
            return _unigram(self.counts, self.info)
        p = self.seen(self.order, self.counts, self.total)
        p[self.counts == 0] = _unpack(self.rest, "<f8")
        return p

    def contexts(self, k: int) -> np.ndarray:
        """How often training has each (k - 1)-gram before a token."""
        c = self.counts.copy()
        if k == 2:
            c[START], c[END] = self.info["trained"], 0
        else:
            c[self.ends] = 0
        return c

    def seen(self, k: int, c: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Probabilities of k-grams that training has; 0 for others."""
        return discounted(c, self.info["d"] if k == 1 else self.info["orders"][k]) / np.maximum(total, 1)

    def cuts(self, g: dict, k: int, hot: int, buckets: int) -> tuple[np.ndarray, list]:
        return _cut(_pair_part(g["context"], g["follower"], self.contexts(k)[g["first"]], hot, buckets), buckets)


def _heads(first: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else np.zeros(0, np.int64)


def _send(climb: Climb, k: int, wave: int, hot: int, buckets: int) -> pa.RecordBatch:
    g = climb.block.grams(k, wave)
    order, cuts = climb.cuts(g, k, hot, buckets)
    # what the shorter probability of a k-gram that training has is made of
    number = climb.counts[g["shorter"]]
    under = climb.total[g["shorter"]] if k > 2 else np.zeros(len(number), np.int64)
    contexts, out = climb.contexts(k), []
    for bucket, x, y in cuts:
        o = order[x:y]
        head = _heads(g["first"][o])
        ctx, follower = g["first"][o][head], g["follower"][o]
        run = np.diff(np.append(head, len(o)))
        out.append((bucket, climb.block.hash[ctx].tobytes(), _pack(run.astype("<u4")), follower.astype("<u4").tobytes(), (follower >> np.uint64(32)).astype("<u1").tobytes(), _pack(g["seen"][o].astype("<u4")), _pack(number[o].astype("<i8")), _pack(under[o].astype("<i8")), _pack(contexts[ctx].astype("<i8"))))
    kinds = (pa.int64(), *[pa.binary()] * 8)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(9)], ["bucket", "ctx", "run", "low", "high", "seen", "number", "under", "total"])


def _meet(pdf: pd.DataFrame, k: int, wave: int, hot: int, info: dict) -> pd.DataFrame:
    """A bucket's contexts: corpus counts of all that was sent, and sums over the followers of contexts with unseen ones."""
    ctx = [np.frombuffer(x, "<u8") for x in pdf["ctx"]]
    run = [_unpack(x, "<u4") for x in pdf["run"]]
    h1 = np.concatenate([np.repeat(a, n) for a, n in zip(ctx, run, strict=True)])
    h2 = np.concatenate([np.frombuffer(a, "<u4").astype(np.uint64) | np.frombuffer(b, "<u1").astype(np.uint64) << np.uint64(32) for a, b in zip(pdf["low"], pdf["high"], strict=True)])
    c = np.concatenate([_unpack(x, "<u4") for x in pdf["seen"]]).astype(np.int64)
    number = np.concatenate([_unpack(x, "<i8") for x in pdf["number"]])
    if k == 2:
        shorter = _unigram(number, info)
    else:
        shorter = discounted(number, info["orders"][k - 1]) / np.maximum(np.concatenate([_unpack(x, "<i8") for x in pdf["under"]]), 1)
    order = np.lexsort((h2, h1))
    new1 = np.append(True, h1[order][1:] != h1[order][:-1])
    starts = np.flatnonzero(new1 | np.append(True, h2[order][1:] != h2[order][:-1]))
    total = np.add.reduceat(c[order], starts)
    of_ctx = np.flatnonzero(new1[starts])
    types = np.stack([*(np.add.reduceat((total == r).astype(np.int64), of_ctx) for r in range(1, TOP + 1)), np.add.reduceat((total > TOP).astype(np.int64), of_ctx)], 1)
    mass = np.add.reduceat(np.where(total > 0, shorter[order[starts]], 0.0), of_ctx)
    each = np.empty(len(h1), np.int64)
    each[order] = np.repeat(total, np.diff(np.append(starts, len(h1))))
    keys = h1[order[starts[of_ctx]]]
    cuts = np.cumsum([int(n.sum()) for n in run])[:-1]
    out: dict[str, list] = {"block": list(pdf["block"]), "bucket": list(pdf["bucket"]), "wave": [wave] * len(pdf), "back": [], "asks": [], "seen": [], "mass": []}
    hot_keys: dict[int, list] = {}
    for a, n, e, t in zip(ctx, run, np.split(each, cuts), pdf["total"], strict=True):
        at = np.searchsorted(keys, a)
        for j in np.flatnonzero(_unpack(t, "<i8") >= hot).tolist():
            hot_keys[int(a[j].astype(np.int64))] = [*types[at[j]].astype(float).tolist(), float(mass[at[j]])]
        asks = np.flatnonzero(np.add.reduceat((e == 0).astype(np.int64), np.cumsum(n, dtype=np.int64) - n.astype(np.int64)) > 0)
        out["back"].append(_pack(e.astype("<i8")))
        out["asks"].append(_pack(asks.astype("<u4")))
        out["seen"].append(_pack(types[at[asks]].astype("<i8")))
        out["mass"].append(mass[at[asks]].astype("<f8").tobytes())
    out["stats"] = [_classes(total).tolist()] + [None] * (len(pdf) - 1)
    out["hot"] = [list(hot_keys.items())] + [None] * (len(pdf) - 1)
    return pd.DataFrame(out)


def _receive(climb: Climb, k: int, got: list[dict], hot: int, buckets: int, hot_sums: tuple[np.ndarray, np.ndarray]) -> tuple[dict, np.ndarray, np.ndarray]:
    """A block's k-grams, their corpus counts and probabilities."""
    g = climb.block.grams(k)
    contexts = climb.contexts(k)
    wave = _wave(g["context"])
    c, weight = np.zeros(len(g["first"]), np.int64), np.ones(len(contexts))
    parts: dict[int, dict] = {}
    floor = min(climb.info["unknown"], 1e-9)
    for w in range(WAVES):
        idx = np.flatnonzero(wave == w)
        order, cuts = climb.cuts({x: g[x][idx] for x in ("context", "follower", "first")}, k, hot, buckets)
        parts[w] = {b: idx[order[x:y]] for b, x, y in cuts}
    for x in got or ():
        o = parts[x["wave"]][x["bucket"]]
        c[o] = _unpack(x["back"], "<i8")
        asks = _unpack(x["asks"], "<u4")
        if len(asks):
            ctx = g["first"][o][_heads(g["first"][o])][asks]
            weight[ctx] = _weight(_unpack(x["seen"], "<i8").reshape(len(asks), -1), np.frombuffer(x["mass"], "<f8"), contexts[ctx], climb.info["orders"][k], floor)
    keys, sums = hot_sums
    if len(keys):
        h = climb.block.hash
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        ctx = np.flatnonzero((keys[at] == h) & (contexts > 0))
        weight[ctx] = _weight(sums[at[ctx], :-1], sums[at[ctx], -1], contexts[ctx], climb.info["orders"][k], floor)
    weight[contexts == 0] = 1
    return g, c, np.where(c > 0, climb.seen(k, c, contexts[g["first"]]), weight[g["first"]] * climb.probabilities()[g["shorter"]])


def _weight(types: np.ndarray, mass: np.ndarray, total: np.ndarray, d: np.ndarray, floor: float) -> np.ndarray:
    """Backoff weights of contexts, from their followers."""
    return left_over(types.astype(np.float64), d) / np.maximum(total, 1) / np.maximum(1 - mass, floor)


def _exchange(table: DataFrame, k: int, hot: int, buckets: int, info: dict) -> list[DataFrame]:
    """The answers to all blocks' k-grams, a wave at a time."""

    def one(wave: int) -> DataFrame:
        def send(batches):
            for r in _rows(batches):
                sent = _send(Climb(r, info), k, wave, hot, buckets)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * sent.num_rows, pa.string()), *sent.columns], ["block", *sent.schema.names])

        columns = "block string, bucket long, ctx binary, run binary, low binary, high binary, seen binary, number binary, under binary, total binary"
        sent = table.select(*_TEXTS, "counts", "rest").mapInArrow(send, columns)
        return materialise(sent.groupBy("bucket").applyInPandas(lambda pdf: _meet(pdf, k, wave, hot, info), _BACK), f"order-{k}")

    return [one(w) for w in range(WAVES)]


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """(doc_id, text, held_out) rows to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    trained = docs.filter(~F.col("held_out")).count()
    with session(spark, 1000):
        texts = materialise(blocks(docs), "token-blocks")
    with session(spark, 2):  # a row is a block
        answers, info = word_table(texts)
        info |= {"trained": trained, "orders": {}}
        got = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "back", "wide")).alias("got"))

        def words(batches):
            for r in _rows(batches):
                c = _counts(Block(r), r["got"], info["buckets"])
                yield pa.RecordBatch.from_pylist([{x: r[x] for x in _TEXTS} | {"counts": [_pack(c.astype("<i8"))], "rest": []}], schema)

        schema = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), *[(x, pa.binary()) for x in _TEXTS[2:]], ("counts", pa.list_(pa.binary())), ("rest", pa.list_(pa.binary()))])
        columns = "block string, ids array<long>, held binary, sizes binary, words binary, tokens binary, counts array<binary>, rest array<binary>"
        table, name = bucketed(texts.join(got, "block").select(*_TEXTS, "got").mapInArrow(words, columns), "words", "block")
        remove(texts)
        remove(answers)
        hot = max(HOT, -(-info["tokens"] // HOT_CONTEXTS))
        buckets = max(1, -(-int(info["tokens"] * 0.9) // (BUCKET_KEYS * WAVES)))
        for k in range(2, order + 1):
            waves = _exchange(table, k, hot, buckets, info)
            back = waves[0]
            for w in waves[1:]:
                back = back.unionByName(w)
            s = back.filter("stats IS NOT NULL").agg(*[F.sum(F.col("stats")[i]).alias(str(i)) for i in range(TOP + 1)]).first()
            info["orders"][k] = discounts([x or 0 for x in s])
            hot_rows = back.filter("hot IS NOT NULL").select(F.explode("hot").alias("h")).groupBy("h.key").agg(*[F.sum(F.col("h.sums")[i]).alias(str(i)) for i in range(TOP + 2)]).toPandas()
            hot_keys = hot_rows["key"].to_numpy(np.int64).astype(np.uint64)
            rank = np.argsort(hot_keys)
            hot_sums = spark.sparkContext.broadcast((hot_keys[rank], hot_rows.drop(columns="key").to_numpy(np.float64)[rank]))
            got = back.groupBy("block").agg(F.collect_list(F.struct("wave", "bucket", "back", "asks", "seen", "mass")).alias("got"))
            joined = table.join(got, "block", "left").select(*_TEXTS, "counts", "rest", "got")
            if k == order:
                result = materialise(joined.mapInArrow(_finish(order, hot, buckets, info, hot_sums), _SCORES), "scores")
            else:

                def climbed(batches, k=k, sums=hot_sums):
                    for r in _rows(batches):
                        _, c, p = _receive(Climb(r, info), k, r["got"], hot, buckets, sums.value)
                        more = {"counts": [*r["counts"], _pack(c.astype("<i8"))], "rest": [*r["rest"], _pack(p[c == 0].astype("<f8"))]}
                        yield pa.RecordBatch.from_pylist([{x: r[x] for x in _TEXTS} | more], schema)

                nxt, nxt_name = bucketed(joined.mapInArrow(climbed, columns), f"order{k}", "block")
            drop(table, name)
            for w in waves:
                remove(w)
            if k < order:
                table, name = nxt, nxt_name
    return result


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(order: int, hot: int, buckets: int, info: dict, hot_sums):
    def run(batches):
        for r in _rows(batches):
            climb = Climb(r, info)
            b, words = climb.block, _unpack(r["counts"][0], "<i8")
            p = climb.probabilities()[np.maximum(b.own, 0)]
            short = b.own < 0  # near the start of a text
            g, _, top = _receive(climb, order, r["got"], hot, buckets, hot_sums.value)
            p[g["at"]] = top[g["own"]]
            short[g["at"]] = False
            if short.any():
                for k in range(2, order - 1):
                    lower = Climb({**r, "counts": r["counts"][:k], "rest": r["rest"][: k - 1]}, info)
                    at = np.flatnonzero(short & (b.place == k - 2))
                    p[at] = lower.probabilities()[lower.block.own[at]]
            m, c = len(b.sizes), words[b.tokens]
            total = np.bincount(b.text, np.log10(p), minlength=m)
            base = np.bincount(b.text, np.log10((c + 1) / (info["tokens"] + info["types"] + 1)), minlength=m)
            yield pa.RecordBatch.from_arrays([pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.sizes), pa.array(np.bincount(b.text, c > 0, minlength=m).astype(np.int64)), pa.array(np.full(m, info["tokens"], np.int64)), pa.array(base), pa.array(total)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs.select("doc_id", "text", (id_mod("doc_id", 7) == 2).alias("held_out")), ORDER)
