"""SentencePiece encoding and decoding with exact N-best segmentation.

The pieces of a public model are read once on the driver and broadcast (one entry a piece). Text is
escaped as the format does it: a leading space is put before it, spaces become U+2581. The lattice holds
every piece that matches at a place; a character that is no piece of its own costs its UTF-8 bytes as
byte pieces. A U+2581 of the text itself is always written as bytes, so that decoding gives back every
text exactly.

A forward Viterbi pass gives the best score up to every place. The N best segmentations then come from a
backward A-star search from the end: a partial path's priority is its own score plus the forward score
of the place it has reached, which is exact, so paths leave the heap in order of their full scores.

No piece has the escaped space after another character, so that the lattice falls apart before each run
of escaped spaces, around each newline if no longer piece has one, and between any two characters that no
piece holds side by side. Segments are searched one by one,
with a table of solved segments that a worker keeps, and the N best of a text are merged from the segments' lists; this equals the search over
the whole text.

A piece of rank r (its place in the model's order of scores) scores -ln(r + 2.7), Zipf's law, as the
model itself has merge ranks and no probabilities. Ties go to the earlier found path, which prefers
longer last pieces.

Defined results: null text has null tokens in ``encode`` and counts as empty in digests; empty text has no
token; repeated rows and null ids stay; other columns pass by.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import uuid
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LITERAL = ""  # the segment of a U+2581 of the text itself; no other segment is empty
N_BEST = 3
_TABLE_SEGMENTS = 400_000  # solved segments that a worker keeps
_TABLE_IDS = 20_000_000
_VECTOR_LENGTH = 48
_TOGETHER = 8192  # segments solved side by side
_GROUP_CHARS = 1 << 20  # of texts whose segments are looked up together
_NO_CHAR = (1 << 21) - 1
_BYTE_PENALTY = 10.0


def read_pieces(path: str = MODEL) -> list[tuple[str, float, bool]]:
    """(piece, score, is a byte piece) by id; control and unknown pieces have an empty string."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-p.get_score(i), i)))}
    low = -math.log(n) - _BYTE_PENALTY
    return [(p.id_to_piece(i), low, True) if p.is_byte(i) else (p.id_to_piece(i), -math.log(rank[i] + 2.7), False) if i in rank else ("", low, False) for i in range(n)]


class Lattice:
    def __init__(self, pieces: list[tuple[str, float, bool]]):
        self.ids = {p: (i, s) for i, (p, s, byte) in enumerate(pieces) if p and not byte}
        self.byte_id = {int(p[3:5], 16): (i, s) for i, (p, s, byte) in enumerate(pieces) if byte}
        #: A trie over characters: [(cost, ids) of the piece that ends here, or empty; what may follow, or None].
        self.trie: dict[str, list] = {}
        for p, (i, v) in self.ids.items():
            level = self.trie
            for k, c in enumerate(p):
                node = level.setdefault(c, [(), None])
                if k == len(p) - 1:
                    node[0] = (-v, (i,))
                elif node[1] is None:
                    node[1] = {}
                level = node[1]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space inside")
        newline = any("\n" in p and len(p) > 1 for p in self.ids)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if newline else f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        text_of = [b"" if not p else bytes([int(p[3:5], 16)]) if byte else p.replace(SPACE, " ").encode() for p, _, byte in pieces]
        self.blob = np.frombuffer(b"".join(text_of), np.uint8)
        self.sizes = np.fromiter(map(len, text_of), np.int64, len(text_of))
        self.offsets = np.cumsum(self.sizes) - self.sizes
        #: Neighbouring characters inside some piece; between any others the lattice falls apart.
        self.joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._flatten()
        self.forget()

    def forget(self) -> None:
        """Empties the table of solved segments: each one's number, and for its N_BEST segmentations, best first, where
        their ids lie, how many there are, and their loss (infinite: there is none)."""
        self.code: dict[str, int] = {}
        self.ids_used, self.all_ids = 0, np.zeros(1 << 16, np.int32)
        self.top = np.zeros(1 << 12)
        self.at, self.size, self.loss = (np.zeros((N_BEST, 1 << 12), x) for x in (np.int64, np.int64, np.float64))

    def _flatten(self) -> None:
        """The trie as arrays: sorted edges (node and character) with their ends; each node's cost and id, or none (-1)."""
        edges, ends, cost, ids = [], [], [math.inf], [-1]
        todo = [(0, self.trie)]
        while todo:
            node, level = todo.pop()
            for c, (hit, further) in level.items():
                edges.append(node << 21 | ord(c))
                ends.append(len(ids))
                if further:
                    todo.append((len(ids), further))
                cost.append(hit[0] if hit else math.inf)
                ids.append(hit[1][0] if hit else -1)
        order = np.argsort(edges)
        self.edges = np.append(np.array(edges, np.int64)[order], np.int64(1) << 62)
        self.ends = np.append(np.array(ends, np.int64)[order], 0)
        self.node_cost, self.node_id = np.array(cost), np.array(ids, np.int32)

    def as_bytes(self, c: str) -> tuple[float, tuple[int, ...]]:
        """Cost and ids of a character's byte pieces."""
        raw = [self.byte_id[b] for b in c.encode()]
        return -sum([x[1] for x in raw]), tuple([x[0] for x in raw])

    def forward(self, s: str) -> tuple[list[float], list[list[tuple[float, int, tuple[int, ...]]]]]:
        """Viterbi: the least cost up to each place, and the arcs that end there as (cost up to here, start, ids)."""
        n = len(s)
        best = [0.0] + [math.inf] * n
        into: list[list] = [[] for _ in range(n + 1)]
        root = self.trie
        for start in range(n):
            base = best[start]
            c = s[start]
            node = root.get(c)
            end = start + 1
            if node is None:
                cost, ids = self.as_bytes(c)
                cost += base
                into[end].append((cost, start, ids))
                if cost < best[end]:
                    best[end] = cost
                continue
            hit, further = node
            if not hit:
                hit = self.as_bytes(c)
            while True:
                if hit:
                    cost = base + hit[0]
                    into[end].append((cost, start, hit[1]))
                    if cost < best[end]:
                        best[end] = cost
                if end == n or further is None:
                    break
                node = further.get(s[end])
                if node is None:
                    break
                end += 1
                hit, further = node
        return best, into

    def nbest(self, s: str, n: int = N_BEST) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of an escaped string: (score, ids), best first."""
        if s == LITERAL:
            cost, ids = self.as_bytes(SPACE)
            return [(-cost, ids)]
        best, into = self.forward(s)
        top = best[-1]
        found, heap, count = [], [], 0
        loss, place, path = 0.0, len(s), ()
        while True:
            # the heuristic is exact: the best arcs cost nothing and are followed at once, only others wait in the heap
            wait = len(found) + 1 < n
            while place:
                order = into[place]
                if len(order) > 1:
                    order.sort()
                    if wait:  # of one partial path, only its n best continuations can be among the n best
                        least = best[place]
                        for cost, start, ids in order[1:n]:
                            heapq.heappush(heap, (loss + cost - least, count, start, (ids, path)))
                            count += 1
                _, place, ids = order[0]
                path = (ids, path)
            ids = []
            while path:
                ids.extend(path[0])
                path = path[1]
            found.append((-top - loss, tuple(ids)))
            if len(found) >= n or not heap:
                return found
            loss, _, place, path = heapq.heappop(heap)

    def arcs(self, s: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place, the pieces that end there: (start, score, ids)."""
        best, into = self.forward(s)
        return [[(start, best[start] - cost, ids) for cost, start, ids in own] for own in into]

    def learn(self, segments: list[str]) -> None:
        """Solves new segments: short ones many at once, by the same forward pass and backward search, a step of all of them at a time."""
        short = sorted((s for s in segments if 0 < len(s) <= _VECTOR_LENGTH), key=len)
        for a in range(0, len(short), _TOGETHER):
            part = short[a : a + _TOGETHER]
            self._keep(part, *self._solve_block(part))
        for s in segments:
            if not 0 < len(s) <= _VECTOR_LENGTH:
                score, *found = self.solve(s)
                parts = [(np.zeros(1, np.int64), np.frombuffer(ids, "<i4"), np.array([len(ids) // 4]), np.array([loss])) for loss, ids in found]
                self._keep([s], np.array([score]), parts)

    def _keep(self, segments: list[str], top: np.ndarray, parts: list[tuple]) -> None:
        """Adds segments with their best scores and, rank by rank, (which segments, all their ids, how many each, losses)."""
        a, b = len(self.code), len(self.code) + len(segments)
        while b > len(self.top):
            self.top = np.append(self.top, self.top)
            self.at, self.size, self.loss = (np.concatenate([x, x], 1) for x in (self.at, self.size, self.loss))
        self.top[a:b] = top
        self.loss[:, a:b] = math.inf
        for rank, (own, ids, size, loss) in enumerate(parts):
            while self.ids_used + len(ids) > len(self.all_ids):
                self.all_ids = np.append(self.all_ids, self.all_ids)
            self.all_ids[self.ids_used : self.ids_used + len(ids)] = ids
            self.at[rank, a + own], self.size[rank, a + own], self.loss[rank, a + own] = self.ids_used + np.cumsum(size) - size, size, loss
            self.ids_used += len(ids)
        self.code.update(zip(segments, range(a, b), strict=True))

    def hit(self, code: int) -> tuple:
        """A segment's best score, and (loss, ids) of its segmentations."""
        return (float(self.top[code]), *[(float(x), self.all_ids[a : a + n].tobytes()) for a, n, x in zip(self.at[:, code].tolist(), self.size[:, code].tolist(), self.loss[:, code].tolist(), strict=True) if x < math.inf])

    def _solve_block(self, segments: list[str], n: int = N_BEST) -> tuple[np.ndarray, list[tuple]]:
        m, lens = len(segments), np.fromiter(map(len, segments), np.int64, len(segments))
        width = int(lens.max()) + 1
        chars = np.full((m, width), _NO_CHAR, np.int64)
        chars[np.arange(width) < lens[:, None]] = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")
        best = np.full((m, width), math.inf)
        best[:, 0] = 0
        flat = best.ravel()
        arcs: list[tuple] = []  # row, start, end, cost of the piece, id or -1 for bytes

        def found(rows, start, end, cost, ids):
            at = rows * width + end
            flat[at] = np.minimum(flat[at], flat[rows * width + start] + cost)
            arcs.append((rows, np.full(len(rows), start), at, cost, ids))

        for start in range(width - 1):
            rows = np.flatnonzero(lens > start)
            node = np.zeros(len(rows), np.int64)
            for end in range(start + 1, width):
                want = node << 21 | chars[rows, end - 1]
                at = np.searchsorted(self.edges, want)
                there = self.edges[at] == want
                node = np.where(there, self.ends[at], 0)
                if end == start + 1:
                    bare = self.node_id[node] < 0
                    if bare.any():
                        odd, own = np.unique(chars[rows[bare], start], return_inverse=True)
                        found(rows[bare], start, end, np.array([self.as_bytes(chr(c))[0] for c in odd.tolist()])[own], np.full(int(bare.sum()), -1, np.int32))
                rows, node = rows[there], node[there]
                if not len(rows):
                    break
                hit = self.node_id[node] >= 0
                if hit.any():
                    found(rows[hit], start, end, self.node_cost[node[hit]], self.node_id[node[hit]])
        row, first, place, cost, ids = (np.concatenate([x[i] for x in arcs]) for i in range(5))
        upto = flat[row * width + first] + cost
        order = np.argsort(upto, kind="stable")  # arcs come by start, which settles ties
        order = order[np.argsort(place[order].astype(np.int32), kind="stable")]
        row, first, upto, ids = row[order], first[order], upto[order], ids[order]
        ptr = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=m * width))])

        # backward: the heuristic is exact, so best arcs are followed at once; the others wait as (row, loss, count, place, arc, path, steps)
        waiting: list[tuple] = []
        paths, sizes, losses, owners = [], [], [], []
        rows, at, loss = np.arange(m), lens.copy(), np.zeros(m)
        path, steps = np.zeros((m, width), np.int64), np.zeros(m, np.int64)
        while True:
            live = np.flatnonzero(at > 0)
            while len(live):
                key = rows[live] * width + at[live]
                top, many = ptr[key], ptr[key + 1] - ptr[key]
                if len(paths) + 1 < n:
                    for k in range(1, n):
                        some = many > k
                        if some.any():
                            o, arc = live[some], top[some] + k
                            waiting.append((rows[o], loss[o] + (upto[arc] - upto[top[some]]), (len(paths) * width + steps[o]) * n + k, first[arc], arc, np.full(len(o), len(paths)), steps[o], o))
                path[live, steps[live]] = top
                steps[live] += 1
                at[live] = first[top]
                live = live[at[live] > 0]
            paths.append(path)
            sizes.append(steps)
            losses.append(loss)
            owners.append(rows)
            if len(paths) >= n or not waiting:
                break
            w = [np.concatenate([x[i] for x in waiting]) for i in range(8)]
            turn = np.lexsort((w[2], w[1], w[0]))
            lead = np.append(True, w[0][turn][1:] != w[0][turn][:-1])
            take, rest = turn[lead], turn[~lead]
            waiting = [tuple(x[rest] for x in w)] if len(rest) else []
            rows, loss, _, at, arc, parent, taken, index = (x[take].copy() for x in w)
            path = np.zeros((len(rows), width), np.int64)
            for q in range(len(paths)):
                own = parent == q
                path[own] = paths[q][index[own]]
            path[np.arange(len(rows)), taken] = arc
            steps = taken + 1

        made = []
        for p, s, x, own in zip(paths, sizes, losses, owners, strict=True):
            inside = np.arange(p.shape[1]) < s[:, None]
            back = np.where(inside, s[:, None] - 1 - np.arange(p.shape[1]), 0)
            arc = np.take_along_axis(p, back, 1)[inside]  # from the start to the end
            tokens, many = ids[arc], s
            bare = np.flatnonzero(tokens < 0)
            if len(bare):
                spelt = [self.as_bytes(chr(c))[1] for c in chars[row[arc[bare]], first[arc[bare]]].tolist()]
                times = np.ones(len(tokens), np.int64)
                times[bare] = [len(y) for y in spelt]
                many = np.bincount(np.repeat(np.arange(len(own)), s), times, minlength=len(own)).astype(np.int64)
                tokens = np.repeat(tokens, times)
                tokens[tokens < 0] = np.fromiter((i for y in spelt for i in y), np.int32)
            made.append((own, tokens, many, x))
        return -flat[np.arange(m) * width + lens], made

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        find = self.cut.findall
        if SPACE not in text:
            return find(SPACE + text.replace(" ", SPACE))
        first, *parts = text.split(SPACE)
        out = find(SPACE + first.replace(" ", SPACE))
        for p in parts:
            out.append(LITERAL)
            out.extend(find(p.replace(" ", SPACE)))
        return out

    def units(self, segment: str) -> list[str]:
        """A segment cut where no piece holds both neighbouring characters, so that no arc crosses."""
        cuts = [i for i, (a, b) in enumerate(zip(segment, segment[1:]), 1) if a + b not in self.joins]  # noqa: B905
        return [segment[a:b] for a, b in zip([0, *cuts], [*cuts, len(segment)], strict=True)] if cuts else [segment]

    def codes(self, segments: list[str]) -> np.ndarray:
        """The numbers of solved segments in the table; a full table starts anew."""
        if len(self.code) >= _TABLE_SEGMENTS or self.ids_used >= _TABLE_IDS:
            self.forget()
        new = set(segments).difference(self.code)
        if new:
            self.learn(sorted(new))
        return np.fromiter(map(self.code.__getitem__, segments), np.int64, len(segments))

    def solve(self, segment: str, n: int = N_BEST) -> tuple:
        """Best score and (loss, ids) of the n best segmentations of one segment, unit by unit."""
        lists = [self.nbest(u, n) for u in self.units(segment)]
        losses = [[(x[0][0] - score, array("i", ids).tobytes()) for score, ids in x] for x in lists]
        return sum([x[0][0] for x in lists]), *ranked(losses, n)

    def tokens(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size)
        return self.all_ids[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def best(self, codes: np.ndarray) -> np.ndarray:
        """Ids of the best segmentation of a text, from its segments."""
        return self.tokens(self.at[0, codes], self.size[0, codes])

    def nbest_codes(self, codes: np.ndarray, n: int = N_BEST) -> list[tuple[float, np.ndarray]]:
        """(loss, ids) of a text's n best segmentations, from its segments: n is at most N_BEST."""
        out = [(0.0, self.best(codes))]
        if n < 2 or not len(codes):
            return out
        first = self.loss[1, codes]
        if len(first) >= n:  # only the n - 1 segments of least first loss take part
            turn = np.flatnonzero(first <= np.partition(first, n - 2)[n - 2])
        else:
            turn = np.arange(len(first))
        turn = turn[np.argsort(first[turn], kind="stable")][: n - 1]
        turn = turn[first[turn] < math.inf]
        options = [[x for x in self.loss[1:, codes[i]].tolist() if x < math.inf] for i in turn.tolist()]
        for loss, swaps in merge_losses(options, n)[1:]:
            at, size = self.at[0, codes], self.size[0, codes]
            for k, which in swaps:
                at[turn[k]], size[turn[k]] = self.at[which + 1, codes[turn[k]]], self.size[which + 1, codes[turn[k]]]
            out.append((loss, self.tokens(at, size)))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.best(self.codes(self.segments(text)))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        ids = np.asarray(ids, np.int64)
        size, at = self.sizes[ids], self.offsets[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(at - ends + size, size) + np.arange(total)].tobytes()[1:]

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode(errors="replace")

    def many(self, texts: list[str | None]):
        """(text, its segments' numbers) for each text, a group of texts at a time; a null text counts as empty.
        The numbers hold until the next text is asked for."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and size < _GROUP_CHARS:
                size += len(texts[stop] or "")
                stop += 1
            group = [t or "" for t in texts[at:stop]]
            cut = [self.segments(t) for t in group]
            codes = self.codes([s for c in cut for s in c])
            a = 0
            for t, c in zip(group, cut, strict=True):
                yield t, codes[a : a + len(c)]
                a += len(c)
            at = stop

    def nbest_text(self, text: str, n: int = N_BEST) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a whole text: (score, ids), best first."""
        segments = self.segments(text)
        if n <= N_BEST:
            codes = self.codes(segments)
            top = math.fsum(self.top[codes].tolist())
            return [(top - loss, ids) for loss, ids in self.nbest_codes(codes, n)]
        solved = [self.solve(s, n) for s in segments]
        top = math.fsum(x[0] for x in solved)
        return [(top - loss, np.frombuffer(ids, "<i4")) for loss, ids in ranked([list(x[1:]) for x in solved], n)]


def ranked(lists: list[list[tuple[float, bytes]]], n: int) -> list[tuple[float, bytes]]:
    """(loss, ids) of the n best joins of one choice from each list; a list begins with its best, at no loss."""
    turn = sorted((i for i, x in enumerate(lists) if len(x) > 1), key=lambda i: (lists[i][1][0], i))[: max(0, n - 1)]
    best = [x[0][1] for x in lists]
    out = []
    for loss, swaps in merge_losses([[x[0] for x in lists[i][1:]] for i in turn], n):
        parts = best.copy()
        for k, which in swaps:
            parts[turn[k]] = lists[turn[k]][which + 1][1]
        out.append((loss, b"".join(parts)))
    return out


def merge_losses(others: list[list[float]], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n smallest sums of one choice a place: its best, at no loss, or one of its others. Places come by their first loss.

    A state's last swapped place is deepened, replaced by, or joined by, the next one.
    """
    out: list[tuple[float, tuple]] = [(0.0, ())]
    if not others:
        return out
    heap = [(others[0][0], ((0, 0),))]
    while heap and len(out) < n:
        loss, swaps = heapq.heappop(heap)
        out.append((loss, swaps))
        at, which = swaps[-1]
        own = others[at]
        if which + 1 < len(own):
            heapq.heappush(heap, (loss - own[which] + own[which + 1], (*swaps[:-1], (at, which + 1))))
        if at + 1 < len(others):
            step = others[at + 1][0]
            heapq.heappush(heap, (loss + step, (*swaps, (at + 1, 0))))
            if which == 0:
                heapq.heappush(heap, (loss - own[0] + step, (*swaps[:-1], (at + 1, 0))))
    return out


def _shared(spark: SparkSession, model: str):
    return spark.sparkContext.broadcast(read_pieces(model))


class Shared:
    """A broadcast with a name that workers can tell it by."""

    def __init__(self, broadcast):
        self.broadcast, self.key = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


_LATTICES: dict[str, Lattice] = {}


def _lattice(pieces) -> Lattice:
    """The lattice of a broadcast model, kept with its cache from task to task of a worker."""
    if pieces.key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[pieces.key] = Lattice(pieces.value)
    return _LATTICES[pieces.key]


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) rows to doc_id, n_tokens, score, second_score, ids_sha256, decoded_sha256 and exact (of the best), n_found,
    last_score, others_sha256 and others_exact (of the N_BEST segmentations after it; exact: they decode to the same bytes)."""
    pieces = Shared(_shared(docs.sparkSession, model))
    schema = "doc_id long, n_tokens long, score double, second_score double, ids_sha256 string, decoded_sha256 string, exact boolean, n_found int, last_score double, others_sha256 string, others_exact boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        lattice = _lattice(pieces)
        for b in batches:
            out = []
            for t, codes in lattice.many(b.column(1).to_pylist()):
                score = float(lattice.top[codes].sum())
                (_, ids), *others = lattice.nbest_codes(codes)
                back = lattice.decode_bytes(ids)
                more = hashlib.sha256()
                for _, x in others:
                    more.update(x.astype("<i4").tobytes())
                losses = [x for x, _ in others]
                out.append((len(ids), score, score - losses[0] if others else None, hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == t.encode(), 1 + len(others), score - max(losses, default=0.0), more.hexdigest(), all(lattice.decode_bytes(x) == back for _, x in others)))
            cols = list(zip(*out, strict=True)) if out else [()] * 10
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.float64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) rows to doc_id, n_tokens, tokens, n_bytes_decoded."""
    pieces = Shared(_shared(docs.sparkSession, model))

    def run(batches):
        lattice = _lattice(pieces)
        for b in batches:
            ids, back = [], []
            texts = b.column(1).to_pylist()
            for real, (_, codes) in zip(texts, lattice.many(texts), strict=True):
                x = None if real is None else lattice.best(codes)
                ids.append(x)
                back.append(None if x is None else len(lattice.decode_bytes(x)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([0 if x is None else len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.int64())], ["doc_id", "n_tokens", "tokens", "decoded_bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>, decoded_bytes long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(documents(spark, sf_dir))
