"""Search over several blocks, lattices at once, models of any order, shared stretches: against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import backoff_lm, nearest, passage_dedup, piece_lattice

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, name string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s0", None if t is None else len(t), "row", 7, "name") for i, t in enumerate(texts)], SCHEMA)


# --- 1 nearest -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((1500, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[1000:] = v[1000]  # a third of the rows are copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(40, v[77].tolist())]  # one id, two vectors
    return rows, nearest.pack(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()


def by_query(result):
    got = defaultdict(list)
    for r in result.orderBy("query_id", "query_key", "rank").collect():
        got[r.query_id, r.query_key].append((r.vec_id, r.score))
    return got


def wanted(rows, at, k):
    x = np.array([r[1] for r in rows])
    s = x @ x[at]
    return sorted((-round(s[j], 12), rows[j][0]) for j in range(len(rows)) if j != at)[:k]


@pytest.mark.parametrize(("block", "chunk"), [(200, 7), (700, 1000), (10**6, 5)])
def test_infinite_margin_is_exact(vectors, block, chunk):
    rows, base = vectors
    got = by_query(nearest.search(base, base.filter("id % 20 = 0"), 20, block, chunk, math.inf))
    ats = [j for j, r in enumerate(rows) if r[0] % 20 == 0]
    assert len(got) == len(ats)
    want = Counter(tuple(i for _, i in wanted(rows, j, 20)) for j in ats)
    assert Counter(tuple(i for i, _ in x) for x in got.values()) == want


@pytest.mark.parametrize(("block", "chunk"), [(200, 7), (700, 1000)])
def test_recall_over_blocks_and_chunks(vectors, block, chunk):
    rows, base = vectors
    got = by_query(nearest.search(base, base.filter("id % 20 = 0"), 20, block, chunk))
    share = []
    for (i, _), found in got.items():
        if i == 40:
            continue
        floor = -wanted(rows, i, 20)[-1][0]
        share.append(sum(s >= floor - 1e-9 for _, s in found) / 20)
        assert len(found) == 20 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert np.mean(share) >= 0.95


# --- 9 pieces ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lattice():
    return piece_lattice.Lattice(piece_lattice.read_pieces())


def test_every_code_point_comes_back(lattice):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "".join(points[i : i + 40]) + " ▁b" for i in range(0, len(points), 40)]
    for t, codes in lattice.many(texts):
        assert lattice.decode(lattice.best(codes)) == t


@pytest.mark.parametrize("text", ["a\U0010fffdb", "▁", "▁▁ ▁", "a▁b c", " ▁a"])
def test_marks_of_the_text_itself(lattice, text):
    assert lattice.decode(lattice.encode(text)) == text
    assert all(lattice.decode(ids) == text for _, ids in lattice.nbest_text(text, 3))


def test_many_at_once_equal_one_by_one(lattice):
    rnd = random.Random(3)
    letters = "theinandorß,é.1🙂A\0"
    segments = sorted({("▁" * rnd.randint(0, 2) + "".join(rnd.choices(letters, k=rnd.randint(1, 14)))) for _ in range(3000)})
    lattice.forget()
    for s, code in zip(segments, lattice.codes(segments).tolist(), strict=True):
        (score, *want), (top, *got) = lattice.solve(s), lattice.hit(code)
        assert top == pytest.approx(score, abs=1e-9) and got[0] == want[0]
        losses = [x[0] for x in want]
        assert [x[0] for x in got] == pytest.approx(losses, abs=1e-9)
        if all(b - a > 1e-9 for a, b in zip(losses, losses[1:], strict=False)) and len(lattice.nbest(s, 4)) < 4:
            assert [x[1] for x in got] == [x[1] for x in want]
        assert len({x[1] for x in got}) == len(got)


def test_caches_move_on(lattice, monkeypatch):
    monkeypatch.setattr(piece_lattice, "_TABLE_SEGMENTS", 5)
    texts = [f"words of number {i} and others {'x' * i}" for i in range(40)]
    for t in texts:
        assert lattice.decode(lattice.encode(t)) == t


# --- 10 language model ---------------------------------------------------------------------------------------------------


class Katz:
    """Order three by dictionaries."""

    def __init__(self, texts):
        self.grams = [Counter(), Counter(), Counter()]
        self.before = Counter()
        for ws in texts:
            path = [0, *ws]
            for i, w in enumerate(ws, 1):
                self.grams[0][w] += 1
                for k in (2, 3):
                    if i - k + 1 >= 0:
                        self.grams[k - 1][tuple(path[i - k + 1 : i + 1])] += 1
                        self.before[tuple(path[i - k + 1 : i])] += 1
        self.n = sum(self.grams[0].values())
        self.d = [backoff_lm.discounts([Counter(g.values())[r] for r in range(1, 7)]) for g in self.grams]
        self.unknown = 1 - sum(self.take(c, 0) for c in self.grams[0].values()) / self.n
        self.after = defaultdict(list)
        for k in (1, 2):
            for g in self.grams[k]:
                self.after[g[:-1]].append(g[-1])

    def take(self, c, k):
        return c - 0.01 if c > 5 else self.d[k][c] * c

    def p(self, context, w):
        if not context:
            return self.take(self.grams[0][w], 0) / self.n if self.grams[0][w] else self.unknown
        k, total = len(context), self.before[context]
        if not total:
            return self.p(context[1:], w)
        c = self.grams[k][(*context, w)]
        if c:
            return self.take(c, k) / total
        left = 1 - sum(self.take(self.grams[k][(*context, x)], k) for x in self.after[context]) / total
        return left / (1 - sum(self.p(context[1:], x) for x in self.after[context])) * self.p(context[1:], w)


@pytest.mark.parametrize("hot", [20, 10**6])
def test_order_three_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_TOKENS", 700)
    monkeypatch.setattr(backoff_lm, "BUCKET_KEYS", 200)
    monkeypatch.setattr(backoff_lm, "HOT", hot)
    monkeypatch.setattr(backoff_lm, "HOT_CONTEXTS", 10**9)
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    texts = [" ".join(rnd.choices(vocabulary, [1 / (i + 1) for i in range(12)], k=rnd.randint(0, 40))) + (" new w1 w0" * (i % 11 == 0)) for i in range(110)] + [None, "", "W0  w0\tw0"]
    words = [[*(t or "").lower().split(), None] for t in texts]
    model = Katz([ws for i, ws in enumerate(words) if i % 7 != 2])
    for context in [(0,), ("w0",), (0, "w0"), ("w0", "w1"), ("w3", "w0"), ("w9", "w9")]:
        assert sum(model.p(context, w) for w in [*model.grams[0], "never"]) == pytest.approx(1)
    docs = frame(spark, texts).withColumn("held_out", F.col("doc_id") % 7 == 2)
    got = {r.doc_id: r for r in backoff_lm.score(docs, 3).collect()}
    for i, ws in enumerate(words):
        path = [0, *ws]
        want = sum(math.log10(model.p(tuple(path[max(0, j - 2) : j]), path[j])) for j in range(1, len(path)))
        assert got[i].score == pytest.approx(want, rel=1e-9), i
        assert got[i].n_tokens == len(ws) and got[i].train_tokens == model.n


def test_settings_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    backoff_lm.score(frame(spark, ["a b", None]).withColumn("held_out", F.lit(False)), 3).collect()
    assert spark.conf.get(key) == before


# --- 7 passages ----------------------------------------------------------------------------------------------------------


def test_shared_stretches(spark):
    rnd = random.Random(12)
    words = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(n))
    short, passage = words(8), words(70)[:395]
    texts = [words(100) + passage + words(90), words(80) + passage + words(120), words(100) + short + words(50), words(60) + short + words(70), words(300), None, ""]
    got = {r.doc_id: r for r in passage_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert all(r.n_removed == 0 for r in got.values())  # shorter than the length
    assert 256 <= got[0].n_shared <= 395 and 256 <= got[1].n_shared <= 395
    assert [got[i].n_shared for i in range(2, 7)] == [0] * 5


@pytest.mark.parametrize("piece", [1500, 3 << 17])
def test_passages_of_over_50_words_by_brute_force(spark, piece, monkeypatch):
    monkeypatch.setattr(passage_dedup, "PIECE_BYTES", piece)
    monkeypatch.setattr(passage_dedup, "BLOCK_BYTES", 20_000)
    rnd = random.Random(13)
    words = lambda n, longest=7: "".join("".join(rnd.choices("abcdefghij", k=rnd.randint(1, longest))) + rnd.choice([" ", " ", "\n", " \t"]) for _ in range(n))
    planted = [words(n, longest) for n, longest in ((49, 7), (50, 7), (51, 7), (51, 3), (52, 9), (60, 7), (90, 2), (120, 7), (51, 40))]
    texts = [words(rnd.randint(0, 80)) + rnd.choice(planted) + words(rnd.randint(0, 80)) for _ in range(60)]
    twice = words(75)
    texts += [twice + words(9) + twice, twice[3:] + words(5), planted[7], planted[7].strip(), "x" + planted[7], texts[0], texts[1] + texts[0], words(400), "a " * 300, "é " * 51, "é " * 90, None, ""]
    inner = words(130)
    texts.append(inner + words(20) + inner)  # repeats, but in no other text
    raw, size, holders = [(t or "").encode() for t in texts], passage_dedup.WORDS + 1, defaultdict(set)
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in raw]
    for i, (b, at) in enumerate(zip(raw, places, strict=True)):
        for k in range(len(at) - size + 1):
            holders[b[at[k][0] : at[k + size - 1][1]]].add(i)
    got = {r.doc_id: r for r in passage_dedup.remove_repeats(frame(spark, texts)).collect()}
    for i, (b, at) in enumerate(zip(raw, places, strict=True)):
        own = np.zeros(len(b), bool)
        for k in range(len(at) - size + 1):
            a, z = at[k][0], at[k + size - 1][1]
            if len(holders[b[a:z]]) > 1:
                own[a:z] = True
        assert got[i].n_passage == own.sum(), i
    assert got[len(texts) - 1].n_passage == 0 < got[len(texts) - 1].n_removed


# --- 2 line dedup --------------------------------------------------------------------------------------------------------


def runs_by_hand(texts, min_lines):
    """Lines that lie in a run of at least min_lines lines with an earlier copy; the deepest power of two of each text."""
    lines = [[x for x in (t or "").split("\n") if x.strip()] for t in texts]
    gone, depth = [set() for _ in texts], [0] * len(texts)
    size = 1
    while size <= max(map(len, lines)):
        for n in {size, min_lines}:
            seen = set()
            for i, ls in enumerate(lines):
                for j in range(len(ls) - n + 1):
                    run = tuple(ls[j : j + n])
                    if run in seen:
                        gone[i] |= set(range(j, j + n)) if n == min_lines else set()
                        depth[i] = max(depth[i], size if n == size else 0)
                    seen.add(run)
        size *= 2
    return [sorted(g) for g in gone], depth


@pytest.mark.parametrize("min_lines", [1, 3, 8, 11])
def test_runs_of_three_to_fifty_lines(spark, min_lines):
    from lamella.llm import line_dedup

    rnd = random.Random(21)
    passages = [[f"passage {p} line {k}" for k in range(n)] for p, n in enumerate((3, 5, 8, 12, 20, 33, 50))]
    texts = []
    for i in range(30):
        out = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 3)
            out += [f"own {i} {len(out)}", *p[a : rnd.randint(a + 1, len(p))]]
        texts.append("\n".join(out))
    gone, depth = runs_by_hand(texts, min_lines)
    got = {r.row.doc_id: r.dedup for r in line_dedup.dedup_lines(frame(spark, texts), 10**6 if min_lines > 1 else 1, min_lines).collect()}
    for i, t in enumerate(texts):
        lines = t.split("\n")
        assert got[i].text == "\n".join(x for j, x in enumerate(lines) if j not in gone[i]), i
        assert (got[i].n_removed, got[i].depth) == (len(gone[i]), depth[i])
    assert min_lines < 11 or max(depth) >= 16


def test_line_ranks_are_in_suffix_order(spark):
    from lamella.llm import line_dedup

    docs = frame(spark, ["a\nb\nc\nd", "a\nb\nc\ne", "b\nc\nd", "c\nd\na\nb"])
    lines = line_dedup.line_table(docs, 1)
    one = line_dedup.ranked(lines, "h1", "h2")
    two = line_dedup.ranked(line_dedup.further(one, one, 1).withColumnRenamed("rank", "own"), "own", "next")
    first = {(r.doc_id, r.pos): r["rank"] for r in one.collect()}
    second = {(r.doc_id, r.pos): r["rank"] for r in two.collect()}
    pairs = {k: (first[k], first[k[0], k[1] + 1]) for k in second}
    assert len(second) == 9
    for x in second:
        for y in second:
            assert (second[x] < second[y]) == (pairs[x] < pairs[y])


# --- 8 mixing ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("quality", [0, 1, None])
def test_ranges_are_even_whatever_the_weights(spark, monkeypatch, quality):
    from lamella.llm import mixing

    monkeypatch.setattr(mixing, "RANGE_ROWS", 100)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("size"))
    labels = spark.range(3000 if quality is not None else 0).select(F.col("id").alias("doc_id"), F.lit(quality or 0).alias("quality"))
    assert mixing.mix(docs, mixing.quality_weights(labels)).agg(F.sum("taken")).first()[0] == 3000
    sizes = mixing.ranged(docs, mixing.quality_weights(labels)).groupBy("range").count().toPandas()["count"]
    assert len(sizes) == 30 and sizes.max() < 160


# --- 4 language ID -------------------------------------------------------------------------------------------------------


def test_each_language_has_equal_room(monkeypatch):
    from lamella.llm import language_id as L

    def counts(text):
        b = np.frombuffer(b"\n" * L.ORDER + text.encode(), np.uint8).astype(np.int64)
        g = b[: -L.ORDER]
        for k in range(1, L.ORDER + 1):
            g = g << 8 | b[k : len(b) - L.ORDER + k]
        return np.unique(g, return_counts=True)

    rnd = random.Random(7)
    big, small = "".join(rnd.choices("abcdefgh ", k=60_000)), "".join(rnd.choices("stuvwxyz ", k=600))
    grams = {"big": counts(big), "small": counts(small)}
    full, cut = L.build(["big", "small"], grams, 10**6), L.build(["big", "small"], grams, 100)
    assert len(cut.step) == 100 < len(full.step)
    for text, lang in (("gab hed fac", 0), ("vuts zyx wst", 1)):
        for m in (full, cut):
            assert m.code_lengths([text.encode()])[0].argmin() == lang
    # pruned contexts fall back to shorter ones: code lengths stay finite, and each context's probabilities sum to one
    n = cut.step.shape[1]
    p = np.exp2(-cut.bits.reshape(-1, n, 2).astype(float))
    p[:, -1] *= 256 - (n - 1)
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    many = {f"l{i:03}": counts("".join(rnd.choices("abcdefgh ", k=400))) for i in range(300)}
    monkeypatch.setattr(L, "TABLE_BYTES", 1 << 20)
    assert L.build(sorted(many), many).bits.nbytes <= 1 << 20


# --- 3 toxicity ----------------------------------------------------------------------------------------------------------


def features_by_hand(text, toxicity):
    """The set of hashed features of a text, word by word."""
    mask = (1 << 20) - 1

    def mix(h):
        h &= 0xFFFFFFFF
        h = (h ^ h >> 16) * 0x7FEB352D & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x846CA68B & 0xFFFFFFFF
        return (h ^ h >> 16) & mask

    words = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
    import zlib

    h = [zlib.crc32(w) >> 8 for w in words]
    out = {mix(x) for x in h}
    for w in words:
        out |= {zlib.crc32(w[:k], k) & mask for k in toxicity.STEMS}
    for gap, salt in ((1, 0x9E3779B1), (2, 0x85EBCA77)):
        out |= {mix(a * salt + b) for a, b in zip(h, h[gap:], strict=False)}
    return out


def ftrl_by_hand(rows, toxicity):
    """FTRL-proximal, a coordinate at a time: the weights of the coordinates that have one, and the bias."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == "bias" else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for features, label in rows:
            own = [*features, "bias"]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - label
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if i != "bias" and weight(i)}, weight("bias")


def test_toxicity_equals_brute_force(spark):
    from lamella.llm import toxicity

    rnd = random.Random(15)
    words = ["alpha", "Beta,", "gamma", "délta", "x1", "omega!", "vile", "venom", "venomous"]
    texts = [" ".join(rnd.choices(words, [5, 5, 5, 5, 5, 5, 1, 1, 1], k=rnd.randint(0, 25))) for _ in range(400)] + [None, "", "  !! "]
    toxic = [int(bool(t) and "ven" in t) for t in texts]
    docs = frame(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    sets = [features_by_hand(t, toxicity) for t in texts]
    order = np.random.default_rng(7).permutation(len(texts))
    weights, bias = ftrl_by_hand([(sorted(sets[i]), toxic[i]) for i in order], toxicity)
    assert dict(zip(model[0].tolist(), model[1].tolist(), strict=True)) == pytest.approx(weights) and model[2] == pytest.approx(bias)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, s in enumerate(sets):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(bias + sum(weights.get(f, 0.0) for f in s)))))
    assert 0 < len(weights) < len(set().union(*sets))


def test_toxicity_sample_is_bounded_by_bytes(spark):
    from lamella.llm import toxicity

    docs = frame(spark, ["word " * 200] * 300)
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    seen = []
    real = toxicity.train
    try:
        toxicity.train = lambda rows: seen.append(len(rows)) or real(rows)
        toxicity.fit(docs, labels, max_text=50_000)
    finally:
        toxicity.train = real
    assert 20 <= seen[0] <= 90
