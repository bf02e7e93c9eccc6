"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import hashlib
import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lamella.llm import backoff_lm, language_id, line_dedup, mixing, near_groups, nearest, passage_dedup, piece_lattice, simhash, toxicity, webp
from lamella.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, name string"
LONG = "the long line of words goes on and on again " * 3000


def frame(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s0"] * len(texts))[i], None if t is None else len(t), "row", 7, "name") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = ["", None, "one two three four five six seven", "one two three four five six seven", " \t\n ", LONG, "a", "ä ö ü ß", None]


def odd(spark):
    df = frame(spark, ODD, ["en", None, "en", "en", None, "fr", "fr", "de", None], ["s1", None, "s0", "s0", None, "s2", "s1", "s1", None])
    return df.unionByName(df.filter("doc_id = 2")).unionByName(df.filter("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 nearest -----------------------------------------------------------------------------------------------------------


def exact_neighbours(ids, v, qid, k):
    s = [(-float(np.dot(x.astype(float), v[ids.index(qid)].astype(float))), i) for i, x in zip(ids, v, strict=True) if i != qid]
    return sorted(s)[:k]


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1200, 24)).astype(np.float32)
    v[100:140] = v[20]  # ties
    ids = list(range(1200))
    df = spark.createDataFrame([(i, x.tolist(), "z") for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>, id string")
    base = nearest.pack(df, "vec_id", "embedding")
    got = defaultdict(list)
    for r in nearest.search(base, base.filter("id % 50 = 0 OR id = 20"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q, rows in got.items():
        want = exact_neighbours(ids, v, q, 20)
        hits += len({i for _, i in want} & {i for i, _ in rows})
        assert all(abs(s - float(v[i].astype(float) @ v[q].astype(float))) < 1e-9 for i, s in rows)
    assert hits / (20 * len(got)) >= 0.9
    assert [i for i, _ in got[20]] == list(range(100, 120))


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [0.5, 0.0]), (20, [2.0, 0.0])]
    base = nearest.pack(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.search(base, base.filter("id % 20 = 0"), 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.0)]
    none = nearest.pack(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert nearest.search(none, none).count() == 0


# --- 2 line dedup --------------------------------------------------------------------------------------------------------


def dedup_by_hand(texts):
    seen1, seen2, out = set(), set(), []
    for t in texts:
        if t is None:
            out.append((None, 0, 0, 0))
            continue
        lines = t.split("\n")
        ink = [x for x in lines if x.strip(" \t\n\v\f\r")]
        gone = set()
        for i, x in enumerate(ink):
            if x in seen1 and len(x.split()) >= 20:
                gone.add(i)
            seen1.add(x)
        pairs = list(itertools.pairwise(ink))
        for i, p in enumerate(pairs):
            if p in seen2:
                gone |= {i, i + 1}
            seen2.add(p)
        runs = sum(i in gone and i - 1 not in gone for i in range(len(ink)))
        n, kept = 0, []
        for x in lines:
            if x.strip(" \t\n\v\f\r"):
                if n not in gone:
                    kept.append(x)
                n += 1
            else:
                kept.append(x)
        out.append(("\n".join(kept), len(ink), len(gone), runs))
    return out


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(3)
    pool = [f"line {i} " + "w " * rnd.choice([1, 3, 25]) for i in range(12)]
    texts = ["\n".join(rnd.choice([*pool, "", "  "]) for _ in range(rnd.randint(0, 9))) + f"\nown {i}" for i in range(40)] + [None, "", "\n\n", "x\ny\nx\ny\nx\ny"]
    got = {r.row.doc_id: r.dedup for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    for i, want in enumerate(dedup_by_hand(texts)):
        d = got[i]
        assert (d.text, d.n_lines, d.n_removed, d.n_runs) == want, i


def test_line_dedup_stage_deletes_short_copies(spark):
    rnd = random.Random(4)
    pool = [f"line {i}" for i in range(12)] + ["x", "a footer of six words here"]
    texts = ["\n".join(rnd.choice([*pool, ""]) for _ in range(rnd.randint(0, 6))) + f"\nown {i}" for i in range(40)] + ["x", "own 3\nown 4", None, ""]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        kept = []
        for line in (t or "").split("\n"):
            if not line.strip() or line not in seen:
                kept.append(line)
            seen.add(line)
        if any(x.strip() for x in kept) or not (t or "").strip():
            want[i] = None if t is None else "\n".join(kept)
    assert {r.doc_id: r.text for r in line_dedup.stage_docs(frame(spark, texts)).collect()} == want and 40 not in want


def test_line_dedup_odd_rows(spark):
    assert line_dedup.dedup_lines(odd(spark)).count() == odd(spark).count()
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    kept = line_dedup.stage_docs(odd(spark))
    assert kept.columns == odd(spark).columns and kept.filter("doc_id = 7").count() == 1


# --- 3 toxicity ----------------------------------------------------------------------------------------------------------


def test_toxicity_learns_words_and_stems(spark):
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = []
    for i in range(900):
        ws = [rnd.choice(words) + rnd.choice(["", "n", "s"]) for _ in range(30)]
        if i % 5 == 0:
            ws[rnd.randrange(30)] = "vilest" + rnd.choice("abcdefgh") + rnd.choice("xyz")
        rows.append((i, " ".join(ws), int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    train = docs.filter("doc_id < 600")
    model = toxicity.fit(train, train.select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(model[0]) < 2000  # sparse
    assert np.mean([(got[i] >= 0.7) == (i % 5 == 0) for i in range(600, 900)]) > 0.97


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(2, 1), (2, 0), (5, 0), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd(spark), labels)
    s = [r.score for r in toxicity.score(odd(spark), model).collect()]
    assert len(s) == odd(spark).count() and all(0 <= x <= 1 for x in s)
    blank = toxicity.fit(empty(spark), labels.limit(0))
    assert {r.score for r in toxicity.score(odd(spark), blank).collect()} == {0.5}


# --- 4 language ID -------------------------------------------------------------------------------------------------------


def slow_code_length(grams, text):
    """Bits of a text by the definition, a byte at a time, with full context dictionaries."""
    stats = defaultdict(Counter)
    for g, n in zip(*grams, strict=True):
        b = int(g).to_bytes(4, "big")
        for k in range(4):
            stats[b[3 - k : 3]][b[3]] += int(n)

    def prob(ctx, s):
        c = stats.get(ctx)
        low = (lambda x: prob(ctx[1:], x)) if ctx else (lambda x: 1 / 256)
        if not c:
            return low(s)
        total, q = sum(c.values()), len(c)
        if s in c:
            return c[s] / (total + q)
        return q / (total + q) * low(s) / (1 - sum(low(x) for x in c))

    b = b"\n\n\n" + text.encode().lower()
    return -sum(math.log2(prob(b[i - 3 : i], b[i])) for i in range(3, len(b)))


def test_ppm_code_lengths_are_exact():
    grams = {}
    for lang, text in (("aa", "the cat sat on the mat, the end" * 3), ("bb", "der hund und die katze äö" * 3)):
        b = np.frombuffer(b"\n\n\n" + text.encode(), np.uint8).astype(np.int64)
        g = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        grams[lang] = np.unique(g, return_counts=True)
    m = language_id.build(["aa", "bb"], grams)
    texts = ["the mat and zebra!", "hund", "q", "äxx the"]
    got = m.code_lengths([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, lang in enumerate(("aa", "bb")):
            assert got[i, j] == pytest.approx(slow_code_length(grams[lang], t), rel=1e-5)


def test_language_id_odd_rows(spark):
    m = language_id.fit(odd(spark))
    got = language_id.predict(odd(spark).select("doc_id", "text"), m).collect()
    assert len(got) == odd(spark).count() and {r.lang_pred for r in got if r.doc_id in (0, 1, 4, 8)} == {"und"}
    assert language_id.fit(empty(spark)) is None
    assert {r.lang_pred for r in language_id.predict(odd(spark).select("doc_id", "text"), None).collect()} == {"und"}
    kept = language_id.keep_known(odd(spark))
    assert kept.columns == odd(spark).columns and kept.filter("text IS NULL").count() == 0


# --- 5 WebP --------------------------------------------------------------------------------------------------------------


def write_code(w, lengths, size):
    """A prefix code in the normal form, lengths by symbol, all code lengths written plainly."""
    kinds = sorted({lengths.get(s, 0) for s in range(size)})
    w.write(0, 1)
    bits = max(1, (len(kinds) - 1).bit_length())
    pad = [k for k in range(16) if k not in kinds][: (1 << bits) - len(kinds)]
    used = sorted(kinds + pad)
    order = [bits if s in used else 0 for s in webp.LENGTH_ORDER]
    w.write(19 - 4, 4)
    for x in order:
        w.write(x, 3)
    w.write(0, 1)
    for s in range(size):
        put(w, used.index(lengths.get(s, 0)), bits)


def put(w, code, n):
    for k in range(n - 1, -1, -1):
        w.write(code >> k & 1, 1)


def canonical(lengths):
    code, out, last = 0, {}, 0
    for n, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - last
        out[s], last = (code, n), n
        code += 1
    return out


def plain_image(w, argb, main=True, cache=0):
    """Literals with 8-bit codes in every channel (green with two lengths)."""
    w.write(1 if cache else 0, 1)
    if cache:
        w.write(cache, 4)
    if main:
        w.write(0, 1)
    size = 280 + (1 << cache if cache else 0)
    green = {s: 8 for s in range(254)} | {254: 9, 255: 9, 256: 9, 280 if cache else 257: 9}
    eight = {s: 8 for s in range(256)}
    for lengths, n in ((green, size), (eight, 256), (eight, 256), (eight, 256)):
        write_code(w, lengths, n)
    webp._write_simple(w, [0, 1])
    codes = canonical(green)
    for p in argb:
        a, r, g, b = webp._parts(int(p))
        put(w, *codes[g])
        for c in (r, b, a):
            put(w, c, 8)
    return codes


def finished(w):
    return webp.riff(w.bytes())


@pytest.fixture
def picture():
    return np.random.default_rng(8).integers(0, 1 << 32, (9, 13), np.uint64).astype(np.uint32)


def test_webp_literals(picture):
    w = webp._header(13, 9, True)
    w.write(0, 1)
    plain_image(w, picture.ravel())
    assert (webp.decode(finished(w)) == picture).all()


def test_webp_green_and_cross_colour(picture):
    factors = np.random.default_rng(1).integers(0, 1 << 24, 3 * 4, np.uint64).astype(np.uint32) | np.uint32(0xFF000000)
    coded = webp._cross(webp._green(picture.ravel(), -1), 13, factors, 2, -1)
    w = webp._header(13, 9, True)
    w.write(1, 1), w.write(2, 2)  # subtract green, undone last
    w.write(1, 1), w.write(1, 2), w.write(0, 3)
    plain_image(w, factors, main=False)
    w.write(0, 1)
    plain_image(w, coded)
    assert (webp.decode(finished(w)) == picture).all()


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(picture, mode):
    modes = np.full(2 * 3, 0xFF000000 | mode << 8, np.uint32)
    px = picture.ravel().tolist()
    sub = lambda a, b: sum(((a >> s & 255) - (b >> s & 255) & 255) << s for s in (0, 8, 16, 24))
    coded = [sub(p, webp._prediction(px, i, i % 13, i // 13, 13, modes, 3, 2)) for i, p in enumerate(px)]
    w = webp._header(13, 9, True)
    w.write(1, 1), w.write(0, 2), w.write(1, 3)
    plain_image(w, modes[:4], main=False)
    w.write(0, 1)
    plain_image(w, coded)
    assert (webp.decode(finished(w)) == picture).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 16, 17, 200])
def test_webp_palettes(colours):
    table = np.random.default_rng(colours).integers(0, 1 << 32, colours, np.uint64).astype(np.uint32)
    index = np.random.default_rng(2).integers(0, colours, (5, 11))
    bits = webp._bundle(colours)
    each, per = 8 >> bits, 1 << bits
    wide = -(-11 // per)
    packed = np.zeros((5, wide * per), int)
    packed[:, :11] = index
    packed = (packed.reshape(5, wide, per) << np.arange(per) * each).sum(2)
    w = webp._header(11, 5, True)
    w.write(1, 1), w.write(3, 2), w.write(colours - 1, 8)
    plain_image(w, webp._palette_deltas(table, -1), main=False)
    w.write(0, 1)
    plain_image(w, 0xFF000000 | packed.ravel() << 8)
    assert (webp.decode(finished(w)) == table[index]).all()


def test_webp_back_references_and_cache():
    w = webp._header(8, 2, True)
    w.write(0, 1)
    first = [0x11223344, 0x55667788]
    codes = plain_image(w, first, cache=3)
    put(w, *codes[256])  # one pixel, by distance code 2: the one to the left
    put(w, 1, 1)
    at = (webp.CACHE_HASH * first[0] & 0xFFFFFFFF) >> 29
    filler = [0x01020304 + i for i in range(13)]
    if at == 0:
        put(w, *codes[280])
        want = [*first, first[1], first[0]]
    else:
        want = [*first, first[1]]
    for p in filler[: 16 - len(want)]:
        a, r, g, b = webp._parts(p)
        put(w, *codes[g])
        for c in (r, b, a):
            put(w, c, 8)
        want.append(p)
    got = webp.decode(finished(w)).ravel().tolist()
    assert got == want


def test_webp_distance_map():
    assert len(webp.NEAR) == 120 and webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and webp.NEAR[-1] == (8, 7)


def test_webp_stores_codes_of_several_lengths():
    rnd = random.Random(6)
    p = "".join(rnd.choices("abcdefghijklmnop", [60, *[1] * 15], k=192 * 400)).encode()
    m = webp.encode(np.frombuffer(p, np.uint8), *webp.shape(len(p)))
    assert webp.samples_of(webp.decode(m))[: len(p)].tobytes() == p
    assert len(m) < 0.3 * len(p)  # four bits a sample by codes of one length


def test_webp_code_lengths_are_limited_and_complete():
    counts = [1, 1]
    while len(counts) < 30:
        counts.append(counts[-1] + counts[-2])
    for most in (7, 15):
        lengths = webp._huffman(np.array(counts), most)
        assert lengths.max() <= most and (1 << 20 >> lengths).sum() == 1 << 20


@pytest.mark.parametrize("kind", ["grey", "words", "bytes", "copies"])
def test_webp_round_trips_of_large_images(kind):
    rng = np.random.default_rng(3)
    n = 192 * 700
    grey = np.repeat(rng.integers(0, 256, n // 3).astype(np.uint8), 3)
    words = rng.choice(np.frombuffer(b"etaoin shrdlu cmfwyp", np.uint8), n)
    p = {"grey": grey, "words": words, "bytes": rng.integers(0, 256, n).astype(np.uint8), "copies": np.tile(words[: n // 5], 5)}[kind]
    m = webp.encode(p, *webp.shape(len(p)))
    assert (webp.samples_of(webp.decode(m))[: len(p)] == p).all()
    assert len(m) < n * {"grey": 0.36, "words": 0.65, "bytes": 1.01, "copies": 0.2}[kind]
    with pytest.raises(ValueError):
        webp.decode(m[: len(m) // 2])


def test_webp_round_trips(spark):
    for t in ["", None, "a" * 700, "".join(map(chr, range(1, 900))), LONG, "é" * 96]:
        n, p = webp.payload_of(t)
        m = webp.encode(np.frombuffer(p, np.uint8), *webp.shape(len(p)))
        assert webp.samples_of(webp.decode(m))[: len(p)].tobytes() == p and len(p) % 192 == 0 and len(p) >= max(192, n)
    assert webp.shape(192 * 40_000)[1] <= webp.MOST
    for bad in (b"", b"RIFF", m[:40]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    rows = webp.load(webp.store(odd(spark))).collect()
    assert len(rows) == odd(spark).count()
    for r in rows:
        if r.doc_id is not None:
            _, p = webp.payload_of(ODD[r.doc_id])
            assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-16:]) and r.payload_bytes == len(p)
    assert webp.load(webp.store(empty(spark))).count() == 0


def test_webp_texts_are_grey_pictures_of_one_code(spark, monkeypatch):
    rnd = random.Random(8)
    part = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=1000))
    texts = [part + "?" + part + "!" + part, "\n" + "Erberte " * 300 + part, "EAT TEA " * 7 + "TEA EAT! " * 400, "é" + part + "ж" * 700, part]
    for r in webp.store(frame(spark, texts)).collect():
        _, p = webp.payload_of(texts[r.doc_id])
        image = webp.decode(bytes(r.media))
        assert image.shape[1] == webp.UNIT and image.astype("<u4").tobytes() == b"".join(bytes([x, x, x, 255]) for x in p)
        assert r.doc_id > 2 or len(r.media) < 1000  # repeats are found wherever they stand, in palettes, too
    rows = {r.doc_id: r for r in webp.load(webp.store(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert rows[i].payload_sha256 == hashlib.sha256(webp.payload_of(t)[1]).hexdigest()
    codes, own = [], webp._huffman
    monkeypatch.setattr(webp, "_huffman", lambda *a: codes.append(1) or own(*a))
    webp.stored(np.frombuffer(webp.payload_of(part)[1], np.uint8))
    assert len(codes) <= 3  # bytes, their lengths, no distances; three channels took seven


@pytest.mark.parametrize("few", [2, 3, 40])
def test_webp_repeats_are_repeats(few):
    rng = np.random.default_rng(few)
    for n in (10, 47, 48, 500, 5000, 40_000):
        px = rng.integers(0, few, n).astype(np.uint8)
        for _ in range(n // 200):
            a, b, k = rng.integers(0, n - 100, 3)
            px[a : a + k % 100] = px[b : b + k % 100]
        done = 0
        for place, back, length in webp.repeats(px):
            assert done <= place and 0 < back <= place and length >= webp.RUN and (px[place : place + length] == px[place - back : place - back + length]).all()
            done = place + length
        m = webp.encode(px, 100, -(-n // 100))
        assert (webp.read_back(m, n) == px).all()


# --- 6 SimHash -----------------------------------------------------------------------------------------------------------


def test_fingerprint_by_definition():
    assert simhash.fingerprint(None, 3) == simhash.fingerprint(" \n", 3) == 0
    assert simhash.fingerprint("Ab c", 3) == xxh64_intdigest(b"ab c", 42)
    h = [xxh64_intdigest(x, 42) for x in (b"a b c", b"b c d", b"c d e")]
    assert simhash.fingerprint("A b  c\td E", 3) == sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) > 1.5)


@pytest.mark.parametrize("hot", [2, 64])
def test_links_give_exact_components(spark, hot):
    rng = random.Random(hot)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(90)} | {0, 1 << 63, 3 << 62}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = [(i, f) for i, f in enumerate(signed)] + [(1000, signed[0]), (None, signed[1])]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    old, simhash.HOT_BUCKET = simhash.HOT_BUCKET, hot
    try:
        distinct = prints.select("fp").distinct()
        roots = {r.node: r.root for r in connected_components(simhash.links(distinct, hot)).collect()}
    finally:
        simhash.HOT_BUCKET = old
    group = list(range(len(fps)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            group[top(i)] = top(j)
    want = {frozenset(signed[i] for i in range(len(fps)) if top(i) == t) for t in {top(i) for i in range(len(fps))}}
    got = defaultdict(set)
    for f in signed:
        got[roots.get(f, f)].add(f)
    assert set(map(frozenset, got.values())) == want


def test_simhash_odd_rows(spark):
    rows = simhash.cluster(odd(spark), 3).collect()
    assert len(rows) == odd(spark).count()
    assert {r.component_id for r in rows if r.fp == 0} == {0}
    assert {r.component_id for r in rows if r.doc_id in (2, 3)} == {2}
    assert simhash.cluster(empty(spark), 3).count() == 0


def test_near_groups_find_similar_texts(spark):
    rnd = random.Random(9)
    texts = []
    for _ in range(30):
        ws = [str(rnd.randrange(10**6)) for _ in range(300)]
        other = ws.copy()
        for k in rnd.sample(range(300), 3):
            other[k] = "changed"
        texts += [" ".join(ws), " ".join(other)]
    alone = [" ".join(str(rnd.randrange(10**6)) for _ in range(200)) for _ in range(30)]
    kept = {r.doc_id for r in near_groups.one_of_each(frame(spark, texts + alone + ["", None, texts[0]])).collect()}
    assert kept >= set(range(60, 90)) and all(i in kept for i in range(0, 60, 2)) and len(kept & set(range(1, 60, 2))) <= 1
    assert 92 not in kept and len({90, 91} & kept) == 1
    assert near_groups.one_of_each(odd(spark)).columns == odd(spark).columns and near_groups.one_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("tile", [1024, 200])
def test_near_groups_find_pairs_inside_a_large_family(spark, monkeypatch, tile):
    """Members of the family share blocks and are alike below the similarity, so that no pivot links a planted pair's two."""
    monkeypatch.setattr(near_groups, "TILE", tile, raising=False)
    rng = np.random.default_rng(8)
    n, planted, close = 1500, 60, 40
    in_block = np.arange(near_groups.BITS) < 640  # blocks come from these
    flip = lambda x, block, rest: x ^ (rng.random(x.shape) < np.where(in_block, block, rest))
    family = flip(np.tile(rng.random(near_groups.BITS) < 0.5, (n, 1)), 0.03, 0.18)
    rows = np.concatenate([family, flip(family[:planted], 0.05, 0.12), flip(np.tile(family[n - 1], (close, 1)), 0.01, 0.03)])
    found = spark.createDataFrame([(i, np.packbits(x).tobytes()) for i, x in enumerate(rows)], "cls long, fp binary")
    root = {r.cls: r.root for r in near_groups.groups(found).collect()}
    assert len(root) == len(rows)
    assert sum(root[n + i] == i for i in range(planted)) == planted
    assert sum(root[n + planted + i] == n - 1 for i in range(close)) == close
    assert all(root[i] == i for i in range(n))


# --- 7 passage dedup -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(passage_dedup, "BLOCK_BYTES", 8000)
    rnd, length = random.Random(seed), passage_dedup.LENGTH
    base = ["".join(rnd.choice("abcdefgh ij") for _ in range(rnd.choice([50, 300, 900, 2500]))) for _ in range(12)]
    texts = []
    for _ in range(50):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            x = rnd.choice(base)
            a = rnd.randint(0, len(x))
            parts.append(x[a : rnd.randint(a, len(x))] if rnd.random() < 0.7 else "".join(rnd.choice("xyz") for _ in range(200)))
        texts.append("".join(parts))
    texts += [texts[0], texts[3], None, "", "a" * 1500, "é" * 450, "ab" * 300 + "q", "b" * 100 + "a" * 450]
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    got = {r.doc_id: r for r in passage_dedup.remove_repeats(frame(spark, texts)).collect()}
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()), i


def test_passages_odd_rows(spark):
    assert passage_dedup.remove_repeats(odd(spark)).count() == odd(spark).count()
    assert passage_dedup.remove_repeats(empty(spark)).count() == 0


def test_passages_of_texts_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(passage_dedup, "PIECE_BYTES", 1500)
    test_passages_equal_brute_force(spark, 3, monkeypatch)


def test_passage_blocks_are_hashed_a_piece_at_a_time():
    rng = np.random.default_rng(4)
    ends = np.cumsum(rng.integers(0, 4000, 1600))
    data = rng.integers(97, 105, ends[-1]).astype(np.uint8)
    tracemalloc.start()
    own = list(passage_dedup.pieces(data, ends))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(data)  # the sums alone take 8
    whole = passage_dedup.Parse(data, ends)
    assert sum(len(p.ends) for p in own) == len(ends) and (np.concatenate([p.reach_hash for p in own]) == whole.reach_hash).all()


# --- 8 mixing ------------------------------------------------------------------------------------------------------------


def test_mix_meets_targets(spark):
    rnd = random.Random(4)
    texts = ["w " * rnd.randint(1, 60) for _ in range(400)]
    sources = [rnd.choice(["a", "b", "c", "c", "c", "c", "c", "c", None]) for _ in texts]
    labels = spark.createDataFrame([(i, rnd.randint(0, 1)) for i in range(0, 400, 3)] + [(0, 1), (None, 1)], "doc_id long, quality int")
    rows = mixing.mix_documents(frame(spark, texts, sources=sources), labels).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = sources[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.size == len(texts[r.doc_id].split())
    total, weights = sum(size.values()), dict(zip(["a", "b", "c", None], [1, 2, 3, 1], strict=True))
    want, open_ = {}, set(size)
    while True:  # water filling by rounds
        level = (total - sum(want.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 3 * size[s]}
        if not full:
            break
        want |= {s: 3 * size[s] for s in full}
        open_ -= full
    want |= {s: weights[s] * level for s in open_}
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1


def test_mix_odd_rows(spark):
    labels = spark.createDataFrame([(2, None), (5, 1)], "doc_id long, quality int")
    assert mixing.mix_documents(odd(spark), labels).count() == odd(spark).count()
    assert mixing.mix_documents(empty(spark), labels).count() == 0
    out = mixing.mixed_rows(odd(spark), labels)
    assert out.columns == odd(spark).columns and out.filter("text IS NULL").count() == 0


# --- 9 pieces ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lattice():
    return piece_lattice.Lattice(piece_lattice.read_pieces())


def all_paths(lattice, s):
    arcs = lattice.arcs(s)

    def go(end):
        if end == 0:
            yield 0.0, ()
        for a, v, ids in arcs[end]:
            for score, rest in go(a):
                yield score + v, rest + ids

    return sorted(go(len(s)), key=lambda x: -x[0])


@pytest.mark.parametrize("s", ["▁thein", "▁wor", "hatin▁thi", "▁▁a▁de", "é▁ü", "🙂"])
def test_n_best_equals_all_paths(lattice, s):
    want, got = all_paths(lattice, s), lattice.nbest(s, 6)
    assert [round(x, 9) for x, _ in got] == [round(x, 9) for x, _ in want[:6]]
    assert len({ids for _, ids in got}) == len(got)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_merged_lists_equal_whole_search(lattice, n):
    text = "the in. of"
    want = all_paths(lattice, "▁" + text.replace(" ", "▁"))[:n]
    assert [round(x, 9) for x, _ in lattice.nbest_text(text, n)] == [round(x, 9) for x, _ in want]


@pytest.mark.parametrize("text", ["", " ", "  a", " ▁x▁ ", "日本語\n\n\t", "a\n", "\0 😀", "Hello, world's end.\nNew line  here", LONG])
def test_decoding_gives_back(lattice, text):
    assert lattice.decode(lattice.encode(text).tolist()) == text


def test_pieces_agree_with_the_public_decoder(lattice):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.MODEL)
    text = "The quick brown fox, naïve."
    assert p.decode(lattice.encode(text).tolist()) == text


def test_pieces_odd_rows(spark):
    rows = piece_lattice.digests(odd(spark)).collect()
    assert len(rows) == odd(spark).count() and all(r.exact for r in rows)
    enc = {r.doc_id: r for r in piece_lattice.encode(odd(spark)).collect()}
    assert enc[1].tokens is None and enc[0].tokens == [] and enc[5].decoded_bytes == len(LONG)
    assert piece_lattice.digests(empty(spark)).count() == 0


# --- 10 language model ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [20, 10**6])
def test_backoff_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(backoff_lm, "BUCKET_KEYS", 300)
    monkeypatch.setattr(backoff_lm, "HOT", hot)
    monkeypatch.setattr(backoff_lm, "HOT_CONTEXTS", 10**9)
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(80)]
    texts = [" ".join(rnd.choices(vocabulary, [1 / (i + 1) for i in range(80)], k=rnd.randint(0, 60))) + (" new" * (i % 11 == 0)) for i in range(120)] + [None, "", "W0  w0\tw0"]
    docs = frame(spark, texts).withColumn("held_out", F.col("doc_id") % 7 == 2)
    words = [[*(t or "").lower().split(), None] for t in texts]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, ws in enumerate(words):
        if i % 7 != 2:
            uni.update(ws)
            for a, b in zip([0, *ws], ws, strict=False):
                bi[a, b] += 1
                ctx[a] += 1
    n, v = sum(uni.values()), len(uni)
    d1, d2 = (backoff_lm.discounts([Counter(c.values())[r] for r in range(1, 7)]) for c in (uni, bi))
    take = lambda c, d: c - 0.01 if c > 5 else d[c] * c
    unknown = 1 - sum(take(c, d1) for c in uni.values()) / n
    p1 = lambda w: take(uni[w], d1) / n if uni[w] else unknown
    followers = defaultdict(list)
    for (a, b), c in bi.items():
        followers[a].append((b, c))

    def p2(a, b):
        if not ctx[a]:
            return p1(b)
        if bi[a, b]:
            return take(bi[a, b], d2) / ctx[a]
        return (1 - sum(take(c, d2) for _, c in followers[a]) / ctx[a]) / (1 - sum(p1(w) for w, _ in followers[a])) * p1(b)

    everything = [*uni, "never"]
    for a in [0, "w0", "w50"]:
        assert sum(p2(a, b) for b in everything) == pytest.approx(1)
    got = {r.doc_id: r for r in backoff_lm.score(docs).collect()}
    for i, ws in enumerate(words):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(uni[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score == pytest.approx(sum(math.log10(p2(a, b)) for a, b in zip([0, *ws], ws, strict=False)), rel=1e-9)


def test_backoff_odd_rows(spark):
    docs = odd(spark).withColumn("held_out", F.lit(False))
    assert backoff_lm.score(docs).count() == odd(spark).count()
    none = backoff_lm.score(docs.withColumn("held_out", F.lit(True))).collect()
    assert {r.score for r in none} == {0.0} and {r.n_known for r in none} == {0}
    assert backoff_lm.score(docs.limit(0)).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline_runs_and_follows_its_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(2)
    mix = ["the of and to in is", "le la les des une est"]
    texts = [" ".join(rnd.choice(mix[i % 2].split()) + rnd.choice(["", "", str(rnd.randrange(999))]) for _ in range(80)) for i in range(60)] + ["123 456", None, ""]
    docs = frame(spark, texts, ["en", "fr"] * 31 + [None], ["a", "b", None] * 21)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing to target weights", "SentencePiece encoding"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= set(range(60)) and all(r.n_tokens == len(r.tokens) for r in out)
