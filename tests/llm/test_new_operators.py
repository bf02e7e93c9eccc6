"""MinHash groups, conversation repair and Merkle manifests against brute force, and on odd rows."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import merkle, minhash, tiles, turn_repair
from lamella.llm.near_groups import shingle_set

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls long, root string, grp long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, "r", 1) for i, t, s in rows], DOCS)


ODD = [(5, None, "a"), (3, "", None), (4, " \t\n", "a"), (9, "one two", "a"), (8, "one  TWO", "b"), (2, "x " * 30_000, "a"), (2, "x " * 30_000, "a"), (None, "one two", None), (7, "ä ö ü ß é", "ä"), (6, "b c d e f\ng", "")]


# --- 11 MinHash -----------------------------------------------------------------------------------------------------------


def groups_by_hand(rows):
    sets = [set(shingle_set(t, 4).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)].append(d)
    return {(d, len(sets[i]), min(low[top(i)], default=None), d is not None and d == min(low[top(i)])) for i, (d, _) in enumerate(rows)}


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple((x is not None, x) for x in t))


def clustered(df):
    return {tuple(r) for r in minhash.cluster(df).select("doc_id", "n_shingles", "component_id", "kept").collect()}


@pytest.mark.parametrize("tile", [1024, 16])
def test_minhash_groups_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(tiles, "TILE", tile)
    rng = random.Random(tile)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n + i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(40)]
    rows += [(n + 100, rows[0][1].upper()), (n + 101, rows[0][1])]
    rng.shuffle(rows)
    assert clustered(docs_of(spark, [(d, t, "a") for d, t in rows])) == groups_by_hand(rows)


def test_minhash_of_the_documents_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert clustered(df) == groups_by_hand([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_minhash_odd_rows(spark):
    df = docs_of(spark, ODD)
    assert clustered(df) == groups_by_hand([(d, t) for d, t, _ in ODD])
    assert minhash.cluster(df).count() == len(ODD)
    assert minhash.cluster(df.limit(0)).count() == 0


def test_tensored_tables_miss_few_pairs():
    rng, by = np.random.default_rng(1), minhash.multipliers()
    missed = 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 360, dtype=np.uint64)
        x, y = pool[:324], np.append(pool[:288], pool[324:360])  # 288 of 360: 0.8
        sig = np.stack([minhash.minhashes(np.unique(s), by) for s in (x, y)])
        keys = minhash.half_keys(sig)
        missed += not ((keys[0] == keys[1]).any() and minhash.alike(sig[:1].view(np.uint8), sig[1:].view(np.uint8))[0, 0])
    assert missed <= 1


# --- 12 conversations -----------------------------------------------------------------------------------------------------


def repaired_by_search(rows):
    """Least (cost, audit) over all edit strings, by a best-first search that carries the strings, and the repaired lines.

    rows are (role, text, kind) after damage."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(lines)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        other = 3 if state == 2 else 2
        name = {2: "user", 3: "assistant"}[other]
        heapq.heappush(heap, (cost + 2, audit + "I", at, other, (*lines, f"{name}:")))
        if at < len(rows):
            role, text, kind = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, lines))
            if kind not in ("blank", "duplicate"):
                extra = kind == "truncated"
                to = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(role[:1])
                if to is not None:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, to, (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, other, (*lines, f"{name}:{text}")))
    raise AssertionError


def by_hand(rows):
    """(conv_id, turn, role, text) rows to the contract's results."""
    kept = defaultdict(list)
    for c, t, r, x in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        r, x, by = " " if r is None else r, " " if x is None else x, zlib.crc32(key.encode()) % 20
        kept[c] += [] if by == 0 else [(t, "user" if by == 4 else r, "" if by == 1 else "".join(ch for ch in x if ch not in ".!?") if by == 2 else x)] * (2 if by == 3 else 1)
    out = {}
    for c, found in kept.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, r, x in found:
            body = x.strip(" \t\n\v\f\r")
            marked.append((r, x, "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((r, x))
        turns = [t for t, _, _ in found if t is not None]
        cost, audit, text = repaired_by_search(marked)
        kinds = [k for _, _, k in marked]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, kind long, grp string, row string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 3, "g", "x") for r in rows], CONVERSATIONS)


def mended(df, **settings):
    rows = turn_repair.repair(turn_repair.damaged(df), **settings).select("conv_id", *turn_repair.RESULT).collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def random_talk(rng, conversations, turns):
    texts = ["Yes.", "no", "Why?", " ", "", "a b c", "Done!\n", "ä", None]
    return [(c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)) for c in range(conversations) for t in range(rng.randrange(1, turns)) if rng.random() > 0.1]


@pytest.mark.parametrize("chunk,fan", [(4096, 256), (3, 2), (1, 3)])
def test_repair_equals_search_with_strings(spark, chunk, fan):
    rng = random.Random(chunk)
    rows = random_talk(rng, 150, 9) + [(1000, t, r, x) for _, t, r, x in random_talk(rng, 1, 60)]
    rows += [(2000, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(200)]
    rng.shuffle(rows)
    got, want = mended(conversations(spark, rows), chunk=chunk, fan=fan), by_hand(rows)
    assert got == want


def test_repair_of_the_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in turn_repair.query(spark, SF).select("conv_id", *turn_repair.RESULT).collect()}
    assert got == by_hand(rows)


def test_repair_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", None), (2, 5, "user", "x " * 50_000), (2, 5, "user", "x " * 50_000), (2, 6, "assistant", "y."), (3, 1, "", "")]
    assert mended(conversations(spark, rows)) == by_hand(rows)
    assert mended(conversations(spark, rows).limit(0)) == {}


def test_codes_are_prefix_free_and_ordered():
    assert turn_repair.CODES == ["D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R"]
    assert not any(a != b and b.startswith(a) for a in turn_repair.CODES for b in turn_repair.CODES)


# --- 13 Merkle ------------------------------------------------------------------------------------------------------------


def hexed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root and the siblings of each leaf, by the definition."""
    proofs, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, c in enumerate(at):
            base = c // 3 * 3
            proofs[i] += [x for k, x in enumerate(nodes[base : base + 3], base) if k != c]
        nodes = [hexed(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [c // 3 for c in at]
    return (nodes[0] if nodes else None), proofs


def leaf_by_hand(doc_id, source, lang, n_chars, text):
    return hexed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def manifest_by_hand(rows):
    """(doc_id, source, lang, n_chars, text) rows to sorted (doc_id, leaf, subroot, root, proof_sha256, verified)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf_by_hand(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    root, upper = tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, upper, strict=True):
        for (_, _, leaf, r), proof in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None and "\n" in r[4]
            out.append((r[0], leaf, trees[s][0], root, hexed(*proof, *above), not tampered))
    return sorted(out, key=lambda x: (x[0] is not None, *[v for v in x if v is not None]))


def manifest(df, **settings):
    found = merkle.manifest(merkle.tampered_leaves(df), **settings)
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "verified").collect()), key=lambda x: (x[0] is not None, *[v for v in x if v is not None]))


@pytest.mark.parametrize("chunk,span", [(3**8, 6), (5, 2), (1, 1), (27, 3)])
def test_manifest_equals_definition(spark, chunk, span):
    rng = random.Random(chunk)
    rows = [(i, rng.choice(["hot"] * 10 + ["a", "b", None, "ä", ""]), "en", 3, rng.choice(["x\ny", "z", None, ""])) for i in range(140)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert manifest(df, chunk=chunk, span=span) == manifest_by_hand(rows)


def test_manifest_of_the_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in df.select(*merkle.FIELDS).collect()]
    assert manifest(df) == manifest_by_hand(rows)


def test_manifest_proofs_fold_to_the_root_and_find_changes(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for r in merkle.manifest(merkle.tampered_leaves(df), chunk=9, span=2).limit(60).collect():
        sub, used = merkle.fold(r.leaf.encode(), r["at"], r.source_total, bytes(r.proof))
        assert sub.decode() == r.subroot
        root, end = merkle.fold(sub, r.source_at, r.sources, bytes(r.proof), used)
        assert root.decode() == r.root and end == len(r.proof)
        assert hashlib.sha256(r.proof).hexdigest() == r.proof_sha256
        assert r.verified == (r.folded_root == r.root)
        assert merkle.fold(b"0" * 64, r["at"], r.source_total, bytes(r.proof))[0].decode() != r.subroot


def test_manifest_odd_rows(spark):
    df = docs_of(spark, ODD)
    rows = [(d, s, "en", None if t is None else len(t), t) for d, t, s in ODD]
    assert manifest(df) == manifest_by_hand(rows)
    assert manifest(df, chunk=1, span=1) == manifest_by_hand(rows)
    assert manifest(df.limit(0)) == []
    assert len(manifest(df.filter("doc_id = 7"))) == 1


# --- pipeline --------------------------------------------------------------------------------------------------------------


def test_near_dedup_stage_keeps_one_of_each_group_of_the_documents(spark):
    from lamella.llm import near_groups

    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    sets = [set(shingle_set(t, 5).tolist()) for _, t in rows]
    near = {i: {j for j in range(len(rows)) if (sets[i] or sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} | ({j for j in range(len(rows)) if not sets[j]} if not sets[i] else set()) for i in range(len(rows))}
    kept = {r.doc_id for r in near_groups.one_of_each(df).select("doc_id").collect()}
    gone = [i for i, (d, _) in enumerate(rows) if d not in kept]
    assert all(len(near[i]) > 1 for i in gone)  # none goes without a near copy
    left = [i for i, (d, _) in enumerate(rows) if d in kept]
    pairs = sum(j in near[i] for i in left for j in left if j > i)
    assert gone and pairs <= 0.1 * len(gone)


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, df in (("empty", docs_of(spark, ODD).limit(0)), ("odd", docs_of(spark, ODD))):
        (tmp_path / name).mkdir()
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            assert f(spark, docs, f"{tmp_path}/{name}").columns == docs.columns, stage
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in out} <= {d for d, _, _ in ODD} and (out == []) == (name == "empty")
