"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a context tree of byte contexts up to ``ORDER`` long. In a context with N symbols
seen, q of them different, a seen symbol has probability n / (N + q); an unseen one costs the escape
q / (N + q) and is then coded in the context one byte shorter, whose distribution excludes the symbols
already refused. Below the empty context all 256 bytes are equally likely. Statistics are frozen after
fitting, so the exact code length of a byte depends on the last ORDER bytes only. The trees of all
languages share one suffix-closed node set, so that a text is scored by table look-ups: an automaton
step per context byte, then one row holding the bits in every language.

Fitting uses a repeatable sample of about ``sample_docs`` labelled documents a language (whole texts);
the table is bounded by ``TABLE_BYTES``. Contexts are kept by their rank within the language that uses them
most, so that each language has equal room, however short its texts; those beyond the room are coded in
shorter contexts. Any number of languages is told apart, at shorter contexts the more there are.

Defined results: null text, and text without a letter, gives ``und`` with score 0; ties go to the
smaller language name; without any labelled document all texts are ``und``; null ids count as not held
out; repeated rows are scored one by one; other columns pass by. The score is the posterior of the
predicted language under equal priors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, documents, id_mod, slices, small_batches

ORDER = 3
SAMPLE_DOCS = 1500
#: Bytes of text coded at a time in the pipeline, whose workers keep other stages' tables, too.
STEP_BYTES = 1 << 18
TABLE_BYTES = 64 << 20  # of the broadcast code lengths; four languages leave room for some 50,000 contexts
UNDETERMINED = "und"
_LEAD = b"\n" * ORDER
_SLICE = 1 << 19
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


@dataclass
class PpmModel:
    languages: list[str]
    classes: np.ndarray  # byte -> symbol class
    step: np.ndarray  # [node, class] -> longest context after the symbol
    bits: np.ndarray  # [node * n_classes + class, language]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        if not texts:
            return out
        joined = np.frombuffer(b"".join(_LEAD + t.translate(ASCII_LOWER) for t in texts), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER
        ends = np.cumsum(lengths)
        n = self.step.shape[1]
        flat = self.step.ravel()
        for at in range(ORDER, len(joined), _SLICE):
            part = self.classes[joined[at - ORDER : at + _SLICE]]
            state = flat[part[: len(part) - ORDER]]
            for k in range(1, ORDER):
                state = flat[state * n + part[k : len(part) - ORDER + k]]
            cost = self.bits[state * n + part[ORDER:]]
            first = int(np.searchsorted(ends, at, side="right"))
            last = int(np.searchsorted(ends, at + len(cost) - 1, side="right"))
            own = np.arange(first, last + 1)
            # a text's own bytes in this slice, without the lead before it
            lo = np.clip(ends[own] - lengths[own] + ORDER - at, 0, len(cost))
            hi = np.clip(ends[own] - at, 0, len(cost))
            full = hi > lo
            if full.any():
                cuts = np.stack([lo[full], hi[full]], 1).ravel()
                padded = np.concatenate([cost, np.zeros((1, cost.shape[1]), cost.dtype)])
                out[own[full]] += np.add.reduceat(padded, cuts, axis=0, dtype=np.float64)[::2]
        return out


def _gram_counts(batches):
    """(lang, text) to (lang, gram, n): windows of ORDER + 1 bytes as one number."""
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(_LEAD + text.encode().translate(ASCII_LOWER))
        for lang, texts in by.items():
            parts = []
            for t in texts:
                b = np.frombuffer(t, np.uint8).astype(np.int64)
                g = b[: len(b) - ORDER]
                for k in range(1, ORDER + 1):
                    g = (g << 8) | b[k : len(b) - ORDER + k]
                parts.append(g)
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])


def build(languages: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]], max_nodes: int | None = None) -> PpmModel:
    """The frozen tables from each language's counts of (ORDER + 1)-byte windows."""
    seen = np.unique(np.concatenate([g & 255 for g, _ in grams.values()] + [np.array([10])]))
    classes = np.full(256, len(seen), np.int32)
    classes[seen] = np.arange(len(seen))
    n_cls = len(seen) + 1  # the last stands for each byte never seen
    max_nodes = max_nodes or max(1, TABLE_BYTES // (4 * n_cls * len(languages)))
    # each context's best rank by frequency in any language
    levels: list[dict[int, int]] = []
    for k in range(ORDER + 1):
        best: dict[int, int] = {}
        for g, n in grams.values():
            keys, inv = np.unique((g >> 8) & ((1 << 8 * k) - 1), return_inverse=True)
            order = np.lexsort((keys, -np.bincount(inv, n, minlength=len(keys))))
            for place, c in enumerate(keys[order].tolist()):
                best[c] = min(place, best.get(c, place))
        levels.append(best)
    kept: list[dict[int, int]] = [{0: 0}]
    count = 1
    for k in range(1, ORDER + 1):  # only contexts whose suffix is kept, so that the set is suffix-closed
        room = max_nodes - count
        ranked = sorted((x for x in levels[k].items() if k == 1 or (x[0] & ((1 << 8 * (k - 1)) - 1)) in kept[k - 1]), key=lambda x: (x[1], x[0]))[: max(0, room)]
        kept.append({c: count + i for i, (c, _) in enumerate(ranked)})
        count += len(ranked)
    bits = np.empty((count, n_cls, len(languages)), np.float32)
    for j, lang in enumerate(languages):
        g, n = grams[lang]
        prob = np.empty((count, n_cls))
        base = np.full(n_cls, 1 / 256)
        for k in range(ORDER + 1):
            ctx = (g >> 8) & ((1 << 8 * k) - 1)
            nodes = np.fromiter((kept[k].get(c, -1) for c in ctx.tolist()), np.int64, len(ctx))
            ok = nodes >= 0
            ids = np.fromiter(kept[k].values(), np.int64, len(kept[k]))
            low = ids.min() if len(ids) else 0
            table = np.zeros((len(ids), n_cls))
            np.add.at(table, (nodes[ok] - low, classes[g[ok] & 255]), n[ok])
            if k == 0:
                below = base[None, :]
            else:
                below = prob[[kept[k - 1][c & ((1 << 8 * (k - 1)) - 1)] for c in kept[k]]] if len(ids) else np.zeros((0, n_cls))
            total, q = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
            size = np.ones(n_cls)
            size[-1] = 256 - len(seen)  # bytes in the class of the unseen
            left = 1 - (below * size * (table > 0)).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                escaped = np.where(total > 0, q / (total + q) * below / np.maximum(left, 1e-12), below)
                prob[ids] = np.where(table > 0, table / (total + q), escaped)
        bits[:, :, j] = -np.log2(np.maximum(prob, 1e-30))
    step = np.zeros((count, n_cls), np.int32)
    byte_of = [*seen.tolist(), -1]
    for k in range(ORDER + 1):
        for c, node in kept[k].items():
            for s, byte in enumerate(byte_of):
                if byte < 0:
                    continue
                w = ((c << 8) | byte) & ((1 << 8 * ORDER) - 1)
                for m in range(min(k + 1, ORDER), -1, -1):
                    to = kept[m].get(w & ((1 << 8 * m) - 1))
                    if to is not None:
                        step[node, s] = to
                        break
    return PpmModel(languages, classes, step, bits.reshape(count * n_cls, len(languages)))


def fit(rows: DataFrame, sample_docs: int = SAMPLE_DOCS, max_nodes: int | None = None) -> PpmModel | None:
    """(doc_id, text, lang) rows to a model; None without labelled texts."""
    rows = rows.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return None
    # one scan, with a threshold on the id's hash for each language
    share = F.create_map(*[x for lang, n in per.items() for x in (F.lit(lang), F.lit(int(min(1.0, sample_docs / n) * (1 << 30))))])
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 30)) < share[F.col("lang")])
    counted = sample.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, gram, n = np.array(counted["lang"].to_pylist(), object), counted["gram"].to_numpy(), counted["n"].to_numpy()
    languages = sorted(set(langs.tolist()))
    if not languages:
        return None
    return build(languages, {x: (gram[langs == x], n[langs == x]) for x in languages}, max_nodes)


def judge(texts: list[str | None], model: PpmModel | None) -> tuple[list, np.ndarray, list]:
    """Predicted language, its posterior and bits a byte of each text."""
    pred, posterior, rate = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [None] * len(texts)
    at = [i for i, t in enumerate(texts) if t and has_letter(t)] if model else []
    raw = [texts[i].encode() for i in at]
    for i, t, bits in zip(at, raw, model.code_lengths(raw) if at else (), strict=True):
        best = int(bits.argmin())
        pred[i] = model.languages[best]
        posterior[i] = 1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()
        rate[i] = float(bits[best]) / len(t)
    return pred, posterior, rate


def predict(rows: DataFrame, model: PpmModel | None, step_bytes: int | None = None) -> DataFrame:
    """(any column, text) rows to that column, lang_pred, score, bits_per_byte. Texts are coded a batch at a time, or so many bytes at a time."""
    kept = rows.columns[0]
    kind = rows.schema[kept].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches if step_bytes is None else (x for batch in batches for x in slices(batch, 1, step_bytes)):
            pred, posterior, rate = judge(b.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(posterior), pa.array(rate, pa.float64())], [kept, "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(run, f"`{kept}` {kind}, lang_pred string, score double, bits_per_byte double")


def keep_known(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The documents whose language is told, all columns; a null lang gets the prediction."""
    small_batches(docs.sparkSession, 200)
    model = fit(docs.filter(id_mod("doc_id", 4) != 2))
    found = predict(docs.select(F.struct("*").alias("row"), "text"), model, STEP_BYTES).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))
    return found.select(*[(F.coalesce("row.lang", "lang_pred") if c == "lang" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir)
    held = id_mod("doc_id", 4) == 2
    model = fit(docs.filter(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
