"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded,
hash-ordered sample of labelled rows. It labels every byte position of the whole
text, in chunks of ``STEPS`` bytes whose states start anew; the document's
probabilities are the mean of those of its positions.

Defined results: null text or text without a letter gives ``und`` with score 0;
rows with a null id count as not held out; repeated rows get equal answers; an
empty training set (no label at all) makes every text ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlake.llm.common import bound_batches

HIDDEN, STEPS = 8, 64
BLOCK = 4096  # chunks of STEPS bytes that are run at once
LABELS = 512  # languages that are learned at most, the most frequent ones
WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and number signs like the half and the circled one


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_lang: int = 300, labels: int = LABELS) -> dict[str, list[str]]:
    """At most ``per_lang`` whole texts for each of the ``labels`` most frequent languages,
    from rows that aren't held out, in the order of a hash of id and text: the number of
    rows does not grow with the table, whatever ids repeat and however many labels it has."""
    fit = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = [(r[0], r[1]) for r in fit.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(labels).collect()]
    if not counts:
        return {}
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 2.0 * per_lang / n)) for lang, n in counts], "lang string, share double")
    # each task keeps per_lang rows of a language at most before anything is shuffled
    first = F.row_number().over(Window.partitionBy("lang").orderBy("u", "x"))
    few = fit.join(F.broadcast(shares), "lang").where(unit < F.col("share"))
    rows = few.select("lang", unit.alias("u"), F.col("text").alias("x")).withColumn("n", first).where(F.col("n") <= per_lang).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.u, r.x)):
        out.setdefault(r.lang, []).append(r.x)
    return out


def _gates(x: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step: x, the byte's column block (3H, B), is overwritten. Returns the
    reset and update gates, the candidate, the recurrent part and the new state."""
    n = h.shape[0]
    g = u @ h
    rz = x[: 2 * n]
    rz += g[: 2 * n]
    np.clip(rz, 0, 1, out=rz)
    q = x[2 * n :]
    q += rz[:n] * g[2 * n :]
    np.tanh(q, out=q)
    return rz[:n], rz[n:], q, g[2 * n :], q + rz[n:] * (h - q)


class ByteGru:
    """Weights by direction: ``w`` (3H, 256) for the byte, ``u`` (3H, H) for the
    state; ``wo`` (L, 2H) and ``bo`` (L, 1) give a position's label scores."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            w = rng.normal(0, 0.3, (3 * hidden, 256))
            w[: 2 * hidden] += 0.5
            self.p["w" + d] = w.astype("f4")
            self.p["u" + d] = rng.normal(0, 0.5 / np.sqrt(hidden), (3 * hidden, hidden)).astype("f4")
        self.p["wo"] = rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype("f4")
        self.p["bo"] = np.zeros((len(langs), 1), "f4")

    def _run(self, x: np.ndarray, d: str, mask: np.ndarray | None, keep: bool) -> list:
        """States by step; x (B, T) bytes, mask (T, B) or None."""
        t_all = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        h = np.zeros((self.hidden, x.shape[0]), "f4")
        out: list = [None] * x.shape[1]
        for t in t_all:
            r, z, q, gn, new = _gates(self.p["w" + d].take(x[:, t], axis=1, mode="clip"), self.p["u" + d], h)
            if mask is not None:
                new *= mask[t]
            out[t] = (r, z, q, gn, h, new) if keep else new
            h = new
        return out

    def train_step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients over chunks x (B, T) with labels y (B)."""
        n, (size, steps) = self.hidden, x.shape
        runs = {d: self._run(x, d, None, True) for d in "fb"}
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        back = {d: [None] * steps for d in "fb"}
        loss, scale = 0.0, 1.0 / (size * steps)
        for t in range(steps):
            h = np.concatenate([runs["f"][t][5], runs["b"][t][5]])
            o = self.p["wo"] @ h + self.p["bo"]
            o -= o.max(0)
            e = np.exp(o)
            e /= e.sum(0)
            loss -= np.log(e[y, np.arange(size)] + 1e-9).sum() * scale
            e[y, np.arange(size)] -= 1
            e *= scale
            grad["wo"] += e @ h.T
            grad["bo"] += e.sum(1, keepdims=True)
            dh = self.p["wo"].T @ e
            back["f"][t], back["b"][t] = dh[:n], dh[n:]
        for d in "fb":
            u, dx_all, carry = self.p["u" + d], np.empty((steps, 3 * n, size), "f4"), np.zeros((n, size), "f4")
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                r, z, q, gn, prev, _ = runs[d][t]
                dh = back[d][t] + carry
                dq = dh * (1 - z) * (1 - q * q)
                dz = dh * (prev - q) * ((z > 0) & (z < 1))
                dr = dq * gn * ((r > 0) & (r < 1))
                dg = np.concatenate([dr, dz, dq * r])
                dx_all[t] = np.concatenate([dr, dz, dq])
                grad["u" + d] += dg @ prev.T
                carry = dh * z + u.T @ dg
            flat, cols = x.T.ravel(), dx_all.transpose(1, 0, 2).reshape(3 * n, -1)
            for i in range(3 * n):
                grad["w" + d][i] += np.bincount(flat, weights=cols[i], minlength=256).astype("f4")
        return loss, grad

    def fit(self, sample: dict[str, list[str]], rounds: int = 450, batch: int = 256, rate: float = 0.02, seed: int = 11) -> ByteGru:
        rng = np.random.default_rng(seed)
        pools = []
        for lang in self.langs:
            raw = [np.frombuffer(s.encode(), np.uint8) for s in sample[lang] if has_letter(s)]
            joined = np.concatenate([*raw, np.zeros(STEPS, np.uint8)]) if raw else np.zeros(STEPS + 1, np.uint8)
            pools.append(joined)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, rounds + 1):
            y = rng.integers(0, len(self.langs), batch)
            x = np.stack([pools[k][(s := rng.integers(0, len(pools[k]) - STEPS + 1)) : s + STEPS] for k in y])
            _, grad = self.train_step(x, y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * min(1.0, 2.0 * (1 - step / (rounds + 1)))
            for k, g in grad.items():
                g *= min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        return self

    def positions(self, x: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Sums of the positions' probabilities by chunk (L, B); x (B, T), lens (B)."""
        n, steps = self.hidden, x.shape[1]
        mask = None if (lens == steps).all() else (np.arange(steps)[:, None] < lens).astype("f4")
        ahead = self._run(x, "f", mask, False)
        total = np.zeros((len(self.langs), len(x)), "f4")
        h = np.zeros((n, len(x)), "f4")
        wf, wb = self.p["wo"][:, :n], self.p["wo"][:, n:]
        for t in range(steps - 1, -1, -1):
            h = _gates(self.p["wb"].take(x[:, t], axis=1, mode="clip"), self.p["ub"], h)[4]
            if mask is not None:
                h *= mask[t]
            o = wf @ ahead[t]
            o += wb @ h
            o += self.p["bo"]
            np.exp(o, out=o)
            o /= o.sum(0)
            if mask is not None:
                o *= mask[t]
            total += o
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Label and score of each whole text; runs of chunks are bounded by BLOCK."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        pend: list[tuple[int, bytes, int, int]] = []
        held = 0
        sums: dict[int, np.ndarray] = {}

        def flush() -> None:
            nonlocal pend, held
            if not pend:
                return
            x, lens, own = np.zeros((held, STEPS), np.uint8), np.full(held, STEPS, np.int64), np.empty(held, np.int64)
            at, flat = 0, x.reshape(-1)
            for i, raw, lo, hi in pend:
                k = -(-(hi - lo) // STEPS)
                flat[at * STEPS : at * STEPS + hi - lo] = np.frombuffer(raw, np.uint8, hi - lo, lo)
                lens[at + k - 1] = (hi - lo) - (k - 1) * STEPS
                own[at : at + k] = i
                at += k
            part = self.positions(x, lens)
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for i, s in zip(own[cut].tolist(), np.add.reduceat(part, cut, axis=1).T):
                sums[i] = sums.get(i, 0) + s.astype("f8")
            pend, held = [], 0

        for i, text in enumerate(texts):
            if text is None or not self.langs or not has_letter(text):
                continue
            raw, lo = text.encode(), 0
            while lo < len(raw):
                hi = min(len(raw), lo + (BLOCK - held) * STEPS)
                pend.append((i, raw, lo, hi))
                held += -(-(hi - lo) // STEPS)
                lo = hi
                if held >= BLOCK:
                    flush()
        flush()
        for i, s in sums.items():
            k = int(s.argmax())
            langs[i], scores[i] = self.langs[k], float(min(1.0, s[k] / s.sum()))
        return langs, scores


def train(docs: DataFrame, per_lang: int = 300) -> ByteGru:
    sample = training_sample(docs, per_lang)
    model = ByteGru(sorted(sample))
    return model.fit(sample) if len(sample) > 1 else model


def label(docs: DataFrame, model: ByteGru, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; the model's weights are a few
    thousand numbers and travel with the function."""
    bound_batches(docs.sparkSession)
    schema = docs.drop("lang_pred", "score").schema
    docs = docs.select(*schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = model.predict(b.column(schema.names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    out = StructType(list(schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(run, out)


def identify(docs: DataFrame, per_lang: int = 300) -> DataFrame:
    """Train on ``docs`` and label every row: ``doc_id, held_out, lang_pred, score``."""
    model = train(docs, per_lang)
    # the text is read, but not sent back
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = model.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
