"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded, documented sample of labelled texts; prediction covers every
byte of every text. A text is cut into segments of `SEGMENT` bytes, which stand side by side as lanes of one batch; both
directions advance together, one byte a step. Each position gets label probabilities; a document's are their mean over its letters.

Sample: every label is learned. Its rows fall into hash classes of their id, and the text with the smallest hash of each class is taken, with at
most `sample_chars` characters of it. There are `per_language` classes, or fewer where `rows` would be passed by all labels together (one at
least). So training needs at most max(rows, labels) x sample_chars characters, whatever the table's size.

Defined results: null text, or text without a letter, is `und` with score 0; with no labelled rows at all every text is `und`; rows
without an id are predicted like others, are not learned from and count as not held out; repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SEGMENT = 128
HIDDEN = 8
LANES = 2048
LETTER = regex.compile(r"\p{L}")

_POOLED = np.zeros(256, bool)
_POOLED[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Network:
    """Two directions of gated units. Gates: update z, reset r (as tanh of half the input, so one call serves both), candidate n.

    Weights: x [2, 256, 3H] input by byte, u [2, 3H, H] recurrent, c [2, H] the candidate's recurrent bias, o [L, 2H] and b [L] labels.
    """

    NAMES = ("x", "u", "c", "o", "b")

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.x = rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 0.5 / hidden**0.5, (2, 3 * hidden, hidden)).astype(np.float32)
        self.c = np.zeros((2, hidden), np.float32)
        self.o = rng.normal(0, 0.3, (len(labels), 2 * hidden)).astype(np.float32)
        self.b = np.zeros(len(labels), np.float32)

    def states(self, codes: np.ndarray, keep: bool = False):
        """Hidden states [2, T, H, B] at every byte of codes [T, B]; with keep also the gates, for training."""
        steps, lanes = codes.shape
        h_ = self.hidden
        out = np.empty((2, steps, h_, lanes), np.float32)
        h = np.zeros((2, h_, lanes), np.float32)
        gates = np.empty((2, steps, 4 * h_, lanes), np.float32) if keep else None
        xt = [np.ascontiguousarray(x.T) for x in self.x]
        inputs = np.empty((2, 3 * h_, lanes), np.float32)
        c = self.c[:, :, None]
        for t in range(steps):
            np.take(xt[0], codes[t], axis=1, out=inputs[0], mode="clip")
            np.take(xt[1], codes[steps - 1 - t], axis=1, out=inputs[1], mode="clip")
            a = self.u @ h
            zr = np.tanh(inputs[:, : 2 * h_] + a[:, : 2 * h_])
            zr *= 0.5
            zr += 0.5
            an = a[:, 2 * h_ :] + c
            n = np.tanh(inputs[:, 2 * h_ :] + zr[:, h_:] * an)
            if keep:
                gates[:, t, : 2 * h_], gates[:, t, 2 * h_ : 3 * h_], gates[:, t, 3 * h_ :] = zr, n, an
            h = n + zr[:, :h_] * (h - n)
            out[0, t], out[1, steps - 1 - t] = h[0], h[1]
        return (out, gates) if keep else out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Label probabilities [T, L, B]."""
        h_ = self.hidden
        logits = self.o[:, :h_] @ states[0] + self.o[:, h_:] @ states[1] + self.b[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for lanes of one label each; weight [T, B] says which positions count."""
        steps, lanes = codes.shape
        h_ = self.hidden
        states, gates = self.states(codes, keep=True)
        p = self.probabilities(states)
        total = max(1.0, float(weight.sum()))
        loss = -float((np.log(p[:, labels, np.arange(lanes)] + 1e-9) * weight).sum()) / total
        d = p
        d[:, labels, np.arange(lanes)] -= 1
        d *= (weight / total)[:, None, :]
        g = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        g["b"] = d.sum(axis=(0, 2))
        for k in (0, 1):
            g["o"][:, k * h_ : (k + 1) * h_] = np.einsum("tlb,thb->lh", d, states[k], optimize=True)
            dh_out = self.o[:, k * h_ : (k + 1) * h_].T @ d
            dh = np.zeros((h_, lanes), np.float32)
            back = np.empty((steps, 3 * h_, lanes), np.float32)
            order = range(steps - 1, -1, -1) if k == 0 else range(steps)
            for t in order:  # from the last byte that this direction read to its first
                dh = dh + dh_out[t]
                step = t if k == 0 else steps - 1 - t
                before = t - 1 if k == 0 else t + 1
                h0 = states[k, before] if 0 <= before < steps else np.zeros_like(dh)
                z, r, n, an = (gates[k, step, i * h_ : (i + 1) * h_] for i in range(4))
                dn = dh * (1 - z) * (1 - n * n)
                da = np.concatenate([dh * (h0 - n) * z * (1 - z) * 2, dn * an * r * (1 - r) * 2, dn * r])
                back[t] = da
                back[t, 2 * h_ :] = dn
                g["u"][k] += da @ h0.T
                g["c"][k] += da[2 * h_ :].sum(axis=1)
                dh = dh * z + self.u[k].T @ da
            flat = back.transpose(0, 2, 1).reshape(-1, 3 * h_)
            np.add.at(g["x"][k], codes.ravel(), flat)
        return loss, g

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 260, lanes: int = 192, length: int = 64, rate: float = 0.02, seed: int = 1) -> list[float]:
        """Adam over random stretches of the texts, the languages evenly drawn."""
        rng = np.random.default_rng(seed)
        first = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        second = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        by = [np.flatnonzero(labels == k) for k in range(len(self.labels))]
        losses = []
        for step in range(1, steps + 1):
            own = np.array([rng.choice(by[k]) for k in rng.integers(0, len(by), lanes)])
            codes = np.full((length, lanes), 32, np.uint8)
            for i, j in enumerate(own):
                text = texts[j]
                at = int(rng.integers(0, max(1, len(text) - length + 1)))
                part = np.frombuffer(text[at : at + length], np.uint8)
                codes[: len(part), i] = part
            loss, g = self.gradients(codes, labels[own], _POOLED[codes].astype(np.float32))
            losses.append(loss)
            norm = float(sum((v * v).sum() for v in g.values())) ** 0.5
            for n in self.NAMES:
                grad = g[n] / max(1.0, norm)
                first[n] += 0.1 * (grad - first[n])
                second[n] += 0.01 * (grad * grad - second[n])
                now = rate * min(1, 3 * (1 - (step - 1) / steps))
                getattr(self, n)[...] -= now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-7)
        return losses

    def documents(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean label probabilities over the letters of each row [rows, L]; zeros for rows without."""
        rows = len(offs) - 1
        total, count = np.zeros((rows, len(self.labels))), np.zeros(rows)
        n_seg = -(-np.diff(offs) // SEGMENT)
        row = np.repeat(np.arange(rows), n_seg)
        start = offs[:-1][row] + SEGMENT * (np.arange(len(row)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg))
        end = np.minimum(start + SEGMENT, offs[1:][row])
        padded = np.concatenate([data, np.full(SEGMENT, 32, np.uint8)])
        for lo in range(0, len(row), LANES):
            s, e, r = start[lo : lo + LANES], end[lo : lo + LANES], row[lo : lo + LANES]
            at = s[:, None] + np.arange(SEGMENT)
            codes = np.where(at < e[:, None], padded[at], 32).astype(np.uint8).T
            weight = _POOLED[codes]
            p = self.probabilities(self.states(np.ascontiguousarray(codes)))
            np.add.at(total, r, np.einsum("tlb,tb->bl", p, weight.astype(np.float32)))
            np.add.at(count, r, weight.sum(axis=0))
        return total / np.maximum(count, 1)[:, None]


def held_out(id_col: str | Column) -> Column:
    """Whether the crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int, sample_chars: int, rows: int, id_col: str, text_col: str, lang_col: str) -> list:
    """Labelled texts (lang, text) to learn from, never held-out ones: of every label, and at most max(rows, labels)."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.filter(~held_out("id") & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    classes = max(1, min(per_language, rows // max(1, known.select("lang").distinct().count())))
    hashed = F.xxhash64(F.col("id").cast("string"))
    chosen = known.groupBy("lang", F.pmod(hashed, F.lit(classes))).agg(F.min(F.struct(hashed.alias("h"), F.substring("text", 1, sample_chars).alias("text"))).alias("x"))
    return chosen.select("lang", "x.text").distinct().orderBy("lang", F.xxhash64("text")).collect()


def train(docs: DataFrame, per_language: int = 150, sample_chars: int = 2000, rows: int = 30_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Network | None:
    """A network for all labels; options go to fit."""
    chosen = [(x.lang, x.text) for x in sample(docs, per_language, sample_chars, rows, id_col, text_col, lang_col)]
    labels = sorted({lang for lang, _ in chosen})
    if not labels:
        return None
    number = {lang: k for k, lang in enumerate(labels)}
    network = Network(labels)
    network.fit([text.encode() for _, text in chosen], np.array([number[lang] for lang, _ in chosen]), **options)
    return network


def predict(docs: DataFrame, network: Network | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language and its probability; columns of those names are replaced."""
    docs = docs.drop(lang_out, score_out)
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches):
        C.enter("language")
        for batch in batches:
            column = batch.column(at)
            data, offs = C.text_buffer(column)
            langs, scores = [], []
            for lo, hi in C.slices(offs, SEGMENT * LANES * 4):
                if network is None:
                    langs, scores = langs + ["und"] * (hi - lo), scores + [0.0] * (hi - lo)
                    continue
                p = network.documents(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                for best, score, text in zip(p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), column.slice(lo, hi - lo).to_pylist()):
                    known = bool(text) and LETTER.search(text) is not None
                    langs.append(network.labels[best] if known else "und")
                    scores.append(min(1.0, score) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*columns, lang_out, score_out])
            C.release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language": op9_language}
ORACLE: dict[str, str] = {}
