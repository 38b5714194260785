"""Operator 10, language ID: a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes from both sides, labels every position with a language
distribution, and a document's probabilities are the mean over its positions.  It is
trained in numpy by backpropagation through time on a bounded sample of labelled rows
(`TRAIN_DOCS` documents of at most `TRAIN_DOC_BYTES` bytes, lowest hash first); every
byte of every document is then labelled.  Texts are laid out in rows of `STEPS` bytes, so
thousands of rows advance together and one step is one small matrix product; the recurrent
state starts anew in each row, whatever the length of the text.

Edge cases: a null or empty text, or one without any letter, is `und` with score 0; rows
with a null language never train; repeated rows simply count; ties go to the language
first in code point order; without any training row every text is `und`; an empty table
gives an empty result; only id, text (and language to train) are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

HIDDEN = 8
STEPS = 128
TRAIN_DOCS = 2000
TRAIN_DOC_BYTES = 20_000
TRAIN_STEPS = 64
TRAIN_ROWS = 192
TRAIN_ROUNDS = 260
#: Bytes laid out at once when documents are labelled.
LAYOUT_BYTES = 2344 * STEPS


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the squashing function of the network, a tenth of tanh's time."""
    y = np.abs(x)
    y += 1
    x /= y
    return x


class Direction:
    """One gated recurrent layer; `embed` (gates, 256) holds the input's part of all three
    gates.  Arrays are (hidden, rows), so that each gate is one contiguous block."""

    def __init__(self, rng, hidden: int):
        self.h = hidden
        self.embed = (rng.standard_normal((3 * hidden, 256)) * 0.5).astype(np.float32)
        self.recur = (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.embed[:hidden] += 2.0  # update gates start half closed: memory first

    def states(self, x: np.ndarray, mask: np.ndarray | None = None, keep: bool = False):
        """Hidden states (steps, hidden, rows) of inputs (steps, rows)."""
        k, steps, rows = self.h, *x.shape
        h = np.zeros((k, rows), np.float32)
        out = np.empty((steps, k, rows), np.float32)
        by_byte = np.ascontiguousarray(self.embed.T)
        tape = []
        for t in range(steps):
            a = np.ascontiguousarray(np.take(by_byte, x[t], 0).T)
            u = self.recur @ h
            g, un = a[: 2 * k], u[2 * k :]
            g += u[: 2 * k]
            _soft(g)
            g += 1
            g *= 0.5
            z = g[:k]
            n = g[k:] * un
            n += a[2 * k :]
            _soft(n)
            new = np.subtract(h, n, out=out[t])
            new *= z
            new += n
            if mask is not None:
                new *= mask[t]
            if keep:
                tape.append((h, z, g[k:], n, un))
            h = new
        return (out, tape) if keep else out

    def backward(self, x: np.ndarray, tape: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of (embed, recur), given those of the states."""
        d_embed, d_recur = np.zeros((256, 3 * self.h), np.float32), np.zeros_like(self.recur)
        dh = np.zeros_like(grad[0])
        for t in range(len(tape) - 1, -1, -1):
            h, z, r, n, un = tape[t]
            dh = dh + grad[t]
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dn * un * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            d_in = np.concatenate((dz, dr, dn * r))
            np.add.at(d_embed, x[t], np.concatenate((dz, dr, dn)).T)
            d_recur += d_in @ h.T
            dh = dh * z + self.recur.T @ d_in
        return d_embed.T, d_recur


class ByteTagger:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.w = (rng.standard_normal((2 * hidden, len(labels))) / np.sqrt(2 * hidden)).astype(np.float32)
        self.b = np.zeros(len(labels), np.float32)

    def fit(self, texts: list[bytes], y: list[int], rounds: int = TRAIN_ROUNDS, seed: int = 7) -> None:
        """Cross-entropy at every position, backpropagated through time, with Adam."""
        rng = np.random.default_rng(seed)
        by_label = [[i for i, k in enumerate(y) if k == c and texts[i]] for c in range(len(self.labels))]
        by_label = [x for x in by_label if x]
        params = [self.ahead.embed, self.ahead.recur, self.back.embed, self.back.recur, self.w, self.b]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        k = self.ahead.h
        for step in range(1, rounds + 1):
            x = np.zeros((TRAIN_STEPS, TRAIN_ROWS), np.uint8)
            mask = np.zeros((TRAIN_STEPS, TRAIN_ROWS), np.float32)
            target = np.zeros(TRAIN_ROWS, np.int64)
            for j in range(TRAIN_ROWS):
                own = by_label[j % len(by_label)]
                i = own[int(rng.integers(len(own)))]
                a = int(rng.integers(max(1, len(texts[i]) - TRAIN_STEPS + 1)))
                piece = np.frombuffer(texts[i][a : a + TRAIN_STEPS], np.uint8)
                x[: len(piece), j], mask[: len(piece), j], target[j] = piece, 1, y[i]
            hf, tape_f = self.ahead.states(x, mask, keep=True)
            hb, tape_b = self.back.states(x[::-1], mask[::-1], keep=True)
            h = np.concatenate((hf, hb[::-1]), 1)
            p = self._softmax(self.w.T @ h + self.b[:, None])
            p[:, target, np.arange(TRAIN_ROWS)] -= 1
            p *= mask[:, None, :] / mask.sum()
            dh = (self.w @ p) * mask[:, None, :]
            d_w = np.einsum("thr,tcr->hc", h, p)
            grads = [*self.ahead.backward(x, tape_f, dh[:, :k]), *self.back.backward(x[::-1], tape_b, dh[::-1, k:]), d_w, p.sum((0, 2))]
            rate = 0.02 * min(1.0, 2.0 * (1 - step / (rounds + 1)))
            for q, g, a1, a2 in zip(params, grads, m1, m2, strict=True):
                a1 += 0.1 * (g - a1)
                a2 += 0.01 * (g * g - a2)
                q -= rate * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.99**step)) + 1e-8)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        """Over the middle axis of (steps, labels, rows)."""
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        return x

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities (documents, labels) over the positions of each document."""
        sizes = np.diff(offsets)
        rows = -(-sizes // STEPS)
        owner = np.repeat(np.arange(len(sizes)), rows)
        if not len(owner):
            return np.zeros((len(sizes), len(self.labels)))
        begin = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)) * STEPS
        at = begin + np.arange(STEPS)[:, None]
        inside = at < offsets[1:][owner]
        x = np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
        mask = inside.astype(np.float32)
        k = self.ahead.h
        logits = self.w[:k].T @ self.ahead.states(x)
        logits += (self.w[k:].T @ self.back.states(x[::-1], mask[::-1]))[::-1]
        logits += self.b[:, None]
        p = self._softmax(logits)
        p *= mask[:, None, :]
        total = np.zeros((len(sizes), len(self.labels)))
        by_row = p.sum(0).T
        full = np.flatnonzero(rows)
        total[full] = np.add.reduceat(by_row, (np.cumsum(rows) - rows)[full], 0)
        return total / np.maximum(sizes, 1)[:, None]


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    sums = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))
    out = np.diff(sums[offsets]) > 0
    wide = np.diff(np.concatenate(([0], np.cumsum(data >= 0x80)))[offsets]) > 0
    for i in np.flatnonzero(~out & wide).tolist():
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TRAIN_DOCS) -> ByteTagger | None:
    """A network trained on at most `most` rows whose id is not held out."""
    rows = docs.where((C.crc_third(id) != 1) & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= TRAIN_DOC_BYTES))
    # ids first, so that no task sends texts which are not picked
    picked = rows.select(F.col(id).alias("i")).distinct().orderBy(F.xxhash64(F.col("i").cast("string")), "i").limit(most)
    texts = rows.select(F.col(id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sample = texts.join(F.broadcast(picked), "i").orderBy(F.xxhash64(F.col("i").cast("string")), "i", "t", "l").limit(most).collect()
    if not sample:
        return None
    labels = sorted({r.l for r in sample})
    tagger = ByteTagger(labels)
    if len(labels) > 1:
        number = {x: k for k, x in enumerate(labels)}
        tagger.fit([r.t.encode() for r in sample], [number[r.l] for r in sample])
    return tagger


def predict(docs: DataFrame, tagger: ByteTagger | None, text: str = "text", prefix: str = "__") -> DataFrame:
    """`docs` with lang and score after `prefix`, which begins the name of no input column."""

    def run(batches):
        for batch in batches:
            data, offsets = C.buffers(batch.column(batch.schema.get_field_index(text)))
            lang, score = [], []
            for a, b in C.doc_chunks(offsets, LAYOUT_BYTES):
                own, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                known = has_letter(own, cuts)
                if tagger is None:
                    known[:] = False
                    p = np.zeros((b - a, 1))
                elif len(own) <= LAYOUT_BYTES:
                    p = tagger.pooled(own, cuts)
                else:  # one very long text by pieces of whole rows, which changes no row
                    pieces = np.append(np.arange(0, len(own), LAYOUT_BYTES), len(own))
                    p = (tagger.pooled(own, pieces) * np.diff(pieces)[:, None]).sum(0, keepdims=True) / len(own)
                best = p.argmax(1)
                lang += [tagger.labels[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                score += np.where(known, np.clip(p.max(1), 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, f"{prefix}lang", f"{prefix}score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(f"{prefix}lang", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())]))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (C.crc_third("doc_id") == 1).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
