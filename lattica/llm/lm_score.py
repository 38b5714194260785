"""Operator 4, LM scoring by masked pseudo-likelihood.

Tokens are the UTF-8 bytes of a text.  A network sees the `SIDE` bytes on either side of a
position, never the byte itself: each neighbour adds its embedding for that distance, a
squashed hidden layer follows, and a softmax over the bytes that the corpus has, and one
class for all others, predicts the masked byte.  A document's score is the sum of the
log-probabilities of its bytes, each given both sides.

The training set is the whole corpus: every window of every text is counted (the counts
are summed per task before they are shuffled), so equal windows are one row with a weight.
Training is data-parallel on those rows: in each round every partition walks its rows (more
than once where the whole table has fewer than `LEAST_WINDOWS`) with Adam steps from the
common weights, and the weights are averaged by the steps behind them.  A row counts by its number to the power `DAMP`, so
that steps are not ruled by the few most frequent windows.  What the driver holds is one set of weights and as many copies as the table has
partitions (`PARTS` to `MOST_PARTS`), whatever the size of the corpus.

Edge cases: null or empty text has 0 tokens, log-probability 0 and a null mean; positions
near the ends see byte 0 beyond the text; repeated rows weigh twice in training and score
alike; empty tables give empty results; an empty corpus scores with untrained weights;
only id and text are read, so other columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SIDE = 2
HIDDEN = 48
ROUNDS = 4
DAMP = 0.7
#: Fewest windows that a round walks, repeats counted, unless that takes more passes than these.
LEAST_WINDOWS, MOST_PASSES = 400_000, 20
#: Least and most partitions of the window table in training, and windows in one of them.
PARTS, MOST_PARTS, PART_WINDOWS = 6, 256, 2_000_000
#: Windows scored at once, and windows of one training step.
BATCH = 4096
TRAIN_BATCH = 96
#: Distinct windows that a worker counts before it sends them on, and windows whose
#: log-probabilities it keeps.
CACHE, KNOWN = 1_000_000, 3_000_000


def window_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with its neighbours as one integer: 8 bits a byte, the masked one lowest,
    then distances -2, -1, +1, +2."""
    n = len(data)
    wide = data.astype(np.int64)
    sizes = np.diff(offsets)
    place = np.arange(n) - np.repeat(offsets[:-1], sizes)
    left = np.repeat(offsets[1:], sizes) - np.arange(n) - 1
    code = wide.copy()
    shift = 8
    for d in (*range(-SIDE, 0), *range(1, SIDE + 1)):
        other = np.zeros(n, np.int64)
        if d < 0:
            other[-d:] = wide[:d]
            other[place < -d] = 0
        else:
            other[:-d] = wide[d:]
            other[left < d] = 0
        code |= other << shift
        shift += 8
    return code


class WindowNet:
    NAMES = ("embed", "bias", "out", "out_bias")

    def __init__(self, seen: np.ndarray, hidden: int = HIDDEN, seed: int = 11):
        """`seen`: which of the 256 bytes are classes of their own; the last class is all others."""
        rng = np.random.default_rng(seed)
        self.seen = seen
        self.others = max(1, int((~seen).sum()))
        self.number = np.where(seen, np.cumsum(seen) - 1, seen.sum()).astype(np.int64)
        self.embed = (rng.standard_normal((2 * SIDE * 256, hidden)) * 0.3).astype(np.float32)
        self.bias = np.zeros(hidden, np.float32)
        self.out = (rng.standard_normal((hidden, int(seen.sum()) + 1)) / np.sqrt(hidden)).astype(np.float32)
        self.out_bias = np.zeros(self.out.shape[1], np.float32)
        self.out_bias[-1] = -4.0

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, k) for k in self.NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> WindowNet:
        a = 0
        for p in self.parts():
            p[...] = flat[a : a + p.size].reshape(p.shape)
            a += p.size
        return self

    def _forward(self, codes: np.ndarray):
        near = (codes[:, None] >> np.arange(8, 8 * (2 * SIDE + 1), 8) & 255) + np.arange(2 * SIDE) * 256
        h = self.embed[near[:, 0]]
        for j in range(1, 2 * SIDE):
            h += self.embed[near[:, j]]
        h += self.bias
        h /= 1 + np.abs(h)
        z = h @ self.out
        z += self.out_bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return near, h, z, p, p.sum(1)

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes))
        for a in range(0, len(codes), BATCH):
            own = codes[a : a + BATCH]
            _, _, z, _, total = self._forward(own)
            out[a : a + BATCH] = z[np.arange(len(own)), self.number[own & 255]] - np.log(total)
        return out - np.where(self.seen[codes & 255], 0.0, np.log(self.others))

    def step(self, codes: np.ndarray, weight: np.ndarray, state: list, rate: float) -> None:
        """One Adam step on weighted windows."""
        near, h, _, p, total = self._forward(codes)
        w = (weight / weight.sum()).astype(np.float32)
        p /= total[:, None]
        p[np.arange(len(codes)), self.number[codes & 255]] -= 1
        p *= w[:, None]
        d = (p @ self.out.T) * (1 - np.abs(h)) ** 2
        flat = near.T.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) > 0)))
        g_embed = np.zeros_like(self.embed)
        g_embed[flat[order][first]] = np.add.reduceat(d[order % len(codes)], first, 0)
        grads = [g_embed, d.sum(0), h.T @ p, p.sum(0)]
        if not state:
            state += [0, [np.zeros_like(g) for g in grads], [np.zeros_like(g) for g in grads]]
        state[0] += 1
        for q, g, m, v in zip(self.parts(), grads, state[1], state[2], strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9 ** state[0])) / (np.sqrt(v / (1 - 0.99 ** state[0])) + 1e-7)


def windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (code, n): every distinct window of the corpus and how often it occurs."""

    def run(batches):
        held, size = [], 0

        def packed():
            codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
            values, inverse = np.unique(codes, return_inverse=True)
            return values, np.bincount(inverse, n, len(values)).astype(np.int64)

        for batch in batches:
            data, offsets = C.buffers(batch.column(0))
            for a, b in C.doc_chunks(offsets):
                values, n = np.unique(window_codes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), return_counts=True)
                held.append((values, n))
                size += len(values)
                if size > CACHE:
                    values, n = packed()
                    held[:], size = [(values, n)], len(values)
                    if size > CACHE // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["code", "n"])
                        held[:], size = [], 0
        if held:
            values, n = packed()
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["code", "n"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, parts: int = PARTS) -> tuple[WindowNet, list[float]]:
    """The trained network and the mean log-loss that each round began with, on a part of it."""
    spark = docs.sparkSession
    counted = C.shared_table(windows(docs, text))
    n = counted.count()
    parts, passes = min(MOST_PARTS, max(parts, n // PART_WINDOWS)), min(MOST_PASSES, -(-LEAST_WINDOWS // max(1, n)))
    table = C.shared_table(counted.withColumn("h", F.xxhash64("code")).repartition(parts, "code").sortWithinPartitions("h").select("code", "n"))
    seen = np.zeros(256, bool)
    seen[[r.b for r in counted.select(F.expr("CAST(code & 255 AS INT) AS b")).distinct().collect()]] = True
    flat, losses = WindowNet(seen).flat(), []
    for r in range(rounds):
        sent, rate = spark.sparkContext.broadcast(flat), 0.02 / (1 + r)

        def run(batches, sent=sent, rate=rate, passes=passes):
            net, state, loss, known = WindowNet(seen).load(sent.value), [], 0.0, 0.0
            for batch in batches:
                codes, weight = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                probe = slice(0, len(codes), 32)  # what the round begins with
                loss -= float(net.log_prob(codes[probe]) @ weight[probe]) if not state else 0.0
                known += weight[probe].sum() if not state else 0.0
                weight = weight**DAMP
                for a in [*range(0, len(codes), TRAIN_BATCH)] * passes:
                    net.step(codes[a : a + TRAIN_BATCH], weight[a : a + TRAIN_BATCH], state, rate)
            n = float(state[0]) if state else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([net.flat().tobytes()], pa.binary()), pa.array([n]), pa.array([loss]), pa.array([float(known)])], names=["net", "n", "loss", "seen"])

        # `parts` rows of one network each: a fixed bound
        rows = [x for x in table.mapInArrow(run, "net binary, n double, loss double, seen double").collect() if x.n]
        sent.unpersist()
        total = sum(x.n for x in rows)
        if not total:
            break
        flat = sum(np.frombuffer(x.net, np.float32).astype(np.float64) * (x.n / total) for x in rows).astype(np.float32)
        losses.append(sum(x.loss for x in rows) / max(1.0, sum(x.seen for x in rows)))
    return WindowNet(seen).load(flat), losses


def scored(docs: DataFrame, net: WindowNet, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, mean_logprob, sum_logprob, n_tokens)."""

    def run(batches):
        known, value = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            data, offsets = C.buffers(batch.column(1))
            total = np.zeros(batch.num_rows)
            for a, b in C.doc_chunks(offsets):
                own, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if not len(own):
                    continue
                codes, inverse = np.unique(window_codes(own, cuts), return_inverse=True)
                lp = np.empty(len(codes))
                at = np.searchsorted(known, codes)
                met = known[np.minimum(at, len(known) - 1)] == codes if len(known) else np.zeros(len(codes), bool)
                lp[met] = value[at[met]]
                lp[~met] = net.log_prob(codes[~met])
                if len(known) > KNOWN:
                    known, value = codes, lp
                elif not met.all():
                    known, value = np.insert(known, at[~met], codes[~met]), np.insert(value, at[~met], lp[~met])
                sums = np.concatenate(([0.0], np.cumsum(lp[inverse])))
                total[a:b] = np.diff(sums[cuts])
            n = np.diff(offsets)
            mean = pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), mean, pa.array(total), pa.array(n)], names=["id", "mean_logprob", "sum_logprob", "n_tokens"])

    kind = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("mean_logprob", T.DoubleType()), T.StructField("sum_logprob", T.DoubleType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, kind).withColumnRenamed("id", id)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    net, _ = train(docs)
    return scored(docs, net)
