"""A quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Learned filters slide over each chunk's embedded bytes; a filter's
answer in a chunk is its greatest (max-pooling). Over the chunks of a text the mean and the greatest answer of each filter go into one
logistic unit, which gives the probability that the text is of label 1. The network learns from the whole texts of a bounded sample of labelled rows on
the driver; scoring runs over whole texts in Arrow batches.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, encode, sample
from palimpsest.llm.language import remainder

#: Dimensions of a byte, bytes under a filter, filters; bytes of a chunk and from one chunk's start to the next's; chunks at once.
DIM, WIDTH, FILTERS = 4, 8, 16
CHUNK, STEP, AT_ONCE = 512, 448, 64
#: The learning sample: whole texts of at most so many ids of a label, and of so many bytes in all; passes over it, and steps at least.
PER_LABEL, SAMPLE_BYTES = 1500, 32 << 20
PASSES, BATCH, RATE, LEAST_STEPS = 8, 32, 0.01, 150
#: From which score on a text is predicted to be of label 1.
THRESHOLD = 0.7


def chunks(data: bytes) -> np.ndarray:
    """Rows of CHUNK bytes that start every STEP bytes, the last filled up with zeros; at least one row."""
    rows = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    flat = np.frombuffer(data.ljust((rows - 1) * STEP + CHUNK, b"\0"), np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (rows, CHUNK), (STEP, 1))


@dataclass
class Network:
    """embed[256, D], filters[W * D, F], lift[F], mix[2F], base[1]."""

    embed: np.ndarray
    filters: np.ndarray
    lift: np.ndarray
    mix: np.ndarray
    base: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(draw(1.0, 256, DIM), draw((WIDTH * DIM) ** -0.5, WIDTH * DIM, FILTERS), np.zeros(FILTERS, np.float32), draw(0.1, 2 * FILTERS), np.zeros(1, np.float32))

    def dumps(self) -> bytes:
        """The weights, to be stored: learning needn't be repeated."""
        out = io.BytesIO()
        np.savez(out, *self.weights())
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as of:
            return cls(*(of[f"arr_{k}"] for k in range(5)))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.lift, self.mix, self.base]

    def answers(self, rows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """rows[N, CHUNK] -> each filter's greatest answer [N, F], and at which byte."""
        out, at = np.empty((len(rows), FILTERS), np.float32), np.empty((len(rows), FILTERS), np.int64) if where else None
        positions = CHUNK - WIDTH + 1
        for k in range(0, len(rows), AT_ONCE):
            x = self.embed.take(rows[k : k + AT_ONCE], axis=0)
            n = len(x)
            a, b, c = x.strides
            seen = np.lib.stride_tricks.as_strided(x, (n, positions, WIDTH * DIM), (a, b, c)).reshape(-1, WIDTH * DIM)
            y = (seen @ self.filters).reshape(n, positions, FILTERS)
            out[k : k + n] = y.max(axis=1)
            if where:
                at[k : k + n] = y.argmax(axis=1)
        return np.maximum(out + self.lift, 0), at

    def pooled(self, answers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        first = np.cumsum(sizes) - sizes
        return np.concatenate([np.add.reduceat(answers, first, axis=0) / sizes[:, None], np.maximum.reduceat(answers, first, axis=0)], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        held = [chunks(encode(t or "")) for t in texts]
        if not held:
            return np.zeros(0)
        answers = np.concatenate([self.answers(x)[0] for x in _joined(held)])
        logit = self.pooled(answers, np.array([len(x) for x in held])).astype(np.float64) @ self.mix + self.base[0]
        return np.round(1 / (1 + np.exp(-np.clip(logit, -60, 60))), 9)

    def gradients(self, held: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Weighted mean cross-entropy of a batch of texts and its gradient."""
        rows, sizes = np.concatenate(held), np.array([len(x) for x in held])
        answers, at = self.answers(rows, True)
        together = self.pooled(answers, sizes)
        p = 1 / (1 + np.exp(-np.clip(together @ self.mix + self.base[0], -60, 60)))
        loss = float(-(weight * np.where(labels == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum() / weight.sum())
        d = ((p - labels) * weight / weight.sum()).astype(np.float32)
        d_mix, d_base = together.T @ d, np.array([d.sum()], np.float32)
        of = np.repeat(np.arange(len(sizes)), sizes)
        d_answers = (d[:, None] * self.mix[:FILTERS] / sizes[:, None])[of]
        top = np.maximum.reduceat(answers, np.cumsum(sizes) - sizes, axis=0)[of] == answers
        ties = np.add.reduceat(top.astype(np.float32), np.cumsum(sizes) - sizes, axis=0)[of]
        d_answers += top / ties * (d[:, None] * self.mix[FILTERS:])[of]
        d_answers *= answers > 0
        d_lift = d_answers.sum(axis=0)
        d_embed, d_filters = np.zeros_like(self.embed), np.zeros_like(self.filters)
        for k in range(FILTERS):  # of a filter only the byte windows with its greatest answer count
            seen = np.take_along_axis(rows, at[:, k, None] + np.arange(WIDTH), axis=1)
            back = d_answers[:, k]
            d_filters[:, k] = self.embed[seen].reshape(len(rows), -1).T @ back
            np.add.at(d_embed, seen, back[:, None, None] * self.filters[:, k].reshape(1, WIDTH, DIM))
        return loss, [d_embed, d_filters, d_lift, d_mix.astype(np.float32), d_base]


def _joined(held: list[np.ndarray], rows: int = 4 * AT_ONCE):
    """The chunks of many texts in parts of at least some rows, so that short texts share a product."""
    part, n = [], 0
    for x in held:
        part.append(x)
        n += len(x)
        if n >= rows:
            yield np.concatenate(part)
            part, n = [], 0
    if part:
        yield np.concatenate(part)


def learn(texts: list[str], labels: list[int], share: float | None = None, passes: int = PASSES, seed: int = 1) -> Network:
    """Fit by Adam. share: how frequent label 1 is where the network will be used, if other than in the sample."""
    net = Network.fresh(seed)
    held, y = [chunks(encode(t)) for t in texts], np.array(labels, np.float32)
    own = float(y.mean())
    share = own if share is None else share
    weight = np.where(y == 1, share / max(own, 1e-9), (1 - share) / max(1 - own, 1e-9)).astype(np.float32)
    rng = np.random.default_rng(seed)
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    each, done = -(-len(held) // BATCH), 0
    passes = max(passes, -(-LEAST_STEPS // each))
    steps = passes * each
    for _ in range(passes):
        order = rng.permutation(len(held))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            _, grads = net.gradients([held[i] for i in some], y[some], weight[some])
            done += 1
            rate = RATE * min(1.0, 3 * (1 - (done - 1) / steps))
            for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.99**done)) + 1e-8)
    for w in (net.embed, net.filters):  # few enough bits for exact sums: a text then scores alike wherever in a batch it lies
        np.clip(np.rint(w * 64) / 64, -8, 8, out=w)
    return net


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", per_label: int = PER_LABEL, most_bytes: int = SAMPLE_BYTES) -> Network | None:
    """Learn from the labelled rows whose id's crc32 leaves no 2 modulo 4: at most `per_label` ids of each label, picked by a hash of the id.

    Ids that are labelled both ways don't count. None if either label is missing.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), 4) != 2))
    counts = {r["label"]: r for r in known.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).collect()}
    if len(counts) < 2:
        return None
    at = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    share = [min(1.0, 3.0 * per_label / counts[k]["ids"]) for k in (0, 1)]
    some = known.where(at < F.when(F.col("label") == 1, F.lit(share[1])).otherwise(F.lit(share[0])) * (1 << 30)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    own = some.where(F.col("label") == F.col("most")).select(F.col("doc_id").alias("__id"), "label")  # about 3 * per_label ids of each label
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("__id")).select("doc_id", "label", "text")
    found = sample(rows, per_label, most_bytes)
    if len({k for _, k in found}) < 2:
        return None
    return learn([t for t, _ in found], [k for _, k in found], counts[1]["n"] / (counts[0]["n"] + counts[1]["n"]))


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", per_label: int = PER_LABEL, net: Network | None = None) -> DataFrame:
    """One row for each row of docs: (doc_id, held_out, score, predicted).

    held_out: crc32 of the id modulo 4 is 2; such rows aren't learned from. predicted is 1 where score >= 0.7. Null texts score as empty
    ones. Where the labels teach nothing, every score is 0.5. Repeated rows score alike; an empty table gives no rows; other columns are ignored.
    Of very long texts every byte counts. net: a network that was learned before; else one is learned here.
    """
    bounded_batches(docs.sparkSession)
    net = net or fit(docs, labels, doc_id, text, quality, per_label)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if net is None:
            return pa.array([0.5] * len(texts), pa.float64())
        return pa.array(np.concatenate([np.zeros(0), *(net.score(texts.slice(k, 256).to_pylist()) for k in range(0, len(texts), 256))]))

    held_out = F.coalesce(remainder(F.col(doc_id), 4) == 2, F.lit(False))
    scored_rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), scored(F.col(text)).alias("score"))
    return scored_rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
