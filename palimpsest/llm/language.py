"""Language identification by a bidirectional gated recurrent network over bytes, in numpy, trained by backpropagation through time.

A text is cut into chunks of bytes that cover all of it. In each chunk one network reads forwards and one backwards; together they give
each byte a distribution over languages, and the document's is the mean over its bytes. At a chunk's ends states start from zero: what is lost there is
small, as languages show in a few letters. The network learns from the whole texts of a bounded sample of labelled rows on the driver; scoring runs over whole texts in Arrow batches, and its memory depends on the batch of chunks alone.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, encode, sample

#: Units each way, bytes of a chunk when scoring and when learning, chunks at once.
UNITS, CHUNK, LEARN_CHUNK, AT_ONCE = 8, 128, 64, 1024
#: The learning sample: whole texts of at most so many ids of a language, and of so many bytes in all.
PER_LANGUAGE, SAMPLE_BYTES = 250, 64 << 20
STEPS, BATCH, RATE = 350, 192, 0.02
#: What texts without a letter are, and the least probability that `accepted` asks for.
LEAST = 0.35
UNDETERMINED = "und"


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (category L): digits, raised digits, fractions and numbers in circles aren't."""
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Network:
    """table[2, 256, 3H]: what each byte adds to update, reset and candidate; turn[2, H, 3H], lift[2, H]; out[2, H, K], base[K]. Index 0 reads forwards."""

    names: list[str]
    table: np.ndarray
    turn: np.ndarray
    lift: np.ndarray
    out: np.ndarray
    base: np.ndarray

    @classmethod
    def fresh(cls, names: list[str], units: int = UNITS, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(names, draw(0.3, 2, 256, 3 * units), draw(units**-0.5, 2, units, 3 * units), np.zeros((2, units), np.float32), draw(0.3, 2, units, len(names)), np.zeros(len(names), np.float32))

    def dumps(self) -> bytes:
        """The weights, to be stored: learning needn't be repeated."""
        out = io.BytesIO()
        np.savez(out, np.array(self.names), *self.weights())
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as of:
            return cls(of["arr_0"].tolist(), *(of[f"arr_{k}"] for k in range(1, 6)))

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.turn, self.lift, self.out, self.base]

    def probabilities(self, chunks: np.ndarray) -> np.ndarray:
        """chunks[N, T] of bytes -> [T, N, K]. Chunks lie along the last axis, so that every step works on long rows."""
        n, length = chunks.shape
        units = self.turn.shape[1]
        scale = np.full(3 * units, 2, np.float32)  # a gate is 1 / (1 + exp(-a)), a tanh is 1 - 2 / (1 + exp(2 a))
        scale[: 2 * units] = -1
        table = np.ascontiguousarray((self.table * scale).transpose(0, 2, 1))
        turn = np.ascontiguousarray((self.turn * scale).transpose(0, 2, 1))
        lift, at = 2 * self.lift[:, :, None], np.ascontiguousarray(chunks.T).astype(np.intp)
        states, x = np.empty((length, 2, units, n), np.float32), np.empty((2, 3 * units, n), np.float32)
        h = np.zeros((2, units, n), np.float32)
        gates, z, r = x[:, : 2 * units], x[:, :units], x[:, units : 2 * units]
        for t in range(length):
            np.take(table[0], at[t], axis=1, out=x[0], mode="clip")
            np.take(table[1], at[length - 1 - t], axis=1, out=x[1], mode="clip")
            y = turn @ h
            gates += y[:, : 2 * units]
            np.exp(np.minimum(gates, 80, out=gates), out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            fresh = y[:, 2 * units :]
            fresh += lift
            fresh *= r
            fresh += x[:, 2 * units :]
            np.exp(np.minimum(fresh, 80, out=fresh), out=fresh)
            fresh += 1
            np.divide(-2, fresh, out=fresh)
            fresh += 1
            now = states[t]
            np.subtract(h, fresh, out=now)
            now *= z
            now += fresh
            h = now
        logits = self.out[0].T @ states[:, 0]
        logits += self.out[1].T @ states[::-1, 1]
        logits += self.base[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.transpose(0, 2, 1)

    def gradients(self, chunks: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of every position's label, and its gradient by backpropagation through time."""
        n, length = chunks.shape
        units = self.turn.shape[1]
        real = (chunks.T != 0).astype(np.float32)
        both = np.stack([chunks.T, chunks.T[::-1]], axis=1).astype(np.int64)  # [T, 2, N]
        side = np.arange(2)[:, None]
        hs, zs, rs, ns, ys = ([None] * length for _ in range(5))
        h = np.zeros((2, n, units), np.float32)
        for t in range(length):
            x = self.table[side, both[t]]
            y = h @ self.turn
            gates = 0.5 + 0.5 * np.tanh(0.5 * (x[..., : 2 * units] + y[..., : 2 * units]))
            z, r = gates[..., :units], gates[..., units:]
            lifted = y[..., 2 * units :] + self.lift[:, None, :]
            fresh = np.tanh(x[..., 2 * units :] + r * lifted)
            hs[t], zs[t], rs[t], ns[t], ys[t] = h, z, r, fresh, lifted
            h = fresh + z * (h - fresh)
        after = np.stack([*hs[1:], h])  # [T, 2, N, H]
        ahead, back = after[:, 0], after[::-1, 1]
        logits = ahead @ self.out[0] + back @ self.out[1] + self.base
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        total = max(1.0, float(real.sum()))
        chosen = p[:, np.arange(n), labels]
        loss = float(-(np.log(chosen + 1e-9) * real).sum() / total)
        d = p * (real / total)[..., None]
        d[:, np.arange(n), labels] -= real / total
        flat = d.reshape(-1, d.shape[2])
        d_out = np.stack([ahead.reshape(-1, units).T @ flat, back.reshape(-1, units).T @ flat])
        d_base = flat.sum(axis=0)
        to_ahead, to_back = d @ self.out[0].T, (d @ self.out[1].T)[::-1]
        d_table, d_turn, d_lift = (np.zeros_like(w) for w in (self.table, self.turn, self.lift))
        dh = np.zeros((2, n, units), np.float32)
        per_byte = np.empty((length, 2, n, 3 * units), np.float32)
        for t in reversed(range(length)):
            dh = dh + np.stack([to_ahead[t], to_back[t]])
            h, z, r, fresh, lifted = hs[t], zs[t], rs[t], ns[t], ys[t]
            d_fresh = dh * (1 - z) * (1 - fresh * fresh)
            dz = dh * (h - fresh) * z * (1 - z)
            dr = d_fresh * lifted * r * (1 - r)
            dx = per_byte[t]
            dx[..., :units], dx[..., units : 2 * units], dx[..., 2 * units :] = dz, dr, d_fresh
            dy = dx.copy()
            dy[..., 2 * units :] *= r
            d_turn += h.transpose(0, 2, 1) @ dy
            d_lift += dy[..., 2 * units :].sum(axis=1)
            dh = dh * z + dy @ self.turn.transpose(0, 2, 1)
        for k in range(2):
            rows = per_byte[:, k].reshape(-1, 3 * units)
            one = both[:, k].ravel()
            order = np.argsort(one, kind="stable")
            found, start = np.unique(one[order], return_index=True)
            d_table[k, found] = np.add.reduceat(rows[order], start, axis=0)
        return loss, [d_table, d_turn, d_lift, d_out, d_base]


def _chunked(data: bytes, length: int) -> np.ndarray:
    """All bytes in rows of `length`, the last filled up with zeros. Zero bytes of the text itself count as filling."""
    rows = -(-len(data) // length)
    return np.frombuffer(data.ljust(rows * length, b"\0"), np.uint8).reshape(rows, length)


def learn(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 1) -> Network:
    """Fit by Adam on random chunks, each language as often as any other."""
    names = sorted(set(labels))
    net = Network.fresh(names, seed=seed)
    of = [[] for _ in names]
    for text, label in zip(texts, labels, strict=True):
        if has_letter(text):
            of[names.index(label)].append(_chunked(encode(text), LEARN_CHUNK))
    pools = [np.concatenate(x) if x else np.zeros((1, LEARN_CHUNK), np.uint8) for x in of]
    rng = np.random.default_rng(seed)
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    each = max(1, BATCH // len(names))
    picked = names if len(names) <= BATCH else None
    for step in range(1, steps + 1):
        which = np.arange(len(names)) if picked else rng.choice(len(names), BATCH, replace=False)
        chunks = np.concatenate([pools[k][rng.integers(0, len(pools[k]), each)] for k in which])
        _, grads = net.gradients(chunks, np.repeat(which, each))
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        rate = RATE * min(1.0, 4 * (1 - (step - 1) / steps))
        for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):
            g *= min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def identify(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and its pooled probability of each text; `und` and 0 for texts without a letter."""
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if net is None:
        return names, scores
    pooled = np.zeros((len(texts), len(net.names)))
    sizes = np.zeros(len(texts))
    held, owners, count = [], [], 0

    def flush() -> None:
        nonlocal held, owners, count
        chunks, owner = np.concatenate(held), np.concatenate(owners)
        for k in range(0, len(chunks), AT_ONCE):
            part = chunks[k : k + AT_ONCE]
            real = (part.T != 0).astype(np.float32)
            p = np.einsum("tnk,tn->nk", net.probabilities(part), real)
            np.add.at(pooled, owner[k : k + AT_ONCE], p)
            np.add.at(sizes, owner[k : k + AT_ONCE], real.sum(axis=0))
        held, owners, count = [], [], 0

    for i, text in enumerate(texts):
        if has_letter(text):
            chunks = _chunked(encode(text), CHUNK)
            held.append(chunks)
            owners.append(np.full(len(chunks), i))
            count += len(chunks)
            if count >= 8 * AT_ONCE:
                flush()
    if held:
        flush()
    for i in np.nonzero(sizes)[0]:
        p = pooled[i] / sizes[i]
        k = int(p.argmax())
        names[i], scores[i] = net.names[k], min(1.0, float(p[k]))
    return names, scores


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of an id as text, modulo `by`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, most_bytes: int = SAMPLE_BYTES) -> Network | None:
    """Learn from the rows with a text and a language whose id's crc32 leaves no 1 modulo 3; None if there are none."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("label"), F.col(text).alias("text")).where(remainder(F.col("doc_id"), 3) != 1)
    rows = sample(known, per_language, most_bytes)
    return learn([t for t, _ in rows], [k for _, k in rows]) if rows else None


def with_language(docs: DataFrame, net: Network | None, text: str = "text", name: str = "language") -> DataFrame:
    """docs plus a column `name` of struct<lang, score>."""
    bounded_batches(docs.sparkSession)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for k in range(0, len(texts), 1000):
            a, b = identify(net, texts.slice(k, 1000).to_pylist())
            langs += a
            scores += b
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    return docs.withColumn(name, predicted(F.col(text)))


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", net: Network | None = None) -> DataFrame:
    """One row for each row of docs: (doc_id, held_out, lang_pred, score).

    held_out: crc32 of the id modulo 3 is 1; such rows aren't learned from, nor are those without id, text or language. lang_pred is a
    learned language, or `und` with score 0 for texts that are null or have no letter, and everywhere if nothing could be learned.
    Repeated rows score alike; an empty table gives no rows; other columns are ignored. Of very long texts every byte counts. net: a network that
    was learned before; else one is learned here.
    """
    net = net or fit(docs, doc_id, text, lang)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(remainder(F.col(doc_id), 3) == 1, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return with_language(plain, net).select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def accepted(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", net: Network | None = None) -> DataFrame:
    """The rows of docs, columns unchanged, whose language is determined with a probability of at least `least`."""
    net = net or fit(docs, doc_id, text, lang)
    plain = [f"c{k}" for k in range(len(docs.columns))]
    named = with_language(docs.toDF(*plain), net, plain[docs.columns.index(text)], "language")
    known = (F.col("language.lang") != UNDETERMINED) & (F.col("language.score") >= least)
    return named.where(known).select(*plain).toDF(*docs.columns)
