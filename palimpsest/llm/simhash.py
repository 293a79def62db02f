"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each set into a word of the perfect binary Golay code (23, 12, 7).
Every word has one codeword within 3 bits, and at most 6 within 4 bits. If two segments differ in at most one bit, the codeword
nearest to the one is within 4 bits of the other. Of at most 3 differing bits, two of the three segments hold at most one each
(pigeonhole), so a pair of linked fingerprints always shares a key made of two codeword indices: 3 index keys for each fingerprint
meet up to 108 probe keys. What shares a key is verified on the whole 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, encode, release, stage, unstage
from palimpsest.llm.components import connected

#: XXH64's seed as Spark uses it, the Golay generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1, the segments as (shift, bits).
SEED = 42
GOLAY = 0b110001110101
SEGMENTS = ((42, 22), (21, 21), (0, 21))
MAX_BITS = 3

#: A key with more index rows than BLOCK is dealt over a grid of groups, each with about so many index rows and so many probes.
BLOCK, PROBE_BLOCK = 4096, 65_536
#: So many hot keys may travel with the task; beyond that they're joined.
HOT_KEYS = 50_000
#: Pairs compared at once, and linked nodes that a task remembers.
AT_ONCE, MOST_JOINED = 1 << 20, 1 << 21


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of a text's lower-cased word shingles; 0 for no words.

    Bit b is set if it is set in over half of the shingles' XXH64 values, repeats included. Fewer words than `width` make one shingle.
    """
    words = encode(text or "").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", width: int = 3) -> DataFrame:
    """docs plus a long column `name`. Null texts have fingerprint 0, as empty ones do."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, width)).astype("int64")

    return docs.withColumn(name, of(F.coalesce(F.col(text), F.lit(""))))


@lru_cache(1)
def _code() -> tuple[np.ndarray, ...]:
    """Syndrome tables for three bytes, the nearest codeword's error by syndrome, all errors up to weight 4, and which of those count."""

    def rest(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        return x

    of_bit = [rest(1 << k) for k in range(23)]
    tables = np.zeros((3, 256), np.int32)
    for t in range(3):
        for v in range(256):
            for k in range(8):
                if v >> k & 1 and 8 * t + k < 23:
                    tables[t, v] ^= of_bit[8 * t + k]
    nearest, errors = np.zeros(2048, np.int32), [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for k in bits:
                syndrome ^= of_bit[k]
            error = sum(1 << k for k in bits)
            if weight < 4:
                nearest[syndrome] = error
            errors[syndrome].append(error)
    most = max(map(len, errors))
    table, real = np.zeros((2048, most), np.int32), np.zeros((2048, most), bool)
    for s, found in enumerate(errors):
        table[s, : len(found)], real[s, : len(found)] = found, True
    return tables, nearest, table, real


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 23-bit words: the index of the nearest codeword, the indices of all codewords within 4 bits (a row each), and which of these are real."""
    tables, nearest, errors, real = _code()
    syndrome = tables[0][words & 255] ^ tables[1][words >> 8 & 255] ^ tables[2][words >> 16]
    return (words ^ nearest[syndrome]) >> 11, (words[:, None] ^ errors[syndrome]) >> 11, real[syndrome]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index keys, their fingerprints' positions, probe keys, their positions)."""
    bits = prints.view(np.uint64)
    parts = [codeword_indices((bits >> np.uint64(shift) & np.uint64((1 << n) - 1)).astype(np.int32)) for shift, n in SEGMENTS]
    index, probe, rows = [], [], []
    for which, (i, j) in enumerate(combinations(range(3), 2)):
        (near_i, all_i, real_i), (near_j, all_j, real_j) = parts[i], parts[j]
        index.append((np.int64(which) << 24) | (near_i.astype(np.int64) << 12) | near_j)
        both = (np.int64(which) << 24) | (all_i.astype(np.int64)[:, :, None] << 12) | all_j[:, None, :]
        there = real_i[:, :, None] & real_j[:, None, :]
        probe.append(both[there])
        rows.append(np.nonzero(there)[0])
    return np.concatenate(index), np.tile(np.arange(len(bits)), 3), np.concatenate(probe), np.concatenate(rows)


def spread(prints: np.ndarray) -> np.ndarray:
    """Like prints differ in few bits: all bits are mixed before they are dealt."""
    x = prints.view(np.uint64)
    for times in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)):
        x = (x ^ (x >> np.uint64(32))) * times
    return x ^ (x >> np.uint64(32))


@dataclass
class Hot:
    """Keys that are dealt over a grid, ascending: in how many blocks their index rows lie, and in how many their probes."""

    key: np.ndarray
    index: np.ndarray
    probe: np.ndarray

    @classmethod
    def none(cls) -> Hot:
        return cls(*(np.empty(0, np.int64) for _ in range(3)))


def dealt(key: np.ndarray, node: np.ndarray, role: int, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """(row, block) of what is sent for rows of one role: a row of a hot key goes to its own block of its role, times all blocks of the other."""
    pick, block = np.arange(len(key)), np.zeros(len(key), np.int32)
    if len(hot.key) and len(key):
        at = np.minimum(np.searchsorted(hot.key, key), len(hot.key) - 1)
        there = hot.key[at] == key
        index, probe = np.where(there, hot.index[at], 1), np.where(there, hot.probe[at], 1)
        own, times = (index, probe) if role == 0 else (probe, index)
        pick = np.repeat(pick, times)
        step = np.arange(len(pick)) - (np.cumsum(times) - times)[pick]
        mine = (spread(node) % own.astype(np.uint64)).astype(np.int64)[pick]
        block = (mine * probe[pick] + step if role == 0 else step * probe[pick] + mine).astype(np.int32)
    return pick, block


#: (a batch of nodes) -> (index keys, their rows, probe keys, their rows, nodes, the words of their fingerprints)
Keys = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]


def _plain_keys(batch: pa.RecordBatch):
    prints = batch.column(0).to_numpy(zero_copy_only=False)
    return *keys_of(prints), prints, [prints]


def _keyed(keys: Keys, hot: Hot, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                ikey, irow, pkey, prow, node, prints = keys(whole.slice(lo, 2048))
                for role, key, row in ((0, ikey, irow), (1, pkey, prow)):
                    pick, block = dealt(key, node[row], role, hot)
                    sent = row[pick]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[pick]), pa.array(block), pa.array(np.full(len(pick), role, np.int8)), *(pa.array(p[sent]) for p in prints)], ["key", "block", "role", *(f"w{k}" for k in range(words))]
                    )

    return run


def _counted(keys: Keys, role: int, part: int = 1):
    """How many rows of a role each key has in a batch, of one node in `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                got = keys(whole.slice(lo, 8192))
                key, row, node = got[2 * role], got[2 * role + 1], got[4]
                key, many = np.unique(key[spread(node[row]) % np.uint64(part) == 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(many.astype(np.int64) * part)], ["key", "many"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of one batch as stars: each node but the smallest of its component, with that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


class _Joined:
    """What a task's links have joined: nodes ascending, and a node of their component each. Forgets all when it has grown too large."""

    def __init__(self) -> None:
        self.nodes = self.roots = np.empty(0, np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        if not len(self.nodes):
            return x
        at = np.minimum(np.searchsorted(self.nodes, x), len(self.nodes) - 1)
        return np.where(self.nodes[at] == x, self.roots[at], x)

    def new(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that join what x and y join and earlier ones haven't."""
        a, b = self.of(x), self.of(y)
        a, b = forest(a[a != b], b[a != b])
        nodes = np.union1d(self.nodes, np.concatenate([x, y]))
        roots = self.of(nodes)
        if len(a):
            at = np.minimum(np.searchsorted(a, roots), len(a) - 1)
            roots = np.where(a[at] == roots, b[at], roots)
        if len(nodes) > MOST_JOINED:
            nodes = roots = np.empty(0, np.int64)
        self.nodes, self.roots = nodes, roots
        return a, b


def _distance(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    out = np.bitwise_count((x[0] ^ y[0]).view(np.uint64)).astype(np.int16)
    for a, b in zip(x[1:], y[1:], strict=True):
        out += np.bitwise_count((a ^ b).view(np.uint64))
    return out


def _linked(limit: int, words: int, named: Callable[[list[np.ndarray]], np.ndarray]):
    """Batches sorted by key, block, role -> links. An index row precedes the probes of its group; those of an unended group are carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = [np.empty(0, np.int64)] * words
        last, held, joined = None, nothing, _Joined()
        for batch in batches:
            if not batch.num_rows:
                continue
            key, block, role, *prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            new[0] = last != (key[0], block[0])
            held = nothing if new[0] else held
            group = np.cumsum(new) - new[0]
            indexed = role == 0
            many = np.bincount(group[indexed], minlength=group[-1] + 1)
            many[0] += len(held[0])
            start = np.cumsum(many) - many
            pool = [np.concatenate([h, p[indexed]]) for h, p in zip(held, prints, strict=True)]
            probes = np.nonzero(~indexed & (many[group] > 0))[0]
            times = many[group[probes]]
            ends = np.cumsum(times)
            at, froms, tos = 0, [], []
            while at < len(probes):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE)))
                n, some = times[at:to], probes[at:to]
                pick = np.repeat(np.arange(len(some)), n)
                inside = np.arange(len(pick)) - (np.cumsum(n) - n)[pick]
                place = start[group[some]][pick] + inside
                x, y = [p[place] for p in pool], [p[some][pick] for p in prints]
                far = _distance(x, y)
                good = np.nonzero((far > 0) & (far <= limit))[0]
                if len(good):
                    x, y = forest(named([p[good] for p in x]), named([p[good] for p in y]))
                    froms.append(x)
                    tos.append(y)
                at = to
            if froms:
                x, y = joined.new(np.concatenate(froms), np.concatenate(tos))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
            last = (key[-1], block[-1])
            held = [p[start[group[-1]] :] if many[group[-1]] else p[:0] for p in pool]

    return run


def met(nodes: DataFrame, keys: Keys, words: int, block: int = BLOCK, probe_block: int = PROBE_BLOCK, hot_keys: int = HOT_KEYS) -> DataFrame:
    """nodes -> (key, block, role, w0...): each node's index rows (role 0) and probes (role 1), those of crowded keys dealt over a grid.

    A group (key, block) holds about `block` index rows and `probe_block` probes at most, whatever the key: each is sent to all blocks of the other role.
    """
    part = max(1, min(64, probe_block // 512))  # probes are many: which keys have too many of them shows in a part of the nodes
    counts = lambda role, part, name, each: nodes.mapInArrow(_counted(keys, role, part), "key long, many long").groupBy("key").agg(F.ceil(F.sum("many") / each).cast("int").alias(name)).where(F.col(name) > 1)
    crowded = counts(0, 1, "index", block).join(counts(1, part, "probe", probe_block), "key", "full")
    crowded = stage(crowded.select("key", F.coalesce("index", F.lit(1)).alias("index"), F.coalesce("probe", F.lit(1)).alias("probe")), "crowded")
    columns = ", ".join(["key long, block int, role byte", *(f"w{k} long" for k in range(words))])
    if crowded.count() <= hot_keys:
        found = sorted(tuple(r) for r in crowded.collect())
        unstage(crowded)
        return nodes.mapInArrow(_keyed(keys, Hot(*(np.array([r[k] for r in found], np.int64) for k in range(3))), words), columns)
    names = [f"w{k}" for k in range(words)]
    every = nodes.mapInArrow(_keyed(keys, Hot.none(), words), columns).drop("block").join(crowded, "key", "left")
    index, probe = F.coalesce("index", F.lit(1)), F.coalesce("probe", F.lit(1))
    mine = F.pmod(F.xxhash64(*names), F.when(F.col("role") == 0, index).otherwise(probe)).cast("int")
    blocks = F.when(F.col("role") == 0, F.transform(F.sequence(F.lit(0), probe - 1), lambda t: mine * probe + t)).otherwise(F.transform(F.sequence(F.lit(0), index - 1), lambda t: t * probe + mine))
    return every.select("key", F.explode(blocks).alias("block"), "role", *names)


def linked(rows: DataFrame, limit: int, words: int, named: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """What `met` gives -> (a, b): links that join the same nodes as all pairs that share a key and differ in at most `limit` bits do.

    Each task returns the links that join what it hasn't joined before, so that a group of n like nodes gives rows in proportion to n, not n squared.
    """
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "role").mapInArrow(_linked(limit, words, named), "a long, b long")


def links(prints: DataFrame, limit: int = MAX_BITS, block: int = BLOCK, hot_keys: int = HOT_KEYS, probe_block: int = PROBE_BLOCK) -> DataFrame:
    """prints(print long, distinct) -> (a, b): links that join the same prints as all pairs within `limit` (at most 3) bits do."""
    if not 0 <= limit <= MAX_BITS:
        raise ValueError(f"the keys hold for up to {MAX_BITS} bits")
    return linked(met(prints, _plain_keys, 1, block, probe_block, hot_keys), limit, 1, lambda w: w[0])


def compared(rows: DataFrame) -> DataFrame:
    """Of what `met` gives, one row (groups, index_rows, probes, pairs): how much the keys ask to be compared."""
    each = rows.groupBy("key", "block").agg(F.count_if(F.col("role") == 0).alias("i"), F.count_if(F.col("role") == 1).alias("p"))
    return each.agg(F.count("*").alias("groups"), F.sum("i").alias("index_rows"), F.sum("p").alias("probes"), F.sum(F.col("i") * F.col("p")).alias("pairs"))


def components(first: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """first(node, first id) and links -> (node, component_id), staged: the smallest id that links reach from each node."""
    roots = connected(found)
    rooted = stage(first.join(roots, first[node] == roots["node"], "left").select(first[node], "first", F.coalesce("root", first[node]).alias("root")), "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    out = stage(rooted.join(least, "root").select(node, "component_id"), "members")
    unstage(roots, rooted, least)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, limit: int = MAX_BITS) -> DataFrame:
    """One row for each row of docs: (doc_id, fingerprint as 16 hex digits, component_id).

    Fingerprints that differ in at most `limit` bits are linked; component_id is the smallest doc_id that links reach, the row's own included.
    Null and empty texts have fingerprint zero and link as others do. A null doc_id gets a row, and counts only if its component has no other id.
    Repeated rows each get a row. Empty tables give no rows. Other columns are ignored.
    """
    printed = stage(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), name="print", width=width).select("doc_id", "print"), "prints")
    first = stage(printed.groupBy("print").agg(F.min("doc_id").alias("first")), "first")
    found = stage(links(first.select("print"), limit), "links")
    release(docs.sparkSession)
    of_print = components(first, found, "print")
    unstage(first, found)
    return printed.join(of_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def smallest_of(docs: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """The rows of docs without the ids all of whose rows in found(doc_id, component_id) have a smaller component_id."""
    gone = found.groupBy("doc_id").agg(F.every(F.col("component_id") < F.col("doc_id")).alias("gone")).where("gone").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, limit: int = MAX_BITS) -> DataFrame:
    """The rows of docs, columns unchanged, without those whose component has a smaller id.

    An id goes only if that holds for all rows that have it, so repeated rows of the kept id stay. Rows without an id stay.
    """
    return smallest_of(docs, near_duplicates(docs, doc_id, text, width, limit), doc_id)
