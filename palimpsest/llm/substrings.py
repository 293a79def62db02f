"""Substring dedup by fixed-block anchors.

Reference blocks are the non-overlapping runs of 10 words of every text. Any 20 consecutive words hold one whole block of their own text, so
a window that occurs twice has a block that some rolling window of 10 words of the other text equals. All rolling windows are probed
against all blocks by hash, in buckets; what comes back is which blocks occur more than once. From these anchors the hits are extended, of all
texts that share one at once: the 20-word windows round an anchor are its extensions to the left and right, one word at a time. Each is looked up by a
hash of 96 bits, its first occurrence in order of (doc_id, start) stays, and windows that repeat the same passage word after word are one maximal exact
repeat, with the place that it repeats.

Each task sums up what it sends: of equal windows in one batch of documents one row goes out, so a passage that a third of all documents
share reaches its bucket once a batch, and no step makes pairs. A bucket is reduced as it is read: what is held are its distinct windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

from palimpsest.llm.common import WORD_GAP, WORD_SPACE, bounded_batches, buckets, encode, release, stage, trim, unstage

#: Words of a window and of a block; window >= 2 * block - 1.
WINDOW, BLOCK = 20, 10
#: Words of a batch, windows that a bucket should hold, and windows that are read before a bucket is reduced.
BATCH_WORDS, BUCKET_ROWS, REDUCE_ROWS = 150_000, 500_000, 2_000_000

_NO_ID = np.iinfo(np.int64).max
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: Columns of what goes to the buckets, each packed by itself as ids in order compress well: hashes, ids, tags, places.
_PLACED, _SEEN = ("<u4", "<i8", "<u4", "<u4"), ("<u8", "<u4", "<i8", "<u4", "<u4")
_RUN_NAMES, _RUN = ["doc", "tag", "first", "last", "of", "of_first"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
_RUN_KINDS = "doc long, tag long, first int, last int, of long, of_first int"
_TO_BUCKETS = ["bucket", "h1", "h2", "docs", "tags", "ats", *_RUN_NAMES]
_KNOWN = np.uint32(1 << 31)


def words_of(text: str | None) -> list[bytes]:
    return encode(text).split() if text else []


def _hashed(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_digest if not seed else (lambda w: xxhash.xxh64_digest(w, seed))
    return np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M3
    return h ^ (h >> np.uint64(29))


def _windows(h: np.ndarray, length: int, step: np.uint64) -> np.ndarray:
    """A hash of each run of `length` word hashes."""
    n = max(0, len(h) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out *= step
        out += h[k : k + n]
    return _mixed(out)


def _tag(words: list[bytes]) -> int:
    """Tells apart texts under one id."""
    return int.from_bytes(hashlib.sha256(b" ".join(words)).digest()[:4], "big")


def _part(doc: int, words: list[bytes]) -> int:
    """Rows without an id have one order, but each text is a document of its own; 0 for rows with one."""
    return _tag(words) if doc == _NO_ID else 0


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, doc, text) -> (doc_id, doc, tag, n_words, sha256): what each text is before anything is removed."""
    for batch in batches:
        tags, sizes, digests = [], [], []
        for text in batch.column(2).to_pylist():
            words = words_of(text)
            digest = hashlib.sha256(b" ".join(words))
            tags.append(int.from_bytes(digest.digest()[:4], "big"))
            sizes.append(len(words))
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(tags, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "doc", "tag", "n_words", "sha256"])


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, doc, text) -> (doc_id, doc, part, z): texts packed for a join, at less than half their size."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts, docs = batch.column(2).to_pylist(), batch.column(1).to_pylist()
        z = [None if t is None else pack(encode(t)) for t in texts]
        parts = [_part(d, words_of(t)) if d == _NO_ID else 0 for d, t in zip(docs, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(parts, pa.int64()), pa.array(z, pa.binary())], ["doc_id", "doc", "part", "z"])
    trim()


def _words_in(z: bytes | None) -> list[bytes]:
    return zstandard.decompress(z).split() if z else []


def _batched(batches: Iterator[pa.RecordBatch], extra: bool = False) -> Iterator[list[tuple]]:
    """(doc, text) or (doc, packed text, hits) -> lists of (doc, words, hits), of BATCH_WORDS words or one document more."""
    held, size = [], 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for doc, text, hits in zip(columns[0], columns[1], columns[2] if extra else columns[1], strict=True):
            words = _words_in(text) if extra else words_of(text)
            if len(words) >= WINDOW:
                held.append((doc, words, hits))
                size += len(words)
                if size >= BATCH_WORDS:
                    yield held
                    held, size = [], 0
    if held:
        yield held
    del held
    trim()


def _packed(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[list[bytes]]]:
    """The buckets that occur, and of each column the bytes of each bucket, in the order of the rows."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    ends = [*first[1:].tolist(), len(bucket)]
    return found, [[x[lo:hi].tobytes() for lo, hi in zip(first.tolist(), ends, strict=True)] for x in (c[order] for c in columns)]


def _unpacked(rows: list[list[bytes]], kinds: tuple[str, ...]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in enumerate(kinds)]


def _blocks(many: int):
    """(doc, text) -> for each bucket the batch's distinct rolling windows, and with their place those that are blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batched(batches):
            h = _hashed([w for _, words, _ in held for w in words])
            sizes = np.array([len(words) for _, words, _ in held])
            first = np.cumsum(sizes) - sizes
            docs = np.array([d for d, _, _ in held], np.int64)
            parts = np.array([_part(d, words) for d, words, _ in held], np.uint32)
            rolled = _windows(h, BLOCK, _M1)
            of = np.repeat(np.arange(len(sizes)), sizes)[: len(rolled)]
            at = np.arange(len(rolled)) - first[of]
            inside = at + BLOCK <= sizes[of]
            rolled, of, at = rolled[inside], of[inside], at[inside]
            order = np.argsort(rolled, kind="stable")
            rolled, of, at = rolled[order], of[order], at[order]
            new = np.concatenate([[True], rolled[1:] != rolled[:-1]])
            group = np.cumsum(new) - 1
            several = (np.bincount(group) > 1)[group]
            block = at % BLOCK == 0
            bucket, low = (rolled >> np.uint64(32)) % np.uint64(many), (rolled & np.uint64(0xFFFFFFFF)).astype("<u4")
            plain = new & (several | ~block)
            found, (hashes,) = _packed(bucket[plain], [low[plain]])
            yield _columns(found, {"plain": hashes})
            placed = np.nonzero(block)[0]
            placed = placed[np.lexsort((at[placed], docs[of[placed]]))]
            where = at[placed].astype("<u4") | np.where(several[placed], _KNOWN, np.uint32(0))
            found, packed = _packed(bucket[placed], [low[placed], docs[of[placed]], parts[of[placed]], where])
            yield _columns(found, dict(zip(("h", "doc", "part", "at"), packed, strict=True)))

    def _columns(found: np.ndarray, given: dict[str, list[bytes]]) -> pa.RecordBatch:
        names = ("plain", "h", "doc", "part", "at")
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *(pa.array(given.get(n, [b""] * len(found)), pa.binary()) for n in names)], ["bucket", *names])

    return run


def _per_bucket(reducer: Callable[[], _Blocks | _Windows]):
    """Batches sorted by bucket -> what a reducer makes of each bucket, one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for b, *rest in zip(*columns, strict=True):
                if b != now:
                    if one is not None:
                        yield from one.reduced()
                    now, one = b, reducer()
                one.rows.append(rest)
                one.size += sum(len(x) for x in rest[:2] if x)
                if one.size >= 4 * REDUCE_ROWS:
                    yield from one.reduced()
        if one is not None:
            yield from one.reduced()
            del one
        trim()

    return run


class _Blocks:
    """Of a bucket of 10-word windows: which hashes there are, which of them twice at least, and the blocks whose hash was seen once as yet."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.size = 0
        self.seen, self.twice = np.empty(0, np.uint32), np.empty(0, np.uint32)
        self.waiting = [np.empty(0, kind) for kind in _PLACED]

    def reduced(self) -> Iterator[pa.RecordBatch]:
        plain, *placed = _unpacked(self.rows, ("<u4", *_PLACED))
        self.rows, self.size = [], 0
        # a block that its own batch knows to occur twice is among the plain ones
        known = placed[-1] >= _KNOWN
        new = placed[0][~known]
        self.seen, times = np.unique(np.concatenate([self.seen, self.twice, plain, new]), return_counts=True)
        self.twice = self.seen[times > 1]
        waiting = [np.concatenate([w, p]) for w, p in zip(self.waiting, placed, strict=True)]
        at = waiting[-1]
        hit = (at >= _KNOWN) | (np.isin(waiting[0], self.twice) if len(self.twice) else False)
        self.waiting = [w[~hit] for w in waiting]
        yield pa.RecordBatch.from_arrays([pa.array(waiting[1][hit]), pa.array(waiting[2][hit].astype(np.int64)), pa.array((at[hit] & ~_KNOWN).astype(np.int32))], ["doc", "part", "at"])


def _runs(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, of: np.ndarray, of_at: np.ndarray) -> pa.RecordBatch:
    """Windows and what each repeats -> maximal runs of starts that repeat one passage, as (doc, tag, first, last, of, of_first)."""
    order = np.lexsort((of_at, of, at, tag, doc))
    doc, tag, at, of, of_at = (x[order] for x in (doc, tag, at.astype(np.int64), of, of_at.astype(np.int64)))
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] > at[:-1] + 1) | (of[1:] != of[:-1]) | (of_at[1:] - at[1:] != of_at[:-1] - at[:-1])
    last = np.append(np.nonzero(cut)[0][1:] - 1, len(doc) - 1) if len(doc) else np.empty(0, int)
    return pa.RecordBatch.from_arrays([pa.array(x).cast(kind) for x, kind in zip((doc[cut], tag[cut], at[cut], at[last], of[cut], of_at[cut]), _RUN, strict=True)], _RUN_NAMES)


def _later(h: tuple[np.ndarray, ...], doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order by hash and place; which of the ordered rows are the first of their hash, which start later than that one, which repeat the row before, and the first."""
    order = np.lexsort((tag, at, doc, *reversed(h)))
    same = np.ones(max(0, len(order) - 1), bool)
    for x in h:
        x = x[order]
        same &= x[1:] == x[:-1]
    new = np.concatenate([[True], ~same]) if len(order) else np.empty(0, bool)
    lead = order[np.nonzero(new)[0][np.cumsum(new) - 1]]
    later = (doc[order] != doc[lead]) | (at[order] != at[lead])
    again = ~new
    for x in (doc, tag, at):
        x = x[order]
        again[1:] &= x[1:] == x[:-1]
    return order, new, later, again, lead


def _candidates(many: int):
    """(doc, packed text, hit blocks) -> for each bucket the batch's first occurrence of each window round a hit; and the runs that repeat one of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batched(batches, True):
            words = [w for _, words, _ in held for w in words]
            ha, hb = _hashed(words), _hashed(words, 7)
            sizes = np.array([len(words) for _, words, _ in held])
            first = np.cumsum(sizes) - sizes
            docs = np.array([d for d, _, _ in held], np.int64)
            tags = np.array([_tag(words) for _, words, _ in held], np.uint32)
            near = np.zeros(len(words) + 1, np.int32)
            for base, n, (_, _, hits) in zip(first, sizes, held, strict=True):
                hits = np.asarray(hits, np.int64)
                hits = hits[hits + BLOCK <= n]
                np.add.at(near, base + np.maximum(hits - (WINDOW - BLOCK), 0), 1)
                np.add.at(near, base + np.minimum(hits, n - WINDOW) + 1, -1)
            places = np.nonzero(np.cumsum(near[:-1]) > 0)[0]
            h1 = _windows(ha, WINDOW, _M1)[places]
            h2 = (_windows(hb, WINDOW, _M2)[places] >> np.uint64(32)).astype(np.uint32)
            of = np.searchsorted(first, places, side="right") - 1
            doc, tag, at = docs[of], tags[of], (places - first[of]).astype(np.uint32)
            order, new, later, again, lead = _later((h1, h2), doc, tag, at)
            sent = np.sort(order[(new | ~later) & ~again])
            found, packed = _packed(h1[sent] % np.uint64(many), [x[sent].astype(kind) for x, kind in zip((h1, h2, doc, tag, at), _SEEN, strict=True)])
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *(pa.array(x, pa.binary()) for x in packed), *(pa.nulls(n, t) for t in _RUN)], _TO_BUCKETS)
            marks, of = order[later], lead[later]
            runs = _runs(doc[marks], tag[marks], at[marks], doc[of], at[of])
            # runs go to any bucket, and through it
            m = runs.num_rows
            where = (runs.column(0).to_numpy() + runs.column(1).to_numpy()) % many
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), *(pa.nulls(m, pa.binary()) for _ in _SEEN), *runs.columns], _TO_BUCKETS)

    return run


class _Windows:
    """Of a bucket of 20-word windows: the first occurrence of each as yet. What starts later than one is a repeat, whatever is still to come."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.size = 0
        self.first = [np.empty(0, kind) for kind in _SEEN]

    def reduced(self) -> Iterator[pa.RecordBatch]:
        local = [r[len(_SEEN) :] for r in self.rows if r[0] is None]
        if local:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*local, strict=True), _RUN, strict=True)], _RUN_NAMES)
        given = _unpacked([r for r in self.rows if r[0] is not None], _SEEN)
        self.rows, self.size = [], 0
        h1, h2, doc, tag, at = held = [np.concatenate([x, y]) for x, y in zip(self.first, given, strict=True)]
        order, _, later, again, lead = _later((h1, h2), doc, tag, at)
        marks, of = order[later], lead[later]
        yield _runs(doc[marks], tag[marks], at[marks], doc[of], at[of])
        kept = order[~later & ~again]
        self.first = [x[kept] for x in held]


def covered(n: int, runs: list[tuple[int, int]]) -> np.ndarray:
    """Which of n words lie in a window that starts in one of the runs."""
    change = np.zeros(n + 1, np.int32)
    for first, last in runs:
        change[first] += 1
        change[min(last + WINDOW, n)] -= 1
    return np.cumsum(change[:-1]) > 0


def _kept(words: list[bytes], runs: list[tuple[int, int]]) -> list[bytes]:
    gone = covered(len(words), runs)
    return [w for w, x in zip(words, gone.tolist(), strict=True) if not x]


def _numbered(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, bool]:
    """((doc_id, doc, text), whether doc is the id itself): doc is a number in the order of the ids, greatest for rows without one.

    Whole numbers are their own; other ids, and tables that hold the greatest number there is, are sorted once, by themselves.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if isinstance(plain.schema["doc_id"].dataType, IntegralType) and plain.agg(F.max("doc_id")).first()[0] != int(_NO_ID):
        return plain.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NO_ID))).alias("doc"), "text"), True
    order = plain.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct().orderBy("__id")
    order = stage(order.select("__id", F.monotonically_increasing_id().alias("doc")), "order")
    return plain.join(order, F.col("doc_id") == F.col("__id"), "left").select("doc_id", F.coalesce("doc", F.lit(int(_NO_ID))).alias("doc"), "text"), False


def _part_of(doc: Column, tag: Column) -> Column:
    return F.when(doc == int(_NO_ID), tag).otherwise(F.lit(0)).cast("long")


def _repeat_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, doc, text) -> (each row's (doc_id, doc, tag, n_words, sha256, copy), the runs of repeated windows by (doc, tag)), both staged.

    copy: the same words are a whole document of a smaller id. Such a document needs no runs: all its windows start earlier elsewhere.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = stage(docs.mapInArrow(_measured, f"doc_id {kind}, doc long, tag long, n_words long, sha256 string"), "measured")
    total = measured.agg(F.sum("n_words")).first()[0] or 0
    many = buckets(spark, total, BUCKET_ROWS)
    leader = stage(measured.where(F.col("n_words") >= WINDOW).groupBy("sha256").agg(F.min("doc").alias("leader"), F.count("*").alias("n")).where("n > 1").select("sha256", "leader"), "leaders")
    known = stage(measured.join(leader, "sha256", "left").select("doc_id", "doc", "tag", "n_words", "sha256", F.coalesce(F.col("doc") > F.col("leader"), F.lit(False)).alias("copy")), "known")
    unstage(measured, leader)
    probed = docs.select("doc", "text").mapInArrow(_blocks(many), "bucket int, plain binary, h binary, doc binary, part binary, at binary").repartition("bucket").sortWithinPartitions("bucket")
    hits = stage(probed.mapInArrow(_per_bucket(_Blocks), "doc long, part long, at int"), "hits")
    release(spark)
    # texts that share an id share hits: these only say where to look
    copies = known.groupBy("doc", _part_of(F.col("doc"), F.col("tag")).alias("part")).agg(F.every("copy").alias("copy")).where("copy")
    by_doc = stage(hits.groupBy("doc", "part").agg(F.collect_set("at").alias("hits")).join(copies, ["doc", "part"], "left_anti"), "hits")
    texts = docs.mapInArrow(_zipped, f"doc_id {kind}, doc long, part long, z binary").select("doc", "part", "z")
    extended = texts.join(by_doc, ["doc", "part"]).select("doc", "z", "hits").mapInArrow(_candidates(many), f"bucket int, h1 binary, h2 binary, docs binary, tags binary, ats binary, {_RUN_KINDS}")
    runs = extended.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_per_bucket(_Windows), _RUN_KINDS)
    runs = stage(runs.groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "last", "of", "of_first")).alias("runs")), "runs")
    unstage(hits, by_doc)
    release(spark)
    return known, runs


def _own_runs(words: list[bytes], of: list[dict]) -> list[tuple[int, int]]:
    """The runs of the text itself, not of another one under its id."""
    tag = _tag(words)
    return [(r["first"], r["last"]) for x in of if x["tag"] == tag for r in x["runs"]]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, packed text, runs by tag) -> (doc_id, n_words, n_removed, kept_sha256) of those that have runs."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for row, (z, of) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
            words = _words_in(z)
            if runs := _own_runs(words, of):
                kept = _kept(words, runs)
                for x, y in zip(out, (row, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    x.append(y)
        rows, *rest = out
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _by_text(runs: DataFrame) -> DataFrame:
    """(doc, tag, runs) -> (doc, part, of): the runs of all texts that a row's (doc, part) may be."""
    short = F.transform("runs", lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"))).alias("runs")
    return runs.select("doc", _part_of(F.col("doc"), F.col("tag")).alias("part"), F.struct("tag", short).alias("one")).groupBy("doc", "part").agg(F.collect_list("one").alias("of"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: (doc_id, n_words, n_removed, kept_sha256): every word in a 20-word window that also starts earlier goes.

    Earlier means a smaller doc_id, of whatever type that has an order, or an earlier start in the same document; windows are judged on the input. Rows
    without an id come after all others, and are one document to each other. Null and empty texts have no words. Rows that repeat an id and its text are the
    same document: neither is earlier. Texts of fewer than 20 words lose nothing; very long ones are read whole. An empty table gives no rows;
    other columns are ignored.
    """
    plain, _ = _numbered(docs, doc_id, text)
    kind = plain.schema["doc_id"].dataType.simpleString()
    known, runs = _repeat_runs(plain)
    texts = plain.mapInArrow(_zipped, f"doc_id {kind}, doc long, part long, z binary")
    cut = texts.join(_by_text(runs), ["doc", "part"]).select("doc_id", "z", "of").mapInArrow(_cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
    copied = known.where("copy").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    whole = known.where("not copy").join(runs.select("doc", "tag"), ["doc", "tag"], "left_anti")
    return cut.unionByName(copied).unionByName(whole.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256")))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The maximal exact repeats themselves: (doc_id, start, length, of, of_start), in words from 0, `of` the doc_id of an earlier document, or the same.

    Every window that `repeats` removes lies in one of them. Documents whose words are all those of one with a smaller id have one of their whole length.
    """
    plain, _ = _numbered(docs, doc_id, text)
    known, runs = _repeat_runs(plain)
    names = known.groupBy("doc").agg(F.first("doc_id").alias("doc_id"))
    rows = runs.select("doc", F.explode("runs").alias("r")).select("doc", F.col("r.first").alias("start"), (F.col("r.last") - F.col("r.first") + WINDOW).alias("length"), "r.of", F.col("r.of_first").alias("of_start"))
    leader = known.where("not copy").groupBy("sha256").agg(F.min("doc").alias("of"))
    whole = known.where("copy").join(leader, "sha256").select("doc", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("length"), "of", F.lit(0).alias("of_start"))
    rows = rows.unionByName(whole).distinct()
    return rows.join(names, "doc").join(names.select(F.col("doc").alias("of"), F.col("doc_id").alias("of_id")), "of").select("doc_id", "start", "length", F.col("of_id").alias("of"), "of_start")


def _shortened(at: int):
    """Rows with the runs of their id as last column -> the same rows without it, the text at column `at` cut; rows of which nothing is left are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            for k, of in enumerate(batch.columns[-1].to_pylist()):
                words = words_of(texts[k]) if of else []
                runs = _own_runs(words, of) if of else []
                if runs:
                    texts[k] = b" ".join(_kept(words, runs)).decode("utf-8", "surrogatepass")
                keep.append(not runs or bool(texts[k]))
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))
        trim()

    return run


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, with repeated words cut from the text; rows of which nothing is left are dropped.

    Texts that lose nothing stay as they are, white space included; else the kept words are joined by one space. Ids are whole numbers, or any with an order.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]  # those of docs may clash with inner ones, and such with dots don't get through to Python
    own, at = docs.toDF(*names), docs.columns.index(text)
    key = names[docs.columns.index(doc_id)]
    plain, itself = _numbered(own, key, names[at])
    known, runs = _repeat_runs(plain)
    copies = known.where("copy").select("doc", "tag", F.array(F.struct(F.lit(0).alias("first"), (F.col("n_words") - WINDOW).cast("int").alias("last"), F.col("doc").alias("of"), F.lit(0).alias("of_first"))).alias("runs"))
    of = _by_text(runs.unionByName(copies.distinct()))
    # the digest of the words, as _part has it, of rows without an id
    digest = F.sha2(F.array_join(F.split(F.btrim(F.col(names[at]), F.lit(WORD_SPACE)), WORD_GAP), " "), 256)
    part = F.when(F.col(key).isNull(), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    if itself:
        doc = F.coalesce(F.col(key).cast("long"), F.lit(int(_NO_ID)))
        joined = own.withColumn("doc", doc).withColumn("part", F.coalesce(part, F.lit(0))).join(of, ["doc", "part"], "left")
    else:
        by_id = known.groupBy("doc_id", "doc").agg(F.count("*").alias("n")).join(of, "doc").select("doc_id", "part", "of")
        joined = own.withColumn("part", F.coalesce(part, F.lit(0))).join(by_id.withColumnRenamed("part", "p"), F.col(key).eqNullSafe(F.col("doc_id")) & (F.col("part") == F.col("p")), "left")
    kinds = StructType([StructField(n, f.dataType, True) for n, f in zip(names, docs.schema, strict=True)])
    return joined.select(*names, "of").mapInArrow(_shortened(at), kinds).toDF(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) AS t(p)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, q FROM later, unnest(range(p, p + 20)) AS t(q)),
word AS (SELECT doc_id, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY i) AS s, count(*) AS n
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.q WHERE gone.q IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
