"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are cut into lower-cased runs of letters and digits. Token k-grams of an item are its seeds; a document that
shares a seed with an item is tiled against it: the longest common runs of tokens that aren't marked yet are found with a Karp-Rabin
rolling hash and marked on both sides, longest first, until none of at least k tokens is left. Tiles may lie in any order, so passages
whose parts were moved are found too. An item is found in a document if its tiles cover enough of its tokens.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, stage, unstage
from palimpsest.llm.seeds import Seeds, tokens

#: Least tokens of a tile, least share of an item's tokens under tiles, and how many characters of benchmark text are in memory at a time.
LEAST = 5
COVERAGE = 0.5
PASS_CHARS = 8_000_000

_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def _rolling(line: list[int], free: list[bool], length: int) -> list[tuple[int, int]]:
    """(hash, start) of each window of `length` free tokens."""
    out, top = [], pow(_BASE, length - 1, _PRIME)
    value = run = 0
    for end, (token, ok) in enumerate(zip(line, free, strict=True)):
        if not ok:
            value = run = 0
            continue
        if run == length:
            value = (value - line[end - length] * top) % _PRIME
            run -= 1
        value = (value * _BASE + token) % _PRIME
        run += 1
        if run == length:
            out.append((value, end - length + 1))
    return out


def tile(text: list[int], item: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length) of each tile, longest first. Tokens of 0 in text match nothing."""
    free_t, free_i = [t != 0 for t in text], [True] * len(item)
    tiles: list[tuple[int, int, int]] = []
    search = max(least, min(20, len(item)))
    while True:
        table = defaultdict(list)
        for value, at in _rolling(item, free_i, search):
            table[value].append(at)
        found, longest = [], search
        for value, at in _rolling(text, free_t, search) if table else ():
            for start in table.get(value, ()):
                if start and at and free_i[start - 1] and free_t[at - 1] and item[start - 1] == text[at - 1]:
                    continue  # not maximal: found one token earlier
                n = 0
                while start + n < len(item) and at + n < len(text) and free_i[start + n] and free_t[at + n] and item[start + n] == text[at + n]:
                    n += 1
                if n >= search:
                    found.append((n, start, at))
                    longest = max(longest, n)
        if longest > 2 * search:
            search = longest
            continue
        again = False
        for n, start, at in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if all(free_i[start : start + n]) and all(free_t[at : at + n]):
                free_i[start : start + n] = [False] * n
                free_t[at : at + n] = [False] * n
                tiles.append((start, at, n))
            else:
                again = True  # what is left of an occluded match may still be long enough
        if again:
            continue
        if search == least:
            return sorted(tiles, key=lambda x: (-x[2], x[0], x[1]))
        search = max(least, search // 2)


class Tiler:
    """The items of one pass."""

    def __init__(self, items: list[tuple[object, str | None]], least: int = LEAST, coverage: float = COVERAGE):
        self.least, self.coverage = least, coverage
        lines = [(name, tokens(text)) for name, text in items]
        lines = [(name, line) for name, line in lines if len(line) >= least]
        self.names = [name for name, _ in lines]
        self.seeds = Seeds([line for _, line in lines], least)

    def matches(self, texts: list[str | None]) -> list[list[tuple[object, float, int, int]]]:
        """For each text the items found in it: (item, share covered, tiles, tokens covered), by item order."""
        out: list[list] = [[] for _ in texts]
        numbered, found = self.seeds.find([tokens(t) for t in texts])
        for (text, item), at in sorted(found.items()):
            line = self.seeds.patterns[item]
            if sum(min(self.least, y - x) for x, y in zip(at, [*at[1:], at[-1] + self.least], strict=True)) < self.coverage * len(line):
                continue  # every tile lies within seeds, and these cover too little
            part: list[int] = []
            end = -1
            for a in at:
                if a > end:
                    part.append(0)
                part += numbered[text][max(a, end) : a + self.least].tolist()
                end = a + self.least
            tiles = tile(part, line, self.least)
            covered = sum(n for _, _, n in tiles)
            if covered >= self.coverage * len(line):
                out[text].append((self.names[item], covered / len(line), len(tiles), covered))
        return out


def scannable(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """(item_id, tokens, scanned): how many tokens each row of benchmark has, and whether that's enough for its item to be looked for."""

    @F.arrow_udf("int")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([len(tokens(t)) for t in texts.to_pylist()], pa.int32())

    return benchmark.select(F.col(item_id).alias("item_id"), counted(F.col(item_text)).alias("tokens")).withColumn("scanned", F.col("tokens") >= least)


def _passes(benchmark: DataFrame, item_id: str, item_text: str, pass_chars: int) -> tuple[DataFrame, int]:
    """Distinct item texts (key, text, of), and in how many passes they travel. of: the number of the pass."""
    items = benchmark.select(F.col(item_text).alias("text")).where("text is not null").groupBy("text").agg(F.count("*").alias("n")).select(F.xxhash64("text").alias("key"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = 1 if chars <= pass_chars else -(-2 * chars // pass_chars)  # half full, as items are dealt by hash
    return items.withColumn("of", F.pmod(F.xxhash64("key"), F.lit(many)).cast("int")), many


def _broadcast(items: DataFrame, k: int, least: int, coverage: float) -> Broadcast:
    part = sorted((r["key"], r["text"]) for r in items.where(F.col("of") == k).collect())
    return items.sparkSession.sparkContext.broadcast(Tiler(part, least, coverage))


_FOUND, _ARROW = "array<struct<item:bigint,coverage:double,tiles:int,tokens:int>>", pa.list_(pa.struct([("item", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("tokens", pa.int32())]))


def _finder(shared: Broadcast):
    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for at in range(0, len(texts), 500):
            rows += shared.value.matches(texts.slice(at, 500).to_pylist())
        return pa.array([[dict(zip(("item", "coverage", "tiles", "tokens"), x, strict=True)) for x in row] for row in rows], _ARROW)

    return found


def _matches(docs: DataFrame, benchmark: DataFrame, kept: list[str], text: str, item_id: str, item_text: str, least: int, coverage: float, pass_chars: int) -> DataFrame:
    """docs(kept..., text) -> (kept..., item, coverage, tiles, tokens), item the key of a distinct item text.

    One pass of items is in memory at a time, on the driver and in a worker: each is broadcast, found and written before the next is fetched. With a
    single pass nothing is written.
    """
    bounded_batches(docs.sparkSession)
    items, many = _passes(benchmark, item_id, item_text, pass_chars)
    if many > 1:
        items = stage(items, "items")
    out = None
    for k in range(many):
        shared = _broadcast(items, k, least, coverage)
        # a plain explode makes Spark look for leaks twice
        found = docs.select(*kept, F.explode_outer(_finder(shared)(F.col(text))).alias("leak")).where("leak is not null").select(*kept, "leak.*")
        if many > 1:
            found = stage(found, "leaks")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    if many > 1:
        unstage(items)
    return out


def _named(found: DataFrame, benchmark: DataFrame, kept: list[str], item_id: str, item_text: str) -> DataFrame:
    """Items by their ids: an item text that several ids share is found for each."""
    ids = benchmark.select(F.col(item_id).alias("item_id"), F.xxhash64(F.col(item_text)).alias("item")).where(F.col(item_text).isNotNull())
    return found.join(ids, "item").select(*kept, "item_id", "coverage", "tiles", "tokens")


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """A row for each benchmark item found in a row of docs: (doc_id, item_id, coverage, tiles, tokens). Documents without leaks have no row.

    Benchmark text travels in passes of about `pass_chars` characters, one at a time, so its size isn't limited (a longer item is a pass of its own);
    documents aren't shuffled, but read once a pass. Null and empty texts hold no items; of very long texts every word counts. Null items and those of
    fewer than `least` tokens are never found: `scannable` lists them. Repeated items, and repeated rows of docs, are each found. An empty table
    gives no rows. Other columns are ignored.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _named(_matches(plain, benchmark, ["doc_id"], "text", item_id, item_text, least, coverage, pass_chars), benchmark, ["doc_id"], item_id, item_text)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows of docs in which no benchmark item is found, columns unchanged, whatever their names. Null and empty texts stay; repeated rows stay or go alike.

    With one pass of items a document is judged where it is read. With more, each pass writes the digests of texts that leak, and documents are joined
    against these: a leak depends on a document's text alone.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain, own = docs.toDF(*names), names[docs.columns.index(text)]
    bounded_batches(docs.sparkSession)
    items, many = _passes(benchmark, item_id, item_text, pass_chars)
    if many == 1:
        clean = plain.withColumn("leaks", _finder(_broadcast(items, 0, least, coverage))(F.col(own))).where(F.size("leaks") == 0)
        return clean.select(*names).toDF(*docs.columns)
    digest = F.sha2(F.coalesce(F.col(own), F.lit("")), 256)
    found = _matches(plain.select(digest.alias("digest"), F.col(own).alias("text")), benchmark, ["digest"], "text", item_id, item_text, least, coverage, pass_chars)
    gone = stage(found.select("digest").distinct(), "leaking")
    return plain.withColumn("own", digest).join(gone, F.col("own") == F.col("digest"), "left_anti").select(*names).toDF(*docs.columns)
