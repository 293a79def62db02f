"""Decontamination, license scans, token counts, mixing, neighbours, WARC: against brute force or exact round trips."""

import gzip
import io
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, licences, mixing, neighbours, tokens, warc


def brute_tiles(text, item, least):
    free_t, free_i, tiles = [t != 0 for t in text], [True] * len(item), []
    while True:
        best, found = least - 1, []
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and free_i[a + n] and free_t[b + n] and item[a + n] == text[b + n]:
                    n += 1
                if n > best:
                    best, found = n, [(a, b, n)]
                elif n == best >= least:
                    found.append((a, b, n))
        if best < least:
            return tiles
        for a, b, n in found:
            if all(free_i[a : a + n]) and all(free_t[b : b + n]):
                free_i[a : a + n] = [False] * n
                free_t[b : b + n] = [False] * n
                tiles.append((a, b, n))


def test_tiling():
    rnd = random.Random(3)
    for _ in range(300):
        item = [rnd.randint(1, 4) for _ in range(rnd.randint(3, 40))]
        text = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 30))] + item[rnd.randint(0, 20) :] + item[: rnd.randint(0, 20)]
        got, want = decontamination.tile(text, item, 3), brute_tiles(text, item, 3)
        assert sorted(n for _, _, n in got) == sorted(n for _, _, n in want)
        assert all(text[b : b + n] == item[a : a + n] for a, b, n in got)


def test_leaks(spark, odd, words):
    items = [words(n, 900 + n) for n in (14, 30, 59)] + [words(3, 5), words(30, 77)]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(7, None), (8, ""), (9, " ".join(items[0]))], "item_id long, text string")
    far = lambda k: " ".join(words(40, k))
    moved = items[2][30:] + words(9, 1) + items[2][:30]
    texts = [
        far(1) + " " + " ".join(items[0]) + " " + far(2),
        far(3) + " " + ", ".join(moved).upper() + "!",
        far(4) + " " + " ".join(items[1][:12]),
        None,
        "",
        far(5) + " " + " ".join(items[3]),
        " ".join(words(20000, 6)) + " " + " ".join(items[1]),
        far(8),
        " ".join(items[4][:16]),
    ]
    docs = odd(texts)
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(docs, benchmark).collect()}
    assert set(got) == {(0, 0), (0, 9), (1, 2), (6, 1), (8, 4)}
    assert got[0, 0]["coverage"] == 1.0 and got[1, 2]["tiles"] == 2 and got[1, 2]["tokens"] == 59
    again = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark, pass_chars=100).collect()}
    assert again == set(got)
    assert {r["item_id"]: r["scanned"] for r in decontamination.scannable(benchmark).collect()} == {0: True, 1: True, 2: True, 3: False, 4: True, 7: False, 8: False, 9: True}
    assert {r["doc_id"] for r in decontamination.without_leaks(docs, benchmark, pass_chars=100).collect()} == {2, 3, 4, 5, 7}
    clean = decontamination.without_leaks(docs, benchmark)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 5, 7]
    assert decontamination.leaks(docs.limit(0), benchmark).count() == 0
    assert decontamination.without_leaks(docs, benchmark.limit(0)).count() == len(texts)


def test_one_pass_at_a_time(spark, words, monkeypatch):
    """Of many passes, repeated items among them, each broadcast is gone before the next is made, and no plan holds more than one finder."""
    items = [(k, " ".join(words(12, k // 3))) for k in range(90)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(words(30, 500 + k)) + " " + t) for k, t in items[:20]], "doc_id long, text string")
    alive, most, plans = [], [], []
    make = decontamination._broadcast

    def counted(given, k, least, coverage):
        shared = make(given, k, least, coverage)
        assert sum(len(p) for p in shared.value.seeds.patterns) <= 12 * 8
        alive.append(shared)
        most.append(sum(b._path is not None for b in alive))
        destroy = shared.destroy
        monkeypatch.setattr(shared, "destroy", lambda: (destroy(), alive.remove(shared)))
        return shared

    kept = decontamination.stage
    monkeypatch.setattr(decontamination, "_broadcast", counted)
    monkeypatch.setattr(decontamination, "stage", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    found = decontamination.leaks(docs, benchmark, pass_chars=300)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {(k, i) for k, t in items[:20] for i, u in items if t == u}
    assert len(most) > 10 and max(most) == 1 and not alive
    finders = [p.count("ArrowEvalPython") for p in plans if "ArrowEvalPython" in p]
    assert len(finders) > 10 and max(finders) == 1 and "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()


def test_patience():
    assert licences.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    assert licences.increasing([]) == []
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ([rnd.randint(0, 8) for _ in range(rnd.randint(0, 15))] for _ in range(2))
        pairs = licences.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        longest = len(licences.increasing([y for x in a for y in sorted((k for k, w in enumerate(b) if w == x), reverse=True)]))
        assert len(pairs) <= longest  # no alignment is longer than the longest common subsequence
    assert licences.align([1, 2, 9, 3, 4, 5, 8, 6], [1, 2, 3, 7, 4, 5, 6]) == [(0, 0), (1, 1), (3, 2), (4, 4), (5, 5), (7, 6)]


def test_licenses(spark, odd, words):
    mit = next(t for k, kind, t in licences.TEMPLATES if k == "MIT" and kind == "text")
    changed = mit.split()
    changed[10] = changed[30] = "other"
    far = " ".join(words(500, 1))
    texts = [f"{far} Released under the MIT License. {far}", f"{far}\n" + " ".join(changed), None, "", "the license under the", mit[: len(mit) // 2], " ".join(words(20000, 2)) + " licensed under CC BY-NC 4.0"]
    docs = odd(texts)
    got = {(r["doc_id"], r["license"], r["template"]): r for r in licences.licenses(docs).collect()}
    assert set(got) == {(0, "MIT", "line"), (1, "MIT", "text"), (6, "CC-BY-NC-4.0", "line")}
    assert (got[0, "MIT", "line"]["first_word"], got[0, "MIT", "line"]["last_word"]) == (500, 504)
    assert got[1, "MIT", "text"]["coverage"] == pytest.approx(1 - 2 / len(mit.replace("/", " ").split()), abs=0.01)
    assert licences.licenses(docs.limit(0)).count() == 0


def brute_licenses(text):
    """Every template aligned with every stretch of the text that may hold it: the most words that lie in order."""
    line, found = licences.tokens(text), []
    for name, kind, template in licences.TEMPLATES:
        want, best = licences.tokens(template), None
        if len(set(line) & set(want)) < licences.COVERAGE * len(set(want)) - len(want) + len(set(want)):
            continue
        most = int(licences.STRETCH * len(want))
        for a in range(len(line)):
            if line[a] not in want:
                continue
            part = line[a : a + most]
            # longest common subsequence, by rows; how far the text is used comes from the first place where the most is reached
            row, ends = [0] * (len(want) + 1), []
            for w in part:
                before = row
                row = [0]
                for k, t in enumerate(want, 1):
                    row.append(before[k - 1] + 1 if t == w else max(row[k - 1], before[k]))
                ends.append(row[-1])
            if best is None or ends[-1] > best[0]:
                best = (ends[-1], a, a + ends.index(ends[-1]))
        if best and best[0] >= licences.COVERAGE * len(want):
            found.append({"license": name, "template": kind, "coverage": best[0] / len(want), "words": best[0], "first_word": best[1], "last_word": best[2]})
    return found


def test_licenses_against_brute_force(spark, odd, words):
    """Whole, edited, cut and mixed templates in made-up text: what is found is what aligning everything with everything finds."""
    rnd, texts = random.Random(21), []
    for k, (_, _, template) in enumerate(licences.TEMPLATES):
        for edits in (0, 1, len(template.split()) // 9, len(template.split()) // 3):
            copy = template.split()
            for place in rnd.sample(range(len(copy)), min(edits, len(copy) - 1)):
                copy[place] = rnd.choice(["", "other", copy[place] + " more"])
            texts.append(" ".join(words(rnd.randint(0, 30), k) + copy + words(rnd.randint(0, 30), 99 + k)))
    texts += [" ".join(words(300, 5)), licences.TEMPLATES[0][2] + " " + licences.TEMPLATES[5][2], None, "", "MIT"]
    got = {}
    for r in licences.licenses(odd(texts)).collect():
        got.setdefault(r["doc_id"], {})[r["license"], r["template"]] = r["words"]
    found = 0
    for k, text in enumerate(texts):
        best = brute_licenses(text or "")
        want = {(f["license"], f["template"]): f["words"] for f in licences.distinct(best)}
        least = {(f["license"], f["template"]) for f in best if f["coverage"] < licences.COVERAGE + 0.05}
        mine = got.get(k, {})
        # patience anchors may miss a word or two of the longest common subsequence, which tells at the very threshold alone
        assert set(want) - least <= set(mine) <= {(f["license"], f["template"]) for f in best}, (k, want, mine)
        assert all(0.9 * want.get(x, 0) <= n for x, n in mine.items())
        found += len(mine)
    assert found >= 2 * len(licences.TEMPLATES)


def test_licenses_of_one_family(words):
    """Each notice of a family is told as itself alone."""
    scanner = licences.Scanner()
    for name, kind, template in licences.TEMPLATES:
        got = [(f["license"], f["template"]) for f in scanner.scan([" ".join(words(20, 1)) + " " + template + " " + " ".join(words(20, 2))])[0]]
        assert (name, kind) in got and all(other == name for other, k in got if k != "line"), (name, got)
    with pytest.raises(ValueError):
        licences.Scanner((("X", "line", "two words"),))


def test_close_copies_of_a_license(words):
    """Two, three and twenty copies, whole or edited, are found as one alone would be, wherever in the text they are."""
    rnd = random.Random(9)
    scanner = licences.Scanner()
    for name, kind, template in licences.TEMPLATES:
        whole = licences.tokens(template)
        for copies in (2, 3, 20):
            for before, apart, after in ((0, 0, 0), (0, 4, 40), (1, 1, 30), (20, 12, 0), (200, 0, 200), (4, 7, 300)):
                for edits in (0, len(whole) // 12):
                    line, least = words(before, 1), 0
                    for k in range(copies):
                        copy = list(whole)
                        for place in rnd.sample(range(len(copy)), edits):
                            copy[place] = rnd.choice(["", "other", copy[place] + " more"])
                        copy = " ".join(copy).split()
                        alone = [f for f in scanner.scan([" ".join(copy)])[0] if (f["license"], f["template"]) == (name, kind)]
                        least = max([least, *(f["words"] for f in alone)])
                        line += copy + words(apart if k + 1 < copies else after, k + 2)
                    got = [f for f in scanner.scan([" ".join(line)])[0] if (f["license"], f["template"]) == (name, kind)]
                    assert not least or (got and got[0]["words"] >= least), (name, kind, copies, before, apart, after, edits, least, got)


def greedy(word, pieces, mark):
    word, n, k = mark + word, 0, 0
    while k < len(word):
        end = next((e for e in range(len(word), k, -1) if word[k:e] in pieces), None)
        n, k = (n + 1, end) if end else (n + len(word[k].encode()), k + 1)
    return n


def test_automaton():
    rnd = random.Random(0)
    for k in range(1500):
        pieces = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(0, 12))}
        machine = tokens.Automaton(pieces, "_" if k % 2 else "")
        word = "".join(rnd.choice("abéz") for _ in range(rnd.randint(0, 25)))
        assert machine.count(word) == greedy(word, pieces, machine.mark)


def test_token_counts(spark, odd):
    pieces = tokens.sentencepiece_pieces("/opt/tokenizers/piece_bpe_32k.model")
    known = set(pieces)
    texts = ["The quick brown fox", None, "", "naïve 漢字 \U0001f600 x", "a" * 5000, "The quick brown fox"]
    docs = odd(texts)
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokens.token_counts(docs, pieces).collect()}
    assert got == {k: (len((t or "").split()), sum(greedy(w, known, "▁") for w in (t or "").split())) for k, t in enumerate(texts)}
    assert tokens.token_counts(docs.limit(0), pieces).count() == 0
    assert {r["n_tokens"] for r in tokens.token_counts(odd(["ab é"]), [], mark="").collect()} == {4}


def brute_targets(sizes, weights=(5, 2, 1), ceiling=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / max(1e-300, sum(weight[s] for s in free)) if free else 0
        over = [s for s in free if level * weight[s] > ceiling * sizes[s]]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in names}
        capped |= {s: float(ceiling * sizes[s]) for s in over}


def test_mixing(spark, odd):
    rnd = random.Random(1)
    texts = ["w " * rnd.randint(0, 50) for _ in range(400)] + [None, "", "long " * 20000]
    docs = odd(texts).withColumn("source", F.expr("case when doc_id % 17 = 0 then null when doc_id % 29 = 0 then 'tiny' else concat('s', doc_id % 7) end")).cache()
    rows = mixing.allotment(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    sizes = {}
    for k, t in enumerate(texts):
        sizes[source[k]] = sizes.get(source[k], 0) + len((t or "").split())
    want = brute_targets(sizes)
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and r["taken"] == r["size"] * r["copies"]
        rate = r["target"] / max(1, r["source_size"])
        assert r["copies"] in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9)) and r["copies"] <= 3
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.allotment(docs.repartition(7)).collect()))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert times == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}
    assert mixing.allotment(docs.limit(0)).count() == 0
    assert {r["target"] for r in mixing.allotment(docs.where("text is null")).collect()} == {0.0}


def test_draws_have_the_right_share(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("s").alias("source"))
    assert docs.select(F.avg(mixing.draw(F.col("doc_id"), F.col("source"), F.col("text")))).first()[0] == pytest.approx(0.5, abs=0.01)


def test_rotation_keeps_products():
    x = np.random.default_rng(0).standard_normal((5, 48))
    y = neighbours.rotated(x, 3)
    assert y.shape == (5, 64) and y @ y.T == pytest.approx(x @ x.T)


def brute_neighbours(vectors, k=20):
    out = {}
    for q, x in vectors.items():
        if q % 20 == 0:
            out[q] = sorted(((-float(np.dot(np.array(x, float), np.array(v, float))), i) for i, v in vectors.items() if i != q))[:k]
    return out


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_neighbours({r["vec_id"]: r["embedding"] for r in table.collect()})
    got = {}
    for r in neighbours.neighbours(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    assert np.mean([len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9
    assert all([x[0] for x in sorted(v)] == list(range(1, 21)) for v in got.values())


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, float(k % 3), 0.5], "x") for k in range(0, 30)] + [(40, None, None), (60, [0.0, 0.0, 0.0], "x"), (80, [1.0, None, 2.0], "x"), (100, [nan, 1.0, 1.0], "x"), (120, [inf, 1.0, 1.0], "x"), (140, [1.0], "x"), (None, [1.0, 1.0, 1.0], "x"), (160, [], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    used = {i: v for i, v, _ in rows[:30]}
    for block in (8192, 3):
        monkeypatch.setattr(neighbours, "VECTORS", block)
        monkeypatch.setattr(neighbours, "QUERIES", max(1, block // 3))
        got = {}
        for r in neighbours.neighbours(table, F.col("vec_id") % 20 == 0).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        # so small a table leaves queries short, and these are searched for in full
        assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == {q: [(i, -s) for s, i in v] for q, v in brute_neighbours(used).items()}
    # each number of components by itself
    assert {(r["query_id"], r["vec_id"]) for r in neighbours.neighbours(table.where("vec_id = 140").unionByName(spark.createDataFrame([(7, [2.0], "x"), (0, [1.0, 1.0, 0.5], "x"), (3, [1.0, 2.0, 0.5], "x")], table.schema)), F.col("vec_id") % 20 == 0).collect()} == {(140, 7), (0, 3)}
    few = table.where("vec_id < 5")
    assert neighbours.neighbours(few, F.col("vec_id") % 20 == 0).count() == 4
    assert neighbours.neighbours(table.where("vec_id = 60"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("block", [8192, 3])
def test_neighbours_of_repeated_ids(spark, monkeypatch, block):
    """Repeated rows of an id, equal or not, take one place, and push no other id out."""
    monkeypatch.setattr(neighbours, "VECTORS", block)
    monkeypatch.setattr(neighbours, "QUERIES", block)
    rng = np.random.default_rng(4)
    near = [(7, [1.0, 0.0, 0.0, 0.0])] * 30 + [(7, [0.9, 0.0, 0.1, 0.0])] * 5 + [(k, [1.0 - k / 1000, 0.0, 0.0, 0.0]) for k in range(100, 140)] + [(0, [1.0, 0.0, 0.0, 0.0])] * 6
    far = [(1000 + 2 * k + 1, x.tolist()) for k, x in enumerate(rng.standard_normal((60, 4)) / 10)]
    for rows in (near, near + far):
        found = neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") == 0).collect()
        best = {}
        for i, x in rows:
            if i:
                best[i] = max(best.get(i, -9.0), x[0])
        want = sorted(best, key=lambda i: (-best[i], i))[:20]
        assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == want and [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, 21))


PAGES = [(1, "http://a", "x" * 200), (2, "http://b\r\nX: y", "x" * 200), (3, "http://c", "y"), (4, None, "y"), (None, "http://e", "x" * 200), (5, "u", None), (6, "ü", "é" * 60), (7, "", "é" * 60), (1, "http://a", "x" * 200), (8, "long", "z\r\n\r\nWARC/1.1\r\n" * 20000)]


def test_warc_round_trip(spark):
    import hashlib

    pages = spark.createDataFrame([(*p, None) for p in PAGES], "page_id long, url string, html string, payload string")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if (h or "").encode() == data and p is not None), default=None)
        again = len(data) >= 100 and first is not None and (i is None or i > first)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    warc.register(spark)
    rows = warc.page_records(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    path = str(tmp_path / "archive")
    rows.write.format("warc").option("fileBytes", 400).mode("append").save(path)
    files = sorted((tmp_path / "archive").glob("*.warc.gz"))
    assert len(files) > 1 and not list((tmp_path / "archive").glob("_temporary*"))
    read = spark.read.format("warc").option("partitionBytes", 500).load(path)
    assert read.rdd.getNumPartitions() > 1 and read.count() == len(PAGES)
    asked = read.where((F.col("warc_type") == "revisit") & F.col("target_uri").isNotNull() & (F.col("payload_length") > 150))
    assert "Filter (" not in asked._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["record_id"] for r in asked.collect()) == ["<urn:palimpsest:page:2>", "<urn:palimpsest:page:>"]
    assert read.where(~(F.col("target_uri") == "http://a")).count() == len(PAGES) - 3  # the null one drops out, as in SQL
    assert spark.read.format("warc").option("payload", "false").load(path).where(F.col("record_id").contains("page:1>")).count() == 2
    plain = tmp_path / "plain.warc"
    plain.write_bytes(b"".join(gzip.decompress(f.read_bytes()) for f in files))
    foreign = tmp_path / "foreign.warc.gz"
    foreign.write_bytes(b"".join(gzip.compress(h) for h in pieces(plain.read_bytes())))
    for one in (plain, foreign):
        back = spark.read.format("warc").load(str(one))
        assert sorted(r["payload"] or b"" for r in back.collect()) == sorted(r["payload"] or b"" for r in read.collect())
        assert back.where("warc_type = 'revisit'").count() == 3
    rows.limit(1).write.format("warc").mode("overwrite").save(path)
    assert spark.read.format("warc").load(path).count() == 1


def test_foreign_archives(spark, tmp_path):
    """One gzip member with many records, members that end anywhere, names in lower case, HTTP blocks without headers or without an end of these."""
    warc.register(spark)
    block = lambda kind, body, more=b"": b"\r\n".join([b"WARC/1.0", b"warc-type: " + kind, b"WARC-RECORD-ID: <urn:" + body[:3] + b">", *([more] if more else []), b"content-length: %d" % len(body), b"", body, b"", b""])
    http = b"Content-Type: Application/HTTP;msgtype=response"
    parts = [
        block(b"response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"first " * 30000, http),
        block(b"response", b"HTTP/1.0 204 No Content", http),
        block(b"response", b"no headers at all", http),
        block(b"response", b"HTTP/1.0 200 OK\nA: b\n\nbare newlines", http),
        block(b"metadata", b"plain: text\r\n\r\nmore"),
    ]
    want = [b"first " * 30000, b"", b"no headers at all", b"bare newlines", b"plain: text\r\n\r\nmore"]
    whole = b"".join(parts)
    files = {"plain.warc": whole, "one.warc.gz": gzip.compress(whole), "cut.warc.gz": b"".join(gzip.compress(whole[k : k + 70_001]) for k in range(0, len(whole), 70_001)), "each.warc.gz": b"".join(map(gzip.compress, parts))}
    # a member of ours that holds two records isn't taken for one
    files["two.warc.gz"] = warc.member(parts[0] + parts[1]) + b"".join(warc.member(p) for p in parts[2:])
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        rows = spark.read.format("warc").load(str(tmp_path / name)).collect()
        assert [r["payload"] for r in rows] == want, name
        assert [r["warc_type"] for r in rows] == ["response"] * 4 + ["metadata"] and rows[0]["record_id"] == "<urn:HTT>" and "warc-type" in rows[0]["headers"]
        heads = spark.read.format("warc").option("columns", "warc_type,offset").load(str(tmp_path / name))
        assert heads.columns == ["warc_type", "offset"] and heads.where("warc_type = 'metadata'").count() == 1
    for bad in (b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", whole[:-20000][:100_000]):
        with pytest.raises(ValueError):
            for head in warc._plain(io.BytesIO(bad)):
                head.body(True)


def test_only_committed_files_count(spark, tmp_path):
    warc.register(spark)
    path = tmp_path / "archive"
    rows = warc.page_records(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    rows.write.format("warc").mode("append").save(str(path))
    (path / f"part-{'0' * 32}-{'1' * 32}.warc.gz").write_bytes(b"of an attempt that failed")
    assert spark.read.format("warc").load(str(path)).count() == len(PAGES)
    job = warc.WarcWriter(str(path), 1 << 20)
    job.write(iter(pa.Table.from_pylist([{"record_id": "x", "payload": b"y"}]).to_batches()))
    assert spark.read.format("warc").load(str(path)).count() == len(PAGES)
    job.abort([])
    assert not [f for f in path.iterdir() if job.job in f.name]


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    """Of records whose payload isn't among the columns, or whose type isn't asked for, headers alone are inflated."""
    from pyspark.sql.datasource import EqualTo
    from pyspark.sql.types import StringType, StructField, StructType

    data = b"".join(warc.member(warc.record({"WARC-Type": "response" if k % 2 else "request"}, np.random.default_rng(k).bytes(300_000))) for k in range(8))
    seen = []

    class Counted:
        def __init__(self, wbits):
            self.of = zlib.decompressobj(wbits)

        def decompress(self, *given):
            out = self.of.decompress(*given)
            seen.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.of, name)

    monkeypatch.setattr(warc, "zlib", type("zlib", (), {"decompressobj": Counted}))
    monkeypatch.setattr(warc, "records", lambda path, size: warc._packed(io.BytesIO(data), len(data)))
    text = StructField("warc_type", StringType())
    reader = warc.WarcReader("x", StructType([text]), 1)
    assert sum(b.num_rows for b in reader.read(warc._Files([("x", len(data))]))) == 8 and sum(seen) < 8 * 20_000
    seen.clear()
    reader = warc.WarcReader("x", StructType([text, StructField("payload", StringType())]), 1)
    assert not list(reader.pushFilters([EqualTo(("warc_type",), "request")]))
    assert sum(b.num_rows for b in reader.read(warc._Files([("x", len(data))]))) == 4 and 4 * 300_000 < sum(seen) < 4 * 320_000 + 4 * 20_000


def pieces(data):
    heads = list(warc._plain(io.BytesIO(data)))
    ends = [h.offset for h in heads[1:]] + [len(data)]
    return [data[h.offset : e] for h, e in zip(heads, ends, strict=True)]


def test_skipping_reads_little():
    """Of unwanted members of our own only the first bytes are read."""
    data = b"".join(warc.member(warc.record({"WARC-Type": "response", "n": str(k)}, np.random.default_rng(k).bytes(200_000))) for k in range(5))

    class Counted(io.BytesIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.total += len(out)
            return out

    assert [h.fields["n"] for h in warc._packed(Counted(data), len(data))] == ["0", "1", "2", "3", "4"]
    assert Counted.total < 50_000


def test_sql_agrees(spark):
    from palimpsest.llm import queries

    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "pages"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, folder)
        found = db.sql(sql)
        at = [found.columns.index(c) for c in df.columns]
        assert sorted((tuple(r) for r in df.collect()), key=str) == sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=str), name
