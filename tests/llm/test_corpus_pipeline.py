"""run() of the corpus pipeline against its stages in plain Python."""

import hashlib

import pytest

from palimpsest.llm import decontamination, language, mixing, seeds, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


def test_run(spark):
    from test_duplicates import brute_repeats, brute_similar
    from test_scans import brute_targets, brute_tiles

    got = sorted((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in corpus_pipeline.run(spark, FOLDER).collect())
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    net = language.fit(docs)
    ids = sorted(rows)
    names, scores = language.identify(net, [rows[i]["text"] for i in ids])
    kept = {i: rows[i]["text"] for i, n, s in zip(ids, names, scores, strict=True) if n != "und" and s >= language.LEAST}
    assert len(kept) > 0.98 * len(rows)
    kept = {i: kept[i] for i, least in zip(kept, brute_similar(list(kept.items()))[0], strict=True) if least == i}
    kept = {i: text if removed else kept[i] for i, _, removed, _, text in brute_repeats(list(kept.items())) if not removed or text}
    items = [seeds.tokens(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def leaks(text):
        line = seeds.tokens(text)
        for item in items:
            number = {w: k for k, w in enumerate(dict.fromkeys(item), 1)}
            if len(set(line) & set(item)) > 4 and sum(n for _, _, n in brute_tiles([number.get(w, 0) for w in line], [number[w] for w in item], decontamination.LEAST)) >= decontamination.COVERAGE * len(item):
                return True
        return False

    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    known = set().union(*map(grams, items))
    kept = {i: t for i, t in kept.items() if not (grams(seeds.tokens(t)) & known and leaks(t))}
    sizes = {}
    for i, t in kept.items():
        sizes[rows[i]["source"]] = sizes.get(rows[i]["source"], 0) + len(t.encode().split())
    goal, want = brute_targets(sizes), []
    for i, t in kept.items():
        source = rows[i]["source"]
        rate = goal[source] / max(1, sizes[source])
        name = ":".join((mixing.SEED, str(i), source or "?", hashlib.md5(t.encode()).hexdigest()))
        drawn = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / (1 << 52)
        want += [(i, t, source, len(t))] * (int(rate) + (drawn < rate - int(rate)))
    assert got == sorted(want)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, FOLDER)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_odd_tables(spark, tmp_path, words):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns whose names clash: the chain runs, and each case ends as the docstrings say."""
    text = {k: " ".join(["the house and the garden of the man were in the north"] + words(60, k)) for k in range(12)}
    rows = [(k, text[k], "en" if k % 2 else None, f"s{k % 2}" if k % 3 else None, None, 1, "x", None, 9) for k in text]
    rows += [(20, None, None, None, None, 1, "x", None, 9), (21, "", "en", "s0", 0, None, None, None, None), (22, "12 34", "de", "s1", 5, 1, "x", None, 9)]
    rows += [(None, text[3] + " more", "en", "s0", None, 1, "x", None, 9), rows[4], (30, text[5], "en", "s1", None, 1, "x", None, 9)]
    rows += [(31, " ".join(words(20_000, 99)) + " the house", "en", "s1", None, 1, "x", None, 9), (32, " ".join(words(40, 70)) + " leaked " + " ".join(words(30, 71)), "en", "s0", None, 1, "x", None, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, language string, `of` int, c0 int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(words(30, 71))), (None, None), (2, ""), (3, "too short")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    kept = [r["doc_id"] for r in out.collect()]
    assert not {20, 21, 22, 30, 32} & set(kept) and len(kept) > 5  # no letters, a copy, a leak
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_staged_tables_go(spark, tmp_path):
    """What no plan reads any more is deleted: of a run the last table stays, and what the stages' last plans read."""
    from palimpsest.llm.common import shared_dir

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    from pathlib import Path

    folder = Path(shared_dir(spark).removeprefix("file:")) / "palimpsest"
    before = set(folder.iterdir()) if folder.exists() else set()
    corpus_pipeline.run(spark, str(tmp_path))
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before)
    assert not {"crowded", "nodes", "links", "roots", "rooted", "edges", "least", "large", "told", "candidates", "hits", "measured", "leaders", "items", "near_duplicates", "language_id"} & set(left), left
