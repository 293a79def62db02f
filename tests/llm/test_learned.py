"""Language identification and the quality classifier: gradients, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from palimpsest.llm import common, language, quality

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("module", [language, quality])
def test_gradients(module):
    """Analytic against numeric, at each weight's steepest entry."""
    rng = np.random.default_rng(0)
    if module is language:
        net = language.Network.fresh(["a", "b", "c"])
        x, y = rng.integers(1, 256, (4, 10)).astype(np.uint8), np.array([0, 1, 2, 1])
        loss = lambda: net.gradients(x, y)
        fields = ("table", "turn", "lift", "out", "base")
    else:
        net = quality.Network.fresh()
        held, y, weight = [quality.chunks(bytes(rng.integers(97, 123, n).astype(np.uint8))) for n in (30, 900, 2000)], np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])
        loss = lambda: net.gradients(held, y, weight)
        fields = ("embed", "filters", "lift", "mix", "base")
    for f in fields:
        setattr(net, f, getattr(net, f).astype(np.float64))
    _, grads = loss()
    for w, g in zip(net.weights(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[at] += 1e-3
        up = loss()[0]
        w[at] -= 2e-3
        down = loss()[0]
        w[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.05, abs=1e-4)


def test_both_passes_agree():
    net = language.Network.fresh(["a", "b"])
    x, y = np.random.default_rng(1).integers(1, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    p = net.probabilities(x)
    assert p.sum(axis=2) == pytest.approx(1) and -np.log(p[:, np.arange(5), y]).mean() == pytest.approx(net.gradients(x, y)[0], rel=1e-4)


def test_against_a_plain_recurrence():
    """Byte by byte and unit by unit, as the gates are defined."""
    rng = np.random.default_rng(3)
    net = language.Network.fresh(["a", "b", "c"], units=4)
    net.lift += rng.standard_normal(net.lift.shape).astype(np.float32)
    net.base += rng.standard_normal(3).astype(np.float32)
    texts = ["naïve recurrence", "x", "a longer text, " * 40, None, "12"]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(data, side):
        h, out = np.zeros(4), []
        for byte in data:
            x, y = net.table[side, byte].astype(float), h @ net.turn[side].astype(float)
            z, r = sigmoid(x[:4] + y[:4]), sigmoid(x[4:8] + y[4:8])
            fresh = np.tanh(x[8:] + r * (y[8:] + net.lift[side]))
            h = (1 - z) * fresh + z * h
            out.append(h)
        return out

    names, scores = language.identify(net, texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        if not text or text == "12":
            assert (name, score) == ("und", 0.0)
            continue
        data, each = text.encode(), []
        for k in range(0, len(data), language.CHUNK):
            part = data[k : k + language.CHUNK]
            filled = part.ljust(language.CHUNK, b"\0")
            ahead, back = states(filled, 0), states(filled[::-1], 1)[::-1]
            for t in range(len(part)):
                logit = ahead[t] @ net.out[0] + back[t] @ net.out[1] + net.base
                p = np.exp(logit - logit.max())
                each.append(p / p.sum())
        want = np.mean(each, axis=0)
        assert name == net.names[int(want.argmax())] and score == pytest.approx(want.max(), abs=1e-5)


def test_against_a_plain_convolution():
    rng = np.random.default_rng(5)
    net = quality.Network.fresh()
    net.lift += rng.standard_normal(quality.FILTERS).astype(np.float32)
    net.base += np.float32(0.3)
    texts = ["short", "", None, "some words of a text " * 60, "ü" * 513]
    for text, score in zip(texts, net.score(texts), strict=True):
        data = (text or "").encode()
        starts = [0]
        while starts[-1] + quality.CHUNK < len(data):
            starts.append(starts[-1] + quality.STEP)
        best = []
        for s in starts:
            chunk = data[s : s + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            answers = [net.embed[list(chunk[k : k + quality.WIDTH])].ravel() @ net.filters for k in range(quality.CHUNK - quality.WIDTH + 1)]
            best.append(np.maximum(np.max(answers, axis=0) + net.lift, 0))
        logit = np.concatenate([np.mean(best, axis=0), np.max(best, axis=0)]) @ net.mix + net.base[0]
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_weights_are_stored(spark, tmp_path, odd):
    net = language.Network.fresh(["a", "b"])
    common.keep_bytes(spark, net.dumps(), str(tmp_path / "net"))
    back = language.Network.loads(common.kept_bytes(spark, str(tmp_path / "net")))
    assert back.names == net.names and all((a == b).all() for a, b in zip(back.weights(), net.weights(), strict=True))
    assert {r["lang_pred"] for r in language.languages(odd(["some text"]), net=back).collect()} <= {"a", "b"}
    one = quality.Network.fresh(4)
    assert (quality.Network.loads(one.dumps()).score(["some text"]) == one.score(["some text"])).all()


def test_learning_sample(spark):
    """Whole texts; each label its own bound, whatever repeats; bytes in all."""
    rows = [(k, "rare" if k % 50 == 0 else "often", f"text {k} " * 100) for k in range(1000)] + [(7, "often", "one id, " * 50)] * 3000 + [(None, "often", "no id"), (5, None, "no label"), (6, "often", None)]
    docs = spark.createDataFrame(rows, "doc_id long, label string, text string").repartition(5)
    got = common.sample(docs, 12, 1 << 20)
    assert got == common.sample(docs.repartition(2), 12, 1 << 20)
    texts = {(t, k) for _, k, t in rows}
    assert all(x in texts for x in got) and [sum(k == name for _, k in got) for name in ("rare", "often")] == [12, 12]
    few = common.sample(docs, 12, 4000)
    assert 0 < sum(len(t) for t, _ in few) <= 4000 and {k for _, k in few} == {"rare", "often"}
    assert common.sample(docs.limit(0), 12, 1 << 20) == [] and common.sample(docs, 12, 3) == []


def test_settings_and_folders(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key) if spark._jsparkSession.sessionState().conf().contains(key) else None
    try:
        spark.conf.set(key, "64m")
        common.bounded_batches(spark)
        assert spark.conf.get(key) == "64m"  # a user's own choice
        spark.conf.unset(key)
        common.bounded_batches(spark)
        assert int(spark._jsparkSession.sessionState().conf().getConfString(key).removesuffix("b")) == 8 << 20
    finally:
        spark.conf.set(key, had) if had else spark.conf.unset(key)

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("sc", (), {"getCheckpointDir": staticmethod(lambda: type("no", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)


def test_chunks_cover_every_byte():
    for n in (0, 1, 64, 448, 511, 512, 513, 960, 961, 5000):
        data = bytes(k % 251 + 1 for k in range(n))
        rows = quality.chunks(data)
        seen = bytearray(rows.shape[0] * quality.STEP + quality.CHUNK)
        for k, row in enumerate(rows):
            seen[k * quality.STEP : k * quality.STEP + quality.CHUNK] = row.tobytes()
        assert bytes(seen[:n]) == data and not any(seen[n:])
        assert b"".join(r.tobytes() for r in language._chunked(data, 128)).rstrip(b"\0") == data


def test_languages(spark, odd):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = language.languages(docs).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd):
    texts = ["the cat and the dog went home " * 3, "", None, "123 !!", "der hund und die katze " * 2000, "x"] + ["the house of the man and that one"] * 20
    signs = len(texts)
    texts += ["\u00b2", "\u00bd \u2460", "\u2163 42"]  # a raised digit, a fraction, a circled number, a Roman numeral: no letters
    docs = odd(texts)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages(docs).collect()}
    assert got[signs] == got[signs + 1] == got[signs + 2] == ("und", 0.0)
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[0][0] == got[4][0] == "en" and got[6] == got[7]
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(len(texts)) if k not in (1, 2, 3, signs, signs + 1, signs + 2)]
    assert language.languages(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.languages(docs.where("lang is null")).collect()} == {"und"}


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95


def test_quality_of_odd_rows(spark, odd):
    texts = [None, "", "plain words here", "### $$$ %%% " * 3000, "plain words here"] + ["good text %d" % k if k % 2 else "### $$$ ||| %d" % k for k in range(40)]
    docs = odd(texts)
    labels = spark.createDataFrame([(k, (k + 1) % 2 if k > 4 else None, 0) for k in range(len(texts))] + [(7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.scores(docs, labels).collect()}
    assert got[0] == got[1] and got[2] == got[4] and got[2] > got[3]
    assert {r["score"] for r in quality.scores(docs, labels.where("quality = 1")).collect()} == {0.5}
    assert quality.scores(docs.limit(0), labels).count() == 0
