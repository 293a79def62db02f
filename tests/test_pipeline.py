"""Detectors, resolution, redaction, audit and the pipeline."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import detectors as D
from palimpsest.operators.overlap import resolve
from palimpsest.operators.redaction import naive_redact, pseudonym, redact
from palimpsest.plans.pipeline import audit_entries, naive_precision, redact_document, redact_documents, spot_check
from palimpsest.schema import SPANS
from palimpsest.sources.audit import read_audit_log, write_audit_log
from palimpsest.streaming.redaction import redact_stream, write_audit_stream


@pytest.fixture(scope="module")
def valid(one):
    from palimpsest.functions.checksum import with_check_digit

    return one(with_check_digit, "31415926535")


def texts(one, detector, text):
    return [s["text"] for s in one(detector.spans, text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("write to a.b+c@ex-am.co.in, please", ["a.b+c@ex-am.co.in"]),
        ("x@y.com and z@w.org", ["x@y.com", "z@w.org"]),
        ("nothing @ here", []),
        ("a@-b.com", []),
        ("a@b.c", []),
        ("", []),
    ],
)
def test_email(one, text, expected):
    assert texts(one, D.EmailDetector(), text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("call 7012345678 now", ["7012345678"]),
        ("+91 70123 45678", ["+91 70123 45678"]),
        ("+91-7012345678", ["+91-7012345678"]),
        ("07012345678", ["07012345678"]),
        ("5012345678", []),
        ("70123456789", []),
        ("70123\n45678", ["70123\n45678"]),
    ],
)
def test_phone(one, text, expected):
    assert texts(one, D.PhoneDetector(), text) == expected


@pytest.mark.parametrize(("text", "expected"), [("ID QWEPR1234T.", ["QWEPR1234T"]), ("QWEZR1234T", []), ("qwepr1234t", []), ("QWEPR123T", []), ("QWEPR१२३४T", ["QWEPR१२३४T"]), ("XQWEPR1234T", [])])
def test_pan(one, text, expected):
    assert texts(one, D.PanDetector(), text) == expected


def test_aadhaar(one, valid):
    grouped = f"{valid[:4]} {valid[4:8]}-{valid[8:]}"
    text = f"{grouped} order 223456789013 and 1{valid[1:]}"
    assert texts(one, D.NaiveAadhaarDetector(), text) == [grouped, "223456789013"]
    assert texts(one, D.AadhaarDetector(), text) == [grouped]
    assert texts(one, D.AadhaarDetector(), "none") == []


def test_default_order():
    assert [d.name for d in D.default_detectors()] == ["regex.email", "regex.phone", "regex.pan", "regex.aadhaar", "ner.gazetteer"]
    assert all(isinstance(d, D.Detector) for d in D.default_detectors())


def test_gazetteer(one):
    found = one(D.GazetteerDetector().spans, "Dr. Lovelace met Priya Menon's aunt in Pune; Pooja left.")
    assert [(s["entity_type"], s["text"]) for s in found] == [("PERSON", "Lovelace"), ("PERSON", "Priya Menon"), ("PERSON", "Pooja"), ("LOCATION", "Pune")]


def test_model_detector(one):
    def make_words():
        import re

        return lambda text: [("PERSON", *m.span(), 0.7) for m in re.finditer(r"Zed(?:'s)?", text)]

    found = one(D.ModelDetector("ner.words", make_words).spans, "Zed and Zed's dog")
    assert [(s["start"], s["end"], s["text"], s["detector"]) for s in found] == [(0, 3, "Zed", "ner.words"), (8, 11, "Zed", "ner.words")]
    with pytest.raises(ImportError):
        D.presidio()


def test_model_engine(spark, one, tmp_path, monkeypatch):
    """The adapter of the model engine, with a package of its name that holds a small stand-in: built once a worker, possessives trimmed, scores kept."""
    (tmp_path / "presidio_analyzer.py").write_text(
        "import re\n"
        "class AnalyzerEngine:\n"
        "    def analyze(self, text, language, entities):\n"
        "        assert language == 'en' and entities == ['PERSON', 'LOCATION']\n"
        "        kinds = {'Zed': 'PERSON', 'Oz': 'LOCATION'}\n"
        "        return [type('R', (), {'entity_type': kinds[m[1]], 'start': m.start(), 'end': m.end(), 'score': 0.75})() for m in re.finditer(r\"(Zed|Oz)(?:'s)?\", text)]\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "presidio_analyzer.py"))
    found = one(D.presidio().spans, "Zed's friends in Oz")
    assert [(s["entity_type"], s["start"], s["end"], s["text"], s["confidence"], s["detector"]) for s in found] == [("PERSON", 0, 3, "Zed", 0.75, "ner.presidio"), ("LOCATION", 17, 19, "Oz", 0.75, "ner.presidio")]
    docs = spark.createDataFrame([("Zed met zed@q.org in Oz, Zed said",), (None,)], "text string")
    out = redact_documents(docs, detectors=[D.EmailDetector(), D.presidio()]).collect()
    assert [r["redacted"] for r in out] == ["PERSON_A met [EMAIL_REDACTED] in Oz, PERSON_A said", None]


def run_spans(spark, f, spans, text=""):
    return spark.createDataFrame([(text, spans)], f"t string, s {SPANS.simpleString()}").select(f(F.col("t"), F.col("s")).alias("x")).first()["x"]


def span(kind, start, end, confidence=0.9, text=None, name="d"):
    return (kind, start, end, text if text is not None else "x" * (end - start), confidence, name)


@pytest.mark.parametrize(
    ("spans", "kept"),
    [
        ([], []),
        ([span("EMAIL", 5, 9), span("PERSON", 0, 5)], [("PERSON", 0, 5), ("EMAIL", 5, 9)]),
        ([span("PERSON", 0, 9, 1.0), span("PAN", 2, 5, 0.1)], [("PAN", 2, 5)]),
        ([span("PHONE", 0, 5, 0.9), span("AADHAAR", 2, 9, 0.97)], [("AADHAAR", 2, 9)]),
        ([span("PAN", 0, 5), span("PHONE", 1, 9)], [("PHONE", 1, 9)]),
        ([span("PAN", 3, 8), span("PHONE", 0, 5)], [("PHONE", 0, 5)]),
        ([span("PAN", 0, 5, name="first"), span("PHONE", 0, 5, name="second")], [("PAN", 0, 5)]),
        ([span("PAN", 4, 10, 0.95), span("PAN", 0, 5), span("PAN", 9, 12)], [("PAN", 4, 10)]),
    ],
)
def test_resolve(spark, spans, kept):
    out = run_spans(spark, lambda t, s: resolve(s), spans)
    assert [(s["entity_type"], s["start"], s["end"]) for s in out] == kept


def test_pseudonyms(spark):
    want = {0: "A", 25: "Z", 26: "AA", 51: "AZ", 52: "BA", 701: "ZZ", 702: "AAA", 18277: "ZZZ", 18278: "AAAA"}
    rows = spark.createDataFrame([(k,) for k in want], "i int").select("i", pseudonym(F.col("i")).alias("p")).collect()
    assert {r["i"]: r["p"] for r in rows} == {k: f"PERSON_{v}" for k, v in want.items()}


def test_redact(spark):
    text = "😀 Asha, ASHA and Ravi in Pune on x"
    spans = [span("PERSON", 17, 21, text="Ravi"), span("PERSON", 2, 6, text="Asha"), span("PERSON", 8, 12, text=" ASHA "), span("LOCATION", 25, 29, text="Pune"), span("DATE_OF_BIRTH", 33, 34, text="x")]
    out = run_spans(spark, redact, spans, text)
    assert out["redacted"] == "😀 PERSON_A, PERSON_A and PERSON_B in Pune on x"
    assert [(r["strategy"], r["replacement"], r["original_length"]) for r in out["records"]] == [
        ("consistent_pseudonymization", "PERSON_A", 4),
        ("consistent_pseudonymization", "PERSON_A", 4),
        ("consistent_pseudonymization", "PERSON_B", 4),
        ("retain", "Pune", 4),
        ("retain_unhandled_type", "x", 1),
    ]
    assert "text" not in out["records"][0].asDict()
    assert run_spans(spark, redact, [], text)["redacted"] == text
    assert run_spans(spark, naive_redact, spans, text) == "😀 [REDACTED], [REDACTED] and [REDACTED] in Pune on x"


def test_pipeline(spark, valid):
    full_width = "".join(chr(ord(c) + 0xFEE0) for c in valid)
    rows = [("a", f"Mail Priya Rao at p@q.org  or +91 70123 45678; PAN QWEPR1234T, no. {full_width}. Priya Rao called."), ("b", ""), ("c", None)]
    out = {r["doc_id"]: r for r in redact_documents(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert out["a"]["redacted"] == "Mail PERSON_A at [EMAIL_REDACTED] or [PHONE_REDACTED]; PAN [PAN_REDACTED], no. [AADHAAR_REDACTED]. PERSON_A called."
    assert out["b"]["redacted"] == "" and out["b"]["records"] == []
    assert out["c"]["redacted"] is None and out["c"]["records"] == []
    nothing = redact_documents(spark.createDataFrame(rows, "doc_id string, text string"), detectors=[])
    assert nothing.agg(F.sum(F.size("records"))).first()[0] == 0


def test_phone_that_is_also_a_valid_number(spark, one):
    """A number after +91 without a separator may pass the checksum from the 9 on; the more confident detector wins, and a + is left."""
    from palimpsest.functions.checksum import verhoeff_valid

    both = next(t for t in (f"91{k}" for k in range(7012345670, 7012345700)) if one(verhoeff_valid, t))
    df = spark.createDataFrame([(f"+{both}",)], "text string")
    assert redact_documents(df).first()["redacted"] == "+[AADHAAR_REDACTED]"


def test_audit_log(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "x@y.org and z@w.org"), ("d2", "none")], "doc_id string, text string")
    done = redact_documents(docs)
    path = str(tmp_path / "deep" / "log")
    assert read_audit_log(spark, path).count() == 0
    write_audit_log(audit_entries(done, "doc_id"), path)
    write_audit_log(audit_entries(done), path)
    rows = read_audit_log(spark, path).collect()
    assert len(rows) == 4 and sorted(str(r["document_id"]) for r in rows) == ["None", "None", "d1", "d1"]
    import json
    from pathlib import Path

    lines = [json.loads(x) for p in Path(path).glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(min(lines, key=len)) == sorted(["entity_type", "start", "end", "original_length", "strategy", "replacement", "confidence", "detector"])
    write_audit_log(audit_entries(done, "doc_id"), path, append=False)
    assert read_audit_log(spark, path).count() == 2
    next(Path(path).glob("part-*")).write_text("\n  \nnot json\n")
    with pytest.raises(Exception):
        read_audit_log(spark, path).collect()


def test_one_document(spark, tmp_path):
    path = str(tmp_path / "log")
    for _ in range(2):
        text, records = redact_document(spark, "  Mail x@y.org  now", audit_log_path=path, document_id="d")
        assert text == "Mail [EMAIL_REDACTED] now" and [(r["start"], r["end"]) for r in records] == [(5, 12)]
    assert [r["document_id"] for r in read_audit_log(spark, path).collect()] == ["d", "d"]
    assert redact_document(spark, "x@y.org", detectors=[]) == ("x@y.org", [])


def test_demos(spark, valid):
    docs = spark.createDataFrame([(f"{valid} 223456789013 998877665544",), ("none",)], "text string")
    row = naive_precision(docs).first()
    assert (row["naive_hits"], row["valid_hits"], row["naive_precision"]) == (3, 1, 1 / 3)
    assert naive_precision(docs.where("text = 'none'")).first()["naive_precision"] is None
    checks = spot_check(spark.createDataFrame([("Priya Menon called.", "Priya Menon"), ("Xyz called.", "Xyz")], "text string, expected string"))
    assert [r["matched"] for r in checks.orderBy("text").collect()] == [True, False]


def test_demo_run(spark, valid, tmp_path):
    from palimpsest.plans import demo

    path = str(tmp_path / "log")
    for _ in range(2):
        out = demo.run(spark, f"Priya: {valid}, 223456789013, p@q.org", path)
        assert out.found["regex.aadhaar"] == [valid] and out.found["regex.aadhaar.naive"] == [valid, "223456789013"] and out.naive_precision == 0.5
        assert out.redacted == "PERSON_A: [AADHAAR_REDACTED], 223456789013, [EMAIL_REDACTED]"
        assert [r["entity_type"] for r in out.logged] == ["PERSON", "AADHAAR", "EMAIL"] and {r["document_id"] for r in out.logged} == {"demo"}


def test_few_files_are_spread_out(spark, tmp_path):
    from palimpsest.plans.pipeline import spread_out

    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    one_file = spark.read.parquet(str(tmp_path / "one"))
    assert spread_out(one_file).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 50)
    assert spread_out(many) is many


def test_entry_without_optional_packages(monkeypatch):
    """The library's own queries are there even if what the optional ones need isn't."""
    import importlib

    import __spark_entry__ as entry
    import palimpsest.queries as own

    real = importlib.import_module

    def without(name, *rest):
        if name.startswith("palimpsest.llm"):
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *rest)

    monkeypatch.setattr(entry.importlib, "import_module", without)
    with pytest.warns(UserWarning, match="xxhash"):
        assert set(entry.queries()) == set(own.QUERIES) and set(entry.oracle_sql()) == set(own.ORACLES)


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("d1", "x@y.org"), ("d2", "none")], "doc_id string, text string").write.json(str(source))
    docs = spark.readStream.schema("doc_id string, text string").json(str(source))
    write_audit_stream(docs, str(out), str(tmp_path / "cp"), "doc_id", available_now=True).awaitTermination(60)
    assert [r["document_id"] for r in read_audit_log(spark, str(out)).collect()] == ["d1"]
    with pytest.raises(ValueError):
        redact_stream(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
