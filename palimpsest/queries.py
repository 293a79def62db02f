"""The registered queries of the library's own operators, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import checksum, metrics, textnorm
from palimpsest.functions.lets import exploded
from palimpsest.operators import labelled, retrieval, scoring
from palimpsest.operators.detectors import AadhaarDetector, Detector, EmailDetector, GazetteerDetector, NaiveAadhaarDetector, PanDetector, PhoneDetector, trim_possessive
from palimpsest.operators.overlap import resolve
from palimpsest.operators.redaction import redact
from palimpsest.plans.pipeline import audit_entries, for_evaluation, naive_precision, redact_documents, spot_check, spread_out
from palimpsest.schema import SPANS
from palimpsest.sources.audit import read_audit_log, read_gold, scratch, write_audit_log, write_gold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Texts derived from keys, as the tables hold few identifiers. Both engines understand these expressions.
_ID = "concat(300000000000 + (o_orderkey * 15485863) % 600000000000, '')"
ORDER_TEXT = (
    "concat('Order ', 200000000000 + o_orderkey * 7919, ' call +91 ', 60000 + (o_orderkey * 7) % 40000, ' ', lpad(concat((o_orderkey * 31) % 100000, ''), 5, '0'), "
    "' ; PAN ABC', substr('ABCFGHJLPTXZ', CAST(1 + o_orderkey % 12 AS INT), 1), 'D', lpad(concat(o_orderkey % 10000, ''), 4, '0'), chr(CAST(65 + o_orderkey % 26 AS INT)), "
    f"' ; id ', substr({_ID}, 1, 4), ' ', substr({_ID}, 5, 4), '-', substr({_ID}, 9, 4), "
    "' ; mail u', o_orderkey, '@ex-', o_orderkey % 7, '.co.in ; desk 0', 6000000000 + (o_orderkey * 104729) % 3999999999)"
)
_EMAIL = r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}\b"
_PHONE, _PAN, _AADHAAR = r"(?:\+91[\s-]?|0)?[6-9][0-9]{4}[\s-]?[0-9]{5}", r"\b[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]\b", r"[2-9][0-9]{3}[\s-]?[0-9]{4}[\s-]?[0-9]{4}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(_table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", F.expr(ORDER_TEXT).alias("text"))


def query(oracle: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _digits_sql(number: str, first: int) -> str:
    """The Verhoeff fold of a string of ASCII digits, in DuckDB."""
    turned = f"list_transform(range(0, length({number})), lambda i: {checksum.POWERS}[(((i + {first}) % 8) * 10 + CAST(substr({number}, CAST(length({number}) - i AS INT), 1) AS INT) + 1)::INT]::INT)"
    return f"list_reduce(list_prepend(0::INT, {turned}), lambda c, x: {checksum.PRODUCT}[(c * 10 + x + 1)::INT]::INT)"


def _found_sql(core: str, flanked: bool = True) -> str:
    """(o_orderkey, text, m) of matches in the derived texts; what flanks a match isn't a digit, and matches lie apart."""
    pattern, group = (rf"(?:^|[^0-9])({core})(?:[^0-9]|$)", 1) if flanked else (core, 0)
    return f"SELECT o_orderkey, text, unnest(regexp_extract_all(text, '{pattern}', {group})) AS m FROM (SELECT o_orderkey, {ORDER_TEXT} AS text FROM orders)"


def _place(text: str) -> str:
    return f"o_orderkey, (strpos({text}, m) - 1)::INT AS start, (strpos({text}, m) - 1 + length(m))::INT AS \"end\", m AS span_text"


def _derived(detector: Detector) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = exploded(_orders(spark, sf_dir), detector.spans(F.col("text")), "s", "o_orderkey")
        return rows.select("o_orderkey", "s.start", "s.end", F.col("s.text").alias("span_text"))

    return run


# Normalisation

_ROUGH = r"concat(chr(9), ' ', replace(replace(text, ', ', concat(',', chr(9), '  ')), '. ', concat('.', chr(10), chr(10), chr(10), chr(10))), ' ', chr(10))"


@query(
    f"SELECT doc_id, md5(n) AS digest, length(n)::INT AS size FROM (SELECT doc_id, "
    rf"regexp_replace(regexp_replace(regexp_replace({_ROUGH}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS n FROM documents)"
)
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rough = _table(spark, sf_dir, "documents").select("doc_id", textnorm.normalise(F.expr(_ROUGH)).alias("n"))
    return rough.select("doc_id", F.md5("n").alias("digest"), F.length("n").alias("size"))


_WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "0123456789")


@query(f"SELECT o_orderkey, concat('office file ', {ORDER_TEXT}) AS folded FROM orders")
def unicode_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width digits, ligatures, a no-break space and zero-width characters, on which the composition and the strip work; plain text comes back."""
    wide = F.translate("text", "0123456789", _WIDE)
    rough = F.concat(F.lit("\ufeffo\ufb03ce\u00a0\ufb01le "), F.regexp_replace(wide, "a", "a\u200b"))
    return _orders(spark, sf_dir).select("o_orderkey", textnorm.normalise(rough).alias("folded"))


# Detection

_EMAIL_ROWS = f"""
SELECT doc_id, i, m[i] AS span_text, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS start
FROM (SELECT doc_id, regexp_extract_all(text, '{_EMAIL}') AS m, string_split_regex(text, '{_EMAIL}') AS g FROM documents), unnest(range(1, len(m) + 1)) AS t(i)
"""


@query(f'SELECT doc_id, start, (start + length(span_text))::INT AS "end", span_text FROM ({_EMAIL_ROWS})')
def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exploded(_table(spark, sf_dir, "documents"), EmailDetector().spans(F.col("text")), "s", "doc_id")
    return rows.select("doc_id", "s.start", "s.end", F.col("s.text").alias("span_text"))


@query(f"SELECT page_id, len(regexp_extract_all(html, '{_EMAIL}'))::INT AS n_emails FROM pages")
def email_counts_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.size(EmailDetector().spans(F.col("html"))).alias("n_emails"))


@query(f"SELECT lang, count(*)::BIGINT AS n_docs, sum(len(regexp_extract_all(text, '{_EMAIL}')))::BIGINT AS n_emails FROM documents GROUP BY lang")
def email_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _table(spark, sf_dir, "documents").select("lang", F.size(EmailDetector().spans(F.col("text"))).alias("n"))
    return counted.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("n_emails"))


for _name, _detector, _sql in (
    ("email_spans_derived", EmailDetector(), f"SELECT {_place('text')} FROM ({_found_sql(_EMAIL, False)})"),
    ("phone_spans_derived", PhoneDetector(), f"SELECT {_place('text')} FROM ({_found_sql(_PHONE)})"),
    ("pan_spans_derived", PanDetector(), f"SELECT {_place('text')} FROM ({_found_sql(_PAN, False)})"),
    ("aadhaar_naive_derived", NaiveAadhaarDetector(), f"SELECT {_place('text')} FROM ({_found_sql(_AADHAAR)})"),
    ("aadhaar_checked_derived", AadhaarDetector(), rf"SELECT {_place('text')} FROM (SELECT *, regexp_replace(m, '[\s-]', '', 'g') AS d FROM ({_found_sql(_AADHAAR)})) WHERE {_digits_sql('d', 0)} = 0"),
):
    QUERIES[_name], ORACLES[_name] = _derived(_detector), _sql


@query(
    rf"SELECT count(*)::BIGINT AS naive_hits, count(*) FILTER (ok)::BIGINT AS valid_hits, count(*) FILTER (ok)::DOUBLE / count(*)::DOUBLE AS naive_precision FROM (SELECT {_digits_sql('d', 0)} = 0 AS ok FROM (SELECT regexp_replace(m, '[\s-]', '', 'g') AS d FROM ({_found_sql(_AADHAAR)})))"
)
def aadhaar_precision_naive_vs_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_precision(_orders(spark, sf_dir))


_BASE = "concat(20000000000 + o_orderkey * 7919, '')"


@query(
    f"SELECT o_orderkey, digit, {_digits_sql('whole', 0)} = 0 AS valid, {_digits_sql('bad', 0)} = 0 AS corrupted_valid, concat(substr(whole, 1, 4), ' ', substr(whole, 5, 4), ' ', substr(whole, 9)) AS shown FROM ("
    "SELECT *, concat(substr(whole, 1, 5), (CAST(substr(whole, 6, 1) AS INT) + 1) % 10, substr(whole, 7)) AS bad FROM ("
    f"SELECT o_orderkey, concat({checksum.INVERSE}[({_digits_sql('base', 1)} + 1)::INT], '') AS digit, concat(base, {checksum.INVERSE}[({_digits_sql('base', 1)} + 1)::INT]) AS whole FROM (SELECT o_orderkey, {_BASE} AS base FROM orders)))"
)
def verhoeff_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_BASE).alias("base")).withColumn("whole", checksum.with_check_digit(F.col("base")))
    whole = F.col("whole")
    return rows.select(
        "o_orderkey",
        checksum.verhoeff_digit(F.col("base")).alias("digit"),
        checksum.verhoeff_valid(whole).alias("valid"),
        checksum.verhoeff_valid(checksum.corrupted(whole)).alias("corrupted_valid"),
        checksum.grouped(whole).alias("shown"),
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 IN (1, 2) THEN c_name WHEN c_custkey % 5 IN (3, 4) THEN c_name ELSE concat(c_name, 's') END AS trimmed FROM customer")
def trim_possessives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ("s", "'s", "’s", "'", "’"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select("c_custkey", trim_possessive(F.concat("c_name", ending)).alias("trimmed"))


# Resolution

_LINE_SPANS = (
    "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS s, CAST(l_quantity + 1 + l_partkey % 9 AS INT) AS e, CAST(l_suppkey % 5 AS INT) AS k, CAST(0.5 + l_discount AS DOUBLE) AS c FROM lineitem"
)
_KINDS = ("EMAIL", "PHONE", "PERSON", "LOCATION", "PAN")


def _line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order, its lines as overlapping spans in order of line number."""
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_quantity AS INT) AS s", "CAST(l_quantity + 1 + l_partkey % 9 AS INT) AS e", "CAST(l_suppkey % 5 AS INT) AS k", "CAST(0.5 + l_discount AS DOUBLE) AS c", "l_partkey")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), F.col("k") + 1)
    one = F.struct(kind.alias("entity_type"), F.col("s").alias("start"), F.col("e").alias("end"), F.concat(F.lit("x"), F.col("l_linenumber")).alias("text"), F.col("c").alias("confidence"), F.lit("lines").alias("detector"))
    listed = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", one.alias("span")))).alias("lines"))
    return listed.select("l_orderkey", F.transform("lines", lambda x: x["span"]).cast(SPANS).alias("spans"))


@query(
    f"""
WITH RECURSIVE spans AS (
  SELECT l_orderkey, s, e, k, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN k IN (0, 1, 4) THEN 0 ELSE 1 END, c DESC, e - s DESC, s, ord) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS ord FROM ({_LINE_SPANS.replace('FROM lineitem', ', l_partkey FROM lineitem')}))),
pick AS (
  SELECT l_orderkey, 0::BIGINT AS n, []::STRUCT(s INT, e INT, k INT)[] AS taken FROM (SELECT DISTINCT l_orderkey FROM spans)
  UNION ALL
  SELECT p.l_orderkey, x.n, CASE WHEN len(list_filter(p.taken, lambda a: a.s < x.e AND x.s < a.e)) > 0 THEN p.taken ELSE list_append(p.taken, {{'s': x.s, 'e': x.e, 'k': x.k}}) END
  FROM pick p JOIN spans x ON x.l_orderkey = p.l_orderkey AND x.n = p.n + 1),
last AS (SELECT l_orderkey, arg_max(taken, n) AS taken FROM pick GROUP BY l_orderkey)
SELECT l_orderkey, u.s AS start, u.e AS "end", {list(_KINDS)}[u.k + 1] AS entity_type FROM (SELECT l_orderkey, unnest(taken) AS u FROM last)
"""
)
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exploded(_line_spans(spark, sf_dir), resolve(F.col("spans")), "s", "l_orderkey")
    return rows.select("l_orderkey", "s.start", "s.end", "s.entity_type")


# Redaction

@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}'))::INT AS n_email, regexp_replace(text, '{_EMAIL}', '[EMAIL_REDACTED]', 'g') AS redacted FROM documents")
def placeholder_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", EmailDetector().spans(F.col("text")).alias("spans"))
    return rows.select("doc_id", F.size("spans").alias("n_email"), redact(F.col("text"), F.col("spans"))["redacted"].alias("redacted"))


@query(
    f"""
SELECT doc_id AS document_id, 'EMAIL' AS entity_type, start, (start + length(span_text))::INT AS "end", length(span_text)::INT AS original_length, 'placeholder_removal' AS strategy,
  '[EMAIL_REDACTED]' AS replacement, 0.95::DOUBLE AS confidence, 'regex.email' AS detector
FROM (SELECT concat(doc_id, '') AS doc_id, span_text, start FROM ({_EMAIL_ROWS}))
"""
)
def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_entries(redact_documents(_table(spark, sf_dir, "documents"), detectors=[EmailDetector()]), "doc_id")


@query(
    rf"""
SELECT entity_type, 'placeholder_removal' AS strategy, count(*)::BIGINT AS n, sum(length(m))::BIGINT AS chars FROM (
  SELECT 'EMAIL' AS entity_type, m FROM ({_found_sql(_EMAIL, False)}) UNION ALL SELECT 'PHONE', m FROM ({_found_sql(_PHONE)}) UNION ALL SELECT 'PAN', m FROM ({_found_sql(_PAN, False)}) UNION ALL
  SELECT 'AADHAAR', m FROM (SELECT m, regexp_replace(m, '[\s-]', '', 'g') AS d FROM ({_found_sql(_AADHAAR)})) WHERE {_digits_sql('d', 0)} = 0)
GROUP BY entity_type
"""
)
def audit_summary_by_type_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = audit_entries(redact_documents(_orders(spark, sf_dir)))
    return entries.groupBy("entity_type", "strategy").agg(F.count("*").alias("n"), F.sum("original_length").cast("long").alias("chars"))


@query(
    f"""
SELECT document_id, entity_type, start, "end", original_length, replacement, 2::BIGINT AS copies FROM (
  SELECT concat(doc_id, '') AS document_id, 'EMAIL' AS entity_type, start, (start + length(span_text))::INT AS "end", length(span_text)::INT AS original_length, '[EMAIL_REDACTED]' AS replacement FROM ({_EMAIL_ROWS}))
"""
)
def audit_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwritten once, appended to once, and read back."""
    path = scratch(spark, "audit")
    entries = audit_entries(redact_documents(_table(spark, sf_dir, "documents"), detectors=[EmailDetector()]), "doc_id")
    for append in (False, True):
        write_audit_log(entries, path, append)
    return read_audit_log(spark, path).groupBy("document_id", "entity_type", "start", "end", "original_length", "replacement").agg(F.count("*").alias("copies"))


@query(
    """
WITH names AS (SELECT c_nationkey, c_custkey, lower(concat('Name', (c_custkey * 7) % 41)) AS k FROM customer),
firsts AS (SELECT c_nationkey, k, row_number() OVER (PARTITION BY c_nationkey ORDER BY min(c_custkey)) - 1 AS i FROM names GROUP BY c_nationkey, k)
SELECT n.c_nationkey, (c_custkey * 20)::INT AS start, concat('PERSON_', CASE WHEN i >= 26 THEN chr((64 + i // 26)::INT) ELSE '' END, chr((65 + i % 26)::INT)) AS replacement
FROM names n JOIN firsts f ON n.c_nationkey = f.c_nationkey AND n.k = f.k
"""
)
def pseudonym_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("NAME")).otherwise(F.lit(" name")), (F.col("c_custkey") * 7 % 41).cast("string"))
    one = F.struct(F.lit("PERSON").alias("entity_type"), (F.col("c_custkey") * 20).cast("int").alias("start"), (F.col("c_custkey") * 20 + F.length(name)).cast("int").alias("end"), name.alias("text"), F.lit(0.85).alias("confidence"), F.lit("keys").alias("detector"))
    rows = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(one).cast(SPANS).alias("spans"))
    done = exploded(rows, redact(F.lit(""), F.col("spans"))["records"], "r", "c_nationkey")
    return done.select("c_nationkey", "r.start", "r.replacement")


# Names and places of the default recogniser's lists, by key

_PEOPLE, _PLACES = ("Priya", "Rahul", "Sunita", "Vikram", "Asha"), ("Pune", "Delhi", "Kochi")
_PICK = f"""
SELECT c_custkey, {list(_PEOPLE)}[(c_custkey % 5 + 1)::INT] AS a, {list(_PEOPLE)}[(c_custkey // 5 % 5 + 1)::INT] AS b, {list(_PLACES)}[(c_custkey % 3 + 1)::INT] AS p FROM customer
"""


def _meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    text = F.concat(pick(_PEOPLE, key), F.lit(" met "), pick(_PEOPLE, F.floor(key / 5)), F.lit("'s aunt in "), pick(_PLACES, key), F.lit("."))
    return _table(spark, sf_dir, "customer").select("c_custkey", pick(_PEOPLE, key).alias("name"), text.alias("text"))


@query(
    f"""
SELECT c_custkey AS doc_idx, v.variant, v.text FROM (SELECT c_custkey, unnest([
  {{'variant': 'original', 'text': concat(a, ' met ', b, chr(39), 's aunt in ', p, '.')}},
  {{'variant': 'naive', 'text': concat('[REDACTED] met [REDACTED]', chr(39), 's aunt in ', p, '.')}},
  {{'variant': 'pipeline', 'text': concat('PERSON_A met PERSON_', CASE WHEN a = b THEN 'A' ELSE 'B' END, chr(39), 's aunt in ', p, '.')}}]) AS v FROM ({_PICK}))
"""
)
def text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _meetings(spark, sf_dir).select(F.col("c_custkey").alias("doc_idx"), "text")
    return retrieval.variants(docs).select("doc_idx", "variant", "text")


@query(f"SELECT c_custkey, concat_ws(',', least(a, b), CASE WHEN a <> b THEN greatest(a, b) END) AS got, a = 'Priya' OR b = 'Priya' AS matched FROM ({_PICK})")
def name_spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spot_check(_meetings(spark, sf_dir).withColumn("expected", F.lit("Priya")), [GazetteerDetector()])
    return found.select("c_custkey", F.array_join("got", ",").alias("got"), "matched")


@query(
    f"""
SELECT c_custkey, 'LOCATION' AS entity_type, 'retain' AS strategy, p AS replacement, (length(a) + length(b) + 16)::INT AS start FROM ({_PICK})
UNION ALL SELECT c_custkey, 'ORGANIZATION', 'retain_unhandled_type', a, 0::INT FROM ({_PICK})
"""
)
def retained_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places stay, and so do types that no strategy handles; both are on record."""
    rows = _meetings(spark, sf_dir)
    firm = F.struct(F.lit("ORGANIZATION").alias("entity_type"), F.lit(0).alias("start"), F.length("name").alias("end"), F.col("name").alias("text"), F.lit(0.5).alias("confidence"), F.lit("keys").alias("detector"))
    places = F.filter(GazetteerDetector().spans(F.col("text")), lambda s: s["entity_type"] == "LOCATION")
    done = redact(F.col("text"), F.concat(F.array(firm), places).cast(SPANS))
    kept = rows.select("c_custkey", "text", done.alias("done")).where(F.col("done.redacted") == F.col("text"))
    return exploded(kept.select("c_custkey", F.col("done.records").alias("records")), F.col("records"), "r", "c_custkey").select("c_custkey", "r.entity_type", "r.strategy", "r.replacement", "r.start")


# Evaluation: gold spans lie apart, predictions are shifted, retyped, doubled or missing by key.

_CASE = "concat(CASE WHEN l_orderkey % 3 = 0 THEN 'person_a' WHEN l_orderkey % 3 = 1 THEN 'person_b' ELSE 'mixed' END, '')"
_PAIRS = f"""
SELECT concat(l_orderkey, '') AS id, {_CASE} AS category, ord, {list(_KINDS)}[l_suppkey % 5 + 1] AS gtype, (100 * ord)::INT AS gs, (100 * ord + 10)::INT AS ge,
  CASE WHEN l_partkey % 11 = 0 THEN 'PAN' ELSE {list(_KINDS)}[l_suppkey % 5 + 1] END AS ptype, (100 * ord + l_partkey % 4 - 1)::INT AS ps, (100 * ord + 10)::INT AS pe,
  CASE WHEN l_partkey % 7 = 0 THEN 0 WHEN l_partkey % 13 = 0 THEN 2 ELSE 1 END AS copies
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord FROM lineitem)
"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    kinds = F.array(*map(F.lit, _KINDS))
    kind = lambda x: F.element_at(kinds, (x["l_suppkey"] % 5 + 1).cast("int"))
    at = lambda i: (100 * (i + 1)).cast("int")
    gold = F.transform("lines", lambda x, i: F.struct(kind(x).alias("type"), at(i).alias("start"), (at(i) + 10).alias("end"), F.concat(F.lit("g"), i + 1).alias("text")))

    def predicted(x: Column, i: Column) -> Column:
        one = F.struct(
            F.when(x["l_partkey"] % 11 == 0, F.lit("PAN")).otherwise(kind(x)).alias("entity_type"),
            (at(i) + x["l_partkey"] % 4 - 1).cast("int").alias("start"),
            (at(i) + 10).alias("end"),
            F.concat(F.lit("p"), i + 1).alias("text"),
            F.lit(0.9).alias("confidence"),
            F.lit("keys").alias("detector"),
        )
        return F.when(x["l_partkey"] % 7 == 0, F.slice(F.array(one), 1, 0)).when(x["l_partkey"] % 13 == 0, F.array(one, one)).otherwise(F.array(one))

    category = F.when(F.col("l_orderkey") % 3 == 0, "person_a").when(F.col("l_orderkey") % 3 == 1, "person_b").otherwise("mixed")
    return rows.select(F.col("l_orderkey").cast("string").alias("id"), category.alias("category"), F.lit("").alias("text"), gold.alias("entities"), F.flatten(F.transform("lines", predicted)).cast(SPANS).alias("predicted"))


def _judged_sql(rule: str) -> str:
    """(id, category, ord, outcome, entity_type, span_text, kind_rank): of a pair the first copy may match."""
    hit = "gtype = ptype AND gs = ps AND ge = pe" if rule == "strict" else "gtype = ptype AND ps < ge AND gs < pe"
    return f"""
SELECT id, category, ord, CASE WHEN copies > 0 AND {hit} THEN 'TP' ELSE 'FN' END AS outcome, gtype AS entity_type, concat('g', ord) AS span_text, 0 AS kind_rank FROM ({_PAIRS})
UNION ALL
SELECT id, category, ord, 'FP', ptype, concat('p', ord), 1 FROM ({_PAIRS}), unnest(range(0, CASE WHEN {hit} THEN greatest(copies - 1, 0) ELSE copies END)) AS t(c)
"""


_SCORES = """count(*) FILTER (outcome = 'TP')::BIGINT AS tp, count(*) FILTER (outcome = 'FP')::BIGINT AS fp, count(*) FILTER (outcome = 'FN')::BIGINT AS fn"""
_RATES = """tp::DOUBLE / nullif(tp + fp, 0)::DOUBLE AS "precision", tp::DOUBLE / nullif(tp + fn, 0)::DOUBLE AS recall"""


def _scores_sql(rule: str, by: str, where: str = "true") -> str:
    inner = f"SELECT {by}, {_SCORES} FROM ({_judged_sql(rule)}) WHERE {where} GROUP BY {by}"
    return f'SELECT *, 2 * "precision" * recall / nullif("precision" + recall, 0) AS f1 FROM (SELECT *, {_RATES} FROM ({inner}))'


@query(_scores_sql("strict", "entity_type"))
def score_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.per_type(scoring.judged(_cases(spark, sf_dir), "strict"))


@query(_scores_sql("relaxed", "entity_type"))
def score_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.per_type(scoring.judged(_cases(spark, sf_dir), "relaxed"))


@query(_scores_sql("strict", "category", "starts_with(category, 'person_')"))
def score_person_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.person_by_category(scoring.judged(_cases(spark, sf_dir), "strict"))


@query(_scores_sql("relaxed", "ROLLUP (entity_type)").replace("SELECT ROLLUP (entity_type),", "SELECT entity_type,"))
def score_per_type_and_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.per_type_and_overall(scoring.judged(_cases(spark, sf_dir), "relaxed"))


@query(f"SELECT outcome AS kind, id AS case_id, category, entity_type, span_text, '' AS text FROM ({_judged_sql('strict')}) WHERE outcome <> 'TP'")
def score_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.failures(scoring.judged(_cases(spark, sf_dir), "strict"), ordered=False)


@query(
    """
WITH k AS (SELECT o_orderkey, o_orderkey % 4 AS v FROM orders),
hits AS (SELECT o_orderkey, unnest(CASE v WHEN 0 THEN ['TP g1', 'FN g2'] WHEN 1 THEN ['TP g1', 'TP g2', 'FP p3'] WHEN 2 THEN ['TP g1', 'FN g2', 'FP p1'] ELSE ['FN g1', 'TP g2'] END) AS x FROM k)
SELECT o_orderkey, substr(x, 1, 2) AS outcome, substr(x, 4) AS span_text FROM hits
"""
)
def score_greedy_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold spans that overlap: each in order takes the first prediction left, so one that fits both is the first one's, whatever fits better."""
    gold = F.array(*(F.struct(F.lit("PERSON").alias("type"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("text")) for a, b, n in ((0, 5, "g1"), (3, 9, "g2"))))
    of = {"p1": (4, 8), "p2": (6, 9), "p3": (0, 2)}  # p1 fits both, p2 and p3 one each
    one = lambda n, kind="PERSON": F.struct(F.lit(kind).alias("entity_type"), F.lit(of[n][0]).alias("start"), F.lit(of[n][1]).alias("end"), F.lit(n).alias("text"), F.lit(0.9).alias("confidence"), F.lit("keys").alias("detector"))
    found = [F.array(one("p1")), F.array(one("p1"), one("p2"), one("p3")), F.array(one("p3"), one("p1", "EMAIL")), F.array(one("p2"))]
    which = F.col("o_orderkey") % 4
    predicted = F.when(which == 0, found[0]).when(which == 1, found[1]).when(which == 2, found[2]).otherwise(found[3]).cast(SPANS)
    cases = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("mixed").alias("category"), F.lit("").alias("text"), gold.alias("entities"), predicted.alias("predicted"))
    return scoring.judged(cases, "relaxed").select(F.col("id").cast("long").alias("o_orderkey"), "outcome", "span_text")


_FOUND_TWO = f"SELECT o_orderkey, o_orderkey % 2 AS late, len(regexp_extract_all(text, '{_PAN}')) AS n_pan FROM (SELECT o_orderkey, {ORDER_TEXT} AS text FROM orders)"


@query(
    f"""
SELECT *, 2 * "precision" * recall / nullif("precision" + recall, 0) AS f1 FROM (SELECT *, {_RATES} FROM (
  SELECT 'strict' AS rule, 'EMAIL' AS entity_type, sum(1 - late)::BIGINT AS tp, sum(late)::BIGINT AS fp, sum(late)::BIGINT AS fn FROM ({_FOUND_TWO})
  UNION ALL SELECT 'relaxed', 'EMAIL', count(*)::BIGINT, 0::BIGINT, 0::BIGINT FROM ({_FOUND_TWO})
  UNION ALL SELECT 'strict', 'PAN', 0::BIGINT, sum(n_pan)::BIGINT, 0::BIGINT FROM ({_FOUND_TWO})
  UNION ALL SELECT 'relaxed', 'PAN', 0::BIGINT, sum(n_pan)::BIGINT, 0::BIGINT FROM ({_FOUND_TWO})))
"""
)
def evaluation_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to scores: detected once, judged by both rules. Gold has the addresses, every other one a character late, and no account numbers."""
    key = F.col("o_orderkey")
    mail = F.concat(F.lit("u"), key, F.lit("@ex-"), key % 7, F.lit(".co.in"))
    start = F.call_function("locate", mail, F.col("text")) - 1
    gold = F.array(F.struct(F.lit("EMAIL").alias("type"), (start + key % 2).cast("int").alias("start"), (start + F.length(mail)).cast("int").alias("end"), mail.alias("text")))
    cases = _orders(spark, sf_dir).select(key.cast("string").alias("id"), F.lit("mixed").alias("category"), "text", gold.alias("entities"))
    return scoring.scores_by_rule(for_evaluation(cases, [EmailDetector(), PanDetector()]))


@query(
    """
SELECT n_nationkey, p AS "precision", r AS recall, 2 * p * r / nullif(p + r, 0) AS f1, CASE WHEN p IS NULL THEN '-' ELSE printf('%.3f', p) END AS shown
FROM (SELECT n_nationkey, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM (SELECT n_nationkey, (n_nationkey % 4)::DOUBLE AS tp, (n_nationkey % 3)::DOUBLE AS fp, (n_nationkey % 5)::DOUBLE AS fn FROM nation))
"""
)
def f1_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp, fp, fn = (F.col("n_nationkey") % k for k in (4, 3, 5))
    return _table(spark, sf_dir, "nation").select("n_nationkey", metrics.precision(tp, fp).alias("precision"), metrics.recall(tp, fn).alias("recall"), metrics.f1(tp, fp, fn).alias("f1"), metrics.shown(metrics.precision(tp, fp)).alias("shown"))


# Labelled sets

@query(
    """
SELECT lpad(concat(p_partkey, ''), greatest(4, length(concat(p_partkey, '')))::INT, '0') AS id, i::INT AS ord, w[i] AS span_text,
  (coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) + i - 1)::INT AS start
FROM (SELECT p_partkey, string_split(concat(p_name, ' ', p_name), ' ') AS w FROM part), unnest(range(1, len(w) + 1)) AS t(i)
"""
)
def offset_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" "), "p_name")
    words = F.transform(F.split(text, " "), lambda w: F.struct(F.lit("PERSON").alias("type"), w.alias("text")))
    built = labelled.build(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.lit("mixed").alias("category"), text.alias("text"), words.alias("entities")))
    return built.select("id", F.posexplode("entities").alias("ord", "e")).select("id", (F.col("ord") + 1).cast("int").alias("ord"), F.col("e.text").alias("span_text"), "e.start")


@query(
    """
SELECT id, 'mixed' AS category, concat(n, ' ', n) AS text, i AS ord, n AS span_text, (CASE WHEN i = 1 THEN 0 ELSE length(n) + 1 END)::INT AS start
FROM (SELECT lpad(concat(p_partkey, ''), greatest(4, length(concat(p_partkey, '')))::INT, '0') AS id, p_name AS n, unnest([1, 2]) AS i FROM part)
"""
)
def gold_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled set is built, written and read back."""
    path = scratch(spark, "gold")
    twice = F.array(*[F.struct(F.lit("PERSON").alias("type"), F.col("p_name").alias("text"))] * 2)
    cases = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.lit("mixed").alias("category"), F.concat("p_name", F.lit(" "), "p_name").alias("text"), twice.alias("entities"))
    write_gold(labelled.build(cases), path)
    rows = read_gold(spark, path).select("id", "category", "text", F.posexplode("entities").alias("ord", "e"))
    return rows.select("id", "category", "text", (F.col("ord") + 1).cast("int").alias("ord"), F.col("e.text").alias("span_text"), "e.start")


def _line_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _line_spans(spark, sf_dir)
    gold = F.transform("spans", lambda s: F.struct(s["entity_type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return spans.select(F.col("l_orderkey").cast("string").alias("id"), F.when(F.col("l_orderkey") % 2 == 0, "even").otherwise("odd").alias("category"), F.lit("").alias("text"), gold.alias("entities"))


@query(f"SELECT id, start, previous_end FROM (SELECT concat(l_orderkey, '') AS id, s AS start, lag(e) OVER (PARTITION BY l_orderkey ORDER BY s, e) AS previous_end FROM ({_LINE_SPANS})) WHERE start < previous_end")
def overlap_quality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled.overlapping(_line_gold(spark, sf_dir))


@query(
    f"""
SELECT 'category' AS kind, CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS name, count(DISTINCT l_orderkey)::BIGINT AS n FROM lineitem GROUP BY ALL
UNION ALL SELECT 'type', {list(_KINDS)}[k + 1], count(*)::BIGINT FROM ({_LINE_SPANS}) GROUP BY k
"""
)
def labelled_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled.summary(_line_gold(spark, sf_dir))


@query(
    rf"""
WITH ids AS (SELECT o_orderkey, concat(o_orderkey, '') AS id, {ORDER_TEXT} AS text FROM orders),
gold AS (SELECT id, 'EMAIL' AS type, concat('u', o_orderkey, '@ex-', o_orderkey % 7, CASE WHEN o_orderkey % 4 = 0 THEN '.com' ELSE '.co.in' END) AS text, o_orderkey FROM ids
  UNION ALL SELECT id, 'AADHAAR', concat(200000000000 + o_orderkey * 7919, ''), o_orderkey FROM ids)
SELECT id, type, text FROM gold WHERE CASE WHEN type = 'EMAIL' THEN o_orderkey % 4 = 0 ELSE {_digits_sql('text', 0)} <> 0 END
"""
)
def gold_without_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    mail = F.concat(F.lit("u"), key, F.lit("@ex-"), key % 7, F.when(key % 4 == 0, ".com").otherwise(".co.in"))
    entity = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.lit(0).alias("start"), F.lit(1).alias("end"), text.alias("text"))
    entities = F.array(entity("EMAIL", mail), entity("AADHAAR", (200000000000 + key * 7919).cast("string")))
    return labelled.without_hit(_orders(spark, sf_dir).select(key.cast("string").alias("id"), "text", entities.alias("entities")))


# Retrieval

_COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_RANKS = f"""
WITH q AS (SELECT vec_id AS query_id, (vec_id + 1) AS correct_idx, embedding FROM embeddings WHERE vec_id % 25 = 0),
s AS (SELECT query_id, correct_idx, b.vec_id, round({_COSINE}, 12) AS score FROM q a, embeddings b),
r AS (SELECT query_id, correct_idx, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, correct_idx, rank::BIGINT AS rank FROM r WHERE vec_id = correct_idx
"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("correct_idx"), "embedding")
    return retrieval.ranks(asked, vectors.select(F.col("vec_id").alias("doc_idx"), "embedding")).where("rank is not null")


@query(_RANKS)
def retrieval_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


@query(f"SELECT part, count(*)::BIGINT AS n, round(avg((rank = 1)::INT::DOUBLE), 9) AS top1_accuracy, round(avg(1.0::DOUBLE / rank), 9) AS mrr FROM (SELECT *, CASE WHEN correct_idx < 200 THEN 'low' ELSE 'high' END AS part FROM ({_RANKS})) GROUP BY part")
def retrieval_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _ranked(spark, sf_dir).withColumn("part", F.when(F.col("correct_idx") < 200, "low").otherwise("high"))
    return retrieval.metrics(parts, ["part"]).select("part", "n", F.round("top1_accuracy", 9).alias("top1_accuracy"), F.round("mrr", 9).alias("mrr"))


@query(
    f"""
WITH v AS (SELECT 'original' AS variant, vec_id, embedding FROM embeddings UNION ALL SELECT 'next', vec_id - 1, embedding FROM embeddings)
SELECT a.variant, round(avg({_COSINE}), 9) AS mean_sim_to_original FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.variant = 'original' GROUP BY a.variant
"""
)
def variant_mean_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    both = vectors.select(F.lit("original").alias("variant"), F.col("vec_id").alias("doc_idx"), "embedding").unionByName(vectors.select(F.lit("next").alias("variant"), (F.col("vec_id") - 1).alias("doc_idx"), "embedding"))
    return retrieval.mean_similarity(both).select("variant", F.round("mean_sim_to_original", 9).alias("mean_sim_to_original"))


# The whole pipeline

@query(None)
def redact_documents_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redact_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "redacted", F.size("records").alias("n_records"))


@query(
    f"""
SELECT o_orderkey, regexp_replace(regexp_replace(CASE WHEN ok1 THEN replace(t, m1, '[AADHAAR_REDACTED]') ELSE t END, '{_EMAIL}', '[EMAIL_REDACTED]', 'g'), '{_PAN}', '[PAN_REDACTED]', 'g') AS redacted
FROM (SELECT o_orderkey, m1, {_digits_sql('m1', 0)} = 0 AS ok1, CASE WHEN {_digits_sql('d2', 0)} = 0 THEN replace(p, m2, '[AADHAAR_REDACTED]') ELSE p END AS t
  FROM (SELECT o_orderkey, concat(200000000000 + o_orderkey * 7919, '') AS m1, concat(substr({_ID}, 1, 4), ' ', substr({_ID}, 5, 4), '-', substr({_ID}, 9, 4)) AS m2, {_ID} AS d2,
    replace(replace({ORDER_TEXT}, concat('+91 ', 60000 + (o_orderkey * 7) % 40000, ' ', lpad(concat((o_orderkey * 31) % 100000, ''), 5, '0')), '[PHONE_REDACTED]'), concat('0', 6000000000 + (o_orderkey * 104729) % 3999999999), '[PHONE_REDACTED]') AS p
  FROM orders))
"""
)
def redact_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_documents(_orders(spark, sf_dir)).select("o_orderkey", "redacted")
