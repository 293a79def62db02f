"""Detectors: from a text column to an array of spans. Those with fixed formats are Column expressions; others may be Python functions."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.functions.checksum import digits_only, verhoeff_valid
from palimpsest.functions.lets import empty
from palimpsest.functions.spanscan import scan
from palimpsest.schema import AADHAAR, CONFIDENCE, EMAIL, PAN, PHONE, POSSESSIVES, SPANS


@runtime_checkable
class Detector(Protocol):
    name: str

    def spans(self, text: Column) -> Column:
        """array<span> of a normalised text, in order of detection."""


class PatternDetector:
    """All matches of a pattern."""

    def __init__(self, name: str, entity_type: str, pattern: str, guard: Callable[[Column], Column], confidence: float):
        self.name, self.entity_type, self.pattern, self.guard, self.confidence = name, entity_type, pattern, guard, confidence

    def spans(self, text: Column) -> Column:
        return scan(text, self.pattern, self.guard(text), self.entity_type, self.confidence, self.name)


class EmailDetector(PatternDetector):
    def __init__(self) -> None:
        super().__init__("regex.email", "EMAIL", EMAIL, lambda t: F.contains(t, F.lit("@")), CONFIDENCE["regex.email"])


class PhoneDetector(PatternDetector):
    """Indian mobile numbers: an optional prefix, five digits from 6 to 9 on, an optional separator, five digits."""

    def __init__(self) -> None:
        super().__init__("regex.phone", "PHONE", PHONE, lambda t: t.rlike(r"(?U)[6-9]\d{4}"), CONFIDENCE["regex.phone"])


class PanDetector(PatternDetector):
    def __init__(self) -> None:
        super().__init__("regex.pan", "PAN", PAN, lambda t: t.rlike("[A-Z]{5}"), CONFIDENCE["regex.pan"])


class NaiveAadhaarDetector(PatternDetector):
    """Twelve digits of the format, whatever their checksum; for comparison only."""

    def __init__(self, name: str = "regex.aadhaar.naive") -> None:
        super().__init__(name, "AADHAAR", AADHAAR, lambda t: t.rlike(r"(?U)[2-9]\d{3}"), CONFIDENCE[name])


class AadhaarDetector(NaiveAadhaarDetector):
    """Of the format and with a valid checksum. A match that fails it still uses up its characters."""

    def __init__(self) -> None:
        super().__init__("regex.aadhaar")

    def spans(self, text: Column) -> Column:
        return F.filter(super().spans(text), lambda s: verhoeff_valid(digits_only(s["text"])))


def trimmed(spans: Column) -> Column:
    """Spans without a possessive ending. Only the end moves, by one suffix at most, and never up to the start."""
    suffix = F.lit("(?s)(?<=.)(?:" + "|".join(POSSESSIVES) + r")\z")

    def one(s: Column) -> Column:
        text = F.regexp_replace(s["text"], suffix, F.lit(""))
        return F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), (s["start"] + F.length(text)).alias("end"), text.alias("text"), s["confidence"].alias("confidence"), s["detector"].alias("detector"))

    return F.transform(spans, one).cast(SPANS)


def trim_possessive(span: Column) -> Column:
    """The same for a span's text alone."""
    return F.regexp_replace(span, "(?s)(?<=.)(?:" + "|".join(POSSESSIVES) + r")\z", "")


def any_of(words: Sequence[str]) -> str:
    """A pattern for any of some words, longest first, that shares what they begin with, so that a scan gives up early."""
    if not words:
        return r"(?!)"

    def branch(some: list[str]) -> str:
        ends, by_first = "" in some, {}
        for w in some:
            if w:
                by_first.setdefault(w[0], []).append(w[1:])
        parts = [re.escape(c) + branch(rest) for c, rest in sorted(by_first.items())]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
        return body + "?" * ends

    return f"(?=[{''.join(sorted({re.escape(w[0]) for w in words}))}]){branch(sorted(set(words)))}"


class GazetteerDetector:
    """The default recogniser of names and places: capitalised words after a form of address or led by a known first name, and known cities.

    A rule, not a model: it finds what its lists hold. Its spans have a constant confidence of 0.85.
    """

    NAMES = (
        "Aarav Aditi Aditya Ajay Akshay Amina Amit Amrita Ananya Anil Anita Anjali Anwar Arjun Arun Asha Ashok Daniel David Deepa Deepak Divya Farhan Fatima Gaurav Geeta Gurdeep "
        "Harish Imran Isha Jasmine Jaspreet John Joseph Karan Kavita Kiran Lakshmi Lata Manish Manoj Maria Mary Meena Mohammed Mohan Mukesh Nadia Naveen Neha Nikhil Nisha Pooja "
        "Pradeep Prakash Priya Rahul Raj Rajesh Ramesh Ravi Rekha Rohan Rohit Sana Sandeep Sanjay Sarah Seema Shreya Simran Sneha Sonia Suman Sunita Suresh Thomas Usha Vijay Vikram Vivek Zara"
    ).split()
    CITIES = (
        "Agra Ahmedabad Bangalore Bengaluru Bhopal Chandigarh Chennai Coimbatore Dehradun Delhi Guwahati Hyderabad Indore Jaipur Kanpur Kochi Kolkata Lucknow Ludhiana Madurai Mumbai Mysore "
        "Nagpur Nashik Patna Pune Raipur Ranchi Surat Thane Vadodara Varanasi Visakhapatnam"
    ).split()
    CONFIDENCE = 0.85

    def __init__(self, names: Sequence[str] = tuple(NAMES), cities: Sequence[str] = tuple(CITIES), name: str = "ner.gazetteer"):
        self.name = name
        tail = r"(?: [A-Z][a-z]+)?(?:'s|’s)?"
        known, forms = any_of(names), any_of(("Mr", "Mrs", "Ms", "Dr", "Shri", "Smt"))
        self.person = rf"(?U)(?=[A-Z])(?:(?<=\b(?:Mr|Mrs|Ms|Dr|Shri|Smt)\.? )[A-Z][a-z]+{tail}|\b{known}\b{tail})"
        self.place = rf"(?U)(?=[A-Z])\b{any_of(cities)}\b(?:'s|’s)?"
        self.people_guard, self.place_guard = rf"(?=[A-Z])(?:{forms}|{known})\b", any_of(cities)

    def spans(self, text: Column) -> Column:
        people = scan(text, self.person, text.rlike(self.people_guard), "PERSON", self.CONFIDENCE, self.name)
        places = scan(text, self.place, text.rlike(self.place_guard), "LOCATION", self.CONFIDENCE, self.name)
        return trimmed(F.concat(people, places))


@lru_cache(maxsize=4)
def _built(factory: Callable[[], Callable[[str], Iterable[tuple]]]) -> Callable[[str], Iterable[tuple]]:
    return factory()


class ModelDetector:
    """A Python recogniser. factory runs once in each worker process and gives a function text -> (entity_type, start, end, confidence)s."""

    def __init__(self, name: str, factory: Callable[[], Callable[[str], Iterable[tuple[str, int, int, float]]]], possessives: bool = True):
        self.name, self.factory, self.possessives = name, factory, possessives

    def spans(self, text: Column) -> Column:
        factory, name = self.factory, self.name
        kind = to_arrow_type(SPANS)

        @F.arrow_udf(SPANS)
        def found(texts: pa.Array) -> pa.Array:
            detect = _built(factory)
            keys = ("entity_type", "start", "end", "text", "confidence", "detector")
            rows = [None if t is None else [dict(zip(keys, (k, a, b, t[a:b], c, name), strict=True)) for k, a, b, c in detect(t)] for t in texts.to_pylist()]
            return pa.array(rows, kind)

        spans = found(text)
        return trimmed(spans) if self.possessives else spans


def _presidio() -> Callable[[str], list[tuple[str, int, int, float]]]:
    from presidio_analyzer import AnalyzerEngine

    engine = AnalyzerEngine()
    return lambda text: [(r.entity_type, r.start, r.end, float(r.score)) for r in engine.analyze(text=text, language="en", entities=["PERSON", "LOCATION"])]


def presidio() -> ModelDetector:
    """The model-backed recogniser, where its packages are installed."""
    if importlib.util.find_spec("presidio_analyzer") is None:
        raise ImportError("presidio_analyzer is not installed; use GazetteerDetector")
    return ModelDetector("ner.presidio", _presidio)


def default_detectors() -> list[Detector]:
    """In the order that breaks ties."""
    return [EmailDetector(), PhoneDetector(), PanDetector(), AadhaarDetector(), GazetteerDetector()]


def detect(text: Column, detectors: Sequence[Detector] | None = None) -> Column:
    """All spans of all detectors, in detector order, then match order; they may overlap."""
    given = default_detectors() if detectors is None else list(detectors)
    return F.concat(*(d.spans(text) for d in given)) if given else F.when(text.isNotNull(), empty(SPANS))
