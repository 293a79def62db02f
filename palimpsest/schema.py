"""Types, schemas and fixed values of the data model. Offsets are 0-based code points into normalised text, ends exclusive."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

ENTITY_TYPES = ("EMAIL", "PHONE", "PAN", "AADHAAR", "PERSON", "ORGANIZATION", "LOCATION", "DATE_OF_BIRTH")

# Which types are structured, the patterns, confidences, placeholders and strategies that results must agree on.
STRUCTURED = ("EMAIL", "PHONE", "PAN", "AADHAAR")
EMAIL = r"(?U)\b[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}\b"
PHONE = r"(?U)(?<!\d)(?:\+91[\s\x1c-\x1f-]?|0)?[6-9]\d{4}[\s\x1c-\x1f-]?\d{5}(?!\d)"
PAN = r"(?U)\b[A-Z]{3}[ABCFGHJLPT][A-Z]\d{4}[A-Z]\b"
AADHAAR = r"(?U)(?<!\d)[2-9]\d{3}[\s\x1c-\x1f-]?\d{4}[\s\x1c-\x1f-]?\d{4}(?!\d)"
CONFIDENCE = {"regex.email": 0.95, "regex.phone": 0.90, "regex.pan": 0.90, "regex.aadhaar": 0.97, "regex.aadhaar.naive": 0.50}
PLACEHOLDERS = {"EMAIL": "[EMAIL_REDACTED]", "PHONE": "[PHONE_REDACTED]", "PAN": "[PAN_REDACTED]", "AADHAAR": "[AADHAAR_REDACTED]"}
REMOVED, PSEUDONYM, RETAINED, UNHANDLED = "placeholder_removal", "consistent_pseudonymization", "retain", "retain_unhandled_type"
NAIVE_TOKEN = "[REDACTED]"
POSSESSIVES = ("'s", "’s", "'", "’")

SPAN = StructType(
    [
        StructField("entity_type", StringType()),
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("text", StringType()),
        StructField("confidence", DoubleType()),
        StructField("detector", StringType()),
    ]
)
SPANS = ArrayType(SPAN)
RECORD = StructType(
    [
        StructField("entity_type", StringType()),
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("original_length", IntegerType()),
        StructField("strategy", StringType()),
        StructField("replacement", StringType()),
        StructField("confidence", DoubleType()),
        StructField("detector", StringType()),
    ]
)
AUDIT = StructType([*RECORD.fields, StructField("document_id", StringType())])
GOLD_ENTITY = StructType([StructField("type", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType())])
GOLD = StructType([StructField("id", StringType()), StructField("category", StringType()), StructField("text", StringType()), StructField("entities", ArrayType(GOLD_ENTITY))])
