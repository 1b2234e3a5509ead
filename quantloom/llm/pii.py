"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are kept whenever their own test holds. Added kinds need more: an
IBAN must pass mod-97, a social security number needs a context word. Built-in functions only.

Defined cases: null text counts as empty (no spans); very long texts are scanned whole; every input row gives one output row, also where
ids repeat or are null; ties in start are ordered by kind; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.spans import Rule, find_spans, score, span_digest

LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: An added kind stays from this score on.
LEAST = 0.6


def digits(column: Column) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def luhn(number: Column, longest: int = 19) -> Column:
    """Whether a string of at most ``longest`` digits passes the Luhn test."""
    padded, total = F.lpad(number, longest, "0"), F.lit(0)
    for i in range(longest):
        d = F.substring(padded, longest - i, 1).cast("int")
        total = total + (d if i % 2 == 0 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (spaces allowed) leaves 1 when divided by 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(F.ascii(c) < 65, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(F.ascii(c) < 65, 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def rules() -> list[Rule]:
    t, hit = F.col("t"), F.col("hit")
    n = F.length(digits(hit))
    near_ssn = F.lower(F.concat("before", F.lit(" "), "after")).rlike("ssn|social security")
    return [
        Rule("email", EMAIL, t.contains("@"), F.lit(True), context="mail|contact|write to|@"),
        Rule("ip", IP, t.rlike(r"[0-9]\.[0-9]"), hit.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), context=r"\bip\b|host|server|address"),
        Rule("card", CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), F.when(n.between(14, 19), luhn(digits(hit))).otherwise(False), context="card|visa|credit|payment"),
        Rule("phone", PHONE, t.contains("+"), n.between(10, 15), context="tel|phone|call|mobile|fax"),
        Rule("iban", IBAN, t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{9}"), mod97(hit), base=False, context="iban|bank|account"),
        Rule("ssn", SSN, t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), near_ssn, base=False, context="ssn|social security"),
    ]


def personal_data_spans(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The spans themselves: row, id, kind, start, stop, hit, before, after, valid, score."""
    every = rules()
    spans = find_spans(docs, every, id_col, text_col).withColumn("score", score(every))
    # a checksum confirms an IBAN as firmly as a base rule
    spans = spans.withColumn("score", F.when(F.col("kind") == 4, F.col("score") + 0.2).otherwise(F.col("score")))
    base = F.col("kind").isin([k for k, r in enumerate(every) if r.base])
    return spans.withColumn("valid", F.col("valid") & (base | (F.col("score") >= LEAST)))


def personal_data(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    top = F.coalesce(F.max(F.when(F.col("valid"), F.col("score"))), F.lit(0.0)).alias("top_score")
    return span_digest(personal_data_spans(docs, id_col, text_col), rules(), id_col, [top])


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
