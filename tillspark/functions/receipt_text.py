"""Fields of captured receipt text (operators H10-H18, H35), one pass over each whole text.

Text extraction is order-sensitive (a total is the last of its kind, a wrapped price belongs to
the line before), so one Arrow-batched function reads the lines of a text and returns a struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONEY = re.compile(r"(-?)\$?(\d[\d,]*\.\d{2})(-?)(?!\d)")
_TOTAL = re.compile(r"^\W*(grand\s+)?total\b(?!\s*(items|savings|discount))", re.IGNORECASE)
_SUBTOTAL = re.compile(r"^\W*sub\s*-?\s*total\b", re.IGNORECASE)
_TAX = re.compile(r"\b(hst|gst|pst|qst|tax)\b", re.IGNORECASE)
_TENDER = re.compile(r"\b(visa|master\s?card|amex|debit|interac|cash|gift\s+card)\b", re.IGNORECASE)
_LAST4 = re.compile(r"(?:[x*•]{2,}[\s-]*|ending\s+(?:in\s+)?)(\d{4})(?!\d)", re.IGNORECASE)
_ISO = re.compile(r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T]+(\d{1,2}):(\d{2}))?")
_US = re.compile(r"\b(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?:\s+(\d{1,2}):(\d{2})\s*([AP]M)?)?", re.IGNORECASE)
_PHONE = re.compile(r"\(?(\d{3})\)?[-. ](\d{3})[-. ](\d{4})\b")
_NOT_ITEM = re.compile(r"\b(total|tax|change|balance|tender|savings|points|cash|visa|debit|master\s?card)\b", re.IGNORECASE)
_CODE = re.compile(r"^\s*(\d{4,14})\s+")

FIELDS = "subtotal decimal(14,2), tax decimal(14,2), total decimal(14,2), total_source string, payment_method string, card_last4 string, transaction_datetime string, phone string, items array<struct<line: int, name: string, code: string, amount: decimal(14,2)>>"


def amounts(line: str) -> list[Decimal]:
    """All amounts with cents; a minus on either side counts."""
    return [Decimal(("-" if a or c else "") + b.replace(",", "")) for a, b, c in _MONEY.findall(line)]


def moments(text: str) -> set[str]:
    """Distinct dates (with a time where there is one) that exist, as ISO text."""
    found = set()

    def add(y: int, m: int, d: int, hour: str | None, minute: str | None, half: str | None) -> None:
        y += 2000 if y < 100 else 0
        try:
            at = pd.Timestamp(year=y, month=m, day=d)
        except ValueError:
            return
        if hour is None:
            found.add(f"{at:%Y-%m-%d}")
            return
        h = int(hour) % 12 + (12 if half.upper() == "PM" else 0) if half else int(hour)
        if h < 24 and int(minute) < 60:
            found.add(f"{at:%Y-%m-%d}T{h:02d}:{minute}")

    for y, m, d, hour, minute in _ISO.findall(text):
        add(int(y), int(m), int(d), hour or None, minute, None)
    for m, d, y, hour, minute, half in _US.findall(text):
        add(int(y), int(m), int(d), hour or None, minute, half)
    return found


def one_moment(text: str) -> str | None:
    """The one date and time of a text: a timed one if its day is the only one; null on conflict."""
    found = moments(text)
    days = {x[:10] for x in found}
    timed = {x for x in found if "T" in x}
    if len(days) != 1 or len(timed) > 1:
        return None
    return next(iter(timed), next(iter(days)))


def extract(text: str | None) -> tuple:
    """All fields of FIELDS for one text."""
    lines = (text or "").split("\n")
    subtotal = tax = total = method = None
    items: list[dict] = []
    summary = False
    for n, line in enumerate(lines, 1):
        money = amounts(line)
        following = amounts(lines[n]) if n < len(lines) and not money else []
        value = (money or (following if re.fullmatch(r"\s*\S+\s*", lines[n]) else []) or [None])[-1] if n < len(lines) or money else None
        if _SUBTOTAL.search(line):
            subtotal, summary = value if value is not None else subtotal, True
        elif _TOTAL.search(line):
            total, summary = value if value is not None else total, True
        elif summary and _TAX.search(line) and money:
            tax = (tax or Decimal(0)) + money[-1]
        elif (m := _TENDER.search(line)) and method is None:
            method = re.sub(r"\s+", "", m[1].lower())
        elif money and not summary and not _NOT_ITEM.search(line):
            name = _MONEY.sub("", line).strip(" \t$-")
            code = _CODE.match(name)
            amount = money[-1]
            if not name and items:
                items[-1]["amount"] = amount if items[-1]["amount"] is None else items[-1]["amount"]
            elif amount < 0 and items and re.search(r"\b(tpd|discount|coupon|off)\b", name, re.IGNORECASE):
                items[-1]["amount"] += amount
            elif name:
                items.append({"line": n, "name": _CODE.sub("", name) if code else name, "code": code[1] if code else None, "amount": amount})
    source = "printed" if total is not None else None
    if total is None and subtotal is not None and tax is not None:
        total, source = subtotal + tax, "recovered"
    last4 = {x for x in _LAST4.findall(text or "")}
    phones = {"-".join(p) for p in _PHONE.findall(text or "")}
    return subtotal, tax, total, source, method, last4.pop() if len(last4) == 1 else None, one_moment(text or ""), phones.pop() if len(phones) == 1 else None, items


def receipt_fields(text: Column) -> Column:
    """A struct of FIELDS, read in one pass over each whole text."""
    names = ["subtotal", "tax", "total", "total_source", "payment_method", "card_last4", "transaction_datetime", "phone", "items"]

    @F.pandas_udf(FIELDS)
    def fields(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([extract(t) for t in batch], columns=names)

    return fields(text)


def parsed(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the fields of each text; the text is read once for all of them."""
    return df.withColumn("fields", receipt_fields(F.col(text)))


def repeated_amounts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Amounts that stand on more than one line of a text, with their number."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    found = lines.select(key, "line", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\d[\d,]*\.\d{2})(?!\d)"), F.lit(1)))).alias("amount"))
    return found.groupBy(key, "amount").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")


def structure_score(text: Column) -> Column:
    """How much a text looks like a receipt: lines with an amount, totals and dates, JVM-side."""
    return F.regexp_count(text, F.lit(r"\d\.\d{2}(?!\d)")) + 5 * F.regexp_count(F.lower(text), F.lit(r"\btotal\b")) + 3 * F.regexp_count(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"))
