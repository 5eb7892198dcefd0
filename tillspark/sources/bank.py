"""Bank exports and exchange rates (A5-A9, A17), with the line number of every row.

An export is read whole, as its line numbers are part of a row's origin, and parsed on the
executors, one task for many files. Nothing is imported unless every row of every file is good.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import any_date, redact

ROW = "reference string, line int, posted date, description string, amount decimal(14,2), card_last4 string, error string"
_AMOUNT = re.compile(r"^-?\$?\d[\d,]*(?:\.\d{1,2})?$")
_LONG_ID = re.compile(r"(?<!\d)\d{4,}(\d{4})(?!\d)")


@dataclass(frozen=True)
class Layout:
    """Where a bank puts what. ``debit`` and ``credit`` are columns of which exactly one is set;
    ``amount`` is a signed column, ``sign`` turns it so that money spent is positive."""

    date: int
    description: int
    date_format: str = "%Y-%m-%d"
    header: bool = False
    debit: int | None = None
    credit: int | None = None
    amount: int | None = None
    sign: int = 1
    card: int | None = None
    columns: tuple[int, ...] = ()


CARD = Layout(date=0, description=1, debit=2, credit=3, card=4, columns=(4, 5))
HEADERED_DEPOSIT = Layout(date=1, description=2, date_format="%b %d, %Y", header=True, amount=3, sign=-1, columns=(5,))
SHORT_DEPOSIT = Layout(date=0, description=2, amount=3, sign=-1, columns=(4,))


def money(text: str) -> Decimal:
    text = text.strip()
    if not _AMOUNT.match(text):
        raise ValueError(f"not an amount: {text!r}")
    try:
        return Decimal(text.replace("$", "").replace(",", "")).quantize(Decimal("0.01"))
    except InvalidOperation as e:
        raise ValueError(f"not an amount: {text!r}") from e


def parse(text: str, layout: Layout) -> Iterator[tuple]:
    """(line, posted, description, amount, last4, error) for each row of one export."""
    reader = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), strict=True)
    try:
        for number, row in enumerate(reader):
            if not row or (layout.header and number == 0):
                continue
            try:
                if layout.columns and len(row) not in layout.columns:
                    raise ValueError(f"{len(row)} columns")
                if layout.amount is not None:
                    amount = layout.sign * money(row[layout.amount])
                else:
                    debit, credit = row[layout.debit].strip(), row[layout.credit].strip()
                    if bool(debit) == bool(credit):
                        raise ValueError("exactly one of debit and credit must be set")
                    amount = money(debit) if debit else -money(credit)
                posted = datetime.strptime(row[layout.date].strip(), layout.date_format).date()
                card = re.sub(r"\D", "", row[layout.card])[-4:] if layout.card is not None and len(row) > layout.card else None
                yield reader.line_num, posted, _LONG_ID.sub(r"****\1", row[layout.description].strip()), amount, card or None, None
            except (ValueError, IndexError) as e:
                yield reader.line_num, None, None, None, None, str(e)
    except csv.Error as e:
        yield reader.line_num, None, None, None, None, str(e)


def read_exports(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """Rows of all exports under ``path``; bad ones say why in ``error``."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("reference"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text, reference in zip(pdf["value"], pdf["reference"], strict=True):
                found = [(reference, *row) for row in parse(text, layout)]
                yield pd.DataFrame(found, columns=[c.split()[0] for c in ROW.split(", ")])

    return files.mapInPandas(rows, ROW)


def read_by_fields(spark: SparkSession, path: str, fields: dict[str, str], sign: int = 1, currency: str = "CAD") -> DataFrame:
    """A5: rows of headered exports by a map from our names (date, description, amount or debit and
    credit, card) to theirs; ``sign`` turns amounts so that money spent is positive. Bad rows say why."""
    raw = spark.read.option("header", "true").option("recursiveFileLookup", "true").csv(path)
    if missing := sorted(set(fields.values()) - set(raw.columns)):
        raise ValueError(f"columns are missing: {missing}")
    value = lambda name: F.trim(F.col(f"`{fields[name]}`")) if name in fields else F.lit(None).cast("string")
    number = lambda c: F.when(c.rlike(_AMOUNT.pattern), F.regexp_replace(c, r"[$,]", "").try_cast("decimal(14,2)"))
    debit, credit = number(value("debit")), number(value("credit"))
    amount = F.lit(sign) * number(value("amount")) if "amount" in fields else F.when(debit.isNotNull() != credit.isNotNull(), F.coalesce(debit, -credit))
    posted = any_date(value("date"))
    error = F.when(posted.isNull(), "date").when(amount.isNull(), "amount").when(F.coalesce(value("description"), F.lit("")) == "", "description")
    return raw.select(
        F.col("_metadata.file_path").alias("reference"), posted.alias("posted"), redact(value("description")).alias("description"), amount.cast("decimal(14,2)").alias("amount"),
        F.lit(currency).alias("currency"), F.nullif(F.right(F.regexp_replace(value("card"), r"\D", ""), F.lit(4)), F.lit("")).alias("card_last4"), error.alias("error"),
    )


def with_fingerprints(rows: DataFrame, account: str) -> DataFrame:
    """Equal rows of an export get ordinals, so overlapping exports agree on identities."""
    same = ["posted", "description", "amount", "card_last4"]
    n = F.row_number().over(Window.partitionBy("reference", *same).orderBy("line"))
    rows = rows.withColumn("occurrence", n)
    parts = F.to_json(F.array(F.lit(account), F.col("posted").cast("string"), F.lower("description"), F.col("amount").cast("string"), F.coalesce("card_last4", F.lit("")), F.col("occurrence").cast("string")))
    return rows.withColumn("fingerprint", F.sha2(parts.cast("binary"), 256))


def import_rows(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """L2: rows whose fingerprint is new, once each; refuses everything if any row is bad."""
    bad = rows.where("error is not null").select("reference", "line", "error").take(5)
    if bad:
        raise ValueError(f"bad rows, nothing imported: {[tuple(b) for b in bad]}")
    new = rows.drop("error").join(existing.select("fingerprint"), "fingerprint", "left_anti")
    return new.groupBy("fingerprint").agg(F.min_by(F.struct(*[c for c in new.columns if c != "fingerprint"]), F.struct("reference", "line")).alias("r")).select("fingerprint", "r.*")


def archive_account(path: str = "reference") -> Column:
    """Institution, product, last four digits and year that an archive path names."""
    pattern = r"([^/]+)/([^/]+)/x(\d{4})(?:/(\d{4}))?/[^/]+$"
    part = lambda i: F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))
    return F.struct(part(1).alias("institution"), part(2).alias("product"), part(3).alias("last4"), part(4).alias("year"))


def exchange_rates(documents: DataFrame, json: str = "json", series: str = "FXUSDCAD") -> DataFrame:
    """Daily rates of published JSON: empty ones are skipped, only 0 < rate < 1000 counts,
    and a day with two different rates has none."""
    schema = f"observations array<struct<d: string, {series}: struct<v: string>>>"
    seen = documents.select(F.explode(F.from_json(json, schema)["observations"]).alias("o"))
    rate = F.col(f"o.{series}.v").try_cast("decimal(18,10)")
    rows = seen.select(F.col("o.d").try_cast("date").alias("rate_date"), rate.alias("rate")).where("rate_date is not null and rate > 0 and rate < 1000")
    return rows.groupBy("rate_date").agg(F.min("rate").alias("rate"), F.max("rate").alias("hi")).where("rate = hi").drop("hi")
