"""Scalar functions over text, dates and money (operators H), as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(c: Column) -> Column:
    """H1: lower case, runs of other characters than a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def squeeze(c: Column) -> Column:
    """H2: white space runs as one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def redact(c: Column) -> Column:
    """Digits of long identifiers but the last four."""
    return F.regexp_replace(c, r"(?<!\d)\d{4,}(\d{4})(?!\d)", r"****$1")


def money(c: Column) -> Column:
    """H3: the last amount with cents in a text; a minus may stand before or after it."""
    found = F.try_element_at(F.regexp_extract_all(c, F.lit(r"(-?\$?\d[\d,]*\.\d{2}-?)(?!\d)"), 1), F.lit(-1))
    plain = F.regexp_replace(found, r"[$,\-]", "").try_cast("decimal(14,2)")
    return F.when(F.contains(found, F.lit("-")), -plain).otherwise(plain).cast("decimal(14,2)")


def cents(c: Column) -> Column:
    """H4: the amount if the text is a finite number with at most two decimals."""
    exact = c.try_cast("decimal(38,10)")
    return F.when(exact == F.round(exact, 2), exact).cast("decimal(14,2)")


def ngrams(c: Column, n: int) -> Column:
    """H6: runs of ``n`` words."""
    words = F.split(c, " ")
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


#: Date formats in the order in which they are tried.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd")


def any_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """H9: the first format that reads the text; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in formats])


def receipt_date(known_unknown: Column, printed: Column, path: Column) -> Column:
    """Null where the date is known to be unknown, else the printed date, else the path's month."""
    month = F.regexp_extract(path, r"(\d{4}-\d{2})/", 1)
    return F.when(known_unknown, F.lit(None)).when(printed.isNotNull(), printed).otherwise(F.concat(month, F.lit("-01")).try_cast("date"))


def fingerprint(**parts: Column) -> Column:
    """sha256 of canonical JSON: keys in text order, no spaces, nulls kept, non-ASCII as escapes left out."""
    fields = F.struct(*[parts[k].alias(k) for k in sorted(parts)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}).cast("binary"), 256)


def retailer_domain(merchant: Column, domains: dict[str, str]) -> Column:
    """The domain of the first name that the merchant contains."""
    out = F.lit(None).cast("string")
    for name, domain in reversed(list(domains.items())):
        out = F.when(F.contains(F.lower(merchant), F.lit(name)), domain).otherwise(out)
    return out


def confidence(fields: Sequence[tuple[Column, str]]) -> Column:
    """The weights of the fields that are there."""
    return sum((F.when(c.isNotNull(), F.lit(w).cast("decimal(5,4)")).otherwise(F.lit("0").cast("decimal(5,4)")) for c, w in fields), F.lit("0").cast("decimal(5,4)"))


def file_extension(path: Column) -> Column:
    """What follows the last dot of a file's name, in lower case."""
    found = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.when(found == "", "(none)").otherwise(F.lower(found))


def filename_metadata(path: Column) -> Column:
    """Date, merchant and total of a name like date_merchant_dollars_cents; all null unless it is one with a real date."""
    pattern = r"(?:^|/)(\d{8})[_-]([^/]+)[_-](\d+)[_-](\d{2})(?:\.[^./]*)?$"
    part = lambda i: F.regexp_extract(path, pattern, i)
    date = F.try_to_timestamp(F.nullif(part(1), F.lit("")), F.lit("yyyyMMdd")).cast("date")
    known = date.isNotNull()
    merchant = F.when(known, squeeze(F.translate(part(2), "_-", "  ")))
    return F.struct(date.alias("date"), merchant.alias("merchant"), F.when(known, F.concat(part(3), F.lit("."), part(4)).try_cast("decimal(14,2)")).alias("total"))


def valid_month(c: Column) -> Column:
    """Yyyy-mm with a month from 01 to 12."""
    return F.coalesce(c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.lit(False))


def has_text(c: Column) -> Column:
    """Anything but white space."""
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def product_label(title: Column, url: Column, retailers: dict[str, str]) -> Column:
    """A page title without leading shopping words, and without the retailer's own name after the last bar.

    retailers: name (lower case) to domain; a name counts only on pages of its domain. A suffix
    that is the page's host counts, too.
    """
    plain = F.trim(F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"(?i)^((buy|shop|purchase|order)(\s+now)?\s+)+", ""))
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    head, suffix = F.regexp_extract(plain, r"^(?s)(.*)\|([^|]*)$", 1), F.regexp_extract(plain, r"^(?s)(.*)\|([^|]*)$", 2)
    name = F.regexp_replace(normalize(suffix), r"\s+(inc|ltd|limited|incorporated|corporation|corp)$", "")
    own = (F.lower(F.trim(suffix)) == F.regexp_replace(host, r"^www\.", "")) & (host != "")
    for retailer, domain in retailers.items():
        own = own | ((name == retailer) & ((host == domain) | F.endswith(host, F.lit("." + domain))))
    return F.when(F.contains(plain, F.lit("|")) & own, F.trim(head)).otherwise(plain)
