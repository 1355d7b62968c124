"""Find contact details in free text and mask personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postulant.functions import as_column
from postulant.functions.patterns import ADDRESS_SEARCH, EMAIL_ENDINGS, EMAIL_SEARCH, PHONE_SEARCH, POSTCODE
from postulant.schema import MASKED_ADDRESS, MASKED_EMAIL, MASKED_NAME, MASKED_PHONE


def cut_email_tail(email: Column | str) -> Column:
    """Drop what was glued on behind the last `.com`, `.net` or `.fr` of the domain."""
    endings = "|".join(ending.replace(".", r"\.") for ending in EMAIL_ENDINGS)
    return F.regexp_replace(as_column(email), f"(@[^@]+(?:{endings})).*", "$1")


def first_email(text: Column | str) -> Column:
    """The first address in the text, or null."""
    body = as_column(text)
    found = F.when(body.contains("@"), F.nullif(F.regexp_extract(body, EMAIL_SEARCH, 0), F.lit("")))
    return cut_email_tail(found)


def phone_candidates(text: Column | str) -> Column:
    """Every stretch of digits that looks like a phone number, in text order."""
    return F.regexp_extract_all(as_column(text), F.lit(PHONE_SEARCH), F.lit(0))


def first_phone(text: Column | str) -> Column:
    """The first candidate that does not open like a year (1 or 2), or null."""
    plausible = F.filter(phone_candidates(text), lambda m: ~m.substr(1, 1).isin("1", "2"))
    return F.get(plausible, F.lit(0))


def longest_first(names: Column | str) -> Column:
    return F.array_sort(as_column(names), lambda a, b: F.length(b) - F.length(a))


def mask_names(text: Column | str, names: Column | str) -> Column:
    """Mask every name, longest first, ignoring case and word boundaries.

    The names are applied one after the other because a later name may occur in
    the placeholder an earlier one left behind.
    """

    def literally(name: Column) -> Column:
        quoted = F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
        return F.concat(F.lit(r"(?iu)\Q"), quoted, F.lit(r"\E"))

    return F.aggregate(
        longest_first(names),
        as_column(text),
        lambda masked, name: F.regexp_replace(masked, literally(name), F.lit(MASKED_NAME)),
    )


def mask_emails(text: Column | str) -> Column:
    body = as_column(text)
    return F.when(body.contains("@"), F.regexp_replace(body, EMAIL_SEARCH, MASKED_EMAIL)).otherwise(body)


def mask_phone(text: Column | str, phone: Column | str) -> Column:
    """Mask every occurrence of one phone number, if there is one; other numbers stay."""
    nothing = F.lit("")  # replacing the empty text changes nothing
    return F.replace(as_column(text), F.coalesce(as_column(phone), nothing), F.lit(MASKED_PHONE))


def mask_addresses(text: Column | str) -> Column:
    """Mask postal addresses. Texts without a five-digit number skip the long search."""
    body = as_column(text)
    masked = F.regexp_replace(body, ADDRESS_SEARCH, "$1" + MASKED_ADDRESS)
    return F.when(body.rlike(POSTCODE), masked).otherwise(body)


def redact(df: DataFrame, text: str = "text", names: str = "names", masked: str = "redacted") -> DataFrame:
    """Add `email`, `phone` and the masked text.

    Both contacts are read from the untouched text; then names, addresses, the
    phone number and the postal address are masked in this order. Each step is a
    projection of its own, which keeps Spark from computing a step twice.
    """
    return (
        df.withColumns({"email": first_email(text), "phone": first_phone(text)})
        .withColumn(masked, mask_names(text, names))
        .withColumn(masked, mask_emails(masked))
        .withColumn(masked, mask_phone(masked, "phone"))
        .withColumn(masked, mask_addresses(masked))
    )
