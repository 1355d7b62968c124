"""Choose the resume among a mail's attachments and read its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postulant.functions import as_column
from postulant.functions.text import clean_docx_text, clean_pdf_text
from postulant.schema import ATTACHMENT, RESUME_EXTENSIONS


def file_extension(name: Column | str) -> Column:
    """From the last dot of the base name; leading dots do not start an extension."""
    return F.regexp_extract(as_column(name), r"[^./][^/]*(\.[^./]*)\z", 1)


def first_attachment(df: DataFrame, attachments: str = "attachments") -> DataFrame:
    """Add the fields of the first attachment: `file_name`, `file_pages` and so on.

    No other attachment is ever tried. As the lowest projection this lets the scan
    read only those fields that are used later, above all not the file bytes.
    """
    fields = {f"file_{f.name}": F.get(F.col(attachments).getField(f.name), F.lit(0)) for f in ATTACHMENT.fields}
    return df.withColumns(fields)


def resume_type(name: Column | str) -> Column:
    """Extension of a resume file, null for any other file."""
    extension = file_extension(name)
    return F.when(extension.isin(*RESUME_EXTENSIONS), extension)


def join_pages(pages: Column | str, fallback: Column | str | bool = False) -> Column:
    """Page texts without a separator, or blank-separated where the fallback reader made them."""
    if isinstance(fallback, bool):
        fallback = F.lit(fallback)
    texts = as_column(pages)
    return F.when(as_column(fallback), F.array_join(texts, " ", "")).otherwise(F.array_join(texts, "", ""))


def join_parts(tables: Column | str, paragraphs: Column | str) -> Column:
    """Table rows (cells joined by tabs), then paragraphs, one per line."""
    none = F.array().cast("array<string>")
    rows = F.transform(F.flatten(as_column(tables)), lambda cells: F.array_join(cells, "\t"))
    parts = F.concat(F.coalesce(rows, none), F.coalesce(as_column(paragraphs), none))
    return F.array_join(parts, "\n")


def resume_text(
    kind: Column | str,
    pages: Column | str,
    tables: Column | str,
    paragraphs: Column | str,
    fallback: Column | str | bool = False,
) -> Column:
    """The cleaned text of a resume of the given type; null if there is none."""
    extension = as_column(kind)
    from_pages = F.coalesce(join_pages(pages, fallback), F.lit(""))
    return F.when(extension == ".pdf", clean_pdf_text(from_pages)).when(
        extension == ".docx", clean_docx_text(join_parts(tables, paragraphs))
    )
