"""Recognise and deliver stored resume files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postulant.functions import as_column
from postulant.schema import MIME_TYPES, NO_FILE_MARK, SIGNATURES, UNKNOWN_MIME, UNKNOWN_TYPE


def file_type(content: Column | str) -> Column:
    """File type by its leading bytes."""
    head = F.hex(F.substring(as_column(content), 1, 4))
    chain = F.when(F.lit(False), UNKNOWN_TYPE)
    for signature, kind in SIGNATURES.items():
        chain = chain.when(head == signature, kind)
    return chain.otherwise(UNKNOWN_TYPE)


def mime_type(kind: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(known[as_column(kind)], F.lit(UNKNOWN_MIME))


def data_link(content: Column | str) -> Column:
    """The file as a data URI, or a cross mark if there is none."""
    data = as_column(content)
    # base64 may wrap its lines; a URI must not.
    encoded = F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))
    uri = F.concat(F.lit("data:"), mime_type(file_type(data)), F.lit(";base64,"), encoded)
    return F.coalesce(uri, F.lit(NO_FILE_MARK))


def download_name(content: Column | str, name: Column | str | None = None) -> Column:
    """`<name>.<type>`, or null if there is no file."""
    data = as_column(content)
    stem = F.lit("cv") if name is None else as_column(name)
    return F.when(data.isNotNull(), F.concat(stem, F.lit("."), file_type(data)))
