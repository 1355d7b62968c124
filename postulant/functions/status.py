"""Status codes and their labels, as map literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postulant.functions import as_column
from postulant.schema import STATUS_LABELS


def status_label(code: Column | str) -> Column:
    """Label of a code; null for an unknown code."""
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return labels[as_column(code)]


def status_code(label: Column | str) -> Column:
    """Code of a label; null for an unknown label."""
    codes = F.create_map(*[F.lit(x) for code, name in STATUS_LABELS.items() for x in (name, code)])
    return codes[as_column(label)]
