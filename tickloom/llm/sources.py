"""One spelling for a document's source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_name(column: str = "source") -> Column:
    """Lower case, hyphens as underscores, no blanks around; NULL and blank are NULL."""
    name = F.lower(F.translate(F.trim(column), "-", "_"))
    return F.when(name != "", name)
