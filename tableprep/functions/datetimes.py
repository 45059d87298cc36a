"""Datetime detection on text by explicit formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats tried, in order of preference, each with the shape its texts have.
DATETIME_FORMATS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}$"),
    ("yyyy-MM-dd'T'HH:mm:ssXXX", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$"),
    ("yyyy-MM-dd HH:mm", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$"),
    ("yyyy", r"^\d{4}$"),
)
LONGEST = 32  # characters that any of these shapes can have
EARLIEST, LATEST = "1677-09-22", "2262-04-11"


def parse_with(text: Column, position: int) -> Column:
    """The text as a timestamp by one format; null when it has another shape or is out of range."""
    pattern, shape = DATETIME_FORMATS[position]
    trimmed = F.trim(text)
    stamp = F.when(trimmed.rlike(shape), F.try_to_timestamp(trimmed, F.lit(pattern)))
    return F.when(stamp.between(F.lit(EARLIEST).cast("timestamp"), F.lit(LATEST).cast("timestamp")), stamp)
