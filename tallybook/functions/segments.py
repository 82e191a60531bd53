"""Customer segment from the three RFM scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER_SEGMENT = "Regular"


def rfm_segment(r: str = "r", f: str = "f", m: str = "m") -> Column:
    """The first rule that holds names the segment."""
    recency, value = F.col(r), F.col(f) + F.col(m)
    # Fixed values.
    return (
        F.when((recency >= 4) & (value >= 8), "Champions")
        .when((recency >= 3) & (value >= 6), "Loyal")
        .when((recency >= 4) & (value <= 5), "New / Promising")
        .when((recency <= 2) & (value >= 7), "At Risk")
        .when((recency <= 2) & (value <= 4), "Lost")
        .otherwise(OTHER_SEGMENT)
    )
