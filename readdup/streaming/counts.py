"""Read counts of each library while reads arrive.

Duplicate sets need all reads of a place, so marking is a batch plan; what can be told of a stream is what a read tells
by itself: its class and whether it was marked before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flags import DUPLICATE, has
from ..operators.ends import with_library
from ..operators.metrics import raw_counts


def library_counts(reads: DataFrame, read_groups: DataFrame) -> DataFrame:
    """The raw counts of each library of a stream (or a table) of reads, whose duplicate bits are taken as they are.

    The state is a row a library, so any output mode but append does without a watermark.
    """
    return raw_counts(with_library(reads, read_groups).withColumn("is_duplicate", F.coalesce(has(DUPLICATE), F.lit(False))))
