"""Token counts as Spark expressions.  A token is a run of word characters or of other signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the public WordPunct pattern over letters and digits of all scripts.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]+"


def token_count(text: Column) -> Column:
    """Number of tokens; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")
