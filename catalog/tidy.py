"""Output hygiene shared by all queries: plain column types that compare across engines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def tidy(df: DataFrame, columns: str | None = None) -> DataFrame:
    """Integers as BIGINT, reals rounded to 6 decimals without negative zero."""
    keep = columns.split() if columns else df.columns
    out = []
    for name in keep:
        kind = df.schema[name].dataType
        col = F.col(f"`{name}`")
        if isinstance(kind, WHOLE):
            col = col.cast("long")
        elif isinstance(kind, REAL):
            col = F.round(col.cast("double"), 6) + F.lit(0.0)
        out.append(col.alias(name))
    return df.select(*out)


def spread_array(df: DataFrame, array: str, names: list[str]) -> DataFrame:
    """Array elements as columns."""
    return df.select(*[c for c in df.columns if c != array], *[F.get(F.col(array), F.lit(n)).alias(c) for n, c in enumerate(names)])
