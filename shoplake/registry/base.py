"""Query registry: each entry pairs a Spark callable with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Plain result types on both engines: bigint, double and string."""
    columns = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType | T.FloatType):
            col = col.cast("double")
        elif isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.BooleanType):
            col = col.cast("bigint")
        elif isinstance(kind, T.DateType):
            col = col.cast("string")
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        columns.append(col.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, *, num: Sequence[str] | str = (), day: Sequence[str] | str = (),
          ts: Sequence[str] | str = (), whole: Sequence[str] | str = ()):
    """Register a query. The lists name columns of `sql` to present as double, date
    text, timestamp text and bigint."""
    def listed(x) -> list[str]:
        return x.split() if isinstance(x, str) else list(x)

    def register(make: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, sf: present(make(spark, sf))
        if sql is not None:
            shown = ([f"CAST({c} AS DOUBLE) AS {c}" for c in listed(num)]
                     + [f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in listed(day)]
                     + [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in listed(ts)]
                     + [f"CAST({c} AS BIGINT) AS {c}" for c in listed(whole)])
            CHECKS[name] = (f"SELECT * REPLACE ({', '.join(shown)}) FROM ({sql.strip()}) AS _result"
                            if shown else sql.strip())
        return make
    return register
