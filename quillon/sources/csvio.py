"""CSV reading: inferred types, an empty text cell as '' and any other empty cell as NULL.

Types are inferred from the first rows alone, so that no pass over the whole input is needed; a later value that doesn't
fit is an error, not a NULL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import BindError

SAMPLE = 1024
_KINDS = [
    (T.BooleanType(), re.compile(r"true|false", re.I)),
    (T.LongType(), re.compile(r"-?\d+")),
    (T.DoubleType(), re.compile(r"-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")),
    (T.DateType(), re.compile(r"\d{4}-\d\d-\d\d")),
]


def infer_type(values: list[str | None]) -> T.DataType:
    """The narrowest type that all values fit; text if there are none."""
    known = [v for v in values if v]
    return next((kind for kind, form in _KINDS if known and all(form.fullmatch(v) for v in known)), T.StringType())


def read_csv(spark: SparkSession, path: str, *, delim: str = ",", header: bool = True, schema: T.StructType | None = None, sample: int = SAMPLE) -> DataFrame:
    """A CSV file or folder; column names in lower case, or column_1, column_2 and so on without a header."""
    if len(delim) != 1 or ord(delim) > 127:
        raise BindError("the delimiter must be one ASCII character")
    reader = spark.read.option("sep", delim).option("header", header).option("mode", "FAILFAST").option("escape", '"')
    if schema is None:
        text = reader.csv(path)
        rows = text.limit(sample).collect()
        names = [c.strip().lower() if header else f"column_{i}" for i, c in enumerate(text.columns, 1)]
        schema = T.StructType([T.StructField(n, infer_type([r[i] for r in rows])) for i, n in enumerate(names)])
    df = reader.schema(schema).csv(path)
    return df.select(*[F.coalesce(df[f.name], F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else df[f.name] for f in schema])
