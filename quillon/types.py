"""Logical types, their SQL spellings and the Spark types that hold them.

Unsigned integers are held in the next wider signed type, and their range is checked when rows are written. The logical
name is kept in the column's metadata, for DESCRIBE.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import BindError

KEY = "logical_type"


@dataclass(frozen=True)
class LogicalType:
    name: str
    spark: T.DataType
    most: int | None = None  # of an unsigned type

    def cast(self, value: Column) -> Column:
        """``value`` as this type; a value that doesn't fit is an error when the job runs."""
        if self.most is None:
            return value.cast(self.spark)
        wide = value.cast(T.DecimalType(38, 0))
        fits = wide.isNull() | wide.between(F.lit(0), F.lit(str(self.most)).cast(T.DecimalType(38, 0)))
        return F.when(fits, wide).otherwise(F.raise_error(F.concat(F.lit(f"value out of range for {self.name}: "), wide.cast("string")))).cast(self.spark)

    def field(self, name: str) -> T.StructField:
        return T.StructField(name, self.spark, True, {KEY: self.name})


BOOLEAN, TINYINT, SMALLINT = LogicalType("Boolean", T.BooleanType()), LogicalType("Tinyint", T.ByteType()), LogicalType("Smallint", T.ShortType())
INTEGER, BIGINT = LogicalType("Integer", T.IntegerType()), LogicalType("Bigint", T.LongType())
UTINYINT, USMALLINT = LogicalType("UTinyint", T.ShortType(), (1 << 8) - 1), LogicalType("USmallint", T.IntegerType(), (1 << 16) - 1)
UINTEGER, UBIGINT = LogicalType("UInteger", T.LongType(), (1 << 32) - 1), LogicalType("UBigint", T.DecimalType(20, 0), (1 << 64) - 1)
FLOAT, DOUBLE, VARCHAR, DATE = LogicalType("Float", T.FloatType()), LogicalType("Double", T.DoubleType()), LogicalType("Varchar", T.StringType()), LogicalType("Date", T.DateType())
YEAR_MONTH, DAY_TIME = LogicalType("Interval(YearMonth)", T.YearMonthIntervalType()), LogicalType("Interval(DayTime)", T.DayTimeIntervalType())

_SPELLINGS = {
    "boolean": BOOLEAN, "bool": BOOLEAN, "tinyint": TINYINT, "smallint": SMALLINT, "int": INTEGER, "integer": INTEGER, "bigint": BIGINT,
    "tinyint unsigned": UTINYINT, "smallint unsigned": USMALLINT, "int unsigned": UINTEGER, "integer unsigned": UINTEGER, "bigint unsigned": UBIGINT,
    "float": FLOAT, "real": FLOAT, "double": DOUBLE, "double precision": DOUBLE, "date": DATE, "interval": DAY_TIME,
    "char": VARCHAR, "varchar": VARCHAR, "nvarchar": VARCHAR, "text": VARCHAR, "string": VARCHAR,
}
_BY_SPARK = [(x.spark, x.name) for x in (BOOLEAN, TINYINT, SMALLINT, INTEGER, BIGINT, FLOAT, DOUBLE, VARCHAR, DATE, YEAR_MONTH, DAY_TIME)]


def parse_type(words: list[str]) -> LogicalType:
    """The type that these words spell; a length is left out by the caller."""
    found = _SPELLINGS.get(" ".join(w.lower() for w in words))
    if found is None:
        raise BindError(f"no such type: {' '.join(words)}")
    return found


def logical_name(field: T.StructField) -> str:
    """The name of a column's logical type: stated in its metadata, or else of its Spark type."""
    stated = field.metadata.get(KEY)
    return stated or next((name for kind, name in _BY_SPARK if isinstance(field.dataType, type(kind))), field.dataType.simpleString())


def of_field(field: T.StructField) -> LogicalType:
    """The logical type of an existing column; NULL columns are held as text."""
    name = logical_name(field)
    known = next((x for x in _SPELLINGS.values() if x.name == name), None)
    if known is not None and known.spark == field.dataType:
        return known
    return VARCHAR if isinstance(field.dataType, T.NullType) else LogicalType(name, field.dataType)


def comparable(one: T.DataType, two: T.DataType) -> bool:
    """Whether values of the types compare without a cast between kinds: numbers with numbers, else like with like."""
    if isinstance(one, T.NullType) or isinstance(two, T.NullType):
        return True
    if isinstance(one, T.NumericType) or isinstance(two, T.NumericType):
        return isinstance(one, T.NumericType) and isinstance(two, T.NumericType)
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return isinstance(one, times) and isinstance(two, times) or type(one) is type(two)


_WIDTHS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def is_whole(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0


def wider_whole(one: T.DataType, two: T.DataType) -> T.DataType:
    """The wider of two whole-number types."""
    rank = lambda x: _WIDTHS.index(type(x)) if type(x) in _WIDTHS else len(_WIDTHS) + getattr(x, "precision", 0)
    return max(one, two, key=rank)
