"""Vector cells: one numeric array per frame."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.functions.numbers import finite

# Fixed thresholds: above 360 the values are servo ticks, above 6.3 degrees.
TICK_LIMIT = 360.0
DEGREE_LIMIT = 6.3
TICK_CENTRE = 2048.0


def quoted(name: str) -> Column:
    """Column by literal name; feature names carry dots."""
    return F.col(f"`{name}`")


def field_type(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name == name)


def depth(dtype: T.DataType) -> int:
    return 1 + depth(dtype.elementType) if isinstance(dtype, T.ArrayType) else 0


def is_numeric_cell(dtype: T.DataType) -> bool:
    while isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    return isinstance(dtype, T.NumericType)


def vector(df: DataFrame, name: str) -> Column:
    """One cell as ``array<double>``: scalars wrap, nested arrays flatten."""
    dtype = field_type(df, name)
    cell = quoted(name)
    if not is_numeric_cell(dtype):
        return F.lit(None).cast("array<double>")
    levels = depth(dtype)
    if levels == 0:
        return F.when(cell.isNotNull(), F.array(cell.cast("double")))
    for _ in range(levels - 1):
        cell = F.flatten(cell)
    return cell.cast("array<double>")


def is_usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())


def all_finite(v: Column) -> Column:
    return F.forall(v, finite)


def fit(v: Column, width: Column) -> Column:
    """Pad with zeros or cut so that the vector has ``width`` values."""
    return (
        F.when(F.size(v) < width, F.concat(v, F.array_repeat(F.lit(0.0), (width - F.size(v)).cast("int"))))
        .when(F.size(v) > width, F.slice(v, F.lit(1), width.cast("int")))
        .otherwise(v)
    )


def shape(df: DataFrame, name: str) -> Column:
    """Shape of one cell as text, ``[]`` for a scalar, null when ragged inside."""
    dtype = field_type(df, name)
    cell = quoted(name)
    if not is_numeric_cell(dtype):
        if isinstance(dtype, T.ArrayType):
            return F.concat(F.lit("["), F.size(cell).cast("string"), F.lit("]"))
        return F.lit("null")

    def of(c: Column, dt: T.DataType) -> Column:
        if not isinstance(dt, T.ArrayType):
            return F.lit("")
        if not isinstance(dt.elementType, T.ArrayType):
            return F.concat(F.lit(","), F.size(c).cast("string"))
        inner = F.array_distinct(F.transform(c, lambda x: of(x, dt.elementType)))
        return F.when(
            F.size(inner) == 1, F.concat(F.lit(","), F.size(c).cast("string"), inner[0])
        ).when(F.size(c) == 0, F.lit(",0"))

    text = of(cell, dtype)
    return F.coalesce(F.concat(F.lit("["), F.ltrim(text, F.lit(",")), F.lit("]")), F.lit("null"))


def kind(df: DataFrame, name: str) -> Column:
    """Value kind as text: the element type inside as many ``array<>`` as it has levels."""
    dtype = field_type(df, name)
    label = dtype.simpleString()
    return F.when(quoted(name).isNull(), F.lit("null")).otherwise(F.lit(label))


def to_radians(v: Column) -> Column:
    """Joint values in radians, the unit guessed from the largest magnitude in the frame."""
    peak = F.array_max(F.transform(v, F.abs))
    return (
        F.when(peak > TICK_LIMIT, F.transform(v, lambda x: (x - TICK_CENTRE) / TICK_CENTRE * F.pi()))
        .when(peak > DEGREE_LIMIT, F.transform(v, F.radians))
        .otherwise(v)
    )


def unit(v: Column) -> Column:
    peak = F.array_max(F.transform(v, F.abs))
    return (
        F.when(peak > TICK_LIMIT, F.lit("ticks"))
        .when(peak > DEGREE_LIMIT, F.lit("degrees"))
        .otherwise(F.lit("radians"))
    )
