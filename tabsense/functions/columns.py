"""Column classes and entrance normalisation (schema only, no jobs).

A column is *numeric* when its Spark type is a NumericType (integers,
floats, decimals; never boolean), *categorical* when it is a string, and
*neither* otherwise (boolean, date, timestamp, nested).  Neither-columns are
counted for shape, missing cells and duplicates but skipped by statistics.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that look like a saved pandas index (fixed values).
INDEX_LIKE_NAMES = ("index", "Unnamed: 0", "level_0")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def column_class(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "categorical"
    return "other"


def column_classes(df: DataFrame) -> DataFrame:
    """B1: one row per column: (position, column_name, data_type, column_class)."""
    rows = [(i, f.name, f.dataType.simpleString(), column_class(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    schema = "position int, column_name string, data_type string, column_class string"
    return df.sparkSession.createDataFrame(rows, schema)


def q(name: str) -> Column:
    """Column reference that tolerates any character in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def normalize_nan(df: DataFrame) -> DataFrame:
    """Float NaN becomes NULL at the entrance (pandas treats both as missing;
    Spark's avg/max would propagate NaN and count would count it)."""
    exprs = []
    changed = False
    for f in df.schema.fields:
        if is_floating(f.dataType):
            exprs.append(F.when(F.isnan(q(f.name)), F.lit(None).cast(f.dataType))
                         .otherwise(q(f.name)).alias(f.name))
            changed = True
        else:
            exprs.append(q(f.name))
    return df.select(*exprs) if changed else df


def nan_as_missing(operator):
    """Operator whose first argument, a DataFrame, has NaN cells read as missing (a no-op without float columns)."""
    @wraps(operator)
    def entered(df, *args, **kwargs):
        if not getattr(df, "_nan_free", False):
            df = normalize_nan(df)
            df._nan_free = True
        return operator(df, *args, **kwargs)
    return entered


def as_double(name: str) -> Column:
    return q(name).cast("double")


def unpivot_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long form ``(position, x)``: one row per input row and column, the value
    cast to double, NULL cells kept.

    Per-column statistics group this by ``position`` instead of running one
    very wide ``agg``: a wide aggregate over more than
    ``spark.sql.codegen.maxFields`` (100) buffer fields loses whole-stage
    code generation, while the grouped form keeps a small buffer per key at
    any table width.  Partial aggregation leaves each map task with one row
    per column, so the shuffle stays tiny whatever the row count."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), q(c).cast("double").alias("x"))
        for i, c in enumerate(cols)])))


def name_of(position: Column, cols: list[str]) -> Column:
    """Column name for a 0-based position, from a literal array of names."""
    return F.element_at(F.array(*[F.lit(c) for c in cols]), position + 1)


def pick(values: list[float], position: Column) -> Column:
    """Per-column constant (e.g. a bound) for a 0-based column position, from
    a literal array: lets one grouped aggregate use different constants per
    column of an unpivot."""
    return F.element_at(F.array(*[F.lit(None if v is None else float(v)).cast("double") for v in values]),
                        position + 1)
