"""Schema contracts, schema deltas and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.scalars import sorted_json

# The contract modes and the number of updates a report shows.
EVOLVE, FREEZE, DISCARD_ROW = "evolve", "freeze", "discard_row"
MODES = (EVOLVE, FREEZE, DISCARD_ROW)
REPORT_ROWS = 20

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class ContractViolation(ValueError):
    """A frozen table met an unknown column or another type."""


def new_columns(target: T.StructType, incoming: T.StructType) -> list[str]:
    """Columns of the batch that the target does not have yet."""
    known = set(target.fieldNames())
    return sorted(name for name in incoming.fieldNames() if name not in known)


def schema_new_columns(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """The same for a whole fleet: rows ``(table_name, column_name)`` that are new."""
    return incoming.join(target, ["table_name", "column_name"], "left_anti")


def _as_decimal(dtype: T.DataType) -> T.DecimalType | None:
    """The decimal that holds every value of an exact number type, integers like a bigint: they
    often widen further."""
    if isinstance(dtype, T.DecimalType):
        return dtype
    return T.DecimalType(19, 0) if isinstance(dtype, _INTEGERS) else None


def _exact_in_double(dtype: T.DataType) -> bool:
    """Whether every value of a number type has a double of its own: up to 2**53."""
    if isinstance(dtype, T.DecimalType):
        return dtype.scale == 0 and dtype.precision <= 15
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType))


def common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """The narrowest type in which no value of either loses anything; text where there is none.

    - Whole numbers widen, beside decimals to a decimal of enough digits (38 at most).
    - Floating point takes in what a double holds exactly: integers up to 32 bits and decimals of
      up to 15 digits without fraction. A bigint or a decimal fraction beside it becomes text.
    - Dates and zoneless timestamps are instants in UTC here, so dates widen to the timestamp
      beside them, and a zoneless timestamp to one with a zone.
    - Structs are joined field by field (new fields behind the known ones), arrays and maps by
      element, key and value. A struct, array or map beside anything else becomes JSON text.
    """
    if left == right:
        return left
    if isinstance(left, T.NullType) or isinstance(right, T.NullType):
        return left if isinstance(right, T.NullType) else right
    if isinstance(left, T.StructType) and isinstance(right, T.StructType):
        return evolved_schema(left, right)
    if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType):
        return T.ArrayType(common_type(left.elementType, right.elementType))
    if isinstance(left, T.MapType) and isinstance(right, T.MapType):
        return T.MapType(common_type(left.keyType, right.keyType), common_type(left.valueType, right.valueType))
    if isinstance(left, _INTEGERS) and isinstance(right, _INTEGERS):
        return max(left, right, key=lambda t: _INTEGERS.index(type(t)))
    if _exact_in_double(left) and _exact_in_double(right):
        if {type(left), type(right)} & {T.FloatType, T.DoubleType}:
            return T.DoubleType()
    one, two = _as_decimal(left), _as_decimal(right)
    if one and two:
        scale = max(one.scale, two.scale)
        digits = max(one.precision - one.scale, two.precision - two.scale) + scale
        return T.DecimalType(digits, scale) if digits <= 38 else T.StringType()
    times = [T.DateType, T.TimestampNTZType, T.TimestampType]
    if type(left) in times and type(right) in times:
        return times[max(times.index(type(left)), times.index(type(right)))]()
    return T.StringType()


def converted(value: Column, old: T.DataType, new: T.DataType) -> Column:
    """A value of ``old`` as the ``new`` type that `common_type` chose for it."""
    if old == new:
        return value
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        fields = [
            (converted(value.getField(f.name), old[f.name].dataType, f.dataType)
             if f.name in old.fieldNames() else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in new
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return F.transform(value, lambda v: converted(v, old.elementType, new.elementType))
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        keyed = F.transform_keys(value, lambda k, v: converted(k, old.keyType, new.keyType))
        return F.transform_values(keyed, lambda k, v: converted(v, old.valueType, new.valueType))
    if isinstance(new, T.StringType) and isinstance(old, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value.cast(new)


def evolved_schema(target: T.StructType, incoming: T.StructType) -> T.StructType:
    """The target's columns in their order, widened where needed, then the new ones."""
    fields = []
    for field in target:
        dtype = field.dataType
        if field.name in incoming.fieldNames():
            dtype = common_type(dtype, incoming[field.name].dataType)
        fields.append(T.StructField(field.name, dtype))
    known = set(target.fieldNames())
    fields += [T.StructField(f.name, f.dataType) for f in incoming if f.name not in known]
    return T.StructType(fields)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly these columns and types; absent columns are NULL."""
    return df.select(
        *[
            (converted(F.col(f"`{f.name}`"), df.schema[f.name].dataType, f.dataType) if f.name in df.columns
             else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def contract_evolve(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Old and new rows under the evolved schema."""
    schema = evolved_schema(target.schema, incoming.schema)
    return conform(target, schema).unionByName(conform(incoming, schema))


def contract_freeze(target: T.StructType, incoming: DataFrame) -> DataFrame:
    """The batch in the target's shape, or an error before any job starts."""
    unknown = new_columns(target, incoming.schema)
    changed = [
        f"{f.name} {f.dataType.simpleString()} -> {incoming.schema[f.name].dataType.simpleString()}"
        for f in target
        if f.name in incoming.columns
        and common_type(f.dataType, incoming.schema[f.name].dataType) != f.dataType
    ]
    if unknown or changed:
        raise ContractViolation(f"frozen schema: new columns {unknown}, changed types {changed}")
    return conform(incoming, target)


def violates(target: T.StructType, incoming: DataFrame) -> Column:
    """True for rows with a value in an unknown column or one that the known type cannot hold."""
    broken = F.lit(False)
    for name in new_columns(target, incoming.schema):
        broken = broken | F.col(name).isNotNull()
    for field in target:
        if field.name in incoming.columns and incoming.schema[field.name].dataType != field.dataType:
            value = F.col(field.name)
            held = value.try_cast(field.dataType)
            broken = broken | (value.isNotNull() & held.isNull())
            kind = incoming.schema[field.name].dataType
            if not isinstance(kind, T.StringType) and isinstance(kind, T.AtomicType):
                # a number or time that does not come back as it was has lost something
                broken = broken | ~held.try_cast(kind).eqNullSafe(value)
    return broken


def contract_discard_row(target: T.StructType, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows in the target's shape, and the rejected ones as they came."""
    broken = violates(target, incoming)
    accepted = incoming.filter(~broken).select(
        *[
            (F.col(f.name) if f.name in incoming.columns else F.lit(None))
            .try_cast(f.dataType).alias(f.name)
            for f in target
        ]
    )
    return accepted, incoming.filter(broken)


def schema_update_dedup(updates: DataFrame) -> DataFrame:
    """One row per distinct delta. ``updates(pipeline, step_no, step, table_name,
    new_columns)``: the same columns of a table count once per pipeline, whichever step
    reported them, and the first step is kept."""
    return (
        updates.withColumn("new_columns", F.array_sort("new_columns"))
        .groupBy("pipeline", "table_name", "new_columns")
        .agg(F.min("step_no").alias("step_no"), F.min_by("step", "step_no").alias("step"))
    )


def schema_update_report(updates: DataFrame, shown: int = REPORT_ROWS) -> DataFrame:
    """Per pipeline: the first updates as JSON lines, and how many more there were.

    The row-number filter keeps at most ``shown`` rows per pipeline and map task, so the
    lists that are built stay that short.
    """
    order = Window.partitionBy("pipeline").orderBy("step_no", "table_name", "line")
    line = sorted_json(
        {
            "step": (F.col("step"), T.StringType()),
            "table": (F.col("table_name"), T.StringType()),
            "new_columns": (F.col("new_columns"), T.ArrayType(T.StringType())),
        }
    )
    first = (
        updates.select("pipeline", "step_no", "table_name", line.alias("line"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= shown)
        .groupBy("pipeline")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("top"))
    )
    totals = updates.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n_updates"))
    lines = F.array_join(F.transform("top", lambda t: t["line"]), "\n")
    more = F.col("n_updates") - shown
    overflow = F.concat(F.lit("\n… (+"), more.cast("string"), F.lit(" more)"))
    return first.join(totals, "pipeline").select(
        "pipeline", "n_updates",
        F.when(more > 0, F.concat(lines, overflow)).otherwise(lines).alias("summary"),
    )
