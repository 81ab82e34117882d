"""CSV files of prompts, responses and reports.

Quotes inside a field are doubled and fields may span lines. Spark reads such a file in one
task, so writes are bounded by `rows_per_file` to keep every file, and the task that reads
it back, small. Large files of others are read in byte ranges (`split_csv`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from caseflow.sources.split_csv import read_by_header

_DIALECT = {
    "header": True,
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
POSITION = "position"
_INDEX = "_index"


def write_result_csv(
    df: DataFrame,
    path: str,
    quote_all: bool = True,
    rows_per_file: int = 100_000,
    index: str | None = None,
) -> str:
    """Overwrite a CSV dataset; array columns are written as JSON text.

    The column `index`, if named, is written first and without a name, as
    `read_result_csv(row_index=True)` reads it.
    """
    if index is not None:
        others = [c for c in df.columns if c != index]
        df = df.select(F.col(index).alias(""), *others)
    columns = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    (
        df.select(*columns)
        .write.mode("overwrite")
        .options(**_DIALECT)
        .option("quoteAll", quote_all)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )
    return path


def read_result_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    row_index: bool = False,
    keep_position: bool = False,
    split: bool = False,
) -> DataFrame:
    """Read the columns of `schema` from a result CSV, by the names in its header.

    Their order in the file does not matter and other columns are ignored. A missing name
    raises at once, a value that is not of its column's type when it is read. An empty
    field is NULL, quoted or not; no other text is.

    With `split` a file is read by many tasks, and each file by its own header; so it is with
    `row_index`, where the files lead with an unnamed row number, which is dropped unless
    `keep_position` asks for it as the column `position`. Otherwise one task reads a file,
    and a file whose header is not that of the others is an error.
    """
    wanted = list(schema.fields)
    if keep_position and not row_index:
        raise ValueError("keep_position needs row_index")
    if split or row_index:
        # Spark cannot compare headers that have a column without a name.
        first = _INDEX if keep_position else None
        raw = read_by_header(spark, path, _DIALECT, [f.name for f in wanted], first)
        place = [_typed(_INDEX, StructField(POSITION, LongType()))] if keep_position else []
        return raw.select(*place, *[_typed(f.name, f) for f in wanted])
    raw = spark.read.options(**_DIALECT, enforceSchema=False).csv(path, multiLine=True)
    missing = [f.name for f in wanted if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}; found {raw.columns}")
    return raw.select(*[_typed(f.name, f) for f in wanted])


def _typed(name: str, field: StructField) -> Column:
    """The text of a column as its type; a value that is none is an error."""
    text = F.col(f"`{name}`")
    if isinstance(field.dataType, StringType):
        return text.alias(field.name)
    value = text.try_cast(field.dataType)
    problem = F.raise_error(F.concat(F.lit(f"{field.name}: not {field.dataType.simpleString()}: "), text))
    bad = text.isNotNull() & value.isNull()
    return F.when(bad, problem.cast(field.dataType)).otherwise(value).alias(field.name)
