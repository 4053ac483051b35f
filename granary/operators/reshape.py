"""Wide to long, long to wide, split columns, multi-row headers, transpose."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.missing import paste
from granary.operators.joins import left_join_na
from granary.operators.windows import fill_down


def pivot_longer(
    df: DataFrame, columns: Sequence[str], names_to: str = "name", values_to: str = "value"
) -> DataFrame:
    """Columns to rows; rows with a missing value stay."""
    ids = [c for c in df.columns if c not in set(columns)]
    return df.unpivot(ids, list(columns), names_to, values_to)


def pivot_wider(
    df: DataFrame,
    ids: Sequence[str],
    names: str,
    values: str,
    levels: Sequence,
    agg: Callable[[Column], Column] = F.sum,
    fill=None,
    glue: str = "{name}",
    also: Sequence[Column] = (),
) -> DataFrame:
    """Rows to columns, in the order of ``levels``, with an aggregate and a default.

    ``also`` are further aggregates of the same groups. As the levels are known, each column is an aggregate over its own rows: one
    exchange, partly aggregated before it.
    """
    cells = [agg(F.when(F.col(names) == level, F.col(values))) for level in levels]
    if fill is not None:
        cells = [F.coalesce(c, F.lit(fill)) for c in cells]
    return df.groupBy(*ids).agg(*[c.alias(glue.format(name=v)) for c, v in zip(cells, levels)], *also)


def repeated_cells(df: DataFrame, ids: Sequence[str], names: str) -> DataFrame:
    return df.groupBy(*ids, names).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def pivot_wider_unique(
    df: DataFrame,
    ids: Sequence[str],
    names: str,
    values: str,
    levels: Sequence,
    glue: str = "{name}",
) -> DataFrame:
    """Rows to columns with one value per cell; a repeated cell fails the query.

    Repeats are counted in the same aggregation; ``repeated_cells`` lists them.
    """
    counted = df.groupBy(*ids).agg(
        *[F.max(F.when(F.col(names) == v, F.col(values))).alias(glue.format(name=v)) for v in levels],
        *[F.count_if(F.col(names) == v).alias(f"_n_{v}") for v in levels],
    )

    def checked(v):
        name = glue.format(name=v)
        kind = counted.schema[name].dataType
        failed = F.raise_error(F.lit(f"more than one {values} for {names} = {v} and the same {list(ids)}"))
        return F.when(F.col(f"_n_{v}") <= 1, F.col(name)).otherwise(failed.cast(kind)).alias(name)

    return counted.select(*ids, *[checked(v) for v in levels])


def wrong_part_count(df: DataFrame, column: str, delimiter: str, n: int) -> DataFrame:
    parts = F.split(F.col(column), _quoted(delimiter), -1)
    return df.where(F.col(column).isNotNull() & (F.size(parts) != n))


def split_columns(df: DataFrame, column: str, into: Sequence[str], delimiter: str) -> DataFrame:
    """Split a text into a fixed number of columns; a row of other length fails."""
    parts = F.split(F.col(column), _quoted(delimiter), -1)
    right_size = F.size(parts) == len(into)
    failed = F.raise_error(F.concat(F.lit(f"{column}: not {len(into)} parts: "), F.col(column)))
    checked = F.when(F.col(column).isNull() | right_size, parts).otherwise(
        F.split(failed.cast("string"), ",")
    )
    wide = df.withColumn("_parts", checked)
    return wide.select(
        *[c for c in df.columns if c != column],
        *[F.col("_parts")[i].alias(name) for i, name in enumerate(into)],
    )


def _quoted(delimiter: str) -> str:
    return rf"\Q{delimiter}\E"


def header_table(
    df: DataFrame, ordinal: str, n_header: int, columns: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """The header rows of some columns as a table (position, column, names...).

    All names but the last may stand only in the first column of a run, as merged
    cells do; they are carried to the right.
    """
    cells = pivot_longer(
        df.where(F.col(ordinal) <= n_header).select(ordinal, *columns), columns, "column", "text"
    )
    wide = cells.groupBy("column").agg(
        *[
            F.max(F.when(F.col(ordinal) == i + 1, F.col("text"))).alias(name)
            for i, name in enumerate(names)
        ]
    )
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    return fill_down(wide.withColumn("position", place), [], ["position"], list(names[:-1]))


def tidy_multi_header(
    df: DataFrame,
    ordinal: str,
    n_header: int,
    ids: Sequence[str],
    columns: Sequence[str],
    names: Sequence[str],
    metrics: Sequence[str],
) -> DataFrame:
    """A sheet with several header rows to rows (ids, leading names) x metrics.

    ``names`` name the header rows from the top; the last holds the metric, whose
    expected values are ``metrics``. The header, of one entry a column, is broadcast as
    one row; a row of the sheet becomes its own rows where it lies, with no exchange.
    Two columns of one header fail. Rows of the sheet with the same ids stay apart.
    """
    lead, metric = list(names[:-1]), names[-1]
    header = header_table(df, ordinal, n_header, columns, names)
    cell = F.when(F.col(metric).isNotNull(), F.struct(F.col(metric).alias("metric"), "column"))
    groups = header.groupBy(*lead).agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))
    one = groups.agg(F.collect_list(F.struct(*lead, "cells")).alias("_groups"))
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"`{c}`") for c in columns]))
    body = df.where(F.col(ordinal) > n_header).select(*ids, values.alias("_values"))
    each = body.join(F.broadcast(one)).select(*ids, "_values", F.explode("_groups").alias("_g"))
    found = [F.try_element_at("_values", F.try_element_at("_g.cells", F.lit(m))).alias(m) for m in metrics]
    return each.select(*ids, *[F.col(f"_g.`{c}`").alias(c) for c in lead], *found)


def joined_header(df: DataFrame, names: Sequence[str], sep: str = ",") -> DataFrame:
    return df.withColumn("col_name", paste(*names, sep=sep))


def transpose(df: DataFrame, category: str, categories: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """A report-sized summary with metrics as rows and categories as columns."""
    typed = df.select(F.col(category), *[F.col(m).cast("double").alias(m) for m in metrics])
    long = pivot_longer(typed, metrics, "metric", "value")
    return pivot_wider(long, ["metric"], category, "value", categories, agg=F.max)
