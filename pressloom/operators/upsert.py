"""Tag edits as table operations keyed by article."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def set_columns(base: DataFrame, updates: DataFrame, columns: Mapping[str, str] | list[str],
                key: str = "goid", modify: bool = True) -> DataFrame:
    """Add or update columns from ``updates``; no row is ever lost and none is multiplied.

    ``columns`` maps update column -> base column. With ``modify`` a new value wins over an old one,
    without it an old value stays; a null never replaces a value. Of updates that repeat a key the greatest value per
    column counts. Rows are joined as they are: where texts should stay in place, ``sources.enrichment`` keeps the
    values as a table of their own.
    """
    names = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    new = updates.groupBy(key).agg(*[F.max(src).alias(f"_new_{dst}") for src, dst in names.items()])
    out = base.join(new, key, "left")
    for dst in names.values():
        old = F.col(dst) if dst in base.columns else F.lit(None).cast(new.schema[f"_new_{dst}"].dataType)
        fresh = F.col(f"_new_{dst}")
        out = out.withColumn(dst, F.coalesce(fresh, old) if modify else F.coalesce(old, fresh))
    return out.drop(*[f"_new_{dst}" for dst in names.values()])


def delete_tag(tags: Column, name: str) -> Column:
    """A tag map without one tag."""
    return F.map_filter(tags, lambda k, _: k != name)


def table_to_records(records: DataFrame, table: DataFrame, columns: Mapping[str, str],
                     names: DataFrame, key: str = "goid") -> tuple[DataFrame, DataFrame]:
    """Write table values, rounded to 4 digits, into the records named in ``names``.

    Returns the records and the names updated. A key on several table rows counts once, with its
    greatest values, since a table has no order that would make one row the last.
    """
    values = [F.round(F.col(src).try_cast("double"), 4).alias(dst) for src, dst in columns.items()]
    rows = (
        table.filter(F.col(key).isNotNull())
        .withColumn(key, F.col(key).cast("string"))
        .withColumn("name", F.concat(F.col(key), F.lit(".xml")))
        .join(names.select("name").distinct(), "name", "left_semi")
        .groupBy(key, "name").agg(F.max(F.struct(*values)).alias("_v")).select(key, "name", "_v.*")
    )
    return set_columns(records, rows, list(columns.values()), key, modify=True), rows.select("name")


def records_to_table(table: DataFrame, records: DataFrame, tags: list[str], key: str = "goid") -> DataFrame:
    """Refresh table columns from records; a matched row takes the record's value even when null, of records that repeat
    a key the greatest."""
    fresh = records.groupBy(F.col(key).cast("string").alias("_key")).agg(
        F.lit(True).alias("_hit"), *[F.max(t).alias(f"_new_{t}") for t in tags])
    out = table.join(fresh, F.col(key).cast("string") == F.col("_key"), "left")
    for tag in tags:
        old = F.col(tag) if tag in table.columns else F.lit(None)
        out = out.withColumn(tag, F.when(F.col("_hit"), F.col(f"_new_{tag}")).otherwise(old))
    return out.drop("_key", "_hit", *[f"_new_{t}" for t in tags])


def rescore_missing(df: DataFrame, column: str, score: Column) -> DataFrame:
    """Compute a score only where it is missing or zero."""
    old = F.col(column)
    return df.withColumn(column, F.when(old.isNull() | (old == 0), score).otherwise(old))
