"""Keyed upsert and checked append (operators U1-U6, S10, C13, J4).

The reference merges through ``INSERT ... ON CONFLICT`` in PostgreSQL. Here the
merge is a DataFrame plan: a full outer equi-join of target and source on the
keys, one ``CASE`` per column. Matching keys take the source's value for every
non-key column the source carries; columns the source does not carry keep the
stored value; new keys are inserted with NULL (the column default).

Each side holds at most one row per key (the target by contract; the source
after :func:`latest_per_key` or the cleaner's duplicate check), so no key can be
hot in the join.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contracts as K


def validate(columns: Sequence[str], table_name: str, keys: Sequence[str]) -> None:
    """The reference's argument checks, with the same failures (``ValueError``)."""
    if not keys:
        raise ValueError("unique keys must not be empty")
    missing = [k for k in keys if k not in columns]
    if missing:
        raise ValueError(f"keys {missing} are not columns of the input {list(columns)}")
    if not re.match(K.TABLE_NAME_PATTERN, table_name):
        raise ValueError(f"illegal table name: {table_name}")
    for c in columns:
        if not isinstance(c, str) or not re.match(K.COLUMN_NAME_PATTERN, c):
            raise ValueError(f"illegal column name: {c}")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   present: Mapping[str, str] | None = None) -> DataFrame:
    """U4: one row per key, the greatest by ``order`` (e.g. file time, then source).

    ``present`` names, per column that a source may lack, the flag column saying
    whether it was delivered. Such a column takes its value from the greatest row
    that has it, as if the sources were applied one after another; its flag is
    true if any row has it.

    A ``groupBy`` with ``max_by`` rather than a window: the reduction is combined
    map-side, so a key with millions of copies never gathers in one task.
    """
    present = {c: f for c, f in (present or {}).items() if c in df.columns and f in df.columns}
    rest = [c for c in df.columns if c not in keys and c not in present and c not in present.values()]
    aggs = [F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")] if rest else []
    for c, flag in present.items():
        aggs.append(F.max_by(F.struct(c), F.when(F.col(flag), F.struct(*order))).alias(f"_row_{c}"))
        aggs.append(F.bool_or(flag).alias(flag))
    if not aggs:
        return df.select(*keys).distinct()
    value = {c: F.col("_row")[c] for c in rest} | {c: F.col(f"_row_{c}")[c] for c in present} | {f: F.col(f) for f in present.values()}
    return df.groupBy(*keys).agg(*aggs).select(*keys, *[value[c].alias(c) for c in df.columns if c not in keys])


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], *,
          now: Column | None = None, audit: bool = True, present: Mapping[str, str] | None = None,
          clocks: bool = False) -> DataFrame:
    """U1 + U2 + U6 + J4: the target after upserting ``source`` on ``keys``.

    ``present`` names, per source column, a flag column of the source: where it is
    false, a matched row keeps its stored value, as if the row's source had no such
    column.

    Output has the target's columns in the target's order. With ``audit``, the
    ``created_at``/``updated_at`` columns are kept on untouched rows, set to
    ``now`` on inserted rows, and ``updated_at`` is refreshed on matched rows.
    When the source holds only key columns, matched rows stay as they are (U2). With
    ``clocks`` the source's own audit columns stand for ``now``.
    """
    present = {c: f for c, f in (present or {}).items() if f in source.columns}
    flags = list(present.values())
    validate([c for c in source.columns if c not in flags], "target", keys)
    now = now if now is not None else F.localtimestamp()
    update = [c for c in source.columns if c not in keys and c not in K.AUDIT_COLUMNS and c not in flags]
    t = target.withColumn("_t_hit", F.lit(True)).alias("t")
    s = source.select(*keys, *update, *flags, *(K.AUDIT_COLUMNS if clocks else ())).withColumn("_s_hit", F.lit(True)).alias("s")
    j = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full_outer")
    s_hit = F.col("s._s_hit").isNotNull()
    t_hit = F.col("t._t_hit").isNotNull()
    types = {f.name: f.dataType for f in target.schema.fields}
    out = []
    for c in target.columns:
        tc = F.col(f"t.{c}")
        if c in keys:
            val = F.coalesce(tc, F.col(f"s.{c}").cast(types[c]))
        elif c in update:
            given = s_hit & F.coalesce(F.col(f"s.{present[c]}"), F.lit(False)) if c in present else s_hit
            val = F.when(given, F.col(f"s.{c}").cast(types[c])).otherwise(tc)
        elif audit and c == "created_at":
            val = F.when(t_hit, tc).otherwise(F.col("s.created_at") if clocks else now.cast(types[c]))
        elif audit and c == "updated_at":
            val = F.when(s_hit & (t_hit & F.lit(bool(update)) | ~t_hit), F.col("s.updated_at") if clocks else now.cast(types[c])).otherwise(tc)
        else:
            val = tc
        out.append(val.alias(c))
    return j.select(*out)


def latest_layers(rows: DataFrame, keys: Sequence[str], seq: str, present: Mapping[str, str]) -> DataFrame:
    """One row per key of several upserts' rows (``seq`` tells their order), as if they were applied one after another.

    A column of ``present`` takes its value from the last row that delivered it, as in
    :func:`latest_per_key`; ``created_at`` stays that of the first row. Rows with a NULL in
    their key match nothing, so each stands for itself.
    """
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    rows = rows.withColumn("_lone", F.when(no_key, F.monotonically_increasing_id()))
    rest = [c for c in rows.columns if c not in (*keys, "_lone", "created_at", *present, *present.values())]
    aggs = [F.max_by(F.struct(*rest), seq).alias("_row"), F.min_by("created_at", seq).alias("created_at")]
    for c, flag in present.items():
        aggs += [F.max_by(F.struct(c), F.when(F.col(flag), F.col(seq))).alias(f"_row_{c}"), F.bool_or(flag).alias(flag)]
    value = {c: F.col("_row")[c] for c in rest} | {c: F.col(f"_row_{c}")[c] for c in present}
    merged = rows.groupBy(*keys, "_lone").agg(*aggs)
    return merged.select(*[value.get(c, F.col(c)).alias(c) for c in rows.columns if c != "_lone"])


def to_contract(df: DataFrame, schema: T.StructType, *, now: Column | None = None) -> DataFrame:
    """S13 + C13: cast to the stored schema (decimals round half-up; overflow raises).

    Columns of the schema that the frame lacks are filled with NULL, audit columns
    with ``now``.
    """
    now = now if now is not None else F.localtimestamp()
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name in K.AUDIT_COLUMNS:
            cols.append(now.cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append_checked(target_schema: T.StructType, df: DataFrame, table_name: str) -> DataFrame:
    """Rows ready to append — unknown columns refused, the rest cast to the contract."""
    if not re.match(K.TABLE_NAME_PATTERN, table_name):
        raise ValueError(f"illegal table name: {table_name}")
    known = {f.name for f in target_schema.fields}
    unknown = [c for c in df.columns if c not in known]
    if unknown:
        raise ValueError(f"columns {unknown} are not in table {table_name}")
    return to_contract(df, target_schema)


def append_rows(target: DataFrame, rows: DataFrame, table_name: str) -> DataFrame:
    """S10 as a plan: ``target`` plus ``rows`` after the name and column checks.

    Unknown columns are refused; columns the rows lack are NULL (the default).
    """
    if not re.match(K.TABLE_NAME_PATTERN, table_name):
        raise ValueError(f"illegal table name: {table_name}")
    unknown = [c for c in rows.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"columns {unknown} are not in table {table_name}")
    types = {f.name: f.dataType for f in target.schema.fields}
    aligned = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c)
                            for c in target.columns])
    return target.unionByName(aligned)
