"""From text columns to canonical typed columns, with the outcome of each row."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafact.config import OnFailure, SourceConfig
from terrafact.functions.rules import chain
from terrafact.functions.text import quoted
from terrafact.sources.feeds import feed_columns, meta_columns

LEVEL, BLAME = "_level", "_blame"


class DatasetAborted(RuntimeError):
    """A feed holds a failure whose policy is to give up the whole file."""


class _Field(NamedTuple):
    name: str
    value: str
    # (input column, output column, policy) of every step
    steps: list[tuple[str, str, OnFailure]]


def project_fields(df: DataFrame, source: SourceConfig) -> DataFrame:
    """Rename feed columns to canonical names; a column the feed lacks is null.

    Columns without a definition are dropped, or carried along with
    ``unmapped="keep"`` where their name is free.
    """
    have = {c.lower(): c for c in feed_columns(df)}
    picked = []
    for name, f in source.by_canonical.items():
        column = have.get(f.column.lower())
        picked.append(
            (F.lit(None).cast("string") if column is None else quoted(column)).alias(name)
        )
    picked += [quoted(have[c]).alias(c) for c in unmapped_columns(df, source)]
    return df.select(*picked, *meta_columns(df))


def unmapped_columns(df: DataFrame, source: SourceConfig) -> list[str]:
    """Lower-cased feed columns carried along as they are."""
    if source.unmapped != "keep":
        return []
    used = {f.column.lower() for f in source.by_canonical.values()}
    taken = {n.lower() for n in source.schema}
    names = {c.lower() for c in feed_columns(df)}
    return sorted(n for n in names if n not in used and n not in taken)


def _staged(df: DataFrame, source: SourceConfig) -> tuple[DataFrame, list[_Field]]:
    """Run the chains step by step, each step's output in a column of its own.

    Every step is one projection over all fields, so a step's result is
    computed once and used by the next step and by the failure test.
    """
    df = project_fields(df, source)
    fields = [_Field(n, n, []) for n in source.by_canonical]
    todo = {f.canonical: chain(f)[0] for f in source.by_canonical.values()}
    depth = 0
    while any(len(steps) > depth for steps in todo.values()):
        added = []
        for i, field in enumerate(fields):
            if len(todo[field.name]) > depth:
                step = todo[field.name][depth]
                out = f"_s{depth}_{field.name}"
                added.append(step.apply(quoted(field.value)).alias(out))
                field.steps.append((field.value, out, step.policy))
                fields[i] = field._replace(value=out)
        df = df.select("*", *added)
        depth += 1
    return df, fields


def _failed(before: str, after: str) -> Column:
    return quoted(before).isNotNull() & quoted(after).isNull()


def _field_level(field: _Field) -> Column:
    """0 unless a step of this field failed under a stricter policy.

    After a failure the value is null, and null cannot fail again, so at most
    one step per field contributes.
    """
    level = F.lit(0)
    for before, after, policy in reversed(field.steps):
        if policy > OnFailure.IGNORE:
            level = F.when(_failed(before, after), F.lit(int(policy))).otherwise(level)
    return level


def _strict(fields: list[_Field]) -> list[_Field]:
    return [f for f in fields if any(p > OnFailure.IGNORE for _, _, p in f.steps)]


def _values(fields: list[_Field]) -> list[Column]:
    return [quoted(f.value).alias(f.name) for f in fields]


def apply_transforms(df: DataFrame, source: SourceConfig, blame: bool = False) -> DataFrame:
    """Canonical typed columns plus ``_level``: 0 keep, 1 skip row, 2 abort file.

    A row with both kinds of failure counts as the stricter one. With ``blame``
    the first field whose failure aborts the file is named in ``_blame``.
    """
    staged, fields = _staged(df, source)
    strict = _strict(fields)
    levels = [_field_level(f) for f in strict]
    level = F.greatest(*levels) if len(levels) > 1 else (levels or [F.lit(0)])[0]
    extra = [quoted(c) for c in unmapped_columns(df, source)]
    columns = [*_values(fields), *extra, *meta_columns(df), level.alias(LEVEL)]
    if blame:
        stop = [f for f in strict if any(p == OnFailure.SKIP_DATASET for _, _, p in f.steps)]
        names = [F.when(_field_level(f) == 2, F.lit(f.name)) for f in stop]
        columns.append(F.coalesce(F.lit(None).cast("string"), *names).alias(BLAME))
    return staged.select(*columns)


def kept_rows(df: DataFrame) -> DataFrame:
    """Rows no rule asked to skip."""
    return df.filter(F.col(LEVEL) == 0).drop(LEVEL)


def check_abort(df: DataFrame) -> None:
    """Raise DatasetAborted when any row of the transformed frame asks for it."""
    bad = df.filter(F.col(LEVEL) == int(OnFailure.SKIP_DATASET)).select(*meta_columns(df)).first()
    if bad is not None:
        raise DatasetAborted(f"a rule gave up the file: {bad.asDict()}")


def rejects(df: DataFrame, source: SourceConfig) -> DataFrame:
    """One row per failed field of every rejected row: field, text, policy."""
    staged, fields = _staged(df, source)
    strict = _strict(fields)
    if not strict:
        staged, strict = staged.filter(F.lit(False)), fields[:1]
    found = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("field"),
                quoted(f.name).alias("input"),
                _field_level(f).alias("level"),
            )
            for f in strict
        ]
    )
    policy = F.when(F.col("r.level") == 2, "skip_dataset").otherwise("skip_row")
    # The test comes first: few rows are rejected, and only those build arrays.
    return (
        staged.filter(F.greatest(F.lit(0), F.lit(0), *[_field_level(f) for f in strict]) > 0)
        .select(
            *meta_columns(df), F.explode(F.filter(found, lambda r: r["level"] > 0)).alias("r")
        )
        .select(
            *meta_columns(df),
            F.col("r.field").alias("field"),
            F.col("r.input").alias("input"),
            policy.alias("policy"),
        )
    )


def type_profile(df: DataFrame, source: SourceConfig) -> DataFrame:
    """Per field: rows, blank values, failed values, kept values."""
    staged, fields = _staged(df, source)
    counts = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        counts.append(F.count_if(quoted(f.name).isNull()).alias(f"b{i}"))
        failed = F.lit(False)
        for before, after, _ in f.steps:
            failed = failed | _failed(before, after)
        counts.append(F.count_if(failed).alias(f"f{i}"))
        counts.append(F.count_if(quoted(f.value).isNotNull()).alias(f"k{i}"))
    per_field = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("field"),
                F.col("n").alias("rows"),
                F.col(f"b{i}").alias("blank"),
                F.col(f"f{i}").alias("failed"),
                F.col(f"k{i}").alias("kept"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return staged.agg(*counts).select(F.inline(per_field))


def check_complete(
    df: DataFrame, schema: Mapping[str, str], derived: set[str], stale: str = "reject"
) -> DataFrame:
    """Keep rows only if every registered field is there.

    A field that was registered once and is no longer defined is missing from
    every row, so all rows go; ``stale="ignore"`` keeps them.
    """
    missing = sorted(n for n in schema if n not in derived and n not in df.columns)
    if not missing or stale == "ignore":
        return df
    warnings.warn(f"registered fields are not defined any more: {missing}", stacklevel=2)
    return df.filter(F.lit(False))
