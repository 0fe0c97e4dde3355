"""Make heterogeneous flow tables alike and clean them for learning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow import lookups as L
from vigilflow.functions.lookup import normalise_label
from vigilflow.functions.numbers import finite_or, parse_number

VARIANCE_FLOOR = 1e-6
KEEP_SHARE = 0.7


def canonical_header(header: list[str], renames: dict[str, str] | None = None) -> list[str]:
    """Canonical names by position: spaces stripped, then renamed."""
    renames = L.COLUMN_RENAMES if renames is None else renames
    return [renames.get(name.strip(), name.strip()) for name in header]


def is_leakage(name: str) -> bool:
    """Metadata by keyword anywhere in the name, or a ``.N`` duplicate."""
    tail = name.rsplit(".", 1)
    return any(word in name.lower() for word in L.LEAKAGE_KEYWORDS) or (
        len(tail) == 2 and tail[1].isdigit()
    )


def kept_positions(header: list[str]) -> dict[str, int]:
    """Position of every column to keep: first of equal names, no leakage."""
    first: dict[str, int] = {}
    for position, name in enumerate(canonical_header(header)):
        first.setdefault(name, position)
    return {name: i for name, i in first.items() if not is_leakage(name)}


def rename_columns(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Strip and rename the columns; of columns that coincide the first stays."""
    names = canonical_header(df.columns, renames)
    numbered = df.toDF(*[str(i) for i in range(len(names))])
    first: dict[str, int] = {}
    for position, name in enumerate(names):
        first.setdefault(name, position)
    return numbered.select(*[F.col(str(i)).alias(name) for name, i in first.items()])


def drop_leakage(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not is_leakage(c)])


def find_label(columns: list[str]) -> str | None:
    """The label column, whatever its case and surrounding spaces."""
    return next((c for c in columns if c.strip().lower() == "label"), None)


def with_label(df: DataFrame, eleven_classes: bool = True) -> DataFrame:
    """Rename the label column to ``Label`` and unify its values."""
    name = find_label(df.columns)
    if name is None:
        raise ValueError("no label column")
    return df.withColumnRenamed(name, "Label").withColumn("Label", normalise_label("Label", eleven_classes))


def keep_classes(df: DataFrame, classes: list[str], label: str = "Label") -> DataFrame:
    return df.filter(F.col(label).isin(list(classes)))


def number_cells(df: DataFrame, columns: list[str]) -> tuple[list[str], Column]:
    """The columns as one array of numbers (bad text and non-finite become null).

    Returns the column order of the array.  Flow tables have some eighty columns;
    one lambda over an array keeps the generated code small, where eighty inlined
    parsers would outgrow what the JVM compiles.
    """
    kinds = dict(df.dtypes)
    texts = [c for c in columns if kinds[c] == "string"]
    plain = [c for c in columns if kinds[c] != "string"]
    parsed = F.transform(F.array(*[F.col(f"`{c}`") for c in texts]), parse_number)
    cast = F.array(*[F.col(f"`{c}`").cast("double") for c in plain])
    both = [cells for names, cells in ((texts, parsed), (plain, cast)) if names]
    return texts + plain, F.transform(F.concat(*both), lambda v: finite_or(v))


def coerce_numbers(df: DataFrame, keep: tuple[str, ...] = ("Label",)) -> DataFrame:
    """All columns but ``keep`` to double; bad text and non-finite values to null."""
    names, cells = number_cells(df, [c for c in df.columns if c not in keep])
    slot = {name: i for i, name in enumerate(names)}
    return df.withColumn("_cells", cells).select(
        *[F.col(f"`{c}`") if c in keep else F.col("_cells")[slot[c]].alias(c) for c in df.columns]
    )


def needed_cells(columns: list[str]) -> int:
    """Filled cells a row needs: 70 % (rounded down) of the columns, label included."""
    return int(len(columns) * KEEP_SHARE)


def drop_sparse_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with too few filled cells (NaN counts as empty)."""
    columns = columns or df.columns
    return df.dropna(thresh=needed_cells(columns), subset=[f"`{c}`" for c in columns])


def fill_zero(df: DataFrame, keep: tuple[str, ...] = ("Label",)) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in df.columns if c not in keep})


def feature_spread(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: the sample standard deviation of every feature (one pass)."""
    return df.agg(*[F.stddev_samp(F.col(f"`{c}`")).alias(c) for c in features])


def varying_features(df: DataFrame, features: list[str]) -> list[str]:
    """Features whose spread exceeds the floor; only one row reaches the driver."""
    spread = feature_spread(df, features).first().asDict()
    return [c for c in features if spread[c] is not None and spread[c] > VARIANCE_FLOOR]


def clean(
    df: DataFrame,
    classes: list[str] | None = None,
    keep: tuple[str, ...] = (),
    eleven_classes: bool = True,
) -> DataFrame:
    """Row cleaning: label, class filter, numbers, sparse rows, zero fill.

    ``keep`` names carried columns (row keys) that are no features.
    """
    labelled = with_label(df, eleven_classes)
    if classes is not None:
        labelled = keep_classes(labelled, classes)
    columns = [c for c in labelled.columns if c not in keep]
    names, cells = number_cells(labelled, [c for c in columns if c != "Label"])
    slot = {name: i for i, name in enumerate(names)}
    filled = F.size(F.filter("_cells", lambda v: v.isNotNull())) + F.col("Label").isNotNull().cast("int")
    rows = labelled.withColumn("_cells", cells).filter(filled >= needed_cells(columns))
    return rows.select(
        *[
            F.coalesce(F.col("_cells")[slot[c]], F.lit(0.0)).alias(c) if c in slot else F.col(f"`{c}`")
            for c in labelled.columns
        ]
    )


def preprocess(
    df: DataFrame,
    classes: list[str] | None = None,
    keep: tuple[str, ...] = (),
    eleven_classes: bool = True,
) -> tuple[DataFrame, list[str]]:
    """Cleaned rows with the varying features only, and the list of these.

    The order matters: the spread is taken after class filter and zero fill.
    """
    rows = clean(df, classes, keep, eleven_classes)
    features = varying_features(rows, [c for c in rows.columns if c != "Label" and c not in keep])
    return rows.select(*keep, *[F.col(f"`{c}`") for c in features], "Label"), features


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames aligned by column name; missing cells are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def class_codes(classes: list[str]) -> dict[str, int]:
    """Integer codes of the class names in sorted order."""
    return {name: code for code, name in enumerate(sorted(classes))}
