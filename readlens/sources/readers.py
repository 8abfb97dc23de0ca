"""Readers, sinks and the dataset catalogue report.

* ``read_table`` — format switch with an allow-list; unknown formats raise.  JSON takes a declared schema, and lines
  that don't fit it are dropped, kept beside the rows, or raise.
* ``write_result`` — header CSV: one part file for small results, or several parts in a given order.  The old output
  is replaced only when the new one is complete.
* ``read_result_csv`` — read such CSVs back with typed columns, each part file by its own header; rows whose values
  do not parse are skipped or raise.
* ``dataset_report`` — schema tree plus a JSON sample per dataset, probed side by side; a dataset that fails to open
  or read yields an ``error`` row instead of stopping the others.
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readlens.functions.expr import settled
from readlens.plans.materialize import delete_folder

SUPPORTED_FORMATS = ("parquet", "json")
#: Column that holds the text of a damaged JSON line.
DAMAGED = "_damaged"

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("n_columns", T.LongType()),
        T.StructField("column_names", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("sample", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    columns: Sequence[str | Column] | None = None,
    schema: str | T.StructType | None = None,
    on_damaged: str = "drop",
) -> DataFrame:
    """Read one dataset (a file, a folder or a glob); project right away so the scan only reads ``columns``.

    ``schema`` declares the columns (a JSON dataset is read in one pass then; without it Spark infers them in a pass of
    its own).  ``on_damaged`` says what becomes of JSON lines that are cut off, are no JSON or hold a value of
    another type in a column that is read: ``drop``, ``keep`` (the line stands in ``_damaged``, its readable values in
    their columns) or ``raise`` when the rows are computed."""
    if fmt not in SUPPORTED_FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    if on_damaged not in ("drop", "keep", "raise"):
        raise ValueError(f"unknown on_damaged {on_damaged!r}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt != "json" or schema is None:
        df = reader.format(fmt).load(path)
        return df.select(*columns) if columns else df
    if on_damaged == "raise":
        df = reader.option("mode", "FAILFAST").json(path)
        return df.select(*columns) if columns else df
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*declared.fields, T.StructField(DAMAGED, T.StringType())])
    df = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", DAMAGED).json(path)
    asked = list(columns) if columns else declared.fieldNames()
    if on_damaged == "keep":
        return settled(df.select(*asked, DAMAGED))
    # settled: a query of fewer columns (a count) may not come down to the damaged column alone, which Spark refuses
    rows = settled(df.select(*asked, DAMAGED))
    return rows.where(F.col(DAMAGED).isNull()).drop(DAMAGED)


def tagged_path(base: str, template: str, **params) -> str:
    """Output folder whose name carries the run parameters, e.g.
    ``tagged_path(out, "corr_by_class_min{min_total}_q{q}", min_total=1000, q=0.9)``."""
    return f"{base.rstrip('/')}/{template.format(**params)}"


def write_result(
    df: DataFrame,
    path: str,
    single_file: bool = False,
    order_by: Sequence[str | Column] | None = None,
    parts: int | None = None,
) -> None:
    """Header CSV, overwrite.

    ``single_file`` funnels the result through one task, so only use it for small aggregated outputs (rows per year,
    per class ...).  ``order_by`` writes any size in order: rows are dealt to ``parts`` ranges (by default as many
    as the session's shuffles have) and sorted within each, so the part files in name order are one sorted sequence.

    The new files are written beside ``path`` and take its place when they are complete: a failed job leaves the old
    output as it was, and ``df`` may read from ``path``.  On a file system whose rename isn't atomic (object stores)
    the exchange itself is not either; the old output then lies under ``<path>.old-*`` until it is over."""
    if order_by:
        keys = list(order_by)
        out = (df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    else:
        out = df.coalesce(1) if single_file else df
    spark, path = df.sparkSession, path.rstrip("/")
    run = uuid.uuid4().hex[:12]
    staged, old = f"{path}.new-{run}", f"{path}.old-{run}"
    try:
        out.write.mode("error").option("header", True).csv(staged)
    except Exception:
        delete_folder(spark, staged)
        raise
    fs, target = _file_system(spark, path)
    new_path, old_path = (_file_system(spark, p)[1] for p in (staged, old))
    replaced = fs.exists(target)
    if replaced and not fs.rename(target, old_path):
        raise OSError(f"could not set aside {path}")
    if not fs.rename(new_path, target):
        if replaced:
            fs.rename(old_path, target)
        raise OSError(f"could not put {staged} in the place of {path}")
    if replaced:
        fs.delete(old_path, True)


def _file_system(spark: SparkSession, path: str):
    """(file system, path) as the session's own readers see them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def files_by_name(spark: SparkSession, path: str) -> Iterator[str]:
    """The data files of a dataset in order of their names, folder by folder: only folders that are reached are listed."""
    fs, p = _file_system(spark, path)
    if fs.getFileStatus(p).isFile():
        yield p.toString()
        return
    for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().getName()):
        if not s.getPath().getName().startswith(("_", ".")):
            yield from files_by_name(spark, s.getPath().toString())


_WHOLE_NUMBERS = ("byte", "tinyint", "short", "smallint", "int", "integer", "long", "bigint")


def _converted(name: str, kind: str) -> Column:
    """A text column as ``kind``, NULL where it does not parse.  Whole numbers may be written as decimals (``5.0``)."""
    c = F.col(name)
    if kind == "string":
        return c
    if kind in _WHOLE_NUMBERS:
        exact = F.trim(c).try_cast("decimal(38,10)")
        return F.coalesce(c.try_cast(kind), F.when(exact == F.floor(exact), exact.try_cast(kind)))
    return c.try_cast(kind)


def parse_result_rows(raw: DataFrame, columns: Mapping[str, str], on_error: str = "skip") -> DataFrame:
    """Text rows with typed columns.  ``skip`` drops rows where a value is missing or does not parse; ``raise`` fails on
    the first such value when the rows are computed."""
    if on_error not in ("skip", "raise"):
        raise ValueError(f"unknown on_error {on_error!r}")
    if on_error == "raise":
        return raw.select(*[
            F.coalesce(_converted(c, t), F.raise_error(F.concat(
                F.lit(f"column {c}: not a value of type {t}: "), F.coalesce(F.col(c), F.lit("missing")))).cast(t)).alias(c)
            for c, t in columns.items()
        ])
    typed = raw.select(*[_converted(c, t).alias(c) for c, t in columns.items()])
    return typed.dropna(how="any")


def result_headers(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """(file, header): the header line of each part file that has lines, NULL where none names all ``columns``."""
    names = F.array(*[F.lit(c) for c in columns])
    cells = F.transform(F.split("value", ","), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))
    return (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.when(F.size(F.array_except(names, cells)) == 0, F.col("value")).alias("header"))
        .groupBy("file")
        .agg(F.max("header").alias("header"))
    )


def read_result_csv(
    spark: SparkSession, path: str, columns: Mapping[str, str], on_error: str = "skip"
) -> DataFrame:
    """Read the part files of a header CSV as text and convert each listed column.  ``columns`` maps
    column name -> Spark type name ("int", "double", "string", ...).

    Each part file is read by its own header, so files may order their columns differently or have more of them; files with
    the same header are one scan.  A file that has lines but no header with all the columns can't be read: ``raise`` names
    it right away, ``skip`` leaves it out as it does rows that do not parse.  Files without any line hold nothing."""
    if on_error not in ("skip", "raise"):
        raise ValueError(f"unknown on_error {on_error!r}")
    by_header: dict[str, list[str]] = {}
    for r in result_headers(spark, path, columns).collect():  # a row for each part file
        if r["header"] is None and on_error == "raise":
            raise ValueError(f"{r['file']}: no header with the columns {', '.join(columns)}")
        if r["header"] is not None:
            by_header.setdefault(r["header"], []).append(unquote(r["file"]))
    raw = None
    for header, files in sorted(by_header.items()):
        names = [n.strip() for n in next(csv.reader([header]))]
        # of columns with the same name the last counts
        fields = [n if n not in names[i + 1:] else f"_{i}" for i, n in enumerate(names)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in fields])
        part = spark.read.schema(schema).option("header", True).csv(sorted(files)).select(*[F.col(f"`{c}`") for c in columns])
        raw = part if raw is None else raw.unionByName(part)
    if raw is None:
        raw = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return parse_result_rows(raw, columns, on_error)


def preview(df: DataFrame, order_col: str, n: int = 10) -> DataFrame:
    """The last ``n`` rows by ``order_col`` (a top-n, planned as TakeOrderedAndProject)."""
    return df.orderBy(F.col(order_col).desc()).limit(n)


def _cell(field: T.StructField) -> Column:
    """A value in a sample: lists, maps and bytes by their size, since they can be wide."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.MapType)):
        c = F.size(c)
    elif isinstance(field.dataType, T.BinaryType):
        c = F.length(c)
    return c.alias(field.name)


def _probe(spark: SparkSession, name: str, fmt: str, path: str, sample_rows: int) -> tuple:
    try:
        df = read_table(spark, path, fmt)  # Parquet: the schema of one footer
        micros = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
        line = F.to_json(F.struct(*map(_cell, df.schema.fields)), micros).alias("j")
        reader, sample = spark.read.schema(df.schema).format(fmt), []
        if not _file_system(spark, path)[0].getFileStatus(_file_system(spark, path)[1]).isFile():
            reader = reader.option("basePath", path)  # columns that are part of folder names
        for file in files_by_name(spark, path):
            sample += [r["j"] for r in reader.load(file).select(line).limit(sample_rows - len(sample)).collect()]
            if len(sample) >= sample_rows:
                break
        names = df.columns
        return (name, fmt, path, "ok", len(names), ",".join(sorted(names)), df.schema.treeString(), f"[{','.join(sample)}]", None)
    except Exception as exc:  # one bad dataset must not stop the rest
        return (name, fmt, path, "error", None, None, None, None, f"{type(exc).__name__}: {exc}")


def dataset_report(
    spark: SparkSession, datasets: Iterable[tuple[str, str, str]], sample_rows: int = 5, at_once: int = 8
) -> DataFrame:
    """One row per (name, format, path): status, number and names of the columns, schema tree, JSON sample, error.

    Datasets are probed side by side, ``at_once`` of them, each once: a Parquet schema comes from one footer, and the
    sample is the first ``sample_rows`` rows of its files in order of their names, so it is the same on every run and
    costs no more on a large dataset.  One that can't be opened or read yields an ``error`` row and the others stay."""
    items = list(datasets)
    with ThreadPoolExecutor(max(1, min(at_once, len(items) or 1))) as pool:
        rows = list(pool.map(lambda d: _probe(spark, *d, sample_rows), items))
    return spark.createDataFrame(rows, REPORT_SCHEMA)
