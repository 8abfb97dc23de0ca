"""Scans, sinks and the driver-table fixtures."""

from readlens.sources.readers import (  # noqa: F401
    SUPPORTED_FORMATS,
    dataset_report,
    preview,
    read_result_csv,
    read_table,
    tagged_path,
    write_result,
)
