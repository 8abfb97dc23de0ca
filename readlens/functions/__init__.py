"""Scalar column expressions shared by the operators."""

from readlens.functions.expr import (  # noqa: F401
    MONTH_ABBREVIATIONS,
    has_text,
    month_abbrev_to_num,
    month_index,
    months_between_idx,
    non_empty,
    safe_int,
    share,
    trailing_year,
    yyyymm,
)
