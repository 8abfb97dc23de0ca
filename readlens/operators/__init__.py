"""DataFrame -> DataFrame operators, grouped by question."""

from readlens.operators import attention, context, genres, sentiment, series  # noqa: F401
