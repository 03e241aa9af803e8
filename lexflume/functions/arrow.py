"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

SLICE_CHARS = 1_500_000


def text_slices(batch: pa.RecordBatch, column: int = 1, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batch in slices of about `chars` characters of its text column, each with the texts; a longer text is a slice of its own."""
    texts = batch.column(column).to_pylist()
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield batch.slice(start), texts[start:]
