"""Blocks of texts of bounded size for array code."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def text_blocks(texts: Sequence[str | None], most_texts: int = 256, most_chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(start, end) of successive blocks with at most most_texts texts and, unless a text alone is longer, most_chars characters."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > start and (i - start >= most_texts or chars + n > most_chars):
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)
