"""Cutting a text before every run of white-space markers (small per-row helper)."""

from __future__ import annotations

import re

MARK = "▁"
_RUNS = re.compile(" *[^ ]+| +")


def marked_chunks(text: str) -> list[str]:
    """Chunks of the marked text, each without its first marker and with spaces for the others.

    The marked text has one marker before it and a marker for every space, so a
    chunk is a run of markers and the characters up to the next run.
    """
    if not text:
        return []
    text = text.replace(MARK, " ")
    parts = text.split(" ")
    if "" in parts:
        return [run[1:] for run in _RUNS.findall(" " + text)]
    return parts
