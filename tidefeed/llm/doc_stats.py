"""Statistics of one text, as rows of a numpy matrix (small per-row helper)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from operator import eq

import numpy as np

from .common import WORD_PATTERN

_WORDS = re.compile(WORD_PATTERN)
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Plain counts, then shares.  Column order of :func:`stats_matrix`.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
          "echo_share", "distinct_share", "digit_share", "bang_share", "stop_share", "words_per_line",
          "ascii_share", "longest_word", "comma_share")
COLUMNS = COUNTS + SHARES


def repeat_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for window in windows:
        seen[window] = seen.get(window, 0) + 1
    covered, reach = 0, 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            covered += at + 3 - max(at, reach)
            reach = at + 3
    return covered


def text_stats(text: str | None) -> tuple[float, ...]:
    """The statistics of one whole text; a null text counts as an empty one."""
    text = text or ""
    words = _WORDS.findall(text)
    n = len(words)
    if not n:
        return (0.0,) * len(COLUMNS)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    return (
        n, chars, symbols, dup_lines, repeats,
        float(np.log1p(n)), chars / n, symbols / n, dup_lines / len(lines), repeats / n,
        sum(map(str.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        sum(map(text.count, "0123456789")) / chars,
        text.count("!") / n,
        text.count(".") / n,
        n / len(lines),
        1.0 if text.isascii() else len(text.encode("ascii", "ignore")) / len(text),
        max(map(len, words)),
        text.count(",") / n,
    )


def stats_matrix(texts: Iterable[str | None]) -> np.ndarray:
    """One row per text, columns in the order of :data:`COLUMNS`."""
    rows = [text_stats(text) for text in texts]
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(COLUMNS))
