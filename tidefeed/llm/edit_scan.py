"""Scanning sorted words for those one edit away (small numpy kernel).

Words are grouped into cells and sorted within each.  A word is compared with the
words after it in its cell by the rows of an edit matrix, one row a character of the
scanned word, three cells wide (one edit leaves nothing else).  The next scanned word
starts from the row of the prefix it shares with the one before; when a row rules one
edit out, all words that share that prefix are skipped.  All words of a batch advance
together, a character a step, so the step is a few operations on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Edits beyond one all count as this many.
_FAR = 2
#: The row of two equal prefixes: cells left of, on and right of the diagonal.
EQUAL = 1 * 9 + 0 * 3 + 1


def _transitions() -> np.ndarray:
    """Next row for a row (three cells as base-three digits) and the three comparisons of a character (bits)."""
    out = np.empty((27, 8), np.uint8)
    for row in range(27):
        left, on, right = row // 9, row // 3 % 3, row % 3
        for same in range(8):
            a = min(left + (not same & 4), on + 1, _FAR)
            b = min(on + (not same & 2), right + 1, a + 1, _FAR)
            c = min(right + (not same & 1), b + 1, _FAR)
            out[row, same] = a * 9 + b * 3 + c
    return out


NEXT = _transitions()
#: Rows without a cell of one edit or none.
DEAD = np.array([min(r // 9, r // 3 % 3, r % 3) >= _FAR for r in range(27)])
#: Cell of a row, left to right.
CELL = np.array([[r // 9, r // 3 % 3, r % 3] for r in range(27)], np.uint8)


class Words:
    """Words as one array of code points, each with a blank before it and three after."""

    def __init__(self, words: list[str]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(np.r_[0, self.length[:-1] + 4])[:len(words)] + 1
        self.codes = np.frombuffer(("\0" + "\0\0\0\0".join(words) + "\0\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)

    def shared_with_previous(self, cell: np.ndarray) -> np.ndarray:
        """Length of the prefix shared with the word before; -1 for the first of a cell and past the end."""
        n = len(self.length)
        out = np.full(n + 1, -1, np.int64)
        if n < 2:
            return out
        at = np.flatnonzero(cell[1:] == cell[:-1]) + 1
        out[at] = 0
        depth = 0
        while len(at):
            at = at[(self.length[at] > depth) & (self.length[at - 1] > depth)
                    & (self.codes[self.start[at] + depth] == self.codes[self.start[at - 1] + depth])]
            out[at] += 1
            depth += 1
        return out


def next_shorter(shared: np.ndarray) -> np.ndarray:
    """For each place the next one whose shared prefix is shorter."""
    out = np.arange(1, len(shared) + 1)
    open_places: list[int] = []
    for at, depth in enumerate(shared.tolist()):
        while open_places and shared[open_places[-1]] > depth:
            out[open_places.pop()] = at
        open_places.append(at)
    return out


def near_pairs(words: list[str], cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``(a, b)``, a < b, of words of one cell that are one edit apart; ``words`` are sorted in each cell."""
    if not len(words):
        return
    data = Words(words)
    shared = data.shared_with_previous(cell)
    shorter = next_shorter(shared)
    # Row after d characters, for every word and depth; a word's own prefixes are equal to it.
    rows = np.full(len(data.codes), EQUAL, np.uint8)
    at = np.arange(len(words))
    seen = at + 1
    depth = shared[seen]
    at, seen, depth = (x[depth >= 0] for x in (at, seen, depth))
    while len(at):
        length, own = data.length[seen], data.start[at]
        char = data.codes[data.start[seen] + depth]
        more = depth < length
        same = ((data.codes[own + depth - 1] == char) * 4 + (data.codes[own + depth] == char) * 2
                + (data.codes[own + depth + 1] == char))
        row = np.where(more, NEXT[rows[own + depth], same], rows[own + depth])
        depth = depth + more
        dead = DEAD[row]
        rows[own + np.minimum(depth, data.length[at] + 2)] = row
        done = ~dead & (depth == length)
        offset = data.length[at] - length + 1
        hit = done & (offset >= 0) & (offset <= 2)
        hit[hit] = CELL[row[hit], offset[hit]] == 1
        if hit.any():
            yield at[hit], seen[hit]
        # the next word, or the next one that does not share the prefix ruled out
        on = np.where(done | dead, seen + 1, seen)
        skip = np.flatnonzero(dead)
        while len(skip):
            skip = skip[shared[on[skip]] >= depth[skip]]
            on[skip] = shorter[on[skip]]
        moved = on != seen
        depth = np.where(moved, shared[on], depth)
        seen = on
        stay = depth >= 0
        if not stay.all():
            at, seen, depth = at[stay], seen[stay], depth[stay]
