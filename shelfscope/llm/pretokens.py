"""Pre-tokens of a text and a task's memory of what is known about each distinct one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)
split = PATTERN.findall

SLICE_BYTES = 1 << 20  # text cut at once; its pre-tokens take some forty times that
MOST_KEPT = 200_000  # entries before a task's memory is emptied; it then counts anew, with the same results


class Known(dict):
    """pre-token -> value; what is missing is computed for a whole slice at once."""

    def __init__(self, compute: Callable[[list[str]], list]):
        self.compute = compute

    def learn(self, pieces: set[str]) -> None:
        missing = list(pieces.difference(self))
        if len(self) + len(missing) > MOST_KEPT:
            self.clear()
            missing = list(pieces)
        if missing:
            self.update(zip(missing, self.compute(missing), strict=True))
