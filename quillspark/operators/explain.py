"""Highlighting of weighted keywords in a text as HTML."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Colour = Callable[[float], tuple[int, int, int, float]]


def colormap(alpha: float = 0.2, filter_ratio: float | None = 0.5) -> Colour:
    """Blue for -1 over white to red for 1; the middle ``filter_ratio`` is transparent."""
    if filter_ratio is not None and not 0 <= filter_ratio <= 1:
        raise ValueError("filter_ratio lies in [0, 1]")
    edge = filter_ratio or 0.0

    def colour(x: float) -> tuple[int, int, int, float]:
        x = max(-1.0, min(1.0, x))
        fade = round(255 * (1 - abs(x)))
        rgb = (255, fade, fade) if x >= 0 else (fade, fade, 255)
        return (*rgb, alpha if abs(x) >= edge else 0.0)

    return colour


def longest_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without overlap: of two that overlap the longer stays, of equals the later."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin < out[-1][1]:
            if end - begin >= out[-1][1] - out[-1][0]:
                out[-1] = (begin, end)
        else:
            out.append((begin, end))
    return out


def keyword_spans(line: str, words: list[str]) -> list[tuple[int, int]]:
    """Where the words stand, as parts of words too, in any case."""
    return [m.span() for w in words if w for m in re.finditer(re.escape(w), line, re.I)]


def highlight(text: str, weights: Mapping[str, float], colour: Colour | None = None) -> str:
    """The escaped text with a coloured span around each keyword, lines joined by breaks."""
    colour = colour or colormap()
    top = max((abs(v) for v in weights.values()), default=0.0) or 1.0
    lower = {k.lower(): v / top for k, v in weights.items()}
    lines = []
    for line in html.escape(text).splitlines():
        at, parts = 0, []
        for begin, end in longest_spans(keyword_spans(line, list(weights))):
            r, g, b, a = colour(lower[line[begin:end].lower()])
            parts += [line[at:begin], f'<span style="background-color: rgba({r}, {g}, {b}, {a})">{line[begin:end]}</span>']
            at = end
        lines.append("".join([*parts, line[at:]]))
    return "<br/>".join(lines)


def random_weights(words: list[str], seed: int = 0) -> dict[str, float]:
    draw = random.Random(seed)
    return {w: draw.uniform(-1, 1) for w in words}


def highlighted(text: Column, weights: Mapping[str, float]) -> Column:
    """``highlight`` as a column, over Arrow batches."""
    given = dict(weights)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else highlight(t, given))

    return run(text)
