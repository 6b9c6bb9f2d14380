"""Chunks of long texts along paragraphs and sentences, fenced code kept whole.

What a chunk ends with depends on what came before it, so this is a loop over a text's units; it
runs in Arrow batches and holds one text at a time.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

_FENCE = re.compile(r"```.*?```", re.DOTALL)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _by_sentences(unit: str, limit: int, overlap: int) -> list[str]:
    done, held = [], ""
    for sentence in _SENTENCE.split(unit):
        if not held:
            held = sentence
        elif len(held) + len(sentence) <= limit:
            held = f"{held} {sentence}".strip()
        else:
            done.append(held.strip())
            carry = " ".join(held.split()[-max(1, overlap // 10) :]) if 0 < overlap < len(held) else None
            held = sentence if carry is None else f"{carry} {sentence}"
    return done + ([held.strip()] if held.strip() else [])


class _Filler:
    """A chunk in the making; ``keep_breaks`` leaves the blank lines between its paragraphs."""

    def __init__(self, limit: int, overlap: int, keep_breaks: bool) -> None:
        self.limit, self.overlap, self.keep = limit, overlap, keep_breaks
        self.done: list[str] = []
        self.held = ""

    def flush(self) -> str:
        """Closes the chunk and gives the tail that the next one begins with."""
        self.done.append(self.held.strip())
        return self.held[-self.overlap :] if 0 < self.overlap < len(self.held) else ""

    def paragraph(self, unit: str) -> None:
        if self.held and len(self.held) + len(unit) > self.limit:
            self.held = self.flush() + unit
        elif self.keep or self.held.endswith("\n"):
            self.held += unit
        else:
            self.held = (self.held + unit).strip()

    def oversized(self, unit: str) -> None:
        if self.held.strip():
            tail = self.flush()
            self.held = f"{tail} " if tail else ""
        for piece in _by_sentences(unit, self.limit, self.overlap):
            if not self.held:
                self.held = piece
            elif len(self.held) + len(piece) > self.limit:
                self.done.append(self.held.strip())
                self.held = f"{self.held[-self.overlap :]} {piece}" if self.overlap else piece
            else:
                self.held = f"{self.held} {piece}".strip()


def split_text(text: str, limit: int = 4000, overlap: int = 200, keep_breaks: bool = False) -> list[str]:
    """The chunks of one text; a text within the limit is its only chunk.

    Lengths are those with every fenced block as a short placeholder, so a restored chunk may be longer.
    """
    if len(text) <= limit:
        return [text]
    fences: list[str] = []

    def hide(match: re.Match) -> str:
        fences.append(match.group(0))
        return f"__CODE_BLOCK_{len(fences) - 1}__"

    parts = re.split(r"(\n\n+)", _FENCE.sub(hide, text))
    filler = _Filler(limit, overlap, keep_breaks)
    for unit in (a + b for a, b in zip(parts[::2], [*parts[1::2], ""], strict=False)):
        if len(unit) > limit:
            filler.oversized(unit)
        elif unit:
            filler.paragraph(unit)
    if filler.held.strip():
        filler.done.append(filler.held.strip())
    out = []
    for chunk in filler.done:
        for i, fence in enumerate(fences):
            chunk = chunk.replace(f"__CODE_BLOCK_{i}__", fence)
        out.append(chunk)
    return out


def chunks(c: Column | str, limit: int = 4000, overlap: int = 200, keep_breaks: bool = False) -> Column:
    """Array of chunks; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_text(t, limit, overlap, keep_breaks))

    return F.pandas_udf(run, "array<string>")(col(c))
