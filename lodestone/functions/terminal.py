"""Recorded terminal output: the final screen, lines that scrolled away, and coloured spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_ESCAPE = re.compile(r"\x1b(?:\[([0-9;?]*)([ -/]*[@-~])|\][^\x07\x1b]*(?:\x07|\x1b\\)?|[@-Z\\^_])")
#: Colours by number.
COLOURS = ("black", "red", "green", "yellow", "blue", "magenta", "cyan", "white")


class Grid:
    """A screen of rows and columns with at most ``keep`` lines of history."""

    def __init__(self, rows: int = 24, cols: int = 80, keep: int = 10_000):
        self.rows, self.cols, self.keep = rows, cols, keep
        self.lines = [[" "] * cols for _ in range(rows)]
        self.history: list[str] = []
        self.y = self.x = 0
        self.truncated = False

    def feed(self, text: str) -> Grid:
        at = 0
        while at < len(text):
            m = _ESCAPE.match(text, at)
            if m:
                if m[2]:
                    self._control(m[1], m[2])
                at = m.end()
                continue
            c = text[at]
            at += 1
            if c == "\n":
                self.x = 0
                self._down()
            elif c == "\r":
                self.x = 0
            elif c == "\b":
                self.x = max(0, self.x - 1)
            elif c == "\t":
                self.x = min(self.cols - 1, (self.x // 8 + 1) * 8)
            elif c >= " " and c != "\x7f":
                if self.x == self.cols:
                    self.x = 0
                    self._down()
                self.lines[self.y][self.x] = c
                self.x += 1
        return self

    def _down(self) -> None:
        if self.y + 1 < self.rows:
            self.y += 1
            return
        self.history.append("".join(self.lines.pop(0)).rstrip())
        self.lines.append([" "] * self.cols)
        if len(self.history) > self.keep:
            self.history.pop(0)
            self.truncated = True

    def _control(self, args: str, final: str) -> None:
        n = [int(a) if a.isdigit() else 0 for a in args.split(";")]
        step = max(1, n[0])
        if final == "A":
            self.y = max(0, self.y - step)
        elif final == "B":
            self.y = min(self.rows - 1, self.y + step)
        elif final == "C":
            self.x = min(self.cols - 1, self.x + step)
        elif final == "D":
            self.x = max(0, self.x - step)
        elif final == "G":
            self.x = min(self.cols, step) - 1
        elif final in "Hf":
            self.y, self.x = min(self.rows, step) - 1, min(self.cols, max(1, n[1] if len(n) > 1 else 1)) - 1
        elif final == "K":
            a, b = ((self.x, self.cols), (0, self.x + 1), (0, self.cols))[min(n[0], 2)]
            self.lines[self.y][a:b] = [" "] * (min(b, self.cols) - a)
        elif final == "J":
            if n[0] == 0:
                self._control("", "K")
            below = range(self.y + 1, self.rows) if n[0] == 0 else range(self.y) if n[0] == 1 else range(self.rows)
            for k in below:
                self.lines[k] = [" "] * self.cols

    def screen(self) -> str:
        """The screen without blank line ends and without blank lines at its end."""
        return "\n".join("".join(x).rstrip() for x in self.lines).rstrip("\n")


def spans(text: str) -> list[dict]:
    """Runs of text and their colour and weight, as the codes before them say."""
    out: list[dict] = []
    state: dict = {"color": None, "bold": False}
    at = 0

    def put(piece: str) -> None:
        if piece:
            if out and (out[-1]["color"], out[-1]["bold"]) == (state["color"], state["bold"]):
                out[-1]["text"] += piece
            else:
                out.append({"text": piece, **state})

    for m in _ESCAPE.finditer(text):
        put(text[at : m.start()])
        at = m.end()
        if m[2] != "m":
            continue
        for code in m[1].split(";"):
            k = int(code) if code.isdigit() else 0
            if k == 0:
                state.update(color=None, bold=False)
            elif k in (1, 22):
                state["bold"] = k == 1
            elif k == 39:
                state["color"] = None
            elif 30 <= k < 38 or 90 <= k < 98:
                state["color"] = ("bright_" if k >= 90 else "") + COLOURS[k % 10]
    put(text[at:])
    return out


def replay(recordings: DataFrame, rows: int = 24, cols: int = 80, keep: int = 10_000) -> DataFrame:
    """doc, screen, history, truncated of recordings (doc, content); bytes that are no UTF-8 are replaced."""
    kind = recordings.schema["doc"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = [Grid(rows, cols, keep).feed((c.as_py() or b"").decode("utf-8", "replace")) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g.screen() for g in grids], pa.string()), pa.array([g.history for g in grids], pa.list_(pa.string())), pa.array([g.truncated for g in grids], pa.bool_())], names=["doc", "screen", "history", "truncated"])

    return recordings.select("doc", "content").mapInArrow(go, f"doc {kind}, screen string, history array<string>, truncated boolean")
