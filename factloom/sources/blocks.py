"""A range of lines of one source file, read where the viewer runs."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Block:
    file: str
    lineRange: str  # noqa: N815
    startLine: int  # noqa: N815
    endLine: int  # noqa: N815
    code: str

    def row(self) -> dict:
        return asdict(self)


def line_numbers(value: str) -> tuple[int, int]:
    """First and last line of ``9:1-17:2``; no range is line 1."""
    if not value:
        return 1, 1
    ends = [e.split(":")[0] for e in value.split("-")]
    if len(ends) != 2:
        raise ValueError(f"invalid line range {value!r}")
    return int(ends[0]), int(ends[1])


def read_block(base: str, file: str, lines: str = "") -> Block:
    """The lines, numbered, cut to the file; ValueError where ``file`` lies outside of ``base``."""
    if not file:
        raise ValueError("missing source file")
    first, last = line_numbers(lines)
    top = os.path.normpath(base)
    path = os.path.normpath(os.path.join(top, file.lstrip("/")))
    if path != top and not path.startswith(top.rstrip(os.sep) + os.sep):
        raise ValueError("source file escapes source base")
    with open(path, encoding="utf-8", errors="replace", newline="") as f:
        every = f.read().split("\n")
    first = max(1, first)
    last = min(max(first, last), len(every))
    first = min(first, len(every))
    code = "\n".join(f"{i:4d}  {every[i - 1]}" for i in range(first, last + 1))
    return Block(os.path.normpath(file).replace(os.sep, "/"), lines, first, last, code)
