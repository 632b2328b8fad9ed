"""Configuration: one JSON object, a section per analyzer, hashed over its raw bytes."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

DEFAULT = "factloom.config.json"


def path_of(root: Path, given: str = "") -> Path:
    return Path(given) if given else root / DEFAULT


def load(path: Path) -> dict[str, bytes]:
    """Raw bytes of every section; a missing file has none, a folder is an error."""
    if path.is_dir():
        raise IsADirectoryError(f"config path {path} is a directory")
    if not path.exists():
        return {}
    text = path.read_text(encoding="utf-8")
    return sections(text)


def sections(text: str) -> dict[str, bytes]:
    decoder, out, at = json.JSONDecoder(), {}, 0

    def space(i: int) -> int:
        while i < len(text) and text[i] in " \t\r\n":
            i += 1
        return i

    at = space(at)
    if text[at : at + 1] != "{":
        raise ValueError("configuration must be a JSON object")
    at = space(at + 1)
    while text[at : at + 1] != "}":
        key, at = decoder.raw_decode(text, at)
        at = space(at)
        if text[at : at + 1] != ":":
            raise ValueError("configuration is not valid JSON")
        at = space(at + 1)
        _, end = decoder.raw_decode(text, at)
        out[key] = text[at:end].encode()
        at = space(end)
        if text[at : at + 1] == ",":
            at = space(at + 1)
    return out


def hash_of(section: bytes | None) -> str:
    return hashlib.sha256(section).hexdigest() if section else ""
