"""Settings from a file and the process."""

from __future__ import annotations

import os
from pathlib import Path


def read(path: str) -> dict[str, str]:
    """KEY=VALUE lines; empty ones and those after `#` are passed over, quotes around a value go. A file
    that is not there has none."""
    file = Path(path)
    out = {}
    for line in file.read_text(encoding="utf-8").splitlines() if file.is_file() else ():
        name, sign, value = line.strip().partition("=")
        if sign and name.strip() and not name.lstrip().startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return out


def setting(name: str, default: str | None = None, path: str = ".env") -> str | None:
    """What the process' environment says, else the file, else the default."""
    return os.environ.get(name) or read(path).get(name) or default
