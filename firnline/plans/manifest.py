"""A record of a run: parameters in effect, code state, inputs, timings."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import platform
import subprocess
import time
from pathlib import Path

WHOLE_BELOW = 2 << 30
ENDS = 8 << 20


def plain(x):
    """Anything, as JSON can hold it."""
    if dataclasses.is_dataclass(x):
        return plain(dataclasses.asdict(x))
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def digest(path: str | Path) -> dict:
    """Size, time and checksum; of very large files, of head and tail."""
    p = Path(str(path).removeprefix("file://"))
    if p.is_dir():
        parts = [digest(f) for f in sorted(p.rglob("*")) if f.is_file() and not f.name.startswith((".", "_"))]
        h = hashlib.sha256("\n".join(f"{Path(f['path']).relative_to(p)} {f['bytes']} {f['sha256']}" for f in parts).encode())
        return {"path": str(p), "exists": True, "files": len(parts), "bytes": sum(f["bytes"] for f in parts), "sha256": h.hexdigest(), "whole": all(f["whole"] for f in parts)}
    if not p.is_file():
        return {"path": str(p), "exists": p.exists()}
    size, h = p.stat().st_size, hashlib.sha256()
    with p.open("rb") as f:
        if size <= WHOLE_BELOW:
            while block := f.read(1 << 20):
                h.update(block)
        else:
            h.update(f.read(ENDS))
            f.seek(size - ENDS)
            h.update(f.read())
    return {"path": str(p), "exists": True, "bytes": size, "mtime": p.stat().st_mtime, "sha256": h.hexdigest(), "whole": size <= WHOLE_BELOW}


def code_state(folder: str | Path = ".") -> dict:
    def git(*a):
        try:
            return subprocess.run(["git", "-C", str(folder), *a], capture_output=True, text=True, timeout=20).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return ""

    return {"commit": git("rev-parse", "HEAD"), "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "dirty": bool(git("status", "--porcelain"))}


def packages(names=("pyspark", "numpy", "pandas", "pyarrow")) -> dict:
    from importlib import metadata

    out = {"python": platform.python_version()}
    for n in names:
        try:
            out[n] = metadata.version(n)
        except metadata.PackageNotFoundError:
            out[n] = None
    return out


class Manifest:
    def __init__(self, path: str | Path, config, source: str = "unknown", inputs=()):
        """inputs: paths whose sizes and checksums are recorded."""
        self.path, self.began = Path(path), time.time()
        self.data = {
            "config": plain(config), "config_source": source, "code": code_state(), "packages": packages(),
            "inputs": [digest(p) for p in inputs if p], "steps": {}, "failures": {}, "warnings": [], "status": "running",
        }
        self.write()

    def step(self, name: str, seconds: float, **more) -> None:
        self.data["steps"][name] = {"min": round(seconds / 60, 4)} | plain(more)
        self.write()

    def failed(self, name: str, error: BaseException) -> None:
        """A step that failed and was left out."""
        self.data["failures"][name] = f"{type(error).__name__}: {error}"[:2000]
        self.write()

    def warn(self, text: str) -> None:
        self.data["warnings"].append(text)
        self.write()

    def finish(self, status: str, error: str = "") -> None:
        """Never raises: a run's outcome stands whatever happens here."""
        self.data |= {"status": status, "wall_clock_min": round((time.time() - self.began) / 60, 4)}
        if error:
            self.data["error"] = error
        try:
            self.write()
        except OSError:
            pass

    def write(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(self.data, indent=1))
