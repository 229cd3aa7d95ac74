"""Run manifests: what ran, with which versions and settings, over which inputs, with which results."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import platform
import subprocess
import time
from collections.abc import Iterable, Mapping
from pathlib import Path

PACKAGES = ("pyspark", "numpy", "pandas", "pyarrow")
ENVIRONMENT = ("MODEL", "OPENAI_BASE_URL", "OPENAI_TIMEOUT_S")
SECRETS = ("OPENAI_API_KEY",)


def sha256(path: str | Path, chunk: int = 1 << 20) -> str | None:
    """Hex digest of a file read in chunks; None if it is not there."""
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while block := f.read(chunk):
                digest.update(block)
    except OSError:
        return None
    return digest.hexdigest()


def git_state(folder: str = ".", most_dirty: int = 50) -> dict:
    def git(*args: str) -> str:
        try:
            return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=10).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return ""

    return {"commit": git("rev-parse", "HEAD"), "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "dirty": git("status", "--porcelain").splitlines()[:most_dirty]}


def versions(packages: Iterable[str] = PACKAGES) -> dict:
    out = {}
    for p in packages:
        try:
            out[p] = importlib.metadata.version(p)
        except importlib.metadata.PackageNotFoundError:
            out[p] = None
    return out


def gpus() -> list[str]:
    """The graphics processors that the driver's host reports, none if it has no tool to ask."""
    try:
        done = subprocess.run(["nvidia-smi", "--query-gpu=name,memory.total", "--format=csv,noheader"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.SubprocessError):
        return []
    return done.stdout.strip().splitlines() if done.returncode == 0 else []


class Manifest:
    """Collects a run's provenance and writes it as JSON; start() and done() mark its life."""

    def __init__(self, folder: str | Path, config: Mapping | None = None, spark=None):
        self.folder = Path(folder)
        self.data = {"config": dict(config or {}), "git": git_state(), "versions": versions(), "host": platform.node(), "platform": platform.platform(), "python": platform.python_version(), "gpus": gpus(), "inputs": {}, "usage": {}, "results": {}}
        self.data["environment"] = {k: os.environ[k] for k in ENVIRONMENT if k in os.environ}
        self.data["environment"] |= {k: hashlib.sha256(os.environ[k].encode()).hexdigest()[:16] for k in SECRETS if os.environ.get(k)}
        if spark is not None:
            self.data["spark"] = {"version": spark.version, "settings": {k: v for k, v in spark.sparkContext.getConf().getAll() if not any(s in k.lower() for s in ("password", "secret", "token", "key"))}}

    def _mark(self, name: str) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / name).write_text(str(time.time()))

    def start(self) -> Manifest:
        self.data["started"] = time.time()
        self._mark("STARTED")
        return self

    def add_inputs(self, paths: Iterable[str | Path]) -> Manifest:
        self.data["inputs"] |= {str(p): sha256(p) for p in paths}
        return self

    def add_dataset(self, root: str | Path, name: str) -> Manifest:
        """The hash of every data file of a dataset on a local disk, in the order of their names."""
        folder = Path(str(root).removeprefix("file://")) / name
        self.data.setdefault("datasets", {})[name] = {str(p.relative_to(folder)): sha256(p) for p in sorted(folder.rglob("*.parquet")) if p.is_file()}
        return self

    def add_results(self, paths: Iterable[str | Path]) -> Manifest:
        self.data["results"] |= {str(p): sha256(p) for p in paths}
        return self

    def add_usage(self, usage: Mapping) -> Manifest:
        self.data["usage"] = dict(usage)
        return self

    def done(self) -> Path:
        self.data["finished"] = time.time()
        self.folder.mkdir(parents=True, exist_ok=True)
        out = self.folder / "manifest.json"
        out.write_text(json.dumps(self.data, indent=2, default=str))
        self._mark("DONE")
        return out
