"""Driver-side settings: YAML mappings, environment files, API limits."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields
from pathlib import Path


def load_yaml(path: str) -> dict:
    """A YAML mapping; anything else is a TypeError. Without a YAML library, plain nested ``key: value`` lines are read."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    try:
        import yaml
    except ImportError:
        return _plain(raw)
    data = yaml.safe_load(raw) or {}
    if not isinstance(data, dict):
        raise TypeError(f"expected a mapping in {path}, got {type(data).__name__}")
    return data


def _plain(raw: str) -> dict:
    root: dict = {}
    levels: list[tuple[int, dict]] = [(-1, root)]
    for line in raw.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        if ":" not in body:
            raise TypeError("expected a mapping")
        indent = len(body) - len(body.lstrip())
        key, _, value = body.strip().partition(":")
        while levels[-1][0] >= indent:
            levels.pop()
        value = value.strip()
        if value:
            levels[-1][1][key] = _scalar(value)
        else:
            levels[-1][1][key] = child = {}
            levels.append((indent, child))
    return root


def _scalar(value: str):
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value.strip("\"'")


ENTRY = re.compile(r"""^[ \t]*(?:export[ \t]+)?([^#\s=][^=\n]*?)[ \t]*=[ \t]*(.*?)[ \t]*$""", re.M)


def load_env(*paths: str) -> dict[str, str]:
    """Sets and returns what the files say and the environment does not have yet; the first file wins."""
    texts = [Path(p).read_text(encoding="utf-8") for p in paths or (".env.local", ".env") if os.path.exists(p)]
    found: dict[str, str] = {}
    for key, value in (m.groups() for text in texts for m in ENTRY.finditer(text)):
        if key not in os.environ:
            os.environ[key] = found[key] = value.strip("\"").strip("'")
    return found


@dataclass(frozen=True)
class ApiSettings:
    provider: str = "offline"
    runtime_model: str = "offline"
    experiment_model: str = "offline"
    temperature: float = 0.0
    top_p: float = 1.0
    max_tokens_runtime: int = 48
    max_tokens_dataset: int = 96
    connect_timeout: float = 0.15
    read_timeout: float = 0.30
    total_timeout: float = 0.45
    max_retries: int = 1
    requests_per_minute: int = 30
    tokens_per_minute: int = 6000
    prompt_version: str = "v1"
    dataset_prompt_version: str = "v1"

    @classmethod
    def from_yaml(cls, path: str | None = None) -> ApiSettings:
        """Settings under our names or those of settings files (``ALSO``). A key that is neither is a TypeError, so no limit is
        silently left at its default."""
        data = {ALSO.get(k, k): v for k, v in (load_yaml(path) if path else {}).items()}
        if unknown := set(data) - {f.name for f in fields(cls)}:
            raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**data)


#: Names of settings files. Fixed values.
ALSO = {"connect_timeout_sec": "connect_timeout", "read_timeout_sec": "read_timeout", "total_timeout_sec": "total_timeout", "target_rpm": "requests_per_minute", "target_tpm": "tokens_per_minute"}
