"""Settings of live pulls: a TOML file, the environment, then overrides; unknown keys are errors."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

FILE = "quarry.toml"


@dataclass(frozen=True)
class Settings:
    email: str | None = None
    app_name: str = "quarry"
    app_version: str = "0.1"
    max_concurrent: int = 1
    min_delay_ms: int = 500
    max_retries: int = 5
    cache_dir: str | None = None

    def user_agent(self) -> str:
        """Who is asking; services want an address to write to."""
        if not re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", self.email or ""):
            raise ValueError("email is missing or malformed")
        return f"{self.app_name}/{self.app_version} (+{self.email})"

    def requests_a_second(self) -> float:
        """What the settings allow at most: each of max_concurrent slots waits min_delay_ms before a request."""
        return self.max_concurrent / max(self.min_delay_ms, 1) * 1000

    def merged(self, values: dict) -> Settings:
        known = {f.name: f.type for f in fields(self)}
        if unknown := sorted(set(values) - set(known)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return replace(self, **{k: int(v) if "int" in known[k] else v for k, v in values.items() if v is not None})


def found_upwards(start: str | Path, name: str = FILE) -> Path | None:
    folder = Path(start).resolve()
    return next((p / name for p in [folder, *folder.parents] if (p / name).is_file()), None)


def load(path: str | Path | None = None, environment: dict[str, str] | None = None, **overrides) -> Settings:
    """From a file (or the nearest one upwards of the working folder), QUARRY_* variables, then overrides."""
    path = Path(path) if path else found_upwards(os.getcwd())
    out = Settings()
    if path:
        out = out.merged(tomllib.loads(path.read_text()))
    env = os.environ if environment is None else environment
    out = out.merged({f.name: env[f"QUARRY_{f.name.upper()}"] for f in fields(out) if f"QUARRY_{f.name.upper()}" in env})
    return out.merged(overrides)
