"""Settings: what the caller gives goes before what was saved, that before the defaults."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace

DEFAULTS = {"db": "parquet", "embedding": "local", "db_timeout_seconds": 300}
BACKENDS = ("parquet",)
FILE = "config.json"


@dataclass(frozen=True)
class Config:
    db: str | None = None
    db_url: str | None = None
    db_timeout_seconds: int | None = None
    db_file: str | None = None
    embedding: str | None = None
    collection: str | None = None


def given(value):
    """The value without outer white space, None where nothing is left."""
    if isinstance(value, str):
        return value.strip() or None
    return value


def load(state_dir: str) -> Config:
    """What was saved; unknown fields are ignored."""
    path = os.path.join(state_dir, FILE)
    if not os.path.isfile(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        saved = json.load(f)
    return Config(**{k.name: saved.get(k.name) for k in fields(Config)})


def save(state_dir: str, config: Config) -> None:
    os.makedirs(state_dir, exist_ok=True)
    with open(os.path.join(state_dir, FILE), "w", encoding="utf-8") as f:
        json.dump({k: v for k, v in asdict(config).items() if v is not None}, f, indent=2)


def merge(state_dir: str, asked: Config) -> Config:
    """Every setting by itself; a timeout is one second at least, a backend must be known."""
    saved = load(state_dir)
    found = {}
    for k in (f.name for f in fields(Config)):
        found[k] = next((x for x in (given(getattr(asked, k)), given(getattr(saved, k)), DEFAULTS.get(k)) if x is not None), None)
    found["db_timeout_seconds"] = max(1, int(found["db_timeout_seconds"]))
    if found["db"].lower() not in BACKENDS:
        raise ValueError(f"unsupported db: {found['db']}")
    config = Config(**found)
    return replace(config, db_file=os.path.abspath(config.db_file or os.path.join(state_dir, "store")))
