"""Configuration from a YAML file; relative paths are relative to the file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

REQUIRED = ("doc_root", "data_dir", "index_dir", "manifest_path", "chat_history_path")


@dataclass(frozen=True)
class Config:
    doc_root: str
    data_dir: str
    index_dir: str
    manifest_path: str
    chat_history_path: str
    include_ext: tuple[str, ...] = (".md", ".txt")
    chunk_chars: int = 4000
    chunk_overlap: int = 500
    top_k: int = 10
    scan_interval_minutes: int = 15
    embedding_model: str = "text-embedding-3-small"
    chat_model: str = "gpt-4.1-mini"
    max_history_turns: int = 12
    max_sources_chars: int = 35000
    max_file_size_mb: float = 8
    max_chunks_per_file: int = 2000


def load_config(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    missing = [k for k in REQUIRED if not raw.get(k)]
    if missing:
        raise ValueError(f"missing in {path}: {', '.join(missing)}")
    base = os.path.dirname(os.path.abspath(path))
    known = {f.name for f in fields(Config)}
    values = {k: v for k, v in raw.items() if k in known and v is not None}
    values |= {k: os.path.join(base, os.path.expanduser(str(values[k]))) for k in REQUIRED}
    if "include_ext" in values:
        values["include_ext"] = tuple(values["include_ext"])
    return Config(**values)
