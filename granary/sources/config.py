"""Settings from YAML: ingest, bots, generation, personas."""

from __future__ import annotations

import functools
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def load_yaml(path: str | Path) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


@dataclass
class Ingest:
    chunk_size: int = 900
    chunk_overlap: int = 120
    dedup_threshold: float = 0.90
    shingle: int = 5
    max_mb: float = 32.0
    enable_paraphrase: bool = False
    ocr_images: bool = False
    dedup_simhash: bool = False
    dedup_semantic: bool = False

    @classmethod
    def load(cls, path: str | Path) -> Ingest:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in load_yaml(path).items() if k in known})


@functools.lru_cache(maxsize=16)
def _bot(path: str) -> dict:
    return load_yaml(path)


def load_bot(bots: str, name: str) -> dict:
    path = Path(bots, name, "bot.yaml")
    if not path.exists():
        raise FileNotFoundError(f"no configuration of bot {name}")
    return _bot(str(path))


def bot_paths(bots: str, name: str) -> dict[str, str]:
    """Where a bot's files and tables are, with defaults below its own folder."""
    own = load_bot(bots, name).get("paths", {})
    return {k: own.get(k, str(Path(bots, name, "data", v))) for k, v in {"raw_dir": "raw", "tables": "tables"}.items()}


def list_bots(bots: str) -> list[dict]:
    """Name and description of each folder that has a readable bot.yaml."""
    out = []
    for folder in sorted(Path(bots).iterdir()) if Path(bots).is_dir() else []:
        try:
            own = load_bot(bots, folder.name)
        except Exception:
            continue
        out.append({"name": folder.name, "description": own.get("description", "")})
    return out


def personas(spark: SparkSession, path: str | Path) -> DataFrame:
    """(key, name, style, directives)."""
    rows = [(k, v.get("name", k), v.get("style", ""), v.get("directives", "")) for k, v in load_yaml(path).items()]
    return spark.createDataFrame(rows, "key string, name string, style string, directives string")
