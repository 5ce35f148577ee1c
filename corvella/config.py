"""Knowledge bases and their registry: a YAML file, and *.local.yaml beside it on top."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

PERFORMANCE = {"embed_batch_size": 64, "image_batch_size": 64, "rerank_recall_size": 24, "top_k": 8, "warmup_on_index": True}


class UnknownKB(KeyError):
    pass


class BadConfig(ValueError):
    pass


@dataclass(frozen=True)
class KBConfig:
    name: str
    root: str
    type: str = "text"
    patterns: tuple[str, ...] = ()
    path_filter: str | None = None
    dimensions: int = 1024
    embed_model: str = ""
    max_file_bytes: int = 5_000_000
    max_files: int | None = 10_000  # None: all
    vector_backend: str = "snapshot"
    extra: dict = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, given: dict, defaults: dict | None = None) -> KBConfig:
        """From a mapping: what the knowledge base says, then defaults, then the class's own."""
        known = {f.name for f in fields(cls)} - {"name", "extra"}
        merged = {k: v for k, v in ((defaults or {}) | given).items() if v is not None}
        if "root" not in merged:
            raise BadConfig(f"{name}: no root")
        values = {k: v for k, v in merged.items() if k in known}
        if "patterns" in values:
            values["patterns"] = tuple(values["patterns"])
        return cls(name=name, extra={k: v for k, v in given.items() if k not in known}, **values)


def _merged(a: dict, b: dict) -> dict:
    return a | {k: _merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def whole(path: str) -> dict:
    """The registry with its local files on top."""
    import yaml

    at = Path(path)
    try:
        found = yaml.safe_load(at.read_text(encoding="utf-8")) or {}
        for more in sorted(at.parent.glob("*.local.yaml")):
            found = _merged(found, yaml.safe_load(more.read_text(encoding="utf-8")) or {})
    except (OSError, yaml.YAMLError) as e:
        raise BadConfig(str(e)) from e
    return found


def services(path: str) -> dict:
    """What the registry says of model services."""
    return whole(path).get("services") or {}


def load(path: str) -> tuple[dict[str, KBConfig], dict]:
    """All knowledge bases by name, and the performance settings."""
    read = whole(path)
    text = (read.get("text_backend") or {}).get("embedding") or {}
    defaults = {"vector_backend": read.get("vector_backend"), "dimensions": text.get("dimensions"), "embed_model": text.get("model")}
    found = read.get("knowledge_bases") or {}
    return {n: KBConfig.of(n, kb or {}, defaults) for n, kb in found.items()}, PERFORMANCE | (read.get("performance") or {})


def pick(kbs: dict[str, KBConfig], name: str) -> KBConfig:
    if name not in kbs:
        raise UnknownKB(name)
    return kbs[name]
