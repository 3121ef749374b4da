"""Configuration: nested dataclasses with YAML or JSON files, dotted overrides and a fingerprint."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from .functions import constants as C


@dataclass
class Ingestion:
    include: list[str] = field(default_factory=lambda: ["**/*.py", "**/*.md", "**/*.rst", "**/*.yaml", "**/*.yml", "**/*.toml", "**/*.json", "**/*.cfg", "**/*.ini"])
    exclude: list[str] = field(default_factory=lambda: [".git", "node_modules", "build", "dist", "__pycache__"])
    max_file_bytes: int = 400_000
    max_commits: int = 3000
    max_diff_chars: int = 4000


@dataclass
class Retrieval:
    depths: dict = field(default_factory=lambda: dict(C.DEPTHS))
    weights: dict = field(default_factory=lambda: dict(C.FUSION_WEIGHTS))
    method: str = "rrf"
    rrf_k: int = C.RRF_K
    candidates: int = C.CANDIDATES
    final: int = C.FINAL
    strict_filters: bool = True


@dataclass
class Context:
    budget: int = C.BUDGET
    chunk_tokens: int = C.CHUNK_TOKENS
    per_file: int = C.PER_FILE
    quotas: dict = field(default_factory=lambda: dict(C.QUOTAS))


@dataclass
class Agent:
    iterations: int = 4
    k: int = 8
    evidence: int = 16
    subqueries: int = 3


@dataclass
class Embedding:
    model: str = "hashing"
    dimension: int = 256


@dataclass
class Config:
    """All settings. Unknown keys raise ValueError wherever they stand."""

    repository: str = "corpus"
    index_path: str = "index"
    model: str = "echo"
    ingestion: Ingestion = field(default_factory=Ingestion)
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)
    context: Context = field(default_factory=Context)
    agent: Agent = field(default_factory=Agent)

    @classmethod
    def load(cls, path: str | None = None, **overrides) -> Config:
        """Settings of a YAML or JSON file, then of dotted overrides such as retrieval__final or {"retrieval.final": 5}."""
        found = cls()
        if path:
            text = Path(path).read_text()
            if path.endswith(".json"):
                values = json.loads(text)
            else:
                import yaml

                values = yaml.safe_load(text) or {}
            update(found, values, "")
        for name, value in overrides.items():
            *parents, last = name.replace("__", ".").split(".")
            at = found
            for p in parents:
                if not hasattr(at, p):
                    raise ValueError(f"unknown setting {name!r}")
                at = getattr(at, p)
            update(at, {last: value}, ".".join([*parents, ""]))
        return found

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    def save(self, path: str) -> None:
        if path.endswith(".json"):
            Path(path).write_text(json.dumps(self.to_dict(), indent=2, sort_keys=True))
        else:
            import yaml

            Path(path).write_text(yaml.safe_dump(self.to_dict(), sort_keys=True))

    def fingerprint(self) -> str:
        return hashlib.sha1(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()[:12]


def update(target, values: dict, where: str) -> None:
    known = {f.name for f in dataclasses.fields(target)}
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"unknown setting {where + name!r}")
        now = getattr(target, name)
        if dataclasses.is_dataclass(now) and isinstance(value, dict):
            update(now, value, f"{where}{name}.")
        else:
            setattr(target, name, value)
