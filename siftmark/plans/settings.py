"""Settings of an engine: limits with bounds, repositories, editions; read from TOML, JSON or the YAML that requests use."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields, replace

from siftmark.plans.request import parse_yaml

# Each limit's default, least and greatest value.
LIMITS = {
    "max_results": (100, 1, 10_000), "window_lines": (150, 20, 2_000), "full_file_lines": (350, 1, 10_000), "source_chars": (140_000, 10_000, 10_000_000), "path_results": (12, 1, 1_000),
    "candidates": (500, 10, 100_000), "hydrated": (18, 1, 500), "per_file": (2, 1, 100), "per_repo": (8, 1, 500), "refresh_seconds": (180, 10, 86_400), "commits": (1_000, 1, 1_000_000), "similar_cases": (5, 0, 100),
}
# What each edition adds to the one before it.
EDITIONS = {"core": (), "semantic": ("semantic",), "precision": ("semantic", "rerank")}


@dataclass(frozen=True)
class Settings:
    """Limits within their bounds, the names of the repositories and the edition."""

    edition: str = "core"
    repositories: tuple[str, ...] = ()
    branches: tuple[str, ...] = ("main", "master", "develop")
    limits: dict[str, int] = field(default_factory=lambda: {k: v[0] for k, v in LIMITS.items()})

    def can(self, capability: str) -> bool:
        """Whether the edition has a capability (``semantic``, ``rerank``)."""
        return capability in EDITIONS[self.edition]

    def scope(self, names: list[str] | None = None) -> tuple[str, ...]:
        """The repositories of a request: those named, all if none is; one that is not known is an error."""
        unknown = set(names or ()) - set(self.repositories)
        if unknown:
            raise ValueError("no such repository: " + ", ".join(sorted(unknown)))
        return tuple(r for r in self.repositories if not names or r in names)


def read_settings(text: str, form: str = "toml") -> Settings:
    """Settings from a text in ``toml``, ``json`` or ``yaml``. Limits are moved into their bounds; unknown names and editions are errors."""
    data = {"toml": tomllib.loads, "json": json.loads, "yaml": parse_yaml}[form](text) or {}
    known = {f.name for f in fields(Settings)}
    if set(data) - known:
        raise ValueError("unknown settings: " + ", ".join(sorted(set(data) - known)))
    base = Settings()
    edition = data.get("edition", base.edition)
    if edition not in EDITIONS:
        raise ValueError("edition has to be one of " + ", ".join(EDITIONS))
    given = data.get("limits") or {}
    if set(given) - set(LIMITS):
        raise ValueError("unknown limits: " + ", ".join(sorted(set(given) - set(LIMITS))))
    limits = {k: min(max(int(given.get(k, default)), low), high) for k, (default, low, high) in LIMITS.items()}
    repositories = tuple(r if isinstance(r, str) else r["name"] for r in data.get("repositories") or ())
    if len(set(repositories)) < len(repositories):
        raise ValueError("two repositories have one name")
    return replace(base, edition=edition, repositories=repositories, branches=tuple(data.get("branches") or base.branches), limits=limits)
