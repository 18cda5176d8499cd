"""Run settings with range checks."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Thresholds of discovery, selection and screening; the defaults are those of the current
    analysis."""

    k: int = 16
    pooled_min: int = 10
    hap_min: int = 500
    enrichment: float = 10.0
    broad_fraction: float = 0.9
    broad_count: int = 10
    share_family: float = 0.99
    share_strict: float = 0.999
    mismatch_radius: int = 2
    min_case_haps: int = 100
    max_queries: int = 72

    def __post_init__(self) -> None:
        if not 1 <= self.k <= 31:
            raise ValueError("k must be 1 to 31")
        for name in ("pooled_min", "hap_min", "broad_count", "min_case_haps", "max_queries"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")
        for name in ("broad_fraction", "share_family", "share_strict"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must be above 0 and at most 1")
        if self.mismatch_radius not in (0, 1, 2):
            raise ValueError("mismatch_radius must be 0, 1 or 2")

    @classmethod
    def of(cls, **values) -> Settings:
        """Settings from a mapping; unknown names are an error."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**values)

    @classmethod
    def read(cls, path: str) -> Settings:
        """Settings from a file of ``name: value`` lines, as YAML writes a flat mapping; ``#`` starts a
        comment, and values are numbers."""
        values: dict[str, int | float] = {}
        with open(path, encoding="utf-8") as f:
            for line in f:
                text = line.split("#", 1)[0].strip()
                if text:
                    name, colon, value = text.partition(":")
                    if not colon or name.strip() in values:
                        raise ValueError(f"not a setting, or set twice: {text}")
                    number = value.strip()
                    values[name.strip()] = float(number) if set(number) & set(".eE") else int(number)
        return cls.of(**values)
