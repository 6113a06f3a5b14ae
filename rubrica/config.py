"""Engine settings; immutable for each call."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    acceptance_threshold: int = 60
    phash_threshold: int = 5
    enable_year: bool = False
    enable_geotag: bool = False
    #: The year that dates are held against; 0 is the year of the run.
    current_year: int = 0
    max_calls: int = 5
    rpm: int = 148
    safety: float = 0.98
    fallback_rpm: int = 25
    fallback_safety: float = 0.8
    #: Delays are multiplied by a number between these two.
    jitter_low: float = 0.9
    jitter_high: float = 1.6
    breaker_rate: float = 0.70
    breaker_window_s: float = 30
    breaker_cooldown_s: float = 10
    breaker_min_errors: int = 20
    breaker_min_requests: int = 10
    #: Calls at a time over the whole job, of the first and of the fallback provider.
    max_concurrent: int = 6
    fallback_concurrent: int = 1
    attempts: int = 3
    text_chars: int = 4000
    legacy_text_chars: int = 3000
    fetch_timeout_s: float = 30
    retention_s: int = 86400
    base_path: str = "https://storage.example.org/container/"
    institute_path: str = "https://storage.example.org/container/uploads/institutes"

    @classmethod
    def from_env(cls, prefix: str = "RUBRICA_") -> EngineConfig:
        def read(kind: type, value: str):
            return value.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)

        named = {f.name: prefix + f.name.upper() for f in fields(cls)}
        return cls(**{f.name: read(type(f.default), os.environ[named[f.name]]) for f in fields(cls) if named[f.name] in os.environ})

    def bases(self) -> dict[int, str]:
        return {1: self.base_path, 2: self.base_path, 3: self.institute_path, 4: self.institute_path}


def effective_limit(rpm: int, safety: float) -> int:
    """Requests a minute that the limiter admits: the safety factor never exceeds 0.95."""
    return int(rpm * min(safety, 0.95))
