"""Settings, from the environment or given directly."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Crawler:
    concurrency: int = 8
    delay_ms: int = 200
    user_agent: str = "weftlake/1.0"
    respect_robots: bool = True


@dataclass(frozen=True)
class Settings:
    mode: str = "local"
    optimizer_model: str = "local/default"
    crawler: Crawler = field(default_factory=Crawler)

    def __post_init__(self):
        if self.mode not in ("local", "remote"):
            raise ValueError(f"mode must be local or remote, not {self.mode!r}")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        e = os.environ if env is None else env
        number = lambda k, d: int(e[k]) if e.get(k, "").isdigit() else d
        crawler = Crawler(number("WEFTLAKE_CONCURRENCY", 8), number("WEFTLAKE_DELAY_MS", 200), e.get("WEFTLAKE_USER_AGENT", "weftlake/1.0"), e.get("WEFTLAKE_RESPECT_ROBOTS", "true").lower() != "false")
        return cls(e.get("WEFTLAKE_MODE", "local"), e.get("WEFTLAKE_MODEL", "local/default"), crawler)
