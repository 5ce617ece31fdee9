"""Where a deployment keeps its files, and what a fetch needs."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

KEY_VARIABLE = "VINTAGE_API_KEY"


class ConfigError(ValueError):
    """Something that a command needs isn't set. The message never has a value."""


@dataclass(frozen=True)
class Config:
    """Paths below one root; the key comes from the environment, and is never shown."""

    root: Path = Path(".")
    key_variable: str = KEY_VARIABLE
    key: str = field(default="", repr=False)

    @classmethod
    def of(cls, root: str | Path, key_variable: str = KEY_VARIABLE) -> Config:
        return cls(Path(root), key_variable, os.environ.get(key_variable, ""))

    @property
    def store(self) -> str:
        return str(self.root / "store")

    @property
    def frozen(self) -> str:
        return str(self.root / "frozen.jsonl")

    @property
    def outputs(self) -> str:
        return str(self.root / "outputs")

    def check_fetch(self) -> None:
        if not self.key:
            raise ConfigError(f"{self.key_variable} isn't set")

    def ensure(self) -> None:
        for folder in (self.root, Path(self.outputs)):
            folder.mkdir(parents=True, exist_ok=True)
