"""API keys: from the environment, else by asking, remembered until a service refuses them."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.text import key_variable
from ..sources.files import Provider

ASK_AGAIN = 2


@dataclass
class _Key:
    value: str | None = None
    refused: bool = False
    asked: int = 0


@dataclass
class Keys:
    """ask gets a provider's name and gives a key or None; a key is asked for once, and again ASK_AGAIN times
    at most after refusals. A refused key of the environment is not taken again."""

    ask: Callable[[str], str | None] | None = None
    held: dict[str, _Key] = field(default_factory=dict)

    def resolve(self, variable: str, label: str) -> str | None:
        key = self.held.setdefault(variable, _Key())
        if key.value is None and not key.refused:
            key.value = os.environ.get(variable, "").strip() or None
        if key.value is None and self.ask and key.asked <= ASK_AGAIN:
            key.asked += 1
            key.value = (self.ask(label) or "").strip() or None
        return key.value

    def refuse(self, variable: str) -> None:
        key = self.held.setdefault(variable, _Key())
        key.value, key.refused = None, True

    def of(self, config: Provider) -> tuple[str | None, str | None]:
        """Variable and key of a provider; both None where it needs none."""
        variable = None if config.provider.lower() == "ollama" else key_variable(config.apiKeyPreset)
        return variable, self.resolve(variable, config.apiKeyPreset or config.provider) if variable else None


def missing(variable: str) -> str:
    return f"API key not configured. Set the environment variable {variable}."
