"""Text generation behind an interface: a transport is injected or named in a registry."""

from __future__ import annotations

from collections.abc import Callable

from weftlake.config import Settings

Transport = Callable[[str, str, str], str]  # (system, user, model) -> text
REGISTRY: dict[str, Transport] = {}


def register(provider: str, transport: Transport) -> None:
    REGISTRY[provider] = transport


def transport_for(settings: Settings, registry: dict[str, Transport] | None = None) -> Transport:
    """The transport of the mode: ``local`` uses the one registered under that name,
    ``remote`` the model's provider."""
    known = REGISTRY if registry is None else registry
    name = "local" if settings.mode == "local" else settings.optimizer_model.partition("/")[0]
    if settings.mode != "local" and "/" not in settings.optimizer_model:
        raise ValueError(f"no provider in model name: {settings.optimizer_model}")
    if name not in known:
        raise ValueError(f"unknown provider: {name}")
    return known[name]


def generate(user: str, settings: Settings, system: str = "", model: str | None = None, transport: Transport | None = None) -> str:
    """One prompt to text; the model defaults to the settings' own."""
    return (transport or transport_for(settings))(system, user, model or settings.optimizer_model)
