"""Public names of a package, imported when they are first asked for: workers import packages often and need few names."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module


def exports(package: str, names: dict[str, str]) -> tuple[Callable[[str], object], list[str]]:
    """(module __getattr__, __all__); names: public name -> module below the package."""

    def get(name: str) -> object:
        if name not in names:
            raise AttributeError(f"{package} has no {name}")
        return getattr(import_module(f"{package}.{names[name]}"), name)

    return get, sorted(names)
