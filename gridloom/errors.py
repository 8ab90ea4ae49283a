"""Errors raised while a DataFrame is built, before any task runs."""

from __future__ import annotations


class BindError(ValueError):
    """A declaration that does not fit the data or the rules. ``category`` says which rules."""

    def __init__(self, category: str, message: str):
        super().__init__(f"[{category}] {message}")
        self.category = category


class SourceError(OSError):
    """An object that can't be opened or read, with the kind of failure in ``category``."""

    def __init__(self, category: str, message: str):
        super().__init__(f"[{category}] {message}")
        self.category = category
