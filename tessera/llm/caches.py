"""Caches of a worker process.  Workers outlive stages, so only the kind in use keeps its entries."""

from __future__ import annotations

_holder: dict | None = None


def hold(cache: dict) -> None:
    """``cache`` is in use from now on; the one before is emptied."""
    global _holder
    if _holder is not cache:
        if _holder is not None:
            _holder.clear()
        _holder = cache
