"""Intermediate tables in the shared folder, as the rest of the library writes them."""

from __future__ import annotations

from quarrymill.functions.scratch import cleared, dropped, own_dir, shared_dir, written

__all__ = ["cleared", "dropped", "own_dir", "shared_dir", "written"]
