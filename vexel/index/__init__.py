"""Persistent indexes: versioned Parquet datasets behind a manifest."""

from vexel.index.store import Index, IndexConflictError, IndexFormatError, IndexSpec, build_index

__all__ = ["Index", "IndexConflictError", "IndexFormatError", "IndexSpec", "build_index"]
