"""Readers of vector files."""

from vexel.sources.files import read_text_vectors, read_vector_file

__all__ = ["read_text_vectors", "read_vector_file"]
