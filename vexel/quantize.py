"""Data-oblivious scalar quantisation of unit vectors.

A vector is normalised and turned by one fixed random rotation, after which every coordinate has
the same known density, that of a coordinate of a random point on the sphere. A Lloyd-Max
codebook for that density gives 2 to 4 bits for each coordinate. A scale for each vector makes its inner
product with its own reconstruction exact, so estimates don't shrink.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ROTATION_SEED = 42


def rotation(dim: int, seed: int = ROTATION_SEED) -> np.ndarray:
    """Orthogonal matrix from the QR decomposition of a seeded Gaussian one, signs fixed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def codebook(dim: int, bits: int) -> np.ndarray:
    """Lloyd-Max levels, ascending, for the density proportional to ``(1 - x^2)^((dim - 3) / 2)``."""
    x = np.linspace(-1, 1, 40_001)[1:-1]
    density = (1 - x * x) ** ((dim - 3) / 2)
    mass, moment = np.cumsum(density), np.cumsum(density * x)
    n = 1 << bits
    levels = x[np.searchsorted(mass / mass[-1], (np.arange(n) + 0.5) / n)]
    for _ in range(500):
        cuts = np.searchsorted(x, (levels[1:] + levels[:-1]) / 2)
        m = np.diff(np.concatenate([[0], mass[cuts], [mass[-1]]]))
        s = np.diff(np.concatenate([[0], moment[cuts], [moment[-1]]]))
        new = np.where(m > 0, s / np.where(m > 0, m, 1), levels)
        if np.abs(new - levels).max() < 1e-9:
            break
        levels = new
    return ((levels - levels[::-1]) / 2).astype(np.float32)


@dataclass
class Quantizer:
    """Encoder and scorer for one dimension and bit width."""

    dim: int
    bits: int = 4
    seed: int = ROTATION_SEED
    levels: np.ndarray = field(init=False)
    turn: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        if not 2 <= self.bits <= 4:
            raise ValueError("bit width must be from 2 to 4")
        if self.dim < 8 or self.dim % 8:
            raise ValueError("the dimension must be a multiple of 8")
        self.levels, self.turn = codebook(self.dim, self.bits), rotation(self.dim, self.seed)

    def prepare(self, query: np.ndarray, normalize: bool = True) -> np.ndarray:
        """A query ready for scoring: normalised, if asked for, and rotated."""
        q = query.astype(np.float32)
        if len(q) != self.dim:
            raise ValueError(f"expected dimension {self.dim}, got {len(q)}")
        norm = float(np.sqrt((q.astype(float) ** 2).sum()))
        return (q / norm if normalize and norm > 0 else q) @ self.turn.T

    def encode(self, vectors: np.ndarray, normalize: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Codes (one byte a coordinate) and scales of rows; a zero vector has scale 0."""
        v = np.asarray(vectors, dtype=np.float32)
        norm = np.sqrt((v.astype(float) ** 2).sum(axis=1))
        unit = (v / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32) @ self.turn.T
        codes = np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, unit).astype(np.uint8)
        match = (unit * self.levels[codes]).sum(axis=1)
        scale = np.where((norm > 0) & (match > 0), 1 / np.where(match > 0, match, 1), 0)
        return codes, (scale if normalize else scale * norm).astype(np.float32)

    def scores(self, prepared: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Estimated inner products."""
        return (self.levels[codes] @ prepared * scale).astype(float)

    def pack(self, codes: np.ndarray) -> list[bytes]:
        """Codes as bit planes, ``dim / 8`` bytes for each bit."""
        planes = [np.packbits((codes >> b) & 1, axis=1) for b in range(self.bits)]
        return [row.tobytes() for row in np.concatenate(planes, axis=1)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        if not packed:
            return np.zeros((0, self.dim), dtype=np.uint8)
        raw = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), self.bits, self.dim // 8)
        planes = np.unpackbits(raw, axis=2)
        return sum(planes[:, b] << b for b in range(self.bits)).astype(np.uint8)

    def self_score(self, vector: np.ndarray) -> float:
        """Estimated similarity of a vector with itself by its plain reconstruction: how much quantising loses."""
        codes, _ = self.encode(vector[None, :])
        return float(self.levels[codes[0]] @ self.prepare(vector))
