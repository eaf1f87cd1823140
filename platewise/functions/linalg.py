"""Dense d-by-d helpers used inside tasks; never applied to row-sized matrices."""

import numpy as np

ILL_CONDITIONED = 1e10


def sym_power(matrix: np.ndarray, power: float, floor: float = 1e-10) -> np.ndarray:
    """Power of a symmetric matrix with its eigenvalues floored."""
    values, vectors = np.linalg.eigh(matrix)
    return (vectors * np.maximum(values, floor) ** power) @ vectors.T


def condition(matrix: np.ndarray) -> float:
    singular = np.linalg.svd(matrix, compute_uv=False)
    return float("inf") if singular[-1] == 0 else float(singular[0] / singular[-1])


def eigen_desc(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order; the signs of the vectors are fixed."""
    values, vectors = np.linalg.eigh(matrix)
    return values[::-1], fixed_signs(vectors[:, ::-1])


def fixed_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns whose largest entry is positive, the first one of those that are equal but for rounding."""
    size = np.abs(vectors)
    lead = (size >= size.max(axis=0) * (1 - 1e-9)).argmax(axis=0)
    signs = np.sign(vectors[lead, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1.0, signs)


def whitening(cov: np.ndarray, k: int, floor: float) -> np.ndarray:
    """d-by-k map onto the first k components with unit variance."""
    values, vectors = eigen_desc(cov)
    return vectors[:, :k] / np.sqrt(np.maximum(values[:k], floor))


def shrunk_cov(n: float, scatter: np.ndarray, fourth: float) -> np.ndarray:
    """Ledoit-Wolf covariance from a centred scatter matrix and the sum of |x|^4."""
    p = scatter.shape[0]
    s = scatter / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = max((fourth / n - (s ** 2).sum()) / (n * p), 0.0)
    share = 0.0 if delta == 0 else min(beta, delta) / delta
    return (1 - share) * s + share * mu * np.eye(p)
