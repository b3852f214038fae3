"""Randomness by hash, budgets and noise: results do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the scores of the token, prompt and paraphrase mechanisms, and of the vector mechanism.
TOKEN_CLIP = (-3.2093127, 16.304797887802124)
PROMPT_CLIP = (-19.227, 7.483)
PARAPHRASE_CLIP = (-96.852, -8.748)
VECTOR_SIGMA, VECTOR_SIGMAS, VECTOR_DELTA = 0.2, 0.5, 1e-5


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key and a seed."""
    digest = F.substring(F.md5(F.concat(key, F.lit(f"|{seed}"))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)


def normal(key: Column, seed: int) -> Column:
    """A standard normal number from a key (Box-Muller)."""
    u = F.greatest(uniform(key, seed), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(key, seed + 1))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def temperature(epsilon: Column, clip: tuple[float, float] = TOKEN_CLIP) -> Column:
    """Temperature at which a draw over clipped scores spends epsilon."""
    return 2 * F.lit(abs(clip[1] - clip[0])) / epsilon


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though lambdas in ``use`` refer to it for every element."""
    return F.transform(F.array(value), use)[0]


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """array<double>: soft-max with the greatest value taken off; an empty array stays empty."""
    if temperature <= 0:
        raise ValueError("the temperature must be above 0")
    share = lambda exps, total: F.when(F.isnan(total) | (total <= 0), F.transform(exps, lambda v: F.lit(1.0) / F.size(exps))).otherwise(F.transform(exps, lambda v: v / total))
    summed = lambda exps: let(F.aggregate(exps, F.lit(0.0), lambda a, v: a + v), lambda total: share(exps, total))
    return let(values, lambda held: let(F.array_max(held), lambda top: let(F.transform(held, lambda v: F.exp((v - top) / temperature)), summed)))


def token_budgets(weights: Column, epsilon: Column, ratio: Column) -> Column:
    """array<double>: each token's budget; their harmonic mean is epsilon times the ratio."""
    return let(weights, lambda held: F.transform(held, lambda w: epsilon * ratio / (w * F.size(held))))


def gaussian_scale(size: int, epsilon: float, sigma: float = VECTOR_SIGMA, sigmas: float = VECTOR_SIGMAS, delta: float = VECTOR_DELTA) -> float:
    """Scale of the Gaussian mechanism on a clipped vector."""
    sensitivity = 2 * sigma * sigmas * math.sqrt(size)
    return math.sqrt(sensitivity**2 / epsilon**2 * 2 * math.log(1.25 / delta))


def noisy_vector(vector: Column, key: Column, size: int, epsilon: float, seed: int = 7) -> Column:
    """The vector clipped and with Gaussian noise by hash."""
    scale = gaussian_scale(size, epsilon)
    clipped = lambda v: clamp(v.cast("double"), -VECTOR_SIGMA, VECTOR_SIGMA * VECTOR_SIGMAS)
    return F.transform(vector, lambda v, i: clipped(v) + scale * normal(F.concat_ws(":", key, i), seed))
