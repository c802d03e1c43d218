"""Keyed noise: the same subject, imputation and variable always get the same draw.

Integer mixing modulo a prime fits in 62 bits, so numpy and SQL engines give the same
numbers, whatever the partitioning of the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np

# Fixed values of the mixing function: modulus 2^31 - 1 and the two lanes' multipliers and starts.
P = 2147483647
LANES = ((742938285, 362436069), (950706376, 521288629))


def _mix(h, k, a):
    x = ((h ^ k) * a) % P
    return x ^ (x >> 15)


def fold(keys):
    """Combine scalar keys to one integer below 2^31."""
    h = 88675123
    for k in keys:
        h = _mix(_mix(h, int(k) % P, LANES[0][0]), 97, LANES[1][0])
    return h % P


def subject_state(ids: np.ndarray):
    """Per-subject hash state, computed once per batch and reused for every draw. Keys that are no numbers count by a digest of their text."""
    if ids.dtype.kind not in "iu":
        ids = np.array([int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "big") >> 1 for x in ids], np.int64)
    ids = ids.astype(np.int64)
    lo, hi = ids % P, ids // P
    return [_mix(_mix(np.full(ids.shape, start, np.int64), lo, a), hi, a) for a, start in LANES]


def uniforms(state, *keys):
    k = fold(keys)
    return [(_mix(_mix(h, k, a), 1, a) % P + 0.5) / P for h, (a, _) in zip(state, LANES)]


def normals(state, *keys):
    """One standard normal per subject for the given keys (Box-Muller on the two lanes)."""
    u1, u2 = uniforms(state, *keys)
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)


def generator(*keys) -> np.random.Generator:
    """Driver-side generator for parameter draws."""
    return np.random.Generator(np.random.PCG64([int(k) for k in keys]))
