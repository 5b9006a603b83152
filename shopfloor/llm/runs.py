"""Array work on texts: word positions and 128-bit word hashes for a batch of
texts at once, used inside tasks."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)      # odd multipliers


def _powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the two multipliers and of their inverses, grown as needed."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int):
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up = [_powers(p, self.n) for p in _P]
            self.down = [_powers(np.uint64(pow(int(p), -1, 1 << 64)), self.n) for p in _P]
        return self


def mix(h: np.ndarray) -> np.ndarray:
    """Bit mixing of 64-bit values (one to one)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers, which=(0, 1)) -> list[np.ndarray]:
    """Polynomial hashes of codes[start:end], from one running sum each."""
    powers.upto(len(codes) + 1)
    out = []
    wide = codes.astype(np.uint64) + np.uint64(1)
    for k in which:
        total = np.empty(len(codes) + 1, np.uint64)
        total[0] = 0
        np.cumsum(wide * powers.up[k][:len(codes)], out=total[1:])
        h = (total[ends] - total[starts]) * powers.down[k][starts]
        out.append(mix(h + (ends - starts).astype(np.uint64) * _P[1 - k]))
    return out
