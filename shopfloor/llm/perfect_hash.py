"""Minimal perfect hashing of byte strings in shards, with the keys stored
beside their slots; lookups take arrays and are exact.  Used inside tasks.

A shard is a cascade of bit arrays.  At each level the keys left over are
hashed to twice as many bits; a key alone on its bit stays there, the others
go to the next level.  A key's slot is the rank of its bit, so slots are
dense, and the key found in the slot is compared byte for byte, so a string
that isn't a key is never taken for one.  Keys that no level separates
(hash collisions) are listed after the others and found by comparison.
"""

from __future__ import annotations

import numpy as np

from .bitvector import Bits
from .runs import Powers, hashes, mix

LEVELS = 24
_STEP = 0x9E3779B97F4A7C15


def key_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> list[np.ndarray]:
    """128 bits of hash of each key data[start:end]."""
    return hashes(data, starts, ends, powers)


def _spread(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    return mix(a + np.uint64(level + 1) * (b | np.uint64(1)) + np.uint64(level * _STEP & (1 << 64) - 1))


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces data[start:start + length], one after the other."""
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def build(keys: list[bytes], powers: Powers) -> dict:
    """A shard of different keys: level sizes, bits, and the keys in slot order."""
    lengths = np.array([len(k) for k in keys], np.int64)
    data = np.frombuffer(b"".join(keys), np.uint8)
    ends = np.cumsum(lengths)
    a, b = key_hashes(data, ends - lengths, ends, powers)
    left, sizes, flags, order = np.arange(len(keys)), [], [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = -(-2 * len(left) // 64) * 64
        at = (_spread(a[left], b[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        stays = alone[at]
        order.append(left[stays][np.argsort(at[stays])])
        sizes.append(size)
        flags.append(alone)
        left = left[~stays]
    order = np.concatenate([*order, left]) if len(keys) else left
    bits = np.packbits(np.concatenate(flags), bitorder="little").tobytes() if flags else b""
    return {"sizes": sizes, "bits": bits, "n_rest": len(left), "lengths": lengths[order].astype("<i4").tobytes(),
            "keys": gathered(data, ends[order] - lengths[order], lengths[order]).tobytes()}


class Shards:
    """Shards side by side; slots are numbered through them in order."""

    def __init__(self, shards: list[dict]):
        self.sizes = np.zeros((len(shards), LEVELS), np.int64)
        for i, s in enumerate(shards):
            self.sizes[i, :len(s["sizes"])] = s["sizes"]
        self.base = np.cumsum(self.sizes.ravel()).reshape(self.sizes.shape) - self.sizes        # first bit of each level
        self.bits = Bits(np.frombuffer(b"".join(s["bits"] for s in shards), "<u8"))
        lengths = [np.frombuffer(s["lengths"], "<i4").astype(np.int64) for s in shards]
        self.counts = np.array([len(x) for x in lengths], np.int64)
        self.first_slot = np.cumsum(self.counts) - self.counts
        self.shift = self.first_slot - self.bits.rank(self.base[:, 0]) if shards else self.first_slot
        self.lengths = np.concatenate([np.zeros(0, np.int64), *lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.keys = np.frombuffer(b"".join(s["keys"] for s in shards), np.uint8)
        self.rest = {(i, self.key(slot)): slot for i, s in enumerate(shards)
                     for slot in range(self.first_slot[i] + self.counts[i] - s["n_rest"], self.first_slot[i] + self.counts[i])}

    def key(self, slot: int) -> bytes:
        return self.keys[self.starts[slot]:self.starts[slot] + self.lengths[slot]].tobytes()

    def lookup(self, data, starts, ends, a, b, shard) -> np.ndarray:
        """The slot of each string data[start:end] in its shard; -1 if it isn't a key there."""
        slots = np.full(len(starts), -1, np.int64)
        left = np.arange(len(starts))
        for level in range(LEVELS):
            size = self.sizes[shard[left], level]
            left = left[size > 0]
            if not len(left):
                break
            at = self.base[shard[left], level] + (_spread(a[left], b[left], level) % self.sizes[shard[left], level].astype(np.uint64)).astype(np.int64)
            hit = self.bits.test(at)
            slots[left[hit]] = self.bits.rank(at[hit]) + self.shift[shard[left[hit]]]
            left = left[~hit]
        self._verify(slots, data, starts, ends)
        if self.rest:
            for i in np.flatnonzero(slots < 0):
                slots[i] = self.rest.get((int(shard[i]), data[starts[i]:ends[i]].tobytes()), -1)
        return slots

    def _verify(self, slots, data, starts, ends) -> None:
        lengths = ends - starts
        found = np.flatnonzero(slots >= 0)
        wrong = self.lengths[slots[found]] != lengths[found]
        slots[found[wrong]] = -1
        found = found[~wrong]
        n = lengths[found]
        differ = gathered(data, starts[found], n) != gathered(self.keys, self.starts[slots[found]], n)
        if differ.any():
            slots[found[np.searchsorted(np.cumsum(n), np.flatnonzero(differ), side="right")]] = -1
