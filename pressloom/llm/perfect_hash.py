"""Minimal perfect hashing of 64-bit keys, in shards that are built apart and looked up together.

A shard tries its keys level by level: each level has a bit per two keys or so, keys alone on their bit are placed and
the others go on to the next level under another seed. A key's slot is the number of bits set before its own, so n keys
fill the slots 0 to n-1. A key that was never placed lands anywhere or nowhere, so slots keep their key for comparison.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

from .words import mixed

BUCKET_BITS = 16  # keys are dealt into shards by this many bits of their hash


def buckets(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.uint64)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def shards_of(bucket: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a bucket: equal runs of buckets. Spark computes the same from the bucket column."""
    return (bucket * shards) >> BUCKET_BITS


def _positions(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    seed = np.uint64((0xA0761D6478BD642F * (level + 1)) % 2**64)
    return (mixed(keys ^ seed) % np.asarray(size, np.uint64)).astype(np.int64)


class Shard(NamedTuple):
    sizes: np.ndarray  # bits per level
    words: np.ndarray  # all levels' bits, 64 a word
    keys: np.ndarray  # by slot


def build(keys: np.ndarray) -> Shard:
    """The function of distinct keys."""
    left, sizes, levels = keys.astype(np.uint64), [], []
    while len(left):
        size = -(-2 * len(left) // 64) * 64
        at = _positions(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = left[~alone[at]]
    words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
    shard = Shard(np.array(sizes, np.int64), words, np.zeros(0, np.uint64))
    slots = PerfectHash([shard]).slots(keys.astype(np.uint64), np.zeros(len(keys), np.int64))
    held = np.zeros(len(keys), np.uint64)
    held[slots] = keys
    return shard._replace(keys=held)


class PerfectHash:
    """Shards side by side: slots run on from one to the next."""

    def __init__(self, shards: Sequence[Shard]):
        self.shards = len(shards)
        depth = max([len(s.sizes) for s in shards], default=0)
        self.sizes = np.zeros((len(shards), depth), np.int64)
        for i, s in enumerate(shards):
            self.sizes[i, : len(s.sizes)] = s.sizes
        ends = np.cumsum(self.sizes.ravel()).reshape(self.sizes.shape)
        self.starts = ends - self.sizes
        self.words = np.concatenate([s.words for s in shards]) if shards else np.zeros(0, np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.keys = np.concatenate([s.keys for s in shards]) if shards else np.zeros(0, np.uint64)

    def slots(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that no level places; other absent keys get some slot."""
        found = np.full(len(keys), -1, np.int64)
        active = np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            sizes = self.sizes[shard[active], level]
            active, sizes = active[sizes > 0], sizes[sizes > 0]
            if not len(active):
                break
            at = self.starts[shard[active], level] + _positions(keys[active], level, sizes)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[held]] & ((np.uint64(1) << bit[held]) - np.uint64(1))
            found[active[held]] = self.before[word[held]] + np.bitwise_count(below)
            active = active[~held]
        return found

    def members(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key that is really held, else -1."""
        keys = keys.astype(np.uint64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slots = self.slots(keys, shards_of(buckets(keys), self.shards))
        return np.where((slots >= 0) & (self.keys[slots] == keys), slots, -1)
