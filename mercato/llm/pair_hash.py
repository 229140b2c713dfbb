"""Minimal perfect hashing of 64-bit keys, bucket by bucket.

A key's bucket comes from high bits of its mix.  A bucket has levels of bits:
at each level the keys still left are hashed to about twice as many places, and
those alone in theirs set its bit; the others go to the next level.  A key's
number is the count of bits set before its own, over all buckets in order.
Keys that were not hashed get a number, too, so a lookup compares the key kept
under it.
"""

from __future__ import annotations

#: Keys of a bucket, about, and bits of the mix that choose the bucket.
PER_BUCKET, SPREAD = 4096, 24


def mix(keys, seed: int):
    """64 well-mixed bits of each key (an integer array), others for each seed."""
    import numpy as np

    x = np.asarray(keys).astype(np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    # The shifts and factors of the splitmix64 finaliser.
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def spread(keys):
    """The bits that choose the bucket."""
    import numpy as np

    return (mix(keys, 0) >> np.uint64(64 - SPREAD)).astype(np.int64)


def build_bucket(keys):
    """Of distinct ``keys``: the sizes of the levels (bits, whole 64-bit words), all bits as words, the keys by their number."""
    import numpy as np

    left = np.asarray(keys, np.int64)
    sizes, words, ordered = [], [], []
    while len(left):
        size = -(-2 * len(left) // 64) * 64
        place = (mix(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        good = alone[place]
        ordered.append(left[good][np.argsort(place[good])])
        left = left[~good]
    none = np.zeros(0, np.int64)
    return sizes, np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate([none, *ordered])


class PairHash:
    """Numbers of keys; ``buckets`` holds, in order, what ``build_bucket`` gave for each."""

    def __init__(self, buckets: list[tuple]):
        import numpy as np

        depth = max((len(sizes) for sizes, _, _ in buckets), default=0)
        self.sizes = np.zeros((max(len(buckets), 1), max(depth, 1)), np.int64)
        for row, (sizes, _, _) in zip(self.sizes, buckets):
            row[: len(sizes)] = sizes
        ends = np.cumsum(self.sizes.ravel()).reshape(self.sizes.shape)
        self.starts = ends - self.sizes
        self.words = np.concatenate([np.zeros(0, np.uint64), *(words for _, words, _ in buckets)])
        self.keys = np.concatenate([np.zeros(0, np.int64), *(keys for _, _, keys in buckets)])
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def find(self, keys):
        """The number of each key, -1 for keys that were not hashed."""
        import numpy as np

        keys = np.asarray(keys, np.int64)
        found = np.full(len(keys), -1, np.int64)
        bucket = spread(keys) * len(self.sizes) >> SPREAD
        left = np.arange(len(keys)) if len(self.keys) else np.zeros(0, np.int64)
        for level in range(self.sizes.shape[1]):
            left = left[self.sizes[bucket[left], level] > 0]
            if not len(left):
                break
            size, start = self.sizes[bucket[left], level], self.starts[bucket[left], level]
            place = start + (mix(keys[left], level + 1) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            lower = np.bitwise_count(word & (np.uint64(1) << bit) - np.uint64(1)).astype(np.int64)
            found[left[hit]] = (self.before[place >> 6] + lower)[hit]
            left = left[~hit]
        known = found >= 0
        found[known & (self.keys[np.maximum(found, 0)] != keys if len(self.keys) else False)] = -1
        return found
