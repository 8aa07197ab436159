"""A cuckoo filter over 64-bit keys, and an index that verifies its hits."""

from __future__ import annotations

from array import array

SLOTS = 4
MASK64 = (1 << 64) - 1


class CuckooFilter:
    """16-bit fingerprints, four slots a bucket, partial-key cuckoo hashing.

    ``insert`` returns False when no slot came free within ``kicks`` moves; the table then lacks
    one fingerprint and the caller must rebuild it larger from the keys it stores.
    """

    def __init__(self, n_buckets: int = 256, kicks: int = 200):
        if n_buckets & (n_buckets - 1):
            raise ValueError("n_buckets must be a power of two")
        self.n_buckets, self.kicks = n_buckets, kicks
        self.slots = array("H", bytes(2 * SLOTS * n_buckets))
        self._turn = 0

    def _print(self, key: int) -> int:
        return (key >> 48) or 1  # 0 marks a free slot

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ ((fp * 0x5BD1E995) >> 7)) & (self.n_buckets - 1)

    def _put(self, bucket: int, fp: int) -> bool:
        for i in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if not self.slots[i]:
                self.slots[i] = fp
                return True
        return False

    def contains(self, key: int) -> bool:
        fp, a = self._print(key), key & (self.n_buckets - 1)
        b = self._other(a, fp)
        return fp in self.slots[SLOTS * a:SLOTS * a + SLOTS] or fp in self.slots[SLOTS * b:SLOTS * b + SLOTS]

    def insert(self, key: int) -> bool:
        fp, a = self._print(key), key & (self.n_buckets - 1)
        b = self._other(a, fp)
        if self._put(a, fp) or self._put(b, fp):
            return True
        for _ in range(self.kicks):
            self._turn += 1
            i = SLOTS * b + self._turn % SLOTS
            fp, self.slots[i] = self.slots[i], fp
            b = self._other(b, fp)
            if self._put(b, fp):
                return True
        return False

    def delete(self, key: int) -> bool:
        fp, a = self._print(key), key & (self.n_buckets - 1)
        for bucket in (a, self._other(a, fp)):
            for i in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.slots[i] == fp:
                    self.slots[i] = 0
                    return True
        return False


class LiveIndex:
    """Live digests behind a cuckoo filter: one entry [digest, keep, size] each.

    The filter answers most first sightings alone; its hits are verified against the entries
    stored under the digest's bucket key. Overflow doubles the filter and refills it from the
    stored entries.
    """

    def __init__(self, n_buckets: int = 256):
        self.filter, self.stored, self.resizes, self.false_hits = CuckooFilter(n_buckets), {}, 0, 0

    @staticmethod
    def key(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "big")

    def find(self, digest: bytes) -> list | None:
        key = self.key(digest)
        if not self.filter.contains(key):
            return None
        for entry in self.stored.get(key, ()):
            if entry[0] == digest:
                return entry
        self.false_hits += 1
        return None

    def add(self, digest: bytes, keep: int | None, size: int) -> None:
        """Count ``size`` rows for the digest; the larger ``keep`` wins, None loses to any id."""
        entry = self.find(digest)
        if entry is None:
            key = self.key(digest)
            self.stored.setdefault(key, []).append([digest, keep, size])
            if not self.filter.insert(key):
                self._grow()
            return
        entry[2] += size
        if keep is not None and (entry[1] is None or keep > entry[1]):
            entry[1] = keep

    def remove(self, digest: bytes) -> bool:
        entry = self.find(digest)
        if entry is None:
            return False
        key = self.key(digest)
        self.filter.delete(key)
        rest = [x for x in self.stored[key] if x is not entry]
        if rest:
            self.stored[key] = rest
        else:
            del self.stored[key]
        return True

    def _grow(self) -> None:
        size = self.filter.n_buckets
        while True:
            size *= 2
            self.filter = CuckooFilter(size)
            self.resizes += 1
            if all(self.filter.insert(key) for key, entries in self.stored.items() for _ in entries):
                return

    def entries(self):
        for entries in self.stored.values():
            yield from entries
