"""Byte-pair merging by a queue of merge ranks.

The queue has a bucket for each rank that holds places in a linked list of tokens, and a
hierarchical bitmap of the buckets that hold any: find-first-set on each level gives the
lowest rank.  A place whose pair has changed since it was put in is stale and is skipped
when it comes out, so nothing is ever searched for or removed from the middle of a bucket.

Short pieces are merged together, all pieces' places in one queue: a step takes the lowest
rank, and of each piece the leftmost place that has it, as NumPy arrays.  Pieces don't meet,
so each sees its own merges in the order that it would see alone.  A long piece has a queue
of its own, one place a step, whose buckets are heaps; it takes n log n steps at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: Bits of a word of the bitmap, as a power of two.
_LEVEL = 6
#: Bytes from which a piece has a queue of its own.
LONG_PIECE = 256


class RankBitmap:
    """A set of ranks below ``size`` whose least member is found in a step for each level."""

    def __init__(self, size: int):
        self._levels: list[list[int]] = []
        while not self._levels or len(self._levels[-1]) > 1:
            size = (size + 63) >> _LEVEL if size > 1 else 1
            self._levels.append([0] * size)

    def add(self, rank: int) -> None:
        for level in self._levels:
            word, bit = rank >> _LEVEL, 1 << (rank & 63)
            had = level[word]
            level[word] = had | bit
            if had:
                return
            rank = word

    def remove(self, rank: int) -> None:
        for level in self._levels:
            word = rank >> _LEVEL
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                return
            rank = word

    def first(self) -> int:
        """The least member; -1 where there is none."""
        at = 0
        for level in reversed(self._levels):
            word = level[at]
            if not word:
                return -1
            at = at << _LEVEL | (word & -word).bit_length() - 1
        return at


class RankQueue:
    """Places by rank; the lowest rank comes first."""

    def __init__(self, n_ranks: int):
        self._bits, self._buckets = RankBitmap(n_ranks), {}

    def put(self, ranks: list[int], places: list[int]) -> None:
        buckets, add = self._buckets, self._bits.add
        for rank, place in zip(ranks, places):
            if rank in buckets:
                buckets[rank].append(place)
            else:
                buckets[rank] = [place]
                add(rank)

    def put_all(self, rank: int, places: list[int]) -> None:
        bucket = self._buckets.setdefault(rank, [])
        bucket += places
        self._bits.add(rank)

    def push(self, rank: int, place: int) -> None:
        """As ``put``, with the bucket a heap; not to be mixed with it."""
        bucket = self._buckets.get(rank)
        if bucket is None:
            self._buckets[rank] = [place]
            self._bits.add(rank)
        else:
            heapq.heappush(bucket, place)

    def buckets(self) -> Iterator[tuple[int, list[int]]]:
        """Each time the whole bucket of the lowest rank, which is then empty."""
        while (rank := self._bits.first()) >= 0:
            self._bits.remove(rank)
            yield rank, self._buckets.pop(rank)

    def places(self) -> Iterator[tuple[int, int]]:
        """Each time the leftmost place of the lowest rank."""
        while (rank := self._bits.first()) >= 0:
            bucket = self._buckets[rank]
            place = heapq.heappop(bucket)
            if not bucket:
                del self._buckets[rank]
                self._bits.remove(rank)
            yield rank, place


class Merger:
    """Merges bytes by the ranks of a byte-level vocabulary; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n_ranks = max(ranks.values()) + 1
        self._shift = self.n_ranks.bit_length()
        self._bytes = np.full(256, -1, dtype=np.int64)
        for b in range(256):
            self._bytes[b] = ranks.get(bytes([b]), -1)
        if (self._bytes < 0).any():
            raise ValueError("the vocabulary has no token for some byte")
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << self._shift | b] = rank
        self._pairs = pairs
        keys = np.array(sorted(pairs), dtype=np.int64)
        # An end that no pair has, so that every search has an answer.
        self._keys = np.append(keys, np.iinfo(np.int64).max)
        self._ranks = np.append(np.array([pairs[k] for k in keys.tolist()], dtype=np.int64), -1)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 where they don't merge, or where one is -1."""
        key = left << self._shift | right
        at = np.searchsorted(self._keys, key)
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(pieces)
        short = [i for i, p in enumerate(pieces) if len(p) < LONG_PIECE]
        for i, p in enumerate(pieces):
            if len(p) >= LONG_PIECE:
                out[i] = self._merge_long(p)
        ids, starts = self._merge_short([pieces[i] for i in short])
        code, ends = ids.astype("<u4").tobytes(), (4 * starts).tolist()
        for k, i in enumerate(short):
            out[i] = code[ends[k] : ends[k + 1]]
        return out

    def _merge_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and where each piece's begin, with the end as the last."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(pieces) else 0
        # A place beside the last stands for none: its token is -1, and what is linked to it is lost.
        token = np.append(self._bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)], -1)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        full = sizes > 0
        after[ends[full] - 1] = n
        before[(ends - sizes)[full]] = n
        after[n] = before[n] = n
        rank = np.append(self._ranks_of(token[:n], token[after[:n]]), -1)
        queue = RankQueue(self.n_ranks)
        places = np.flatnonzero(rank >= 0)
        places = places[np.argsort(rank[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[places])) + 1
        for some in np.split(places, cuts) if len(places) else []:
            queue.put_all(int(rank[some[0]]), some.tolist())
        for r, bucket in queue.buckets():
            at = np.array(bucket)
            at = at[rank[at] == r]  # the rest is stale
            if len(at) > 1:
                at.sort()
                of = piece[at]
                first = np.append(True, of[1:] != of[:-1])
                if not first.all():  # a piece's next place has to wait for what this one makes
                    queue.put_all(r, at[~first].tolist())
                    at = at[first]
            elif not len(at):
                continue
            gone = after[at]
            right, left = after[gone], before[at]
            token[at], after[at], rank[gone] = r, right, -1
            before[right] = at
            token[gone] = -2
            n_at = len(at)
            found = self._ranks_of(np.concatenate((token[at], token[left])), np.concatenate((token[right], token[at])))
            rank[at], rank[left] = found[:n_at], found[n_at:]
            rank[n] = -1
            live = found >= 0
            queue.put(found[live].tolist(), np.concatenate((at, left))[live].tolist())
        left_over = token[:n] >= 0
        starts = np.append(0, np.cumsum(left_over))[np.append(ends - sizes, n)]
        return token[:n][left_over], starts

    def _merge_long(self, piece: bytes) -> bytes:
        token = self._bytes[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n, pairs, shift = len(token), self._pairs, self._shift
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        rank, queue = [-1] * n, RankQueue(self.n_ranks)

        def pair(i: int, j: int) -> None:
            found = pairs.get(token[i] << shift | token[j], -1)
            rank[i] = found
            if found >= 0:
                queue.push(found, i)

        for i in range(n - 1):
            pair(i, i + 1)
        for r, at in queue.places():
            if rank[at] != r:  # stale
                continue
            gone = after[at]
            right, left = after[gone], before[at]
            token[at], token[gone], after[at], rank[at], rank[gone] = r, -1, right, -1, -1
            if right >= 0:
                before[right] = at
                pair(at, right)
            if left >= 0:
                pair(left, at)
        return np.array([t for t in token if t >= 0], dtype="<u4").tobytes()

