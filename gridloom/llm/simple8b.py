"""Simple-8b coding of unsigned integers in 64-bit words, vectorised with NumPy.

The top four bits of a word select how many ids share its other 60 bits.  Ids are cut
into blocks of ``BLOCK``; each block starts a new word and its first word's place is
stored, so blocks decode on their own.  Values of over 60 bits go to a table at the
end; the escape selector's word holds the place in that table.
"""

from __future__ import annotations

import struct

import numpy as np

#: Ids in a word and bits for each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
BLOCK = 256
#: The first selector wide enough, by bits.
_NARROWEST = np.append(np.searchsorted(WIDTHS, np.arange(61)), [len(WIDTHS)] * 4).astype(np.int8)
#: Bits of an id, and a mask of them, by the top four bits of a word.
_WIDTH_OF = np.append(WIDTHS, [60, 60])
_MASK_OF = (np.uint64(1) << _WIDTH_OF.astype(np.uint64)) - np.uint64(1)
MAGIC = b"GS8b"
_HEADER = struct.Struct("<4sIQQQQ")  # magic, block size, ids, blocks, words, escapes


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    lengths = np.frexp(values.astype(np.float64))[1]
    large = values >> np.uint64(53) != 0  # a double may round these up
    if large.any():
        lengths[large] = np.array([int(v).bit_length() for v in values[large]])
    return lengths


def pack(values: np.ndarray) -> bytes:
    """``values`` (unsigned) as one self-contained byte string."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint64)
    padded[:n] = values
    # The selector at each place: the densest whose width holds all the ids it would take.
    # Zeros beyond a block fit everywhere; a word that reaches past its block is padded.
    needs = np.zeros((blocks, BLOCK + 64), dtype=np.int8)
    needs[:, :BLOCK] = _NARROWEST[_bit_lengths(padded)].reshape(blocks, BLOCK)
    select = np.full((blocks, BLOCK), ESCAPE, dtype=np.int8)
    widest = {1: needs}  # by count: the widest of so many ids from each place on
    for s in range(len(COUNTS) - 1, -1, -1):
        n_ids = int(COUNTS[s])
        if n_ids > 1:
            half = next(c for c in widest if 2 * c >= n_ids)
            widest[n_ids] = w = np.zeros_like(needs)
            np.maximum(widest[half][:, :-half], widest[n_ids - half][:, half:], out=w[:, :-half])
        np.copyto(select, np.int8(s), where=widest[n_ids][:, :BLOCK] <= s)
    step = np.append(COUNTS, [1, 1])[select].ravel()
    select = select.ravel()
    # Follow the words of all blocks side by side.
    begin = np.arange(blocks, dtype=np.int64) * BLOCK
    end = np.minimum(begin + BLOCK, n)
    at, live, starts = begin.copy(), np.arange(blocks), []
    while len(live):
        starts.append(at[live])
        at[live] += step[at[live]]
        live = live[at[live] < end[live]]
    starts = np.sort(np.concatenate(starts)) if starts else np.zeros(0, dtype=np.int64)
    kind = select[starts]
    words = kind.astype(np.uint64) << np.uint64(60)
    if n:  # words follow each other without a gap, so each takes the ids up to the next one's
        took = np.diff(np.append(starts, n))
        shift = (np.arange(n) - np.repeat(starts, took)) * np.repeat(_WIDTH_OF[kind], took)
        words |= np.bitwise_or.reduceat(np.where(np.repeat(kind == ESCAPE, took), np.uint64(0), padded[:n] << shift.astype(np.uint64)), starts)
    escaped = np.flatnonzero(kind == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(starts, begin).astype("<u8")
    head = _HEADER.pack(MAGIC, BLOCK, n, blocks, len(words), len(escaped))
    return b"".join([head, offsets.tobytes(), words.astype("<u8").tobytes(), padded[starts[escaped]].astype("<u8").tobytes()])


def unpack(data: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The values of ``data``, or of a range of its blocks, as uint64."""
    magic, size, n, blocks, n_words, n_escapes = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    last_block = blocks if last_block is None else min(last_block, blocks)
    if first_block >= last_block:
        return np.zeros(0, dtype=np.uint64)
    at = _HEADER.size
    offsets = np.append(np.frombuffer(data, "<u8", blocks, at), np.uint64(n_words)).astype(np.int64)
    at += 8 * blocks
    lo, hi = offsets[first_block], offsets[last_block]
    words = np.frombuffer(data, "<u8", hi - lo, at + 8 * lo)
    escapes = np.frombuffer(data, "<u8", n_escapes, at + 8 * n_words)
    kind = (words >> np.uint64(60)).astype(np.int64)
    count = np.append(COUNTS, [1, 1])[kind]
    # A block's last word may hold fewer ids than its selector says.
    last = np.append(offsets[first_block + 1 : last_block], hi) - lo - 1
    sizes = np.minimum(n - np.arange(first_block, last_block) * size, size)
    count[last] -= np.add.reduceat(count, offsets[first_block:last_block] - lo) - sizes
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out = np.repeat(words, count)
    out >>= (at * np.repeat(_WIDTH_OF[kind], count)).astype(np.uint64)
    out &= np.repeat(_MASK_OF[kind], count)
    escaped = np.flatnonzero(kind == ESCAPE)
    if len(escaped):
        out[(np.cumsum(count) - count)[escaped]] = escapes[(words[escaped] & _MASK_OF[ESCAPE]).astype(np.int64)]
    return out
