"""A static range asymmetric numeral system over token ids, many lanes at once.

Identifiers go to lanes in turn. All lanes share one table of frequencies that
add up to 2**20; a lane's state lies between 2**31 and 2**63 and gives off or takes
in 32-bit words, which the lanes of a block share in one stream. The states are
noted at regular steps, with a checksum of the ids in between, so that a reader can
start at any of these checkpoints.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS, LOW = 20, 31
_HEAD = struct.Struct("<4sIIIIII")
_MAGIC = b"rAns"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**20, at least 1 where ``counts`` is."""
    total, present = int(counts.sum()), counts > 0
    if not total:
        return np.zeros(len(counts), dtype=np.uint64)
    room = (1 << BITS) - int(present.sum())
    if room < 0:
        raise ValueError("more distinct ids than the table has places")
    share = counts.astype(object) * room // total if total > 1 << 40 else counts.astype(np.int64) * room // total
    freq = np.where(present, 1 + np.asarray(share, dtype=np.int64), 0)
    freq[int(freq.argmax())] += (1 << BITS) - int(freq.sum())
    return freq.astype(np.uint64)


class Coder:
    """Encodes and decodes blocks by one table of frequencies."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.id_of = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.crc = zlib.crc32(freq.astype("<u8").tobytes())

    def encode(self, ids: np.ndarray, lanes: int = 512, every: int = 256) -> bytes:
        """One block; a checkpoint after each ``every`` steps of all lanes."""
        n, low = len(ids), np.uint64(32)
        steps = -(-n // lanes)
        freq, start = self.freq[ids], self.start[ids]
        if n and not freq.all():
            raise ValueError("an id without a place in the table")
        # with x = q * f + r the next state, (q << BITS) + r + c, is x + q * ((1 << BITS) - f) + c
        limit, rest = freq << np.uint64(LOW - BITS + 32), np.uint64(1 << BITS) - freq
        state = np.full(lanes, 1 << LOW, dtype=np.uint64)
        words, states, marks, total = [], {}, {}, 0
        for t in range(steps - 1, -1, -1):
            a, b = t * lanes, min((t + 1) * lanes, n)
            x = state[: b - a]
            full = np.flatnonzero(x >= limit[a:b])
            if len(full):
                over = x[full]
                words.append(over.astype(np.uint32))  # the low 32 bits
                total += len(over)
                x[full] = over >> low
            q = x // freq[a:b]
            q *= rest[a:b]
            x += q
            x += start[a:b]
            if t % every == 0:
                states[t], marks[t] = state.copy(), total
        points = range(0, steps, every)
        out = [_HEAD.pack(_MAGIC, n, lanes, every, len(points), total, self.crc)]
        for t in points:
            crc = zlib.crc32(ids[t * lanes : (t + every) * lanes].astype("<u4").tobytes())
            out.append(struct.pack("<II", total - marks[t], crc) + states[t].astype("<u8").tobytes())
        out += [w.astype("<u4").tobytes() for w in reversed(words)]
        return b"".join(out)

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids between two checkpoints; checked against the checksums."""
        magic, n, lanes, every, points, total, crc = _HEAD.unpack_from(block)
        if magic != _MAGIC or crc != self.crc:
            raise ValueError("not a block of this table")
        size = 8 + 8 * lanes
        words = np.frombuffer(block, "<u4", total, _HEAD.size + points * size).astype(np.uint64)
        out, mask, bits, least, low = [], np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(1 << LOW), np.uint64(32)
        for p in range(first, points if last is None else last):
            at = _HEAD.size + p * size
            read, check = struct.unpack_from("<II", block, at)
            state = np.frombuffer(block, "<u8", lanes, at + 8).astype(np.uint64)
            got = []
            for t in range(p * every, min((p + 1) * every, -(-n // lanes))):
                x = state[: min(lanes, n - t * lanes)]
                slot = x & mask
                ids = self.id_of.take(slot)
                x >>= bits
                x *= self.freq.take(ids)
                slot -= self.start.take(ids)
                x += slot
                empty = np.flatnonzero(x < least)
                k = len(empty)
                if k:
                    x[empty] = (x[empty] << low) | words[read : read + k]
                    read += k
                got.append(ids)
            part = np.concatenate(got)
            if zlib.crc32(part.astype("<u4").tobytes()) != check:
                raise ValueError("a damaged block")
            out.append(part)
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)
