"""CRC-32 of many byte spans at once, from a table of what each byte adds at each distance from the span's end."""

from __future__ import annotations

import numpy as np

#: Fixed value: the reflected CRC-32 polynomial.
POLYNOMIAL = 0xEDB88320
#: Bytes that one block of a span holds; the position table has a row for each.
BLOCK = 64
#: Bytes of spans that are expanded at a time.
STEP_BYTES = 1 << 20


def _byte_table() -> np.ndarray:
    """Register after one byte, for each value of the low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return table


BYTE = _byte_table()


def zero_byte(register: np.ndarray) -> np.ndarray:
    """Register after one more byte of value 0."""
    return (register >> np.uint32(8)) ^ BYTE[register & np.uint32(255)]


def _position_table() -> np.ndarray:
    """[d, b]: what byte b adds to the register when d bytes follow it."""
    table = np.zeros((BLOCK, 256), np.uint32)
    table[0] = BYTE
    for d in range(1, BLOCK):
        table[d] = zero_byte(table[d - 1])
    return table


def _block_shift() -> np.ndarray:
    """[k, b]: register after BLOCK zero bytes, from byte k of the register being b and the others 0."""
    table = (np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(BLOCK):
        table = zero_byte(table)
    return table


def shifted(register: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Register after as many zero bytes as the table ``shift`` stands for."""
    out = shift[0, register & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ shift[k, (register >> np.uint32(8 * k)) & np.uint32(255)]
    return out


POSITION, SHIFT = _position_table(), _block_shift()


def _length_constants() -> np.ndarray:
    """[n]: what the all-ones start adds to the register after n bytes, n up to BLOCK."""
    out = np.zeros(BLOCK + 1, np.uint32)
    out[0] = 0xFFFFFFFF
    for n in range(1, BLOCK + 1):
        out[n] = zero_byte(out[n - 1 : n])[0]
    return out


START = _length_constants()


def _blocks(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR of what the bytes of each block of 1 to BLOCK bytes add to the register."""
    out = np.zeros(len(starts), np.uint32)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(starts):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + STEP_BYTES, "right")))
        size = lengths[at:upto]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        value = data[np.repeat(starts[at:upto], size) + place]
        out[at:upto] = np.bitwise_xor.reduceat(POSITION[np.repeat(size, size) - 1 - place, value], first)
        at = upto
    return out


def _fold(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One register for each run of ``counts`` block registers: neighbours from the end fold in pairs, then in fours..."""
    shift = SHIFT
    from_end = np.repeat(np.cumsum(counts), counts) - 1 - np.arange(len(values))
    while len(values) > len(counts):
        even = np.flatnonzero(from_end % 2 == 0)
        before = np.maximum(even - 1, 0)
        paired = (even > 0) & (from_end[before] == from_end[even] + 1)
        values = values[even] ^ np.where(paired, shifted(values[before], shift), np.uint32(0))
        from_end = from_end[even] // 2
        shift = shifted(shift, shift)
    return values


def crc32_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start : start + length]`` for each span; spans may overlap and may be empty.

    A span of up to BLOCK bytes is one XOR of table entries and a constant of its length. A longer one is cut into
    blocks from its end, whose registers fold together with shifts by one block, two blocks, four blocks and so on.
    """
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    short = (lengths > 0) & (lengths <= BLOCK)
    register = np.full(len(starts), START[0], np.uint32)
    if short.any():
        register[short] = _blocks(data, starts[short], lengths[short]) ^ START[lengths[short]]
    long = np.flatnonzero(lengths > BLOCK)
    if len(long):
        # The first block takes what is over, so that all others are whole.
        counts = -(-lengths[long] // BLOCK)
        head = lengths[long] - (counts - 1) * BLOCK
        first = np.cumsum(counts) - counts
        nth = np.arange(int(counts.sum())) - np.repeat(first, counts)
        size = np.where(nth == 0, np.repeat(head, counts), BLOCK)
        at = np.repeat(starts[long], counts) + np.where(nth == 0, 0, np.repeat(head, counts) + (nth - 1) * BLOCK)
        state = _blocks(data, at, size)
        state[first] ^= START[head]
        register[long] = _fold(state, counts)
    return register ^ np.uint32(0xFFFFFFFF)
