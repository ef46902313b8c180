"""Simple-8b: unsigned integers packed into 64-bit words, in shards of fixed-size blocks.

The top four bits of a word are its selector, which says how many values of
which width fill the other sixty.  Layout of a shard (all little-endian):

    magic "PLS8", u32 block length, u64 ids, u64 documents, u64 words, u64 escapes
    i64 id of each document        u8 whether it is null       u64 end of each document (ids before its end)
    u64 first word of each block, and the number of words
    words                          escapes

A block is ``block`` ids, whatever documents they belong to.  As each block has
the offset of its first word, all words of a shard decode at once, and any block
can be decoded alone.  A value of 61 to 64 bits is an escape: its word has
selector 0 and the place of the value among the escapes.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PLS8"
HEAD = struct.Struct("<4sIQQQQ")
#: Values in a word and their width, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def _selectors(widths: np.ndarray) -> np.ndarray:
    """The best selector for a word that starts at each place of each block; places after a block's end count as width 0."""
    span = widths.shape[1]
    runs = {1: np.pad(widths, ((0, 0), (0, 128)))}
    best = np.where(widths > 60, 0, 15).astype(np.uint8)
    for s in range(14, 0, -1):
        n = int(COUNTS[s])
        power = 1 << (n.bit_length() - 1)
        p = 1
        while p < power:
            if 2 * p not in runs:
                wide = runs[p].copy()
                np.maximum(runs[p][:, :-p], runs[p][:, p:], out=wide[:, :-p])
                runs[2 * p] = wide
            p *= 2
        wide = runs[power]
        most = np.maximum(wide[:, :span], wide[:, n - power : n - power + span])
        best[most <= WIDTHS[s]] = s
    return best


def pack_words(ids: np.ndarray, block: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block and the number of words, escapes)."""
    if block < 1 or block > 128:
        raise ValueError("a block has 1 to 128 ids")
    blocks = -(-len(ids) // block)
    span = block + 120  # a word may start at the last place of a block and covers zeros beyond
    cells = np.zeros((blocks, span), np.uint64)
    whole = len(ids) // block
    cells[:whole, :block] = np.asarray(ids[: whole * block]).reshape(whole, block)
    if whole < blocks:
        cells[whole, : len(ids) - whole * block] = ids[whole * block :]
    grid = cells[:, :block]
    widths = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)
    best = _selectors(widths)
    sizes = np.full(blocks, block)
    if blocks:
        sizes[-1] = len(ids) - (blocks - 1) * block
    at, steps = np.zeros(blocks, np.int64), []
    live = np.arange(blocks)
    while len(live):
        s = best[live, at[live]]
        steps.append((live, at[live], s))
        at[live] += COUNTS[s]
        live = live[at[live] < sizes[live]]
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)
    which, start, selector = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(which, kind="stable")
    which, start, selector = which[order], start[order], selector[order]
    firsts = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=blocks))]).astype(np.uint64)
    words = selector.astype(np.uint64) << np.uint64(60)
    values, place = cells.reshape(-1), which * span + start
    for s in range(2, 16):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            at, word = place[rows], words[rows]
            for k in range(int(COUNTS[s])):
                word |= values[at + k] << np.uint64(k * WIDTHS[s])
            words[rows] = word
    rows = np.flatnonzero(selector == 0)
    words[rows] = np.arange(len(rows), dtype=np.uint64)
    return words, firsts, values[place[rows]]


def unpack_words(words: np.ndarray, firsts: np.ndarray, escapes: np.ndarray, n: int, block: int = 128) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    firsts = firsts.astype(np.int64)
    which = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    before = np.cumsum(counts) - counts
    start = before - before[firsts[:-1]][which] if len(words) else before
    span = block + 120
    out = np.zeros((len(firsts) - 1, span), np.uint64)
    values, place = out.reshape(-1), which * span + start
    for s in range(2, 16):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            at, word, mask = place[rows], words[rows], np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(int(COUNTS[s])):
                values[at + k] = (word >> np.uint64(k * WIDTHS[s])) & mask
    rows = np.flatnonzero(selector == 0)
    values[place[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return np.ascontiguousarray(out[:, :block]).reshape(-1)[:n]


def write_shard(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, block: int = 128) -> bytes:
    words, firsts, escapes = pack_words(ids, block)
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, block, len(ids), len(doc_ids), len(words), len(escapes))
    ends = np.cumsum(lengths).astype("<u8")
    return b"".join([head, keys.tobytes(), null.tobytes(), ends.tobytes(), firsts.astype("<u8").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def read_shard(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, end of each document, ids)."""
    magic, block, n, docs, n_words, n_escapes = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a shard")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    keys, null, ends = take("<i8", docs), take("u1", docs), take("<u8", docs)
    firsts, words, escapes = take("<u8", -(-n // block) + 1), take("<u8", n_words), take("<u8", n_escapes)
    doc_ids = [None if z else int(k) for k, z in zip(keys, null, strict=True)]
    return doc_ids, ends.astype(np.int64), unpack_words(words, firsts, escapes, n, block)
