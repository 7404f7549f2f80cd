"""Removal of repeated byte strings across documents, by suffix sorting of what may repeat.

A byte goes if it is covered by a string of `length` bytes that also starts in
a document with a smaller id.

1. Anchors. Every window of `length` bytes holds the anchor of its lowest
   hash among the strings of ANCHOR bytes in it, so equal windows have equal
   anchors at equal places. Anchors that two documents have are shared. An
   anchor that several documents of a batch have is known to be shared at
   once, and its part (anchors are dealt by hash) hears of it in two entries
   only, whatever their number.
2. Contexts. Around shared anchors lie the bytes that windows with this anchor
   cover. Of each such context a hash goes to the anchor's part. A document
   whose context equals that of a smaller document loses it whole; in a batch
   that is known at once, and only the smallest is sent on.
3. Suffixes. Where an anchor has several different contexts, the bytes of each
   (from its smallest document) are gathered, and all their windows sorted as
   suffixes of the joined contexts in two stages: suffixes smaller than their
   successors directly, the rest by scanning the buckets in order; common
   prefixes of neighbours then show equal windows, and each group's smallest
   document keeps its bytes.
4. What is lost is joined to the documents and cut out.

What each step finds is written as a table, so that its shuffle files are
deleted before the next step begins; texts are shuffled in each of the last
three, by document. The tables of lost contexts and ranges are read with the
result and stay in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .cluster import cut, discard, pieces
from .words import Hasher, mix, slices
from .workers import freed, freed_group

LENGTH = 50
ANCHOR = 20
LEAST_PARTS = 64
#: Bytes of text whose anchors go to one part, about.
BYTES_A_PART = 1 << 26


def two_stage_sort(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of data in the order of their suffixes, compared by `depth` bytes at least; ties stay in any order.

    data ends with a byte smaller than or equal to all others. Suffixes smaller
    than their successor (type B) are sorted directly. The others follow by
    induction: a suffix not smaller than its successor stands in its first
    byte's bucket in the order of the successors, and before that bucket's type
    B suffixes; buckets are scanned upwards, and within a bucket first the
    suffixes whose successor starts with a smaller byte, then runs of the same
    byte, shortest first.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    # Type: compare each byte with the next different one.
    change = np.flatnonzero(np.diff(data)) + 1
    run_end = np.append(change, n)[np.searchsorted(change, np.arange(n), side="right")]
    after = data[np.minimum(run_end, n - 1)]
    smaller = (run_end < n) & (data < after)
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)
    direct = direct[np.argsort(_packed(keys, direct, depth), kind="stable")]
    rank = np.zeros(n + 1, np.int64)  # the empty suffix comes first
    out = np.zeros(n, np.int64)
    spot = 0
    run = run_end - np.arange(n)
    induced = np.flatnonzero(~smaller)
    by_byte = induced[np.argsort(data[induced], kind="stable")]
    cuts = np.searchsorted(data[by_byte], np.arange(257))
    direct_cuts = np.searchsorted(data[direct], np.arange(257))
    for byte in range(256):
        mine = by_byte[cuts[byte] : cuts[byte + 1]]
        if len(mine):
            order = np.argsort(run[mine], kind="stable")
            mine = mine[order]
            steps = np.searchsorted(run[mine], np.arange(1, int(run[mine[-1]]) + 2))
            for low, high in zip(steps[:-1].tolist(), steps[1:].tolist()):
                if low == high:
                    continue
                part = mine[low:high]
                part = part[np.argsort(rank[part + 1], kind="stable")]
                out[spot : spot + len(part)] = part
                rank[part] = np.arange(spot + 1, spot + 1 + len(part))
                spot += len(part)
        part = direct[direct_cuts[byte] : direct_cuts[byte + 1]]
        out[spot : spot + len(part)] = part
        rank[part] = np.arange(spot + 1, spot + 1 + len(part))
        spot += len(part)
    return out


def _packed(keys: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The byte strings of some positions as one sortable column."""
    rows = np.ascontiguousarray(keys[at])
    return rows.view(f"S{depth}").reshape(-1) if len(at) else np.zeros(0, f"S{depth}")


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix in order shares its first `depth` bytes with the one before it."""
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    same = np.zeros(len(order), bool)
    left, right, alive = order[:-1], order[1:], np.arange(1, len(order))
    for step in range(depth):
        equal = padded[left + step] == padded[right + step]
        if not equal.all():
            left, right, alive = left[equal], right[equal], alive[equal]
    same[alive] = True
    return same


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first lowest value in each run of `width` values, by doubling."""
    low, at = values, np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        n = len(low) - step
        right = low[step:] < low[:n]
        at = np.where(right, at[step:], at[:n])
        low = np.where(right, low[step:], low[:n])
        done += step
    return at


def _windows(part, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of a slice: (document, start, anchor start), and the hashes of the strings of `anchor` bytes."""
    data = part.data
    hashes = Hasher(data).spans(np.arange(len(data) - anchor + 1), np.arange(anchor, len(data) + 1)) if len(data) >= anchor else np.zeros(0, np.uint64)
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), hashes
    at = _lowest(hashes, length - anchor + 1)  # also of windows across documents, which go next
    counts = np.maximum(part.ends - part.starts - length + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(part.starts, counts)
    return docs, starts, at[starts], hashes


def _occurrences(part, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the anchors of a slice: (hash, document, start, first window, last window)."""
    docs, starts, at, hashes = _windows(part, length, anchor)
    if not len(starts):
        return np.zeros(0, np.uint64), docs, at, starts, starts
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (docs[1:] != docs[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    return hashes[at[heads]], docs[heads], at[heads], starts[heads], starts[tails]


def _pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about limit bytes of text, so that memory doesn't follow the batch size."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            done = ends[low - 1] if low else 0
            high = min(batch.num_rows, max(low + 1, int(np.searchsorted(ends, done + limit, side="right"))))
            yield batch.slice(low, high - low)
            low = high


def _narrow(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned 64-bit numbers."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.reshape(-1).view(np.uint64)


def _pack(keys: np.ndarray) -> bytes:
    """Document keys as a base and offsets of as few bytes as they need."""
    if not len(keys):
        return b""
    base = int(keys.min())
    offsets = (keys - base).view(np.uint64)
    width = max(1, (int(offsets.max()).bit_length() + 7) // 8)
    return base.to_bytes(8, "little", signed=True) + bytes([width]) + _narrow(offsets, width)


def _unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.int64)
    return _widen(blob[9:], blob[8]).view(np.int64) + int.from_bytes(blob[:8], "little", signed=True)


def _parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _deal(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, order[cuts[p] : cuts[p + 1]]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns change."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


#: Bytes of an anchor's hash, and of a context's: two contexts are taken for equal if both agree.
_HASH_BYTES, _DIGEST_BYTES = 6, 8
_MASK = np.uint64((1 << 8 * _HASH_BYTES) - 1)
_FAR = np.iinfo(np.int64).max


def _announce(parts: int, length: int, anchor: int):
    """Batches of (key, text) to rows for the parts: hashes with the batch's smallest and largest document, and what is known at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            keys = batch.column(0).to_numpy()
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for part in slices(batch.column(1)):
                hashes, owner, _, _, _ = _occurrences(part, length, anchor)
                if len(hashes):
                    found.append((hashes, keys[part.first : part.last][owner]))
            if not found:
                continue
            hashes, owner = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            once = _heads(hashes, owner)
            hashes, owner = hashes[once], owner[once]
            heads = _heads(hashes)
            tails = np.append(heads[1:], len(hashes)) - 1
            several = owner[heads] != owner[tails]
            rows: dict[int, list[bytes]] = {}
            for p, at in _deal(_parts_of(hashes[heads], parts), parts):
                alone, apart = at[~several[at]], at[several[at]]
                rows[p] = [
                    _narrow(hashes[heads[alone]], _HASH_BYTES), _pack(owner[heads[alone]]), _narrow(hashes[heads[apart]], _HASH_BYTES), b"", b"",
                ]
            known = np.repeat(several, tails - heads + 1)
            for p, at in _deal(owner[known] % parts, parts):
                row = rows.setdefault(p, [b""] * 5)
                row[3], row[4] = _narrow(hashes[known][at], _HASH_BYTES), _pack(owner[known][at])
            columns = [pa.array(list(rows), pa.int32()), *[pa.array(c, pa.binary()) for c in zip(*rows.values())]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "alone", "owner", "apart", "known", "known_owner"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """(key, anchors): the shared anchors of documents that don't know of them yet, and the known ones passed on."""
    blobs = {c: [v.as_py() for v in table[c]] for c in table.column_names if c != "part"}
    read = lambda c: np.concatenate([np.zeros(0, np.uint64), *[_widen(b, _HASH_BYTES) for b in blobs[c]]])
    keys = lambda c: np.concatenate([np.zeros(0, np.int64), *[_unpack(b) for b in blobs[c]]])
    hashes, owner, apart = read("alone"), keys("owner"), np.unique(read("apart"))
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    heads = _heads(hashes)
    tails = np.append(heads[1:], len(hashes)) - 1
    often = owner[heads] != owner[tails] if len(heads) else np.zeros(0, bool)
    if len(apart) and len(heads):
        spot = np.minimum(np.searchsorted(apart, hashes[heads]), len(apart) - 1)
        often |= apart[spot] == hashes[heads]
    keep = np.repeat(often, tails - heads + 1) if len(heads) else often
    hashes, owner = np.concatenate([hashes[keep], read("known")]), np.concatenate([owner[keep], keys("known_owner")])
    order = np.argsort(owner, kind="stable")
    hashes, owner = hashes[order], owner[order]
    heads = _heads(owner)
    ends = np.append(heads[1:], len(owner))
    blobs_ = [_narrow(hashes[a:b], _HASH_BYTES) for a, b in zip(heads, ends)]
    return pa.table({"key": pa.array(owner[heads], pa.int64()), "anchors": pa.array(blobs_, pa.binary())})


def _flagged(batch: pa.RecordBatch, lists: str, width: int) -> list[np.ndarray]:
    """Of each row, the sorted numbers in its lists of packed numbers."""
    column = batch.column(batch.schema.get_field_index(lists))
    out = []
    for i in range(batch.num_rows):
        row = column[i]
        blobs = [b.as_py() for b in row.values] if row.is_valid else []
        out.append(np.unique(_widen(b"".join(blobs), width)))
    return out


def _contexts(part, rows: list[np.ndarray], length: int, anchor: int, by_digest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a slice whose anchor (or, if by_digest, whose own hash) is among its row's numbers: (anchor, context hash, document, begin, end)."""
    hashes, owner, _, first, last = _occurrences(part, length, anchor)
    last = last + length
    digests = Hasher(part.data).spans(first, last)
    mine = digests if by_digest else hashes & _MASK
    sizes = [len(rows[part.first + i]) for i in range(part.last - part.first)]
    cuts = np.searchsorted(owner, np.arange(len(sizes) + 1))
    keep = np.zeros(len(owner), bool)
    for i in np.flatnonzero(sizes).tolist():
        at = slice(cuts[i], cuts[i + 1])
        flags = rows[part.first + i]
        spot = np.minimum(np.searchsorted(flags, mine[at]), len(flags) - 1)
        keep[at] = flags[spot] == mine[at]
    return hashes[keep] & _MASK, digests[keep], owner[keep], first[keep], last[keep]


def _outline(parts: int, length: int, anchor: int):
    """Batches of (key, text, anchors) to rows for the parts: context hashes with the batch's smallest document, and what other documents lose at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            keys, flags = batch.column(0).to_numpy(), _flagged(batch, "anchors", _HASH_BYTES)
            held = []
            for part in slices(batch.column(1)):
                hashes, digests, owner, _, _ = _contexts(part, flags, length, anchor, False)
                held.append((hashes, digests, keys[part.first : part.last][owner]))
            if not held:
                continue
            hashes, digests, owner = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((owner, digests, hashes))
            hashes, digests, owner = hashes[order], digests[order], owner[order]
            once = _heads(hashes, digests, owner)
            hashes, digests, owner = hashes[once], digests[once], owner[once]
            lowest = np.zeros(len(hashes), bool)
            lowest[_heads(hashes, digests)] = True
            rows: dict[int, list[bytes]] = {}
            heads = np.flatnonzero(lowest)
            for p, at in _deal(_spread(hashes[heads], parts), parts):
                at = heads[at]
                rows[p] = [_narrow(hashes[at], _HASH_BYTES), _narrow(digests[at], _DIGEST_BYTES), _pack(owner[at]), b"", b""]
            lost = np.flatnonzero(~lowest)
            for p, at in _deal(owner[lost] % parts, parts):
                row = rows.setdefault(p, [b""] * 5)
                row[3], row[4] = _narrow(digests[lost[at]], _DIGEST_BYTES), _pack(owner[lost[at]])
            columns = [pa.array(list(rows), pa.int32()), *[pa.array(c, pa.binary()) for c in zip(*rows.values())]] if rows else [pa.array([], pa.int32()), *[pa.array([], pa.binary())] * 5]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "hash", "digest", "owner", "lost", "lost_owner"])

    return run


def _spread(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(parts)).astype(np.int64)


def _compare(table: pa.Table) -> pa.Table:
    """(key, lost, asked): contexts that a smaller document has too, and those whose bytes are needed."""
    blobs = {c: [v.as_py() for v in table[c]] for c in table.column_names if c != "part"}
    read = lambda c, width: np.concatenate([np.zeros(0, np.uint64), *[_widen(b, width) for b in blobs[c]]])
    keys = lambda c: np.concatenate([np.zeros(0, np.int64), *[_unpack(b) for b in blobs[c]]])
    hashes, digests, owner = read("hash", _HASH_BYTES), read("digest", _DIGEST_BYTES), keys("owner")
    order = np.lexsort((owner, digests, hashes))
    hashes, digests, owner = hashes[order], digests[order], owner[order]
    first = _heads(hashes, digests)
    lowest = np.zeros(len(hashes), bool)
    lowest[first] = True
    least = owner[first[np.cumsum(lowest) - 1]] if len(first) else owner
    lost = owner > least
    group = _heads(hashes)
    sizes = np.diff(np.append(np.searchsorted(first, group), len(first)))  # different contexts of each anchor
    asked = first[np.repeat(sizes > 1, sizes)] if len(group) else first
    at = [_by_key(np.concatenate([owner[lost], keys("lost_owner")]), np.concatenate([digests[lost], read("lost", _DIGEST_BYTES)])), _by_key(owner[asked], digests[asked])]
    return pa.table(
        {
            "key": pa.array([k for x in at for k in x], pa.int64()),
            "lost": pa.array([b for b in at[0].values()] + [b""] * len(at[1]), pa.binary()),
            "asked": pa.array([b""] * len(at[0]) + [b for b in at[1].values()], pa.binary()),
        }
    )


def _by_key(owner: np.ndarray, numbers: np.ndarray) -> dict[int, bytes]:
    order = np.argsort(owner, kind="stable")
    owner, numbers = owner[order], numbers[order]
    heads = _heads(owner)
    ends = np.append(heads[1:], len(owner))
    return {int(owner[a]): _narrow(numbers[a:b], _DIGEST_BYTES) for a, b in zip(heads, ends)}


def _bytes_of(parts: int, length: int, anchor: int):
    """Batches of (key, text, asked) to rows for the parts: the asked contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            keys, asked = batch.column(0).to_numpy(), _flagged(batch, "asked", _DIGEST_BYTES)
            found: dict[int, dict[tuple[int, int, int], bytes]] = {}
            for part in slices(batch.column(1)):
                hashes, digests, owner, begin, end = _contexts(part, asked, length, anchor, True)
                data = part.data.tobytes()
                own = keys[part.first : part.last]
                for p, h, d, i, a, b in zip(_spread(hashes, parts).tolist(), hashes.tolist(), digests.tolist(), owner.tolist(), begin.tolist(), end.tolist()):
                    found.setdefault(p, {})[h, d, int(own[i])] = data[a:b]
            if not found:
                continue
            rows = []
            for p, items in found.items():
                h, d, k = (np.array(x, t) for x, t in zip(zip(*items), (np.uint64, np.uint64, np.int64)))
                sizes = np.array([len(c) for c in items.values()], np.uint16)
                rows.append((p, _narrow(h, _HASH_BYTES), _narrow(d, _DIGEST_BYTES), _pack(k), sizes.tobytes(), b"".join(items.values())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 5])], names=_BYTE_COLUMNS)

    return run


_BYTE_COLUMNS = ["part", "hash", "digest", "owner", "size", "bytes"]
#: A lost range of a context: the context's hash, then where the range starts and ends in it.
_RANGE = np.dtype([("digest", "<u8"), ("low", "<u2"), ("high", "<u2")])


def _resolve(length: int):
    """A part's contexts to (key, windows): ranges of each that a smaller document has too."""

    def run(table: pa.Table) -> pa.Table:
        blobs = {c: [v.as_py() for v in table[c]] for c in table.column_names if c != "part"}
        hashes = np.concatenate([_widen(b, _HASH_BYTES) for b in blobs["hash"]]).tolist()
        digests = np.concatenate([_widen(b, _DIGEST_BYTES) for b in blobs["digest"]]).tolist()
        keys = np.concatenate([_unpack(b) for b in blobs["owner"]]).tolist()
        sizes = np.frombuffer(b"".join(blobs["size"]), np.uint16).astype(np.int64)
        text, ends = b"".join(blobs["bytes"]), np.cumsum(sizes)
        lowest: dict[tuple[int, bytes], int] = {}
        variants: dict[int, list[bytes]] = {}
        named: dict[tuple[int, bytes], int] = {}
        for h, d, key, size, end in zip(hashes, digests, keys, sizes.tolist(), ends.tolist()):
            context = text[end - size : end]
            old = lowest.get((h, context))
            if old is None:
                variants.setdefault(h, []).append(context)
                named[h, context] = d
            if old is None or key < old:
                lowest[h, context] = key
        covered = _covered_windows({h: v for h, v in variants.items() if len(v) > 1}, lowest, length)
        out: dict[int, list[tuple[int, int, int]]] = {}
        for item, ranges in covered.items():
            out.setdefault(lowest[item], []).extend((named[item], low, high) for low, high in ranges)
        return pa.table({"key": pa.array(list(out), pa.int64()), "windows": pa.array([np.array(r, _RANGE).tobytes() for r in out.values()], pa.binary())})

    return run


def _covered_windows(variants: dict[int, list[bytes]], lowest: dict[tuple[int, bytes], int], length: int) -> dict[tuple[int, bytes], list[tuple[int, int]]]:
    """Of each context with different ones of the same anchor: ranges of windows that a smaller document has too."""
    items = [(h, c) for h, cs in variants.items() for c in cs]
    out: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    # Anchors are independent of each other: suffixes of some thousands of contexts are sorted at a time.
    low = 0
    while low < len(items):
        high = min(len(items), low + 4_000)
        while high < len(items) and items[high][0] == items[high - 1][0]:
            high += 1
        _sort_contexts(items[low:high], lowest, length, out)
        low = high
    return out


def _sort_contexts(items: list[tuple[int, bytes]], lowest: dict[tuple[int, bytes], int], length: int, out: dict) -> None:
    sizes = np.array([len(c) + 1 for _, c in items])
    begins = np.cumsum(sizes) - sizes
    # UTF-8 has no byte 255, so bytes move up by one and 0 parts the contexts.
    data = np.frombuffer(b"\xff".join(c for _, c in items) + b"\xff", np.uint8) + np.uint8(1)
    order = two_stage_sort(data, length)
    owner = np.repeat(np.arange(len(items)), sizes)
    inside = np.arange(len(data)) - begins[owner] + length < sizes[owner]
    order = order[inside[order]]
    same = common_prefixes(data, order, length)
    group = np.cumsum(~same) - 1
    keys = np.array([lowest[x] for x in items], np.int64)
    least = np.full(int(group[-1]) + 1, _FAR) if len(group) else np.zeros(0, np.int64)
    np.minimum.at(least, group, keys[owner[order]])
    lost = np.sort(order[least[group] < keys[owner[order]]])
    if not len(lost):
        return
    heads = np.flatnonzero(np.r_[True, (np.diff(lost) != 1) | (np.diff(owner[lost]) != 0)])
    tails = np.append(heads[1:], len(lost)) - 1
    for a, b in zip(lost[heads].tolist(), lost[tails].tolist()):
        i = int(owner[a])
        out.setdefault(items[i], []).append((a - int(begins[i]), b - int(begins[i]) + length))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256[, kept][, carried columns]) of each row of docs.

    Texts are UTF-8 bytes, null texts empty; matches never cross documents and
    are judged on the input. A byte goes if a string of `length` bytes over it
    also starts in a row with a smaller id, so of rows with the same id neither
    counts for the other. Rows with a null id come after all others. kept (if
    asked for) is what is left, as text; where a cut splits a character, its
    other bytes are left out. The columns in carry go along with their rows. Ids are integers. An empty table gives
    no rows.
    """
    # A document gets a row from each part that has something for it, up to the number of its shared anchors.
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    parts = max(LEAST_PARTS, pieces(docs.sparkSession, total, BYTES_A_PART))
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_FAR).cast("long"))
    texts = docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)])
    blobs = lambda names: "part int, " + ", ".join(f"{c} binary" for c in names)

    announced = texts.select("key", "text").mapInArrow(freed(_announce(parts, length, anchor)), blobs(["alone", "owner", "apart", "known", "known_owner"]))
    flags = announced.groupBy("part").applyInArrow(freed_group(_shared), "key long, anchors binary").groupBy("key").agg(F.collect_list("anchors").alias("anchors"))
    flags = cut(flags)
    dealt = texts.repartition(parts, "key")
    around = dealt.join(flags, "key").select("key", "text", "anchors")
    outlined = around.mapInArrow(freed(_outline(parts, length, anchor)), blobs(["hash", "digest", "owner", "lost", "lost_owner"]))
    compared = outlined.groupBy("part").applyInArrow(freed_group(_compare), "key long, lost binary, asked binary")
    answers = compared.groupBy("key").agg(*[F.collect_list(F.when(F.length(c) > 0, F.col(c))).alias(c) for c in ("lost", "asked")])
    answers = cut(answers)
    discard(flags)
    asked = dealt.join(answers.filter(F.size("asked") > 0).select("key", "asked"), "key").select("key", "text", "asked")
    gathered = asked.mapInArrow(freed(_bytes_of(parts, length, anchor)), blobs(_BYTE_COLUMNS[1:]))
    windows = gathered.groupBy("part").applyInArrow(freed_group(_resolve(length)), "key long, windows binary").groupBy("key").agg(F.collect_list("windows").alias("windows"))
    windows = cut(windows)
    joined = dealt.join(answers.select("key", "lost"), "key", "left").join(windows, "key", "left").select("key", "text", "lost", "windows", *[f"carried_{i}" for i in range(len(carry))])
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
    columns = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if keep_text else "")
    columns += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            lost = _flagged(batch, "lost", _DIGEST_BYTES)
            partly = [np.frombuffer(b"".join(b.as_py() for b in row.values) if row.is_valid else b"", _RANGE) for row in batch.column(3)]
            wanted = [np.union1d(a, b["digest"]) for a, b in zip(lost, partly)]
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for part in slices(batch.column(1)):
                _, context, owner, begin, end = _contexts(part, wanted, length, anchor, True)
                cuts = np.searchsorted(owner, np.arange(part.last - part.first + 1))
                for i in range(part.last - part.first):
                    low, high = int(part.starts[i]), int(part.ends[i])
                    text = part.data[low:high]
                    gone = np.zeros(len(text), bool)
                    at = slice(cuts[i], cuts[i + 1])
                    if cuts[i + 1] > cuts[i]:
                        gone = _covered(len(text), context[at], begin[at] - low, end[at] - low, lost[part.first + i], partly[part.first + i])
                    rest = text[~gone].tobytes()
                    sizes.append(len(text))
                    removed.append(len(text) - len(rest))
                    spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                    digests.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest.decode("utf-8", "ignore") if keep_text else "")
            ids = pa.array([None if k == _FAR else k for k in batch.column(0).to_pylist()], pa.int64()).cast(id_type)
            out = [ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                out, names = [*out, pa.array(kept, pa.string())], [*names, "kept"]
            out, names = [*out, *batch.columns[4:]], [*names, *carry]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return joined.mapInArrow(freed(cut_out), columns)


def _covered(n: int, context: np.ndarray, begin: np.ndarray, end: np.ndarray, lost: np.ndarray, partly: np.ndarray) -> np.ndarray:
    """Which of n bytes go: contexts that are lost whole, and lost ranges of others."""
    edges = np.zeros(n + 1, np.int64)
    if len(lost):
        spot = np.minimum(np.searchsorted(lost, context), len(lost) - 1)
        whole = lost[spot] == context
        np.add.at(edges, begin[whole], 1)
        np.add.at(edges, end[whole], -1)
    if len(partly):
        order = np.argsort(context, kind="stable")
        low = np.searchsorted(context[order], partly["digest"], side="left")
        high = np.searchsorted(context[order], partly["digest"], side="right")
        times = high - low
        which = np.repeat(np.arange(len(partly)), times)
        place = order[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        np.add.at(edges, begin[place] + partly["low"][which], 1)
        np.add.at(edges, begin[place] + partly["high"][which], -1)
    return np.cumsum(edges)[:n] > 0
