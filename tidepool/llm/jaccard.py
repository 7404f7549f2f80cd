"""Similarity join of documents by the Jaccard coefficient of their word shingles, exact.

1. Documents of equal shingle sets form a class; only classes are compared.
2. Routing. Of two sets that reach the threshold, at most d elements differ,
   with d known from their size class. The element space is cut into m > d
   segments, so at least one segment is alike in both sets; classes that share
   a segment's content get into one block (a connected component of this
   relation). m is larger than d by a slack for empty segments; a class with
   more empty ones than that also shares its prefix, the lowest elements of
   the set, one of which any partner must have. Elements in more than a
   fraction of the documents are left out of segments, which takes away at
   most as many differences, so nothing is lost and common lines and passages
   don't bind blocks together. Classes that meet so are listed in sets of at
   most MANY, one row a member. Within a set, pairs are held against the parity
   sketches of their elements: bits that differ are differing elements at
   least, so pairs with more of them than the threshold allows are no links.
   A set leaves a spanning forest of the other pairs, so rows grow with the
   members, never with their pairs. Where more than MANY classes share a key,
   in one batch or in all, each is tied to the smallest, whatever the sketches
   say; MANY decides how much is compared later, not what is found.
3. Search. In each block, T-occurrence search by DivideSkip: of the lists of a
   set's elements, the short ones are heap-merged, and what occurs in them
   often enough is looked up in the long ones by binary search. The first
   sets of components are tried before the others, and sets that are already
   connected are passed over, so a group of thousands of near copies costs no
   pairs. Blocks of more than CHUNK classes are searched in chunks; then one
   class of every component that was found searches the other chunks, and last
   every class outside the largest component of its block searches all of
   them. A pair not compared in these rounds is connected already, so
   components are exact without any cap.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .cluster import cut, discard, look_up, pieces
from .graph import components
from .words import Hasher, distinct, mix, shingles, slices, words
from .workers import freed, freed_group

#: Share of documents from which an element is too common for segments.
COMMON = 0.002
#: Classes of a block that are searched in one task.
CHUNK = 1024
#: Classes in one set up to which their pairs are held against sketches. Only speed depends on it.
MANY = 32
#: Documents for which keys go to one part, about: a part of their keys has some MB, and is one group in memory.
ROWS_A_PART = 1500
#: Bitmaps of 32,768 bits by which texts outside of blocks are passed over: 1 MB in all, whatever the input.
FILTER_BITMAPS = 256
_CLASS_RATIO = 1.5
_TABLE_BITS = 20


class Sizes:
    """Size classes and segment counts for a threshold in per cent."""

    def __init__(self, percent: int, largest: int):
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, ceil(low[-1] * _CLASS_RATIO)))
        self.percent = percent
        self.low = np.array(low)
        top = self.low[1:] - 1
        partner = top * 100 // percent
        self.differ = (100 - percent) * (top + partner) // (100 + percent)
        self.segments = np.ceil((self.differ + 3) / 0.9).astype(np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1

    def reaches_down(self, n: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether a set of n elements may have a partner in the size class below."""
        return (label > 0) & (-(-n * self.percent // 100) < self.low[label])


def _sets(column: pa.Array, k: int, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes, bounds) of each slice of texts."""
    for part in slices(column, SLICE):
        found = words(part)
        docs, hashes = shingles(Hasher(part.data, lower=lower).spans(found.begin, found.end), found, k)
        kept, bounds = distinct(docs, hashes, len(part.starts))
        yield part.first, kept, bounds


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _sketch(own: np.ndarray) -> bytes:
    """Parity of the elements by hash: about two bits an element, a power of two of them."""
    bits = 1 << max(6, int(2 * len(own) - 1).bit_length())
    odd = np.zeros(bits, np.uint8)
    np.add.at(odd, (own % np.uint64(bits)).astype(np.int64), np.uint8(1))
    return np.packbits(odd & 1).tobytes()


def _folded(sketch: bytes, size: int) -> int:
    """A sketch at `size` bytes: a position modulo the smaller number of bits."""
    bits, out = 8 * len(sketch), int.from_bytes(sketch, "little")
    while bits > 8 * size:
        bits //= 2
        out = (out >> bits) ^ (out & ((1 << bits) - 1))
    return out


def _differing(a: bytes, b: bytes) -> int:
    """Elements in which two sets differ at least."""
    size = min(len(a), len(b))
    return (_folded(a, size) ^ _folded(b, size)).bit_count()


#: Documents whose elements or keys a task counts together, about, and bytes of the batches in which it gets their texts. Only memory and speed depend on them.
AT_ONCE, TEXT_BYTES = 2500, 4 << 20
#: Bytes of text that are cut into shingles at a time, and of keys that a task sends at a time.
SLICE, SENT = 1 << 17, 1 << 20


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def _often(values: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """What is `least` times or more in an ascending array, and how often."""
    heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    counts = np.diff(heads, append=len(values))
    often = counts >= least
    return values[heads[often]], counts[often]


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str, lower: bool) -> DataFrame:
    """(id, n, digest, sketch) of each document, and (token, docs) of what is common in about AT_ONCE documents."""
    kind = docs.schema[id_col].dataType.simpleString()

    def common(tokens: list[np.ndarray], n: int, ids: pa.DataType) -> pa.RecordBatch:
        every = np.concatenate(tokens)
        tokens.clear()
        every.sort()
        found, counts = _often(every, max(5, COMMON * n))
        m = len(found)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(m, ids), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.binary()), pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))],
            names=["id", "n", "digest", "sketch", "token", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, ids = [], 0, pa.null()
        for batch in _in_pieces(batches):
            sizes, digests, sketches = [], [], []
            for _, kept, bounds in _sets(batch.column(1), k, lower):
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    sizes.append(b - a)
                    digests.append(_digest(kept[a:b]).hex() if b > a else None)
                    sketches.append(_sketch(kept[a:b]) if b > a else None)
                tokens.append(kept)
            n, ids = batch.num_rows, batch.column(0).type
            held += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(sketches, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                names=["id", "n", "digest", "sketch", "token", "docs"],
            )
            if held >= AT_ONCE:
                yield common(tokens, held, ids)
                held = 0
        if held:
            yield common(tokens, held, ids)

    return docs.select(id_col, text_col).mapInArrow(freed(run), f"id {kind}, n long, digest string, sketch binary, token long, docs long")


def _segment_keys(n: int, docs: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, label: np.ndarray, rules: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key) of every segment with elements, and whether a document has more empty ones than its slack."""
    m = rules.segments[label]
    base = np.concatenate([[0], np.cumsum(m)])
    spot = base[docs] + (mix(tokens ^ np.uint64(0x5DEECE66D)) % m[docs].astype(np.uint64)).astype(np.int64)
    total = np.zeros(base[-1], np.uint64)
    np.add.at(total, spot, mix(tokens))
    filled = np.flatnonzero(np.bincount(spot, minlength=base[-1]))
    owner = np.searchsorted(base, filled, side="right") - 1
    key = mix(total[filled] + mix(((filled - base[owner]).astype(np.uint64) << np.uint64(8)) + label[owner].astype(np.uint64) + np.uint64(1)))
    empty = m - np.bincount(owner, minlength=n)
    return owner, key, empty > m - rules.differ[label] - 1


def _keys(kept: np.ndarray, bounds: np.ndarray, common: np.ndarray, table: np.ndarray, rules: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) by which partners meet."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    docs = np.repeat(np.arange(n), sizes)
    plain = np.ones(len(kept), bool)
    maybe = np.flatnonzero(table[(kept >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
    if len(maybe) and len(common):
        spot = np.minimum(np.searchsorted(common, kept[maybe]), len(common) - 1)
        plain[maybe[common[spot] == kept[maybe]]] = False
    label = rules.of(np.maximum(sizes, 1))
    owners, keys = [], []
    sparse = np.zeros(n, bool)
    for down in (False, True):
        use = sizes > 0
        if down:
            use &= rules.reaches_down(sizes, label)
        ids = np.flatnonzero(use)
        if not len(ids):
            continue
        new = np.full(n, -1)
        new[ids] = np.arange(len(ids))
        at = np.flatnonzero(plain & use[docs])
        owner, key, few = _segment_keys(len(ids), new[docs[at]], kept[at], sizes[ids], label[ids] - down, rules)
        owners.append(ids[owner])
        keys.append(key)
        sparse[ids[few]] = True
    if sparse.any():
        # The prefix: with all but the required overlap of the lowest elements, one is shared.
        prefix = sizes - -(-sizes * rules.percent // 100) + 1
        at = np.flatnonzero(sparse[docs] & (np.arange(len(kept)) - bounds[:-1][docs] < prefix[docs]))
        owners.append(docs[at])
        keys.append(mix(kept[at] + np.uint64(0x632BE59BD9B4E019)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(keys)


def _groups(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) in order, and where each key's nodes start and how many they are."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    heads = np.flatnonzero(first)
    return keys, nodes, heads, np.diff(np.append(heads, len(keys)))


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct (a, b) in order, two rows."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[new], b[new]])


def _stars(nodes: np.ndarray, heads: np.ndarray, sizes: np.ndarray, big: np.ndarray) -> np.ndarray:
    """Edges from the smallest node of each big group to its others, two rows."""
    inside = np.repeat(big, sizes)
    lowest = np.repeat(nodes[heads], sizes)
    apart = inside & (nodes != lowest)
    return _distinct_pairs(lowest[apart], nodes[apart])


def _sets_of(nodes: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, node) of groups of at most MANY nodes: all groups that hang together as one set, if those are at most MANY nodes, else each group.

    A set is named by a hash of its members, so the same set has the same name
    in every part.
    """
    apart = sizes > 1
    heads, sizes = heads[apart], sizes[apart]
    if not len(heads):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.repeat(heads, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    group = np.repeat(np.arange(len(heads)), sizes)
    known, member = np.unique(nodes[at], return_inverse=True)
    label = np.arange(len(known))
    while True:  # the smallest label of a group for its members, until none changes
        low = np.minimum.reduceat(label[member], np.cumsum(sizes) - sizes)
        new = label.copy()
        np.minimum.at(new, member, low[group])
        new = new[new]
        if (new == label).all():
            break
        label = new
    whole = np.bincount(label, minlength=len(known)) <= MANY
    large = ~whole[label[member]]
    kind = np.concatenate([label[whole[label]], len(known) + group[large]])
    node = np.concatenate([known[whole[label]], nodes[at][large]])
    order = np.lexsort((node, kind))
    kind, node = kind[order], node[order]
    starts = np.flatnonzero(np.r_[True, np.diff(kind) != 0])
    name = mix(np.add.reduceat(mix(node.view(np.uint64)), starts)).view(np.int64)
    rows = _distinct_pairs(np.repeat(name, np.diff(np.append(starts, len(kind)))), node)
    return rows[0], rows[1]


_BLOB = ["part", "edges", "x", "y", "head"]


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    p, e, *blobs = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.bool_()), *[pa.array(x, pa.binary()) for x in blobs]], names=_BLOB)


def candidates(docs: DataFrame, common: np.ndarray, rules: Sizes, k: int, text_col: str, lower: bool, parts: int) -> DataFrame:
    """(a, b, star): edges a, b of nodes that share a crowded key (star), and members b of the sets a that share a key.

    Keys are dealt to parts by value. Of a key that more than MANY nodes of a
    batch share, only the smallest is sent, the others get their edge at once,
    so a key that a third of all documents share brings its part a few entries
    a batch. Such an entry is marked as a head: it stands for nodes that the
    part doesn't see, so a key with a head gets stars however few its entries.
    """
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(common >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def blobs_of(keys: list[np.ndarray], nodes: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(keys), np.concatenate(nodes)
        keys.clear()
        nodes.clear()
        key, node, heads, sizes = _groups(*every)
        del every
        big = sizes > MANY
        edges = _stars(node, heads, sizes, big)
        head = np.repeat(big, sizes)
        sent = ~head
        sent[heads] = True
        key, node, head = key[sent], node[sent], head[sent]
        part = (key % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        key, node, head, part = key[order], node[order], head[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        rows, size = [], 0
        for p, i, j in zip(range(parts), cuts[:-1].tolist(), cuts[1:].tolist()):
            if j > i:
                rows.append((p, False, key[i:j].tobytes(), node[i:j].tobytes(), head[i:j].tobytes()))
                size += 17 * (j - i)
            if size >= SENT:
                yield _blobs(rows)
                rows, size = [], 0
        if edges.shape[1]:
            rows.append((n % parts, True, edges[0].tobytes(), edges[1].tobytes(), b""))
        if rows:
            yield _blobs(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, nodes, held = set(), [], [], 0
        for batch in _in_pieces(batches):
            for _, kept, bounds in _sets(batch.column(0), k, lower):
                names = np.array([_node(_digest(kept[a:b])) for a, b in zip(bounds[:-1], bounds[1:])], np.int64)
                owner, key = _keys(kept, bounds, common, table, rules)
                fresh = np.array([x not in seen and not seen.add(x) for x in names.tolist()], bool)
                keep = fresh[owner]
                keys.append(key[keep])
                nodes.append(names[owner[keep]])
            held += batch.num_rows
            if held >= AT_ONCE:
                yield from blobs_of(keys, nodes, held)
                seen, held = set(), 0
        if held:
            yield from blobs_of(keys, nodes, held)

    def meet(table: pa.Table) -> pa.Table:
        edges = table["edges"].to_numpy()
        read = lambda name, kind, of: np.frombuffer(b"".join(v.as_buffer() for v, e in zip(table[name], edges) if e == of), kind)
        sent = read("x", np.uint64, False)
        key, node, heads, sizes = _groups(sent, read("y", np.int64, False))
        tied = (sizes > MANY) | np.isin(key[heads], sent[read("head", bool, False)])
        stars = np.concatenate([_stars(node, heads, sizes, tied), np.stack([read("x", np.int64, True), read("y", np.int64, True)])], axis=1)
        both = np.concatenate([stars, np.stack(_sets_of(node, heads[~tied], sizes[~tied]))], axis=1)
        return pa.table({"a": pa.array(both[0]), "b": pa.array(both[1]), "star": pa.array(np.arange(both.shape[1]) < stars.shape[1])})

    blobs = docs.select(text_col).mapInArrow(freed(send), "part int, edges boolean, x binary, y binary, head binary")
    return blobs.groupBy("part").applyInArrow(freed_group(meet), "a long, b long, star boolean").distinct()


def _forest(nodes: list[int], sizes: list[int], sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Edges that connect the nodes as all pairs do that may be links by size and sketch."""
    root = list(range(len(nodes)))
    out = []
    for j in range(1, len(nodes)):
        for i in range(j):
            if root[i] == root[j] or nodes[i] == nodes[j]:
                continue
            low, high = sorted((sizes[i], sizes[j]))
            if 100 * low < percent * high or _differing(sketches[i], sketches[j]) > (100 - percent) * (low + high) // (100 + percent):
                continue
            out.append((nodes[i], nodes[j]))
            old, new = root[j], root[i]
            root = [new if r == old else r for r in root]
    return out


def near_enough(found: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b): stars as they are, and a spanning forest of what may be links in each set of at most MANY (or of two sets of one name)."""
    members = found.filter("not star").select(F.col("a").alias("set"), F.col("b").alias("node")).join(classes.select("node", "n", "sketch"), "node")
    sets = members.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("node", "n", "sketch"))).alias("m")).filter(F.size("m") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            cuts = lists.offsets.to_pylist()
            node, n, sketch = (lists.values.field(i).to_pylist() for i in range(3))
            edges = [e for a, b in zip(cuts[:-1], cuts[1:]) for e in _forest(node[a:b], n[a:b], sketch[a:b], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return sets.select("m").mapInArrow(freed(run), "a long, b long").unionByName(found.filter("star").select("a", "b"))


class Lists:
    """Inverted lists of a chunk of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.postings = owner[order]
        self.tokens, self.begin = np.unique(tokens[order], return_index=True)
        self.end = np.append(self.begin[1:], len(tokens))
        # (list, entry) as one ascending number, so that many lists are probed by one binary search.
        self.places = np.repeat(np.arange(len(self.tokens)), self.end - self.begin) * np.int64(max(1, len(sets))) + self.postings
        self.longest = int((self.end - self.begin).max()) if len(self.tokens) else 0

    def search(self, query: np.ndarray, percent: int, label: np.ndarray, first: np.ndarray, joined: set[int], limit: int) -> list[int]:
        """Sets before `limit` that reach the threshold with the query, at most one of each label, none of the labels in `joined`.

        Sets that are the first of their label are tried before the others.
        The labels of the sets found are added to `joined`.
        """
        if not len(self.tokens):
            return []
        spot = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        spot = spot[self.tokens[spot] == query]
        need = -(-len(query) * percent // 100)
        if len(spot) < need:
            return []
        spot = spot[np.argsort(self.end[spot] - self.begin[spot], kind="stable")]
        n_long = min(need - 1, int(need / (0.0085 * np.log2(self.longest + 1) + 1)))
        short, long_ = spot[: len(spot) - n_long], spot[len(spot) - n_long :] * np.int64(len(self.sizes))
        fits = 100 * np.minimum(self.sizes, len(query)) >= percent * np.maximum(self.sizes, len(query))
        fits[limit:] = False
        out = []
        for leading in (True, False):
            wanted = fits & (first == leading)
            if joined:
                wanted &= ~np.isin(label, list(joined))
            if not wanted.any():
                continue
            lists = [self.postings[a:b] for a, b in zip(self.begin[short], self.end[short])]
            for y, times in _merged([x[wanted[x]].tolist() for x in lists], need - n_long):
                if int(label[y]) in joined:
                    continue
                probes = long_ + y
                at = np.minimum(np.searchsorted(self.places, probes), len(self.places) - 1)
                both = times + int((self.places[at] == probes).sum())
                if 100 * both >= percent * (len(query) + int(self.sizes[y]) - both):
                    out.append(y)
                    joined.add(int(label[y]))
        return out


def _merged(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """Entries that occur in at least `least` of the ascending lists, and in how many, by a heap of the lists' heads."""
    last, times = -1, 0
    for x in heapq.merge(*[x for x in lists if x]):
        if x == last:
            times += 1
            continue
        if times >= least:
            yield last, times
        last, times = x, 1
    if times >= least:
        yield last, times


def _search_chunk(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """A label for each set: the position of the first one that it is connected to."""
    lists = Lists(sets)
    label, first = np.arange(len(sets)), np.ones(len(sets), bool)
    for q in range(1, len(sets)):
        joined: set[int] = set()
        lists.search(sets[q], percent, label, first, joined, q)
        if joined:
            low = min(joined)
            label[np.isin(label, list(joined))] = low
            label[q] = low
            first = label == np.arange(len(sets))
    return label


def _read(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in column]


def _by_digest(table: pa.Table) -> pa.Table:
    """One row for each digest, in its order."""
    table = table.sort_by("digest")
    names = np.array(table["digest"].to_pylist(), object)
    first = np.ones(len(names), bool)
    first[1:] = names[1:] != names[:-1]
    return table.filter(pa.array(first))


def _cross_links(sets: DataFrame, queries: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the query classes to classes of other components, in all chunks of their blocks.

    Queries are dealt into pieces too where there are many, so that a task
    holds one chunk and some chunks' worth of queries at most.
    """
    index = sets.join(comps, "digest")
    few = queries.count() <= 4 * CHUNK
    piece = F.lit(1) if few else F.ceil(F.col("chunks") / 4).cast("int")
    asked = index.join(queries, "digest").withColumn("piece", F.pmod(F.xxhash64("digest", F.lit(1)), piece).cast("int"))
    asked = asked.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("digest", "component", "set", "block", "chunk", "piece")])
    index = index.withColumn("piece", F.explode(F.sequence(F.lit(0), piece - 1)))

    def search(_, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())})
        if not left.num_rows or not right.num_rows:
            return empty
        left, right = _by_digest(left), _by_digest(right.rename_columns([c.removeprefix("q_") for c in right.column_names]))
        names, numbers = left["digest"].to_pylist(), {}
        label = np.array([numbers.setdefault(c, len(numbers)) for c in left["component"].to_pylist()])
        first = np.zeros(len(label), bool)
        first[np.unique(label, return_index=True)[1]] = True
        lists = Lists(_read(left["set"]))
        a, b = [], []
        for name, mine, query in zip(right["digest"].to_pylist(), right["component"].to_pylist(), _read(right["set"])):
            hits = lists.search(query, percent, label, first, {numbers[mine]} if mine in numbers else set(), len(label))
            a += [name] * len(hits)
            b += [names[y] for y in hits]
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return index.groupBy("block", "chunk", "piece").cogroup(asked.groupBy("q_block", "q_chunk", "q_piece")).applyInArrow(search, "a string, b string")


def _maybe_in(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose column may be among the wanted ones', before an exact join.

    Hashes of the wanted values set bits of FILTER_BITMAPS bitmaps, which are
    broadcast. With many values more other rows pass; no wanted one is lost.
    """
    h = F.xxhash64(column)
    bucket, at = F.pmod(h, F.lit(FILTER_BITMAPS)).alias("__bucket"), F.pmod(F.shiftright(h, 8), F.lit(32768)).alias("__at")
    bits = wanted.select(bucket, at).groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    marked = rows.select("*", bucket, at).join(F.broadcast(bits), "__bucket")  # FILTER_BITMAPS rows at most
    byte = "cast(conv(hex(substring(__bits, cast(__at div 8 as int) + 1, 1)), 16, 10) as int)"
    return marked.filter(f"(shiftright({byte}, cast(__at % 8 as int)) & 1) = 1").drop("__bucket", "__at", "__bits")


def link_components(
    docs: DataFrame, *, k: int = 5, percent: int = 80, lower: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_shingles, component_id) of each row of docs.

    Sets are the distinct runs of k words of a text (lower-cased A-Z if lower;
    a shorter text is one run as a whole). Two documents link when 100 x
    intersection >= percent x union. component_id is the smallest id reachable
    by links, the own id included. Null, empty and wordless texts have no
    shingles and link with nothing. Rows with a null id take part with the
    smallest non-null id of their component, or null. Repeated rows are equal
    documents. Ids may be of any type that can be ordered. An empty table gives
    no rows. percent must be at least 67.
    Elements are compared by 64-bit hash, classes by a 128-bit one.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must be between 67 and 100")
    signed = cut(signatures(docs, k, id_col, text_col, lower), TEXT_BYTES)
    seen = signed.filter("n is not null").agg(F.count("n").alias("rows"), F.max("n").alias("largest")).first()
    own = signed.filter("n is not null").select("id", "n", "digest", "sketch")
    if not seen["rows"]:
        return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    often = signed.filter("token is not null").groupBy("token").agg(F.sum("docs").alias("docs"))
    often = often.filter(F.col("docs") >= COMMON * seen["rows"]).select("token")  # at most the mean set size / COMMON
    common = np.sort(np.array([r["token"] for r in often.collect()], np.int64).view(np.uint64))
    rules = Sizes(percent, int(seen["largest"]))

    node = F.expr("cast(conv(" + "||".join(f"substring(digest, {i}, 2)" for i in range(15, 0, -2)) + ", 16, -10) as bigint)")
    classes = own.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("node", node))
    met = cut(candidates(docs, common, rules, k, text_col, lower, pieces(docs.sparkSession, seen["rows"], ROWS_A_PART)), TEXT_BYTES)
    edges = cut(near_enough(met, classes, percent), TEXT_BYTES)
    discard(met)
    blocks = components(edges)
    discard(edges)
    members = cut(classes.join(blocks.withColumnRenamed("component", "block"), "node").select("digest", "rep", "block"))
    discard(blocks)
    chunks = members.groupBy("block").agg(F.ceil(F.count("digest") / CHUNK).cast("int").alias("chunks"))
    dealt = members.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs, digests = [], []
            for _, kept, bounds in _sets(batch.column(4), k, lower):
                for a, b in zip(bounds[:-1], bounds[1:]):
                    blobs.append(kept[a:b].tobytes())
                    digests.append(_digest(kept[a:b]).hex())
            keep = pa.array([d == e for d, e in zip(digests, batch.column(0).to_pylist())], pa.bool_())
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blobs, pa.binary())], names=["digest", "block", "chunks", "chunk", "set"])
            yield out.filter(keep)

    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    shaped = dealt.join(_maybe_in(texts, members, "rep"), "rep").select("digest", "block", "chunks", "chunk", "text")
    sets = cut(shaped.mapInArrow(freed(shape), "digest string, block long, chunks int, chunk int, set binary"), TEXT_BYTES)
    discard(members)

    def within(table: pa.Table) -> pa.Table:
        table = _by_digest(table)
        names = table["digest"].to_pylist()
        label = _search_chunk(_read(table["set"]), percent)
        return pa.table({"digest": pa.array(names, pa.string()), "component": pa.array([names[i] for i in label], pa.string()), "block": table["block"], "chunks": table["chunks"]})

    found = cut(sets.groupBy("block", "chunk").applyInArrow(within, "digest string, component string, block long, chunks int"), TEXT_BYTES)
    comps = found.select("digest", "component")
    large = found.filter("chunks > 1")
    if large.take(1):
        wide = sets.filter("chunks > 1")
        linked = large.select(F.col("digest").alias("a"), F.col("component").alias("b"))
        state = large.select("digest", "component")
        leaders = large.filter("digest = component").select("digest")
        for queries in (leaders, None):
            if queries is None:
                sizes = state.join(large.select("digest", "block"), "digest").groupBy("block", "component").count()
                most = sizes.groupBy("block").agg(F.max_by("component", F.struct("count", "component")).alias("most"))
                rest = state.join(large.select("digest", "block"), "digest").join(most, "block")
                queries = cut(rest.filter("component <> most").select("digest"))
                if not queries.take(1):
                    break
            linked = cut(linked.unionByName(_cross_links(wide, queries, state, percent)), TEXT_BYTES)
            joined = components(linked)
            state = cut(
                large.select("digest")
                .join(joined.withColumnRenamed("node", "digest"), "digest", "left")
                .select("digest", F.coalesce("component", "digest").alias("component"))
            )
        comps = found.filter("chunks = 1").select("digest", "component").unionByName(state)
    discard(sets)
    lowest = cut(comps.join(classes, "digest").groupBy("component").agg(F.min("rep").alias("lowest")))
    named = look_up(comps, lowest, "component").select("digest", "lowest")
    totals = cut(classes.join(named, "digest", "left").select("digest", F.coalesce("lowest", "rep").alias("component_id")))
    for table in (found, lowest, classes):
        discard(table)
    return own.drop("sketch").join(totals, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )
