"""All pairs of documents whose sets of word shingles reach a Jaccard similarity, by T-occurrence search.

Two sets of n and m shingles link only if they share T = ceil(t/(1+t) (n+m)) of them. So a set's shingles are ordered (the
same way everywhere: ordinary ones by hash, then those with long inverted lists by hash) and linked sets meet
in the first n - ceil(t n) + 1. The steps:

1. Each document's set is hashed; equal sets count as one from here on, named by their digest. Prefixes in hash order are dealt
   out by shingle. A set stays only if some prefix shingle has another owner of fitting size, with enough shingles
   behind it in both sets to reach T.
2. Sets that stay are written in blocks, bucketed by runs of blocks. Owners of every shingle are counted over all blocks, and each block
   gets back a mark for each of its shingles: one owner, some, or more than ``short`` (a long list). Nothing of this is broadcast, so
   any number of lists may be long, and only the counts and marks are shuffled, not the sets.
3. Sets are ordered anew, long lists last, which is DivideSkip's division: short lists are merged, long
   ones only probed. Owners of each short list are paired with the larger sets among them, and a query's sorted partner
   lists are heap-merged with their counts. A pair survives if its count, and all that could follow the prefixes,
   reaches T. Sets so common that their prefix reaches into long lists ("dense") are tied to the other dense owners of
   those lists by a star, not by pairs; a block ties its own and sends one of them on.
4. Families (components of surviving ties) are brought together, each set once, several families to a task. Inside a
   family DivideSkip runs over whole sets: short lists are merged up to T - L occurrences, the L long lists are probed by
   binary search, and exact counts decide. Jaccard distance is a metric, so members within half the
   allowed distance of a pivot (the "ball") all link with each other; those links are counted without being searched. A family
   too large for a task is cut into blocks of members: balls are found block by block, and each pair of blocks with
   members outside the ball is searched by itself, exactly, giving a spanning forest of its links.

Entries travel as packed arrays. No list is turned into all its pairs: lists beyond ``short`` never are, and shorter
ones cost at most ``short`` entries per owner. Work grows with the square of a family only in members outside its ball.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, bucketed, forget, materialise, parts_for
from .components import connected

SHORT = 32  # owners of a list that is merged; longer lists are probed
BROADCAST = 200_000  # rows of 40 bytes that may be broadcast: some 10 MB; more are joined by sorting
HEAVY = 16  # owners of a shingle in one batch beyond which they are not listed there
FAMILY_ENTRIES = 1_000_000  # shingles of a family that one task searches
BALL = 32  # members of a family from which a pivot is looked for
DOCS = 1024  # documents that a worker handles at a time
BLOCK_ENTRIES = 1 << 18  # shingles of a block of sets, unless one set has more
RUN_BITS = 3  # blocks of a run, that is of a group when marks come back: 8 of 2 MB
BLOCKS = 4  # blocks of sets that a worker is handed at a time
BLOCK_BITS, SET_BITS = 24, 11  # a set's name: task, block of the task, place in the block

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
#: Prefixes are the smallest hashes of a set; times an odd number they spread evenly over parts, one to one.
_DEAL = np.uint64(0xD6E8FEB86659FD93)
_UNDEAL = np.uint64(pow(int(_DEAL), -1, 1 << 64))
_KEY_BITS = np.uint64((1 << 40) - 1)
_COUNTED = 6  # leading bytes of a hash by which owners are counted: a rare clash counts two shingles as one, the same way in all sets


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than a shingle make one shingle of all of them."""
    from xxhash import xxh3_64_intdigest

    # bytes.lower changes A-Z only, bytes.split cuts at space and the controls 9 to 13 only.
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : len(w) - k + 1 + j]) * _MIX
        h ^= h >> _SHIFT
    h.sort()
    return h[_new(h)]


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows starts, in sorted columns."""
    first = np.ones(len(columns[0]), bool)
    if len(first):
        first[1:] = False
        for c in columns:
            first[1:] |= c[1:] != c[:-1]
    return first


def least_overlap(n, percent: int):
    """Shingles that a set of ``n`` shares with any partner at least."""
    return -(-n * percent // 100)


def pair_overlap(n, m, percent: int):
    """Shingles that sets of ``n`` and ``m`` share if they link."""
    return -(-(n + m) * percent // (100 + percent))


def divide_skip(query: np.ndarray, lists: np.ndarray, starts: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """T-occurrence search: owners on at least ``need`` of the query's lists, and on how many.

    ``lists`` holds all inverted lists (sorted owners) end to end, list ``i`` from ``starts[i]``; ``query`` numbers the
    query's lists. The L longest are set aside; the others, being sorted runs, are merged (a merge sort finds the runs) and owners
    on at least ``need - L`` of them are probed in the long lists by binary search. Work is that of the lists read, however many
    members there are.
    """
    length = starts[query + 1] - starts[query]
    order = query[np.argsort(length, kind="stable")]
    longest = int(length.max(initial=1))
    apart = min(max(0, need - 1), int(need / (0.0085 * np.log2(longest + 1) + 1)), len(order))
    while apart and starts[order[-apart] + 1] - starts[order[-apart]] < 16:  # probing pays for lists of some length
        apart -= 1
    short, long = order[: len(order) - apart], order[len(order) - apart :]
    size = starts[short + 1] - starts[short]
    at = np.repeat(starts[short] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    merged = np.sort(lists[at], kind="stable")
    first = np.flatnonzero(_new(merged))
    count = np.diff(np.concatenate([first, [len(merged)]]))
    enough = count >= max(1, need - apart)
    found, count = merged[first[enough]], count[enough]
    for i in long:
        own = lists[starts[i] : starts[i + 1]]
        place = np.searchsorted(own, found)
        count += (place < len(own)) & (own[np.minimum(place, len(own) - 1)] == found)
    good = count >= need
    return found[good], count[good]


def _slices(dealt: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Parts of sorted, evenly spread hashes: equal ranges."""
    edges = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64)
    bounds = [0, *np.searchsorted(dealt, edges).tolist(), len(dealt)]
    return ((p, slice(a, b)) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b)


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, DOCS):
            yield whole.slice(at, DOCS)
        pa.default_memory_pool().release_unused()


def _short_key(key: bytes, n: int) -> int:
    """A set in prefix entries: its size, up to 2^24 - 1, above 40 bits of its digest."""
    return min(n, (1 << 24) - 1) << 40 | int.from_bytes(key[:5], "little")


FIRST = "part int, ids array<long>, marks array<long>, sizes array<int>, keys array<binary>, listed array<boolean>, h binary, k binary, pos binary"


def _first_prefixes(words: int, percent: int, parts: int) -> Callable:
    """Per batch: its documents, and prefix entries (shingle, set) by part of the shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        turn = 0
        for b in _few(batches):
            ids, marks, sizes, keys, hashes, seen, len_of = b.column(0).to_pylist(), b.column(2).to_pylist(), [], [], [], {}, {}
            for doc, text in zip(ids, b.column(1).to_pylist(), strict=True):
                s = shingle_set(text, words) if text else np.zeros(0, np.uint64)
                sizes.append(len(s))
                key = xxhash.xxh3_128_digest(s) if len(s) and doc is not None else None
                keys.append(key)
                if key and key not in seen:
                    len_of[key] = len(s)
                    seen[key] = len(hashes)
                    hashes.append(s[: len(s) - least_overlap(len(s), percent) + 1] * _DEAL)
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            order = np.argsort(h)
            h, owner = h[order], np.repeat(np.arange(len(hashes)), np.fromiter(map(len, hashes), np.int64, len(hashes)))[order]
            pos = np.minimum(np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0), 65535).astype(np.uint16)[order]
            k = np.fromiter((_short_key(x, len_of[x]) for x in seen), np.uint64, len(seen))[owner]
            # Sets with a shingle of very many sets of this batch stay anyway; they needn't be listed one by one.
            start = np.flatnonzero(_new(h))
            count = np.diff(np.concatenate([start, [len(h)]]))
            heavy = np.repeat(count > HEAVY, count)
            listed = np.zeros(len(hashes), bool)
            listed[owner[heavy]] = True
            # One owner stays listed for those of other batches to meet; it has room on both sides.
            one = np.zeros(len(h), bool)
            one[start[count > HEAVY]] = True
            k = np.where(one, k & _KEY_BITS, k)
            keep = ~heavy | one
            h, k, pos = h[keep], k[keep], pos[keep]
            rows = {p: [p, h[x].tobytes(), k[x].tobytes(), pos[x].tobytes()] for p, x in _slices(h, parts)}
            home = turn % parts
            turn += 1
            rows.setdefault(home, [home, None, None, None])
            own = [bool(key and listed[seen[key]]) for key in keys]
            docs = [[(x if p == home else []) for p in rows] for x in (ids, marks, sizes, keys, own)]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.bool_())]
            cells = [[r[i] for r in rows.values()] for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells[0], pa.int32()), *[pa.array(x, t) for x, t in zip(docs, kinds, strict=True)], *[pa.array(c, pa.binary()) for c in cells[1:]]],
                ["part", "ids", "marks", "sizes", "keys", "listed", "h", "k", "pos"],
            )

    return run


def _range_max(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest of ``values[low:high]`` for each pair of bounds; -1 for empty ranges. A table of powers of two."""
    out = np.full(len(low), -1, np.int64)
    span = high - low
    level, table = 0, values
    while (todo := span >= 1 << level).any():
        here = todo & (span < 2 << level)
        i = low[here]
        out[here] = np.maximum(table[i], table[high[here] - (1 << level)])
        table = np.maximum(table[: -(1 << level)], table[1 << level :]) if len(table) > 1 << level else table
        level += 1
    return out


SHARED = "kind int, doc_id long, mark long, n int, key binary, k long, listed boolean"


def _shared_sets(percent: int) -> Callable:
    """Kind 0: documents; 1: sets (k) with a prefix shingle that a possible partner owns too."""

    def run(group: pa.Table) -> pa.Table:
        h, k, pos = (_joined(group.column(c), t) for c, t in (("h", np.uint64), ("k", np.uint64), ("pos", np.uint16)))
        order = np.argsort(h)
        # Most shingles have one owner: those go first.
        again = np.zeros(len(h), bool)
        same = h[order[1:]] == h[order[:-1]]
        again[1:] = same
        again[:-1] |= same
        order = order[again]
        h, k, pos = h[order], k[order], pos[order].astype(np.int64)
        order = np.lexsort((pos, k, h))  # by size within a list, as the key begins with it
        h, k, pos = h[order], k[order], pos[order]
        new = _new(h, k)
        h, k, pos = h[new], k[new], pos[new]
        n = (k >> np.uint64(40)).astype(np.int64)
        # Size 0 marks an owner that stands for very many; size 2^24 - 1 may be larger: both fit anything.
        vague = (n == 0) | (n == (1 << 24) - 1)
        behind = np.where(vague | (pos == 65535), 1 << 40, n - pos)
        # Owners of sizes n and m may link here only if both have T(n, m) shingles from this one on, that is
        # m <= room(n) and n <= room(m) with room = behind * (100 + percent) / percent - size. So an owner stays
        # if, among those of fitting size in its list, the largest room (but its own) is at least its size.
        room = np.minimum(behind * (100 + percent) // percent - n, 1 << 24)
        room[vague] = 1 << 24
        lists = np.cumsum(_new(h)) - 1 if len(h) else n
        at = (lists << 26) + n
        low = np.searchsorted(at, (lists << 26) + np.where(vague, 0, least_overlap(n, percent)))
        high = np.searchsorted(at, (lists << 26) + np.where(vague, 1 << 25, np.minimum(n * 100 // percent, room)), "right")
        own = np.arange(len(h))
        best = np.maximum(_range_max(room, low, np.minimum(own, high)), _range_max(room, np.maximum(own + 1, low), high))
        # An owner that stands for others fits all of its list, whatever their size.
        crowd = np.zeros(int(lists[-1]) + 1 if len(h) else 0, np.int64)
        np.add.at(crowd, lists[vague], 1)
        stays = (best >= n) | ((crowd[lists] - vague) > 0) if len(h) else vague
        sets = np.unique(k[stays & (n > 0)])
        docs = []
        for c in ("ids", "marks", "sizes", "keys", "listed"):
            flat = group.column(c).combine_chunks()
            docs.append((flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).flatten())
        d, g = len(docs[0]), len(sets)
        own = [None if key is None else _short_key(key, size) for key, size in zip(docs[3].to_pylist(), docs[2].to_pylist(), strict=True)]
        return pa.table(
            {
                "kind": pa.array(np.repeat([0, 1], [d, g]), pa.int32()),
                "doc_id": pa.concat_arrays([docs[0], pa.nulls(g, pa.int64())]),
                "mark": pa.concat_arrays([docs[1], pa.nulls(g, pa.int64())]),
                "n": pa.concat_arrays([docs[2], pa.nulls(g, pa.int32())]),
                "key": pa.concat_arrays([docs[3], pa.nulls(g, pa.binary())]),
                "k": pa.concat_arrays([pa.array(own, pa.uint64()).view(pa.int64()), pa.array(sets.view(np.int64), pa.int64())]),
                "listed": pa.concat_arrays([docs[4], pa.nulls(g, pa.bool_())]),
            }
        )

    return run


SETS = "run long, block long, ids array<long>, keys array<binary>, n array<int>, shingles binary"


class _Block:
    """Sets gathered into rows of some entries; a set's name follows from its block and place."""

    def __init__(self):
        from pyspark import TaskContext

        self.number = TaskContext.get().partitionId() << BLOCK_BITS
        self.rows: tuple[list, ...] = ([], [], [], [])
        self.entries = 0

    def add(self, doc: int, key: bytes, s: bytes) -> pa.RecordBatch | None:
        done = self.close() if self.rows[0] and (self.entries + len(s) // 8 > BLOCK_ENTRIES or len(self.rows[0]) == DOCS) else None
        for column, value in zip(self.rows, (doc, key, len(s) // 8, s), strict=True):
            column.append(value)
        self.entries += len(s) // 8
        return done

    def close(self) -> pa.RecordBatch | None:
        if not self.rows[0]:
            return None
        ids, keys, n, sets = self.rows
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary())
        row = [pa.array([v], k) for v, k in zip((self.number >> RUN_BITS, self.number, ids, keys, n, b"".join(sets)), kinds, strict=True)]
        self.number, self.rows, self.entries = self.number + 1, ([], [], [], []), 0
        return pa.RecordBatch.from_arrays(row, ["run", "block", "ids", "keys", "n", "shingles"])


def _whole_sets(words: int) -> Callable:
    """Whole sets of the documents that stay, each once a task, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        made, seen = _Block(), set()
        for b in _few(batches):
            for doc, text, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key in seen:
                    continue
                s = shingle_set(text, words)
                if xxhash.xxh3_128_digest(s) == key:  # else another text under the same id and hash
                    seen.add(key)
                    if done := made.add(doc, key, s.tobytes()):
                        yield done
        if done := made.close():
            yield done

    return run


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of blocks as rows of their own: name, id, digest, size, shingles."""
    for whole in batches:
        for r in range(whole.num_rows):
            block, ids, keys, n, raw = (whole.column(c)[r] for c in ("block", "ids", "keys", "n", "shingles"))
            sizes = n.values.to_numpy().astype(np.int64)
            offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes) * 8]).astype(np.int32).tobytes())
            names = (np.int64(block.as_py()) << SET_BITS) + np.arange(len(sizes))
            sets = pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, raw.as_buffer()])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), ids.values, keys.values, n.values, sets], ["name", "id", "key", "n", "shingles"])


APART = "name long, id long, key binary, n int, shingles binary"


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sets as blocks."""
    made = _Block()
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("id", "key", "shingles")), strict=True):
            if done := made.add(*row):
                yield done
    if done := made.close():
        yield done


def _shingles(row) -> tuple[np.ndarray, np.ndarray]:
    """A block's shingles, dealt, and their distinct leading bytes in order (high ones first, as numbers)."""
    whole = np.frombuffer(row, np.uint64) * _DEAL
    lead = np.sort(whole >> np.uint64(64 - 8 * _COUNTED))
    return whole, lead


def _packed(lead: np.ndarray) -> bytes:
    """Ascending numbers of ``_COUNTED`` bytes as compressed byte planes of their steps."""
    steps = np.diff(lead, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :_COUNTED]
    return pa.compress(np.ascontiguousarray(steps.T).tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :_COUNTED] = np.frombuffer(pa.decompress(raw, n * _COUNTED, "zstd", asbytes=True), np.uint8).reshape(_COUNTED, n).T
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


OWNERS = "part int, run long, block long, n int, h binary, at binary, count binary"


def _owners(parts: int) -> Callable:
    """The shingles of each block, with the number of owners in it, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for of, block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                _, lead = _shingles(raw.as_buffer())
                start = np.flatnonzero(_new(lead))
                count = np.diff(np.concatenate([start, [len(lead)]]))
                lead = lead[start]
                more = np.flatnonzero(count > 1)  # counts of one aren't written out
                rows = []
                for p, x in _slices(lead << np.uint64(64 - 8 * _COUNTED), parts):
                    own = more[np.searchsorted(more, x.start) : np.searchsorted(more, x.stop)]
                    rows.append((p, of, block, x.stop - x.start, _packed(lead[x]), (own - x.start).astype(np.uint32).tobytes(), count[own].astype(np.uint32).tobytes()))
                cells = list(zip(*rows, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["part", "run", "block", "n", "h", "at", "count"])

    return run


MARKS = "run long, block long, part int, several binary, long binary"


def _marks(short: int) -> Callable:
    """For each block's shingles of a part, in order: has it several owners, has it more than ``short``."""

    def run(group: pa.Table) -> pa.Table:
        size = group.column("n").to_numpy().astype(np.int64)
        ends = np.cumsum(size)
        h, counts = np.empty(int(ends[-1]), np.uint64), np.ones(int(ends[-1]), np.uint32)
        for raw, at, count, a, b in zip(*(group.column(c) for c in ("h", "at", "count")), ends - size, ends, strict=True):
            h[a:b] = _unpacked(raw.as_py(), b - a)
            counts[a:b][np.frombuffer(at.as_py(), np.uint32)] = np.frombuffer(count.as_py(), np.uint32)
        order = np.argsort(h, kind="stable")
        start = np.flatnonzero(_new(h[order]))
        total = np.add.reduceat(counts[order], start, dtype=np.int64)
        owners = np.empty(len(h), np.uint32)
        owners[order] = np.repeat(np.minimum(total, 1 << 31), np.diff(np.concatenate([start, [len(h)]])))
        bits = [[np.packbits(owners[a:b] > least).tobytes() for a, b in zip(ends - size, ends, strict=True)] for least in (1, short)]
        return pa.table({**{c: group.column(c) for c in ("run", "block", "part")}, "several": pa.array(bits[0], pa.binary()), "long": pa.array(bits[1], pa.binary())})

    return run


SECOND = "part int, h binary, name binary, n binary, rest binary, long binary, star_a binary, star_b binary"


def _second_prefixes(percent: int, parts: int, marked: int) -> Callable:
    """Prefix entries of a run of blocks under the second order, by part: shingle, set, its size, what may follow the listed part, if long.

    Of a block's dense sets in a long list one is listed; it is tied to the others right here.
    """

    def listed_of(block: int, n: np.ndarray, shingles: pa.Buffer, marks: pa.Table) -> list[tuple]:
        whole, lead = _shingles(shingles)
        lead = lead[_new(lead)]
        sizes = [x.stop - x.start for _, x in _slices(lead << np.uint64(64 - 8 * _COUNTED), marked)]
        bits = []
        for column in ("several", "long"):
            found = [np.unpackbits(np.frombuffer(raw, np.uint8), count=size) for raw, size in zip(marks.column(column).to_pylist(), sizes, strict=True)]
            bits.append(np.concatenate(found).astype(bool))
        at = np.searchsorted(lead, whole >> np.uint64(64 - 8 * _COUNTED))
        several, is_long = bits[0][at], bits[1][at]
        names = (np.int64(block) << SET_BITS) + np.arange(len(n))
        of = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((is_long, of))  # stable: by hash among the long and among the others
        whole, several, is_long = whole[order], several[order], is_long[order]
        n_short = np.bincount(of, ~is_long, len(n)).astype(np.int64)
        prefix = n - least_overlap(n, percent) + 1
        # Shingles of one owner join nothing.
        listed = (np.arange(len(whole)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(prefix, n)) & several
        h, long_too, owner = whole[listed], is_long[listed], of[listed]
        order = np.argsort(h, kind="stable")
        h, owner, long_too = h[order], owner[order], long_too[order]
        start = np.flatnonzero(_new(h))
        first = np.repeat(start, np.diff(np.concatenate([start, [len(h)]])))
        tied = long_too & (first != np.arange(len(h)))
        stars = np.unique(owner[first[tied]] * len(n) + owner[tied])
        h, owner, long_too = h[~tied], owner[~tied], long_too[~tied]
        columns = (h, names[owner], n[owner].astype(np.int32), (n - np.minimum(prefix, n_short))[owner].astype(np.int32), long_too)
        rows = [(p, *(c[x].tobytes() for c in columns), None, None) for p, x in _slices(h, parts)]
        if len(stars):
            rows.append((block % parts, *[None] * 5, names[stars // len(n)].tobytes(), names[stars % len(n)].tobytes()))
        return rows

    def run(key: tuple, blocks: pa.Table, marks: pa.Table) -> pa.Table:
        marks = marks.sort_by([("block", "ascending"), ("part", "ascending")])
        of = marks.column("block").to_numpy()
        rows = []
        for block, n, shingles in zip(*(blocks.column(c) for c in ("block", "n", "shingles")), strict=True):
            a, b = np.searchsorted(of, block.as_py()), np.searchsorted(of, block.as_py(), "right")
            rows += listed_of(block.as_py(), n.values.to_numpy().astype(np.int64), shingles.as_buffer(), marks.slice(a, b - a))
        cells = list(zip(*rows, strict=True)) or [()] * 8
        return pa.table([pa.array(cells[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cells[1:]]], ["part", "h", "name", "n", "rest", "long", "star_a", "star_b"])

    return run


def _partners(percent: int, parts: int) -> Callable:
    """Of one part's lists: partner runs of each query by part of the query, and stars of dense sets.

    A run is (query, partner, count, least count) rows sorted by both; stars are (a, b) rows.
    """

    def run(group: pa.Table) -> pa.Table:
        h, own, n, rest, long = (_joined(group.column(c), t) for c, t in (("h", np.uint64), ("name", np.int64), ("n", np.int32), ("rest", np.int32), ("long", np.bool_)))
        order = np.argsort(h)
        again = np.zeros(len(h), bool)
        same = h[order[1:]] == h[order[:-1]]
        again[1:] = same
        again[:-1] |= same
        order = order[again]
        h, own, n, rest, long = h[order], own[order], n[order].astype(np.int64), rest[order].astype(np.int64), long[order]
        # Sets by size, then name: in a list, a later set is the query and each earlier one a partner.
        ids, first, at = np.unique(own, return_index=True, return_inverse=True)
        by = np.lexsort((ids, n[first]))
        ids, n, rest = ids[by], n[first][by], rest[first][by]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        local = rank[at]
        order = np.lexsort((local, h))
        h, local, long = h[order], local[order], long[order]
        new = _new(h, local)
        h, local, long = h[new], local[new], long[new]
        start = np.flatnonzero(_new(h))
        begin = np.repeat(start, np.diff(np.concatenate([start, [len(h)]])))
        star = long & (begin != np.arange(len(h)))
        stars = np.unique(local[begin[star]] * len(ids) + local[star]) if star.any() else np.zeros(0, np.int64)
        star_a, star_b = (np.concatenate([mine, _joined(group.column(c), np.int64)]) for mine, c in ((ids[stars // max(1, len(ids))], "star_a"), (ids[stars % max(1, len(ids))], "star_b")))
        rows = [(x % parts, None, None, None, None, star_a[i : i + 65536].tobytes(), star_b[i : i + 65536].tobytes()) for x, i in enumerate(range(0, len(star_a), 65536))]
        # Each position of a short list with every earlier one; only partners of fitting size.
        begin = np.where(long, np.arange(len(h)), begin)
        least = np.searchsorted(n, -(-n * percent // 100))
        codes = []
        for at in range(0, len(h), 1 << 15):
            j = np.arange(at, min(at + (1 << 15), len(h)))
            many = j - begin[j]
            small = local[np.repeat(begin[j] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            big = np.repeat(local[j], many)
            fit = small >= least[big]
            codes.append(big[fit] * len(ids) + small[fit])
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        del codes
        code.sort()
        start = np.flatnonzero(_new(code))
        count = np.diff(np.concatenate([start, [len(code)]])).astype(np.int32)
        big, small = np.divmod(code[start], max(1, len(ids)))
        need = np.maximum(1, pair_overlap(n[big], n[small], percent) - np.maximum(rest[big], rest[small])).astype(np.int32)
        possible = need <= np.minimum(n[big], n[small])
        big, small, count, need = ids[big[possible]], ids[small[possible]], count[possible], need[possible]
        dealt = big.astype(np.uint64) * _DEAL
        order = np.lexsort((small, dealt))
        dealt, big, small, count, need = dealt[order], big[order], small[order], count[order], need[order]
        rows += [(p, big[x].tobytes(), small[x].tobytes(), count[x].tobytes(), need[x].tobytes(), None, None) for p, x in _slices(dealt, parts)]
        cells = list(zip(*rows, strict=True)) or [()] * 7
        return pa.table([pa.array(cells[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cells[1:]]], ["part", "query", "partner", "count", "least", "star_a", "star_b"])

    return run


PARTNERS = "part int, query binary, partner binary, count binary, least binary, star_a binary, star_b binary"


def _merged(group: pa.Table) -> pa.Table:
    """Heap-merge the sorted partner runs of each query; keep partners whose counts can still reach T."""
    runs = []
    for q, b, c, t in zip(*(group.column(x).to_pylist() for x in ("query", "partner", "count", "least")), strict=True):
        if q:
            q = (np.frombuffer(q, np.uint64) * _DEAL).tolist()
            runs.append(zip(q, np.frombuffer(b, np.int64).tolist(), np.frombuffer(c, np.int32).tolist(), np.frombuffer(t, np.int32).tolist(), strict=True))
    a_out, b_out, query, partner, total, least = [], [], None, None, 0, 1
    for q, b, c, t in heapq.merge(*runs):
        if b == partner and q == query:
            total += c
            continue
        if partner is not None and total >= least:
            a_out.append(query)
            b_out.append(partner)
        query, partner, total, least = q, b, c, t
    if partner is not None and total >= least:
        a_out.append(query)
        b_out.append(partner)
    stars = [_joined(group.column(c), np.int64) for c in ("star_a", "star_b")]
    back = (np.array(a_out, np.uint64) * _UNDEAL).view(np.int64)
    return pa.table({"a": pa.array(np.concatenate([back, stars[0]])), "b": pa.array(np.concatenate([np.array(b_out, np.int64), stars[1]]))})


class _Family:
    """Members of a family and their inverted lists."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray], percent: int):
        self.sizes, self.percent = sizes, percent
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        by = np.lexsort((owner, flat))
        shingle = flat[by]
        starts = np.flatnonzero(_new(shingle))
        self.lists, self.starts = owner[by], np.concatenate([starts, [len(flat)]])
        self.number = np.empty(len(flat), np.int64)  # the list of each shingle of each member
        self.number[by] = np.repeat(np.arange(len(starts)), np.diff(self.starts))
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.root = np.arange(len(sizes))
        self.links = np.zeros(len(sizes), np.int64)

    def pivot(self) -> int:
        """The member that shares most with all others."""
        shared = np.add.reduceat(np.diff(self.starts)[self.number], self.at[:-1])
        return int(np.argmax(shared / (len(self.sizes) * self.sizes + self.sizes.sum())))

    def ball(self, pivot: int) -> np.ndarray:
        """Members within half the allowed distance of a member; by the triangle inequality any two of them link."""
        near = np.zeros(len(self.starts) - 1, np.int64)
        near[self.number[self.at[pivot] : self.at[pivot + 1]]] = 1
        return in_ball(np.add.reduceat(near[self.number], self.at[:-1]), self.sizes, self.sizes[pivot], self.percent)

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def tie(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = self.top(i), self.top(j)
            if a != b:
                self.root[max(a, b)] = min(a, b)

    def search(self, asking: np.ndarray, asked: np.ndarray) -> None:
        """DivideSkip for each member of ``asking`` (numbers), among those with ``asked``; of two that both ask, the smaller counts the pair."""
        asking = asking[np.argsort(self.sizes[asking], kind="stable")]
        turn = np.full(len(self.sizes), -1)
        turn[asking] = np.arange(len(asking))
        larger = len(asking) == len(self.sizes)  # all partners that count are at least as large, so they share more
        for i in asking.tolist():
            n = int(self.sizes[i])
            need = pair_overlap(n, n, self.percent) if larger else least_overlap(n, self.percent)
            found, count = divide_skip(self.number[self.at[i] : self.at[i + 1]], self.lists, self.starts, int(need))
            good = asked[found] & ((turn[found] < 0) | (turn[found] > turn[i])) & (100 * count >= self.percent * (n + self.sizes[found] - count))
            found = found[good]
            self.links[i] += len(found)
            self.links[found] += 1
            self.tie(i, found)

    def roots(self) -> np.ndarray:
        return np.array([self.top(i) for i in range(len(self.sizes))])


def in_ball(shared, n, of_pivot, percent: int):
    """If the Jaccard distance from a pivot is at most half of the distance at which two sets still link."""
    union = n + of_pivot - shared
    return 200 * (union - shared) <= (100 - percent) * union


def _whole_family(sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member with the others, and the first member that it reaches."""
    family, m = _Family(sizes, sets, percent), len(sizes)
    inner = family.ball(pivot := family.pivot()) if m >= BALL else np.zeros(m, bool)
    if 8 * inner.sum() < m:  # not worth while
        inner[:] = False
    else:
        family.links[inner] += inner.sum() - 1
        family.tie(pivot, np.flatnonzero(inner))
    family.search(np.flatnonzero(~inner), np.ones(m, bool))
    return family.links, family.roots()


FOUND = "name long, root long, links long"


def _members(group: pa.Table, own: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    sizes, raw = group.column("n").to_numpy().astype(np.int64), group.column("shingles").combine_chunks()
    return sizes[own], [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in own]


def _families(percent: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        fam, names = group.column("family").to_numpy(), group.column("name").to_numpy()
        order = np.lexsort((names, fam))
        bounds = np.concatenate([np.flatnonzero(_new(fam[order])), [len(fam)]])
        found: tuple[list, ...] = ([], [], [])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = order[a:b]
            links, root = _whole_family(*_members(group, own), percent)
            for column, value in zip(found, (names[own], names[own][root], links), strict=True):
                column.append(value)
        return pa.table({c: np.concatenate(x) for c, x in zip(("name", "root", "links"), found, strict=True)})

    return run


def _pivots(percent: int) -> Callable:
    """The pivot of a family's first block."""

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("name").to_numpy())
        pivot = int(order[_Family(*_members(group, order), percent).pivot()])
        return group.slice(pivot, 1).select(["family", "blocks", "name", "n", "shingles"])

    return run


def _balls(percent: int) -> Callable:
    """Which members of a block of a large family are in the ball of the family's pivot."""

    def run(key: tuple, block: pa.Table, pivot: pa.Table) -> pa.Table:
        inner, of = np.zeros(block.num_rows, bool), None
        if block.num_rows and pivot.num_rows:  # without a first block there is no pivot, and no ball
            of, center = pivot.column("name")[0].as_py(), np.frombuffer(pivot.column("shingles").combine_chunks()[0].as_buffer(), np.uint64)
            sizes, sets = _members(block, np.arange(block.num_rows))
            shared = np.array([np.isin(x, center, assume_unique=True).sum() for x in sets], np.int64)
            inner = in_ball(shared, sizes, len(center), percent)
        return pa.table({"family": block.column("family"), "name": block.column("name"), "pivot": pa.array([of] * block.num_rows, pa.int64()), "n": block.column("n"), "inner": pa.array(inner)})

    return run


def _block_pairs(percent: int) -> Callable:
    """One pair of blocks of a family too large for a task, or one such block with itself."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        names, right = group.column("name").to_numpy(), group.column("right").to_numpy(zero_copy_only=False).astype(bool)
        own = np.argsort(names)
        names, right = names[own], right[own]
        family = _Family(*_members(group, own), percent)
        if key[1].as_py() == key[2].as_py():
            family.search(np.arange(len(own)), np.ones(len(own), bool))
        else:  # the later block, whose members are outside the ball, asks the other
            family.search(np.flatnonzero(right), ~right)
        return pa.table({"name": names, "root": names[family.roots()], "links": family.links})

    return run


def _large_families(members: DataFrame, percent: int, family_entries: int) -> DataFrame:
    """``name, root, links`` of the members of families that are cut into blocks. Every table here is keyed by family and block."""
    half = max(1, family_entries // 2)
    members = members.withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks").cast("long")).cast("int"))
    pivots = members.where("own = 0").select("family", "blocks", "name", "n", "shingles").groupBy("family").applyInArrow(_pivots(percent), "family long, blocks int, name long, n int, shingles binary")
    pivots = materialise(pivots, "pivots").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    balls = members.groupBy("family", "own").cogroup(pivots.groupBy("family", "own")).applyInArrow(_balls(percent), "family long, name long, pivot long, n int, inner boolean")
    balls = materialise(balls, "balls")
    # Blocks of the ball come first, then those of the rest; pairs of blocks need one of the rest.
    sizes = balls.groupBy("family").agg(*[F.ceil(F.sum(F.when(F.col("inner") == v, F.col("n")).otherwise(0)) / half).cast("int").alias(c) for v, c in ((True, "ball"), (False, "rest"))], F.count(F.when(F.col("inner"), 1)).alias("inside"))
    sizes = materialise(sizes, "sizes")
    few = sizes.count() <= BROADCAST
    hint = F.broadcast if few else (lambda df: df)
    inside = balls.where("inner").join(hint(sizes), "family").select("name", F.col("pivot").alias("root"), (F.col("inside") - 1).cast("long").alias("links"))
    mine = F.pmod(F.xxhash64(F.lit("pair"), "name"), F.when(F.col("inner"), F.col("ball")).otherwise(F.col("rest")).cast("long")).cast("int")
    placed = balls.join(hint(sizes), "family").where("rest > 0").select("name", "family", "inner", "ball", "rest", (mine + F.when(F.col("inner"), 0).otherwise(F.col("ball"))).alias("own"))
    cut = members.select("name", "n", "shingles").join(placed, "name")
    cut = cut.withColumn("other", F.explode(F.sequence(F.when(F.col("inner"), F.col("ball")).otherwise(F.lit(0)), F.col("ball") + F.col("rest") - 1)))
    cut = cut.select("family", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).alias("right"), "name", "n", "shingles")
    pieces = materialise(cut.groupBy("family", "one", "two").applyInArrow(_block_pairs(percent), FOUND), "pieces").unionAll(inside)
    links = pieces.groupBy("name").agg(F.sum("links").alias("links"))
    forest = connected(pieces.select(F.col("name").alias("a"), F.col("root").alias("b")))
    return links.join(forest.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce("root", "name").alias("root"), "links")


def jaccard_groups(
    docs: DataFrame,
    words: int = 5,
    percent: int = 75,
    id_col: str = "doc_id",
    text_col: str = "text",
    short: int = SHORT,
    family_entries: int = FAMILY_ENTRIES,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``, one row per input row.

    Documents link when 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles (A-Z lower-cased, words cut at
    white space; a text of fewer words is one shingle). ``component_id`` is the smallest id reachable by links, ``n_links`` the
    number of other distinct sets that a document's set links with. Null and empty texts and texts without words have
    no shingles and are their own component. Equal sets link. Rows with a null id link with nothing and
    have a null component. Rows that repeat an id are judged by their own texts, each for itself; they share a component
    if their texts do. Extra columns are ignored.
    """
    made = _groups(docs, words, percent, id_col, text_col, short, family_entries)
    return made.select("doc_id", "n_shingles", "component_id", "n_links")


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays of each group linked by ``jaccard_groups``: that of the smallest id.

    Rows that link with nothing stay, so do rows with a null id and texts without words, each of them. Where
    the smallest id has several texts in a group, the one of the smallest ``xxhash64`` stays; of rows equal in id and
    text one stays.
    """
    made = materialise(_groups(docs, words, percent, id_col, text_col, SHORT, FAMILY_ENTRIES), "groups")
    first = made.where(F.col("group").isNotNull() & (F.col("doc_id") == F.col("component_id"))).groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("of"), F.count(F.lit(1)).alias("rows"))
    first = materialise(first.select("of.*", "rows"), "first")
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    alone = made.where(F.col("group").isNull()).select("doc_id", "mark").distinct().select("doc_id", "mark", F.lit(0).cast("long").alias("rows"))
    kept = first.unionByName(alone)
    left = own.join(kept, own.doc_id.eqNullSafe(kept.doc_id) & (own.mark == kept.mark)).select("row", own.doc_id, "text", "rows")
    if first.where("rows > 1").limit(1).count():
        left = left.where("rows < 2").unionByName(left.where("rows > 1").dropDuplicates(["doc_id", "text"]))
    return left.select("row.*")


def _groups(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, short: int, family_entries: int) -> DataFrame:
    spark = docs.sparkSession
    parts = parts_for(docs, text_col)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))

    with arrow_rows(spark, DOCS):
        first = texts.mapInArrow(_first_prefixes(words, percent, parts), FIRST)
        shared = materialise(first.groupBy("part").applyInArrow(_shared_sets(percent), SHARED), "shared")
    rows = shared.where("kind = 0").select("doc_id", "mark", "n", "key", "k", "listed")
    # A set is read again from one of its rows: that of the smallest id, told from others of that id by the hash of its text.
    reps = rows.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("of"), F.max("listed").alias("listed"), F.max("k").alias("k"))
    reps = materialise(reps.select("key", F.col("of.doc_id").alias("id"), "of.mark", "listed", "k"), "reps")
    sharing = shared.where("kind = 1").select("k").distinct()
    stay = materialise(reps.where("listed").select("id", "mark", "key").unionAll(reps.where("not listed").join(sharing, "k", "left_semi").select("id", "mark", "key")), "stay")

    # Where few sets stay they are broadcast, so that texts aren't shuffled; otherwise the join is by sorting.
    staying = stay.count()
    picked = texts.where("text is not null").join(F.broadcast(stay) if staying <= BROADCAST else stay, ["id", "mark"]).select("id", "text", "key")
    with arrow_rows(spark, DOCS):
        sets = bucketed(picked.mapInArrow(_whole_sets(words), SETS), "sets", "run", parts)
    if (sets.agg(F.sum(F.size("n"))).first()[0] or 0) > staying:  # rows repeated in several tasks
        repeated = sets
        with arrow_rows(spark, BLOCKS):
            sets = bucketed(repeated.mapInArrow(_apart, APART).dropDuplicates(["key"]).mapInArrow(_again, SETS), "sets", "run", parts)
        forget(repeated)

    with arrow_rows(spark, BLOCKS):
        found = _linked(sets, percent, parts, short, family_entries)
        ids = sets.select("block", F.posexplode(F.arrays_zip("ids", "keys")).alias("at", "of")).select(_name(), F.col("of.ids").alias("id"), F.col("of.keys").alias("key"))
        found = materialise(found.join(ids, "name"), "named")
    least = found.groupBy("root").agg(F.min("id").alias("component_id"))
    reached = found.join(least, "root").select("key", "root", "component_id", "links")
    judged = reps.join(reached, "key", "left").select("key", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce(F.col("root").cast("string"), F.hex("key")).alias("group"))
    judged = materialise(judged, "judged")
    forget(reps, stay, sets, found)
    # Equal texts share a key, null keys have none: AQE splits a key that holds very many rows.
    return rows.join(judged, "key", "left").select(
        "doc_id",
        "mark",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "group",
    )


def _name():
    return (F.shiftleft("block", SET_BITS) + F.col("at")).alias("name")


def _linked(sets: DataFrame, percent: int, parts: int, short: int, family_entries: int) -> DataFrame:
    """``name, root, links`` of the sets that are in families."""
    marked = 4 * parts
    counted = sets.select("run", "block", "shingles").mapInArrow(_owners(marked), OWNERS)
    marks = materialise(counted.groupBy("part").applyInArrow(_marks(short), MARKS), "marks")
    second = sets.select("run", "block", "n", "shingles").groupBy("run").cogroup(marks.groupBy("run")).applyInArrow(_second_prefixes(percent, parts, marked), SECOND)
    partners = materialise(second.groupBy("part").applyInArrow(_partners(percent, parts), PARTNERS), "partners")
    forget(marks)
    family = connected(partners.groupBy("part").applyInArrow(_merged, "a long, b long"))
    family = materialise(family.select(F.col("node").alias("name"), F.col("root").alias("family")), "family")
    forget(partners)

    named = F.broadcast(family) if family.count() <= BROADCAST else family
    slim = sets.select("block", F.posexplode("n").alias("at", "size")).select(_name(), "size")
    sizes = materialise(slim.join(named, "name").groupBy("family").agg(F.sum("size").alias("entries")), "entries")
    large = sizes.where(F.col("entries") > family_entries).select("family", F.ceil(2 * F.col("entries") / family_entries).cast("int").alias("blocks"))
    members = sets.mapInArrow(_apart, APART).join(named, "name").join(large, "family", "left")
    bucket = F.pmod(F.xxhash64("family"), F.lit(4 * parts)).cast("int")
    found = members.where("blocks is null").select(bucket.alias("bucket"), "family", "name", "n", "shingles").groupBy("bucket").applyInArrow(_families(percent), FOUND)
    if large.limit(1).count():
        big = materialise(members.where("blocks is not null").select("family", "blocks", "name", "n", "shingles"), "large")
        found = found.unionByName(_large_families(big, percent, family_entries))
    return materialise(found, "found")


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM words
), sized AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS kind FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y, u.kind <> v.kind AS other, v.kind AS kind FROM common JOIN sized u ON u.doc_id = x JOIN sized v ON v.doc_id = y WHERE 100 * c >= 75 * (u.n + v.n - c)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN links ON x = node
)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(root) AS component_id,
       (SELECT count(DISTINCT kind) FROM links WHERE x = d.doc_id AND other) AS n_links
FROM documents d LEFT JOIN sized s USING (doc_id) JOIN reach ON node = d.doc_id GROUP BY d.doc_id
"""
