"""N-gram Jaccard self join by PartEnum signatures (Arasu, Ganti and Kaushik 2006).

A document's set is its distinct ``SHINGLE``-word shingles.  Size bands make a
Jaccard threshold a Hamming one: sets that can be similar lie in one band or two
neighbouring ones, and similar ones differ in at most k elements.  For each band
the feature domain is cut into ``n1`` partitions of ``PARTS`` parts; similar sets
have a partition with at most ``ERRORS`` differences, so they agree on some
``PARTS - ERRORS`` of its parts: each such subset's projection is a signature.

Only signatures of non-empty projections are used when a set has more good
partitions (every subset non-empty) than its differences can spoil; the few sets
with fewer also get signatures of empty projections, which meet only among
themselves.  So no similar pair is lost.

Similar sets share several signatures, so each may leave out some of its own, the
last in one order of all (prefix filtering on signatures).  Those found often in a
sample of the documents come last: a passage that many documents share, and no
more, then brings few of them together.

Signatures travel packed (four bytes each, and five of the set's name where it
changes) to buckets of bounded size; what many documents of one batch share is
sent once.  More documents mean more buckets, and in the end each signature goes
alone: so nothing larger travels with it.

Only sets that met get a sketch: counts of its elements in ``CELLS`` cells or
more, whose differences add up to at most the sets' difference.  Small groups with
the same least member go to one place, which gets each sketch once.  Sets that the
sketches prove too different are told apart there; so passages that many
documents share do not pair them all.  The groups left give links from members to
one of the group, verified on the texts.  Where that leaves a group
in several components, these and all others that such groups connect are one
family; its cross pairs are searched exactly by prefix filtering, in blocks.
Equal sets are one node throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.components import connected_components
from cohortlens.llm.shared import give_back, settled, settled_at, ship_package, small_batches
from cohortlens.llm.words import Words, mix, text_chunks
from cohortlens.session import discard

SHINGLE = 5
THRESHOLD = 75  # percent
PARTS, ERRORS = 3, 1
#: partitions beyond what differences can spoil, so that good ones are left over
SLACK = 0.25
#: signatures of a bucket on average, and held by a task before it sends them
BUCKET_SIGNATURES = 6_000_000
FLUSH = 1_000_000
#: shingles of the documents in which frequent signatures are looked for, how often they are then found at least,
#: how many are kept, and a table to look them up (a power of two)
SAMPLE_SHINGLES, LEAST_FOUND, MOST_FREQUENT, FREQUENT_TABLE = 4_000_000, 3, 250_000, 1 << 23
#: bytes of texts whose sets are made at once
TEXT_BYTES = 1 << 19
#: bytes of rows that a Python worker gets at once (a packed row alone can be some hundred KB)
BATCH_BYTES = 4 << 20
#: documents of a batch from which a signature they share is sent once
LOCAL_GROUP = 64
#: parts (a power of two, 256 at most) in which signatures are sorted to find the repeated ones
SORT_PARTS = 16
#: cells of the sketch of a small set, half a byte each
CELLS = 128
#: members of a group that is compared together with others, and pairs compared at once
SMALL_GROUP = 1_000
PAIRS_AT_ONCE = 250_000
#: members from which a group goes to a place of its own
SPREAD_GROUP = 64
#: members of the groups that one task tells apart on average, and in one batch of rows
APART_MEMBERS, MEMBERS_AT_ONCE = 1_000_000, 1 << 16
#: sums of cells that are compared first
COARSE = 32
#: members of a block when a family is searched pair by pair
BLOCK = 1_000
#: nodes (8 bytes each) up to which the set of candidates is broadcast
MAX_BROADCAST_NODES = 2_000_000


@dataclass(frozen=True)
class Scheme:
    """Bands and partitions for a threshold in percent."""

    threshold: int = THRESHOLD
    parts: int = PARTS
    errors: int = ERRORS
    slack: float = SLACK

    def bands(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(greatest size, partitions n1, partitions that differences can spoil) of each band; n1 0: equal sets only."""
        t, top, low = self.threshold, [], 1
        while low < 1 << 40:
            top.append(low * 100 // t)
            low = top[-1] + 1
        sizes = np.array(top, np.int64)
        differ = self.differ(sizes, sizes)
        spoiled = differ // (self.errors + 1)
        n1 = np.where(differ > 0, spoiled + 1 + np.ceil(self.slack * spoiled).astype(np.int64), 0)
        return sizes, n1, spoiled

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Elements in which similar sets of at most these sizes can differ."""
        return (a + b) * (100 - self.threshold) // (100 + self.threshold)

    def shared(self, good: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """Signatures that similar sets share at least, of ``good`` partitions of one of them.

        With j parts of a partition changed, the subsets without these stay equal.
        A change costs most where fewest were before.
        """
        stay = [math.comb(self.parts - j, self.parts - self.errors) if j <= self.errors else 0 for j in range(self.parts + 1)]
        left, changes = stay[0] * good, differ
        for j in range(self.errors + 1):
            used = np.minimum(changes, good)
            left, changes = left - (stay[j] - stay[j + 1]) * used, changes - used
        return left

    def similar(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.threshold * (a + b - common)


def shingle_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, sorted distinct shingle hashes) of each text, A-Z lower-cased; fewer words: the whole sequence."""
    w = Words(texts, lower=True)
    where, h = w.grams(shingle)
    row = w.row()[where] if len(where) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < shingle))
    if len(short):
        row = np.concatenate([row, short])
        h = np.concatenate([h, np.array([w.whole(int(i)) for i in short], np.uint64)])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[first], h[first]
    return np.searchsorted(row, np.arange(len(texts) + 1)), h


def _node(values: np.ndarray) -> int:
    """64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _projections(offsets: np.ndarray, values: np.ndarray, n1: np.ndarray, band: np.ndarray, space: int, scheme: Scheme):
    """(set, signature, whether its projection is empty) of every subset of parts, and the good partitions of each set.

    ``n1`` partitions for each set (0: none); equal projections of one band and
    ``space`` have equal signatures.
    """
    sizes, n2 = np.diff(offsets), scheme.parts
    which = np.repeat(np.arange(len(sizes)), sizes)
    use = n1[which] > 0
    which, values = which[use], values[use]
    h = mix(values + np.uint64(0x632BE59BD9B4E019))
    base = np.cumsum(n1) - n1  # first partition of each set
    part = ((h >> np.uint64(32)) * n1[which].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    cell = (base[which] + part) * n2 + (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % n2
    total = int(n1.sum())
    sums = np.zeros(total * n2, np.uint64)
    np.add.at(sums, cell, mix(values ^ np.uint64(0x8CB92BA72F3D8DD7)))
    filled = (np.bincount(cell, minlength=total * n2) > 0).reshape(total, n2)
    sums = sums.reshape(total, n2)
    owner = np.repeat(np.arange(len(sizes)), n1)
    place = (np.arange(total) - base[owner]).astype(np.uint64)
    name = mix(place * np.uint64(0x9E3779B97F4A7C15) + band[owner].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
               + np.uint64(space))
    sigs, empty = [], []
    for k, subset in enumerate(combinations(range(n2), n2 - scheme.errors)):
        key = mix(name + np.uint64(k + 1))
        value = key.copy()
        for p in subset:
            value += mix(sums[:, p] + np.uint64(p + 1))
        has = filled[:, subset].any(1)
        sigs.append(mix(np.where(has, value, key ^ np.uint64(0x5851F42D4C957F2D))))
        empty.append(~has)
    good = np.bincount(owner, weights=filled.sum(1) > scheme.errors, minlength=len(sizes))
    return np.tile(owner, len(sigs)), np.concatenate(sigs), np.concatenate(empty), good


@dataclass(frozen=True)
class Frequent:
    """Signatures found often in a sample of the documents, ascending, and how often."""

    sig: np.ndarray
    n: np.ndarray

    @cached_property
    def seen(self) -> np.ndarray:
        seen = np.zeros(FREQUENT_TABLE, bool)  # made in each task
        seen[self.sig & np.uint64(FREQUENT_TABLE - 1)] = True
        return seen

    def among(self, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the frequent ones in ``sig``, how often each was found)."""
        maybe = np.flatnonzero(self.seen[sig & np.uint64(FREQUENT_TABLE - 1)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.sig, sig[maybe]), len(self.sig) - 1)
        found = self.sig[at] == sig[maybe]
        return maybe[found], self.n[at[found]]


def _left_out(owner: np.ndarray, sig: np.ndarray, spare: np.ndarray, frequent: Frequent) -> np.ndarray:
    """Places of each set's ``spare`` most frequent signatures (those not in ``frequent`` stay)."""
    often, n = frequent.among(sig)
    often = often[np.lexsort((sig[often], n, owner[often]))[::-1]]
    who = owner[often]
    nth = np.arange(len(who)) - np.searchsorted(-who, -who)  # owners descend
    return often[nth < spare[who]]


def signatures(offsets: np.ndarray, values: np.ndarray, scheme: Scheme, frequent: Frequent | None = None
               ) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of sets in the form of ``shingle_sets``.

    Similar sets share several signatures.  Where they must share m, each may leave
    out m - 1, the last in one order of all signatures: the first that they share is
    left in both, whatever the order.  Here ``frequent`` ones come last.
    """
    top, n1_of, _ = scheme.bands()
    sizes = np.diff(offsets)
    own = np.searchsorted(top, sizes)
    out_set, out_sig = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for band in (own, own + 1):
        at = np.minimum(band, len(n1_of) - 1)
        n1 = np.where(sizes > 0, n1_of[at], 0)
        if not n1.any():
            continue
        owner, sig, empty, good = _projections(offsets, values, n1, band, 0, scheme)
        # a similar set of the band has at most this many elements
        most = np.minimum(top[at], sizes * 100 // scheme.threshold)
        differ = scheme.differ(sizes, most)
        poor = (n1 > 0) & (good <= differ // (scheme.errors + 1))
        sent = ~empty | poor[owner]
        owner, sig = owner[sent], sig[sent]
        if frequent is not None:
            spare = np.where(poor | (n1 == 0), 0, np.maximum(0, scheme.shared(good, differ) - 1))
            out = _left_out(owner, sig, spare, frequent)
            owner, sig = np.delete(owner, out), np.delete(sig, out)
        out_set.append(owner)
        out_sig.append(sig)
    return np.concatenate(out_set), np.concatenate(out_sig)


def cells_of(sizes: np.ndarray) -> np.ndarray:
    """Cells of the sketch of a set: ``CELLS``, doubled until a cell has six elements at most on average."""
    return CELLS << np.ceil(np.log2(np.maximum(1.0, sizes / (6.0 * CELLS)))).astype(np.int64)


def sketches(offsets: np.ndarray, values: np.ndarray) -> list[bytes]:
    """Counts (up to 15, half a byte) of each set's elements in its cells."""
    sizes = np.diff(offsets)
    cells = cells_of(sizes)
    ends = np.cumsum(cells)
    which = np.repeat(np.arange(len(sizes)), sizes)
    cell = (ends - cells)[which] + (mix(values ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(24)).astype(np.int64) % cells[which]
    counts = np.minimum(np.bincount(cell, minlength=int(ends[-1]) if len(ends) else 0), 15).astype(np.uint8)
    raw = (counts[::2] | (counts[1::2] << 4)).tobytes()
    return [raw[(e - c) // 2:e // 2] for e, c in zip(ends.tolist(), cells.tolist(), strict=True)]


@dataclass
class Sketched:
    """Sets with their sketches one after the other in ``raw``."""

    sizes: np.ndarray
    raw: np.ndarray

    def __post_init__(self) -> None:
        self.half = cells_of(self.sizes) // 2
        self.begin = np.cumsum(self.half) - self.half
        self.coarse = np.empty((len(self.sizes), COARSE), np.uint8)
        for half in np.unique(self.half).tolist():
            every = np.flatnonzero(self.half == half)
            for at in np.array_split(every, 1 + len(every) * half // (1 << 21)):
                sums = self._counts(at, half, 2 * half).reshape(len(at), -1, COARSE).sum(1, dtype=np.int64)
                self.coarse[at] = np.minimum(sums, 255)

    def _counts(self, at: np.ndarray, half: int, cells: int) -> np.ndarray:
        """Counts in ``cells`` cells of sets with sketches of ``half`` bytes (a larger sketch is folded)."""
        packed = np.lib.stride_tricks.sliding_window_view(self.raw, half)[self.begin[at]]
        out = np.empty((len(at), 2 * half), np.uint8)
        out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
        if 2 * half == cells:
            return out
        return np.minimum(out.reshape(len(at), -1, cells).sum(1, dtype=np.int64), 15).astype(np.uint8)

    def near(self, a: np.ndarray, b: np.ndarray, scheme: Scheme) -> np.ndarray:
        """Whether sketches leave open that the sets ``a[i]`` and ``b[i]`` are similar.

        Similar sets differ in at most (a + b) (100 - t) / (100 + t) elements, and
        cell counts differ by no more than the sets do.
        """
        t, out = scheme.threshold, np.zeros(len(a), bool)
        small, large = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        todo = np.flatnonzero(100 * small >= t * large)
        alike = self.half[a[todo]] == self.half[b[todo]]  # only then sums of cells may be compared
        refuted = np.zeros(len(todo), bool)
        for at in np.array_split(np.flatnonzero(alike), 1 + len(todo) // (1 << 16)):
            x, y = self.coarse[a[todo[at]]], self.coarse[b[todo[at]]]
            apart = (np.maximum(x, y) - np.minimum(x, y)).sum(1, dtype=np.uint16).astype(np.int64)
            refuted[at] = apart * (100 + t) > (self.sizes[a[todo[at]]] + self.sizes[b[todo[at]]]) * (100 - t)
        todo = todo[~refuted]
        # a pair that several groups hold is compared once
        u, v = np.minimum(a[todo], b[todo]), np.maximum(a[todo], b[todo])
        _, once, same = np.unique(u * (1 << 32) + v, return_index=True, return_inverse=True)
        every, todo = todo, todo[once]
        kind = self.half[a[todo]] * (1 << 40) + self.half[b[todo]]
        for k in np.unique(kind).tolist():
            x, y = k >> 40, k & ((1 << 40) - 1)
            cells = 2 * min(x, y)
            some = todo[kind == k]
            for p in np.array_split(some, 1 + len(some) * max(x, y) // (1 << 20)):
                of_a, of_b = self._counts(a[p], x, cells), self._counts(b[p], y, cells)
                apart = (np.maximum(of_a, of_b) - np.minimum(of_a, of_b)).sum(1, dtype=np.int64)
                out[p] = apart * (100 + t) <= (self.sizes[a[p]] + self.sizes[b[p]]) * (100 - t)
        out[every] = out[todo][same]
        return out


def _pairs_within(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs within consecutive groups."""
    n = np.diff(cut)
    later = np.repeat(cut[1:], n) - np.arange(cut[0], cut[-1]) - 1  # places of its group after each place
    first = np.repeat(np.arange(cut[0], cut[-1]), later)
    return first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)


def clusters(sets: Sketched, place: np.ndarray, cut: np.ndarray, scheme: Scheme) -> Iterator[tuple[int, np.ndarray]]:
    """(group, members) of what sketches cannot tell apart, chained, in groups ``place[cut[g]:cut[g + 1]]``; two members or more.

    Groups of up to ``SMALL_GROUP`` members are compared many at a time.
    """
    n = np.diff(cut)
    small = np.flatnonzero((n > 1) & (n <= SMALL_GROUP))
    weight = np.cumsum(n[small] * n[small])
    for part in np.split(small, np.searchsorted(weight, np.arange(PAIRS_AT_ONCE, weight[-1] if len(weight) else 0, PAIRS_AT_ONCE))):
        if not len(part):
            continue
        at = np.concatenate([np.arange(cut[g], cut[g + 1]) for g in part.tolist()])
        member, ends = place[at], np.append(0, np.cumsum(n[part]))
        i, j = _pairs_within(ends)
        open_ = sets.near(member[i], member[j], scheme)
        i, j = i[open_], j[open_]
        label, before = np.arange(len(member)), None
        while before is None or (before != label).any():  # the least place spreads along the open pairs
            before = label.copy()
            np.minimum.at(label, j, before[i])
            np.minimum.at(label, i, before[j])
            label = label[label]
        order = np.argsort(label, kind="stable")
        bounds = np.append(np.flatnonzero(np.diff(label[order], prepend=-1)), len(label))
        group_of = np.repeat(part, n[part])
        for x in np.flatnonzero(np.diff(bounds) > 1).tolist():
            own = order[bounds[x]:bounds[x + 1]]
            yield int(group_of[own[0]]), member[own]
    for g in np.flatnonzero(n > SMALL_GROUP).tolist():
        left = place[cut[g]:cut[g + 1]]
        while len(left) > 1:
            group, front, left = [left[:1]], left[:1], left[1:]
            while len(front) and len(left):
                near = np.zeros(len(left), bool)
                for x in front:
                    rest = np.flatnonzero(~near)
                    if not len(rest):
                        break
                    near[rest] = sets.near(left[rest], np.full(len(rest), x), scheme)
                front, left = left[near], left[~near]
                group.append(front)
            group = np.concatenate(group)
            if len(group) > 1:
                yield g, group


def _set_rows(shingle: int, sketched: bool = False):
    """Texts -> (n_shingles, node) structs, or (n_shingles, node, sketch)."""
    kind = pa.struct([("n_shingles", pa.int64()), ("node", pa.int64())] + ([("sketch", pa.binary())] if sketched else []))

    @F.arrow_udf("n_shingles bigint, node bigint" + (", sketch binary" if sketched else ""))
    def sets(col: pa.Array) -> pa.Array:
        n, node, sketch = [], [], []
        for _, texts in text_chunks(col, TEXT_BYTES):
            offsets, values = shingle_sets(texts, shingle)
            for i in range(len(texts)):
                v = values[offsets[i]:offsets[i + 1]]
                n.append(len(v))
                node.append(_node(v) if len(v) else None)
            if sketched:
                sketch += sketches(offsets, values)
        give_back()
        columns = [pa.array(n, pa.int64()), pa.array(node, pa.int64())] + ([pa.array(sketch, pa.binary())] if sketched else [])
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    return sets.asNondeterministic()


#: within a bucket this many bits of a signature tell it apart (a false meeting costs one check of the sketches)
KEY_MASK = (1 << 32) - 1
#: bits of a node that travel with its signatures (where two nodes share them, both are taken)
REF_MASK = (1 << 40) - 1
#: packed signatures of a bucket: ``hashes``, and for each of ``refs`` how many of them; or a group of a signature (``members``)
PACKED = "bucket int, is_local boolean, sig bigint, members array<bigint>, hashes binary, refs binary, counts binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("is_local", pa.bool_()), ("sig", pa.int64()), ("members", pa.list_(pa.int64()))]
                    + [(c, pa.binary()) for c in ("hashes", "refs", "counts")])


def _split(values: np.ndarray, low: str, high: str) -> bytes:
    """Integers as all their low parts, then all their high parts."""
    bits = 8 * np.dtype(low).itemsize
    return (values & ((1 << bits) - 1)).astype(low).tobytes() + (values >> bits).astype(high).tobytes()


def _joined(raw: bytes, low: str, high: str) -> np.ndarray:
    """The integers of ``_split``."""
    a, b = np.dtype(low).itemsize, np.dtype(high).itemsize
    n = len(raw) // (a + b)
    return np.frombuffer(raw, low, n).astype(np.int64) | np.frombuffer(raw, high, n, a * n).astype(np.int64) << (8 * a)


def _runs(sig: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sig, place) sorted, with the bounds of each sig."""
    order = np.lexsort((place, sig))
    sig, place = sig[order], place[order]
    first = np.ones(len(sig), bool)
    first[1:] = (sig[1:] != sig[:-1]) | (place[1:] != place[:-1])
    sig, place = sig[first], place[first]
    cut = np.flatnonzero(np.diff(sig, prepend=sig[:1] - np.uint64(1))) if len(sig) else np.zeros(0, np.int64)
    return sig, place, np.append(cut, len(sig))


def _repeated(sig: np.ndarray, least: int) -> np.ndarray:
    """Which entries have a signature that occurs at least ``least`` times."""
    out = np.full(len(sig), least <= 1)
    if least <= 1:
        return out
    part = sig.astype(np.uint8) & np.uint8(SORT_PARTS - 1)  # sorted a part at a time, to hold less
    for p in range(SORT_PARTS):
        at = np.flatnonzero(part == p)
        s = sig[at]
        order = np.argsort(s)
        s = s[order]
        same = s[1:] == s[:-1]  # most signatures occur once: only the others are counted
        twice = np.zeros(len(s), bool)
        twice[1:] = same
        twice[:-1] |= same
        at, s = at[order[twice]], s[twice]
        cut = np.append(np.flatnonzero(np.diff(s, prepend=s[:1] - np.uint64(1))), len(s)) if len(s) else np.zeros(1, np.int64)
        n = np.diff(cut)
        out[at] = np.repeat(n >= least, n)
    return out


def _send(scheme: Scheme, shingle: int, buckets: int, frequent: Frequent | None = None):
    """Documents -> packed signatures by bucket, and the groups of signatures that many of a batch share."""

    def pack(nodes: np.ndarray, owner: np.ndarray, sig: np.ndarray, local: bool) -> Iterator[dict]:
        bucket = ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((owner, bucket))
        cut = np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))
        for x in np.flatnonzero(np.diff(cut)).tolist():
            at = order[cut[x]:cut[x + 1]]
            own = owner[at]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            # local ones with their whole name
            yield {"bucket": x, "is_local": local, "hashes": sig[at].astype("<u8" if local else "<u4").tobytes(),
                   "refs": _split(nodes[own[first]] & REF_MASK, "<u4", "u1"),
                   "counts": _split(np.diff(np.append(first, len(own))), "u1", "<u2")}

    def flush(nodes: list[int], sizes: list[np.ndarray], cells: list[bytes], owner: list[np.ndarray],
              sigs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        node, size = np.array(nodes, np.int64), np.concatenate(sizes)
        own, sig = np.concatenate(owner), np.concatenate(sigs)
        owner.clear()
        sigs.clear()
        many = _repeated(sig, LOCAL_GROUP)
        s, place, cut = _runs(sig[many], own[many].astype(np.int64))
        own, sig = own[~many], sig[~many]
        rows, sent = [], np.ones(len(place), bool)
        for g, group in clusters(Sketched(size, np.frombuffer(b"".join(cells), np.uint8)), place, cut, scheme):
            # one of each cluster stands for it elsewhere; the cluster itself goes on as a group
            a = cut[g]
            sent[a:cut[g + 1]] &= ~np.isin(place[a:cut[g + 1]], group[1:])
            rows.append({"bucket": int(s[a] >> np.uint64(40)) % buckets, "sig": int(s[a].view(np.int64)),
                         "members": node[group].tolist()})
            if len(rows) == 512:
                yield pa.RecordBatch.from_pylist(rows, _PACKED)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _PACKED)
        # a row holds all that goes to its bucket: one at a time
        for row in pack(node, own, sig, False):
            yield pa.RecordBatch.from_pylist([row], _PACKED)
        if len(place):
            for row in pack(node, place[sent], s[sent], True):
                yield pa.RecordBatch.from_pylist([row], _PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        nodes, sizes, sketch, owner, sigs, held = [], [], [], [], [], 0
        for batch in batches:
            for _, texts in text_chunks(batch.column("text"), TEXT_BYTES):
                offsets, values = shingle_sets(texts, shingle)
                fresh = []
                for i in range(len(texts)):
                    v = values[offsets[i]:offsets[i + 1]]
                    if len(v) and (node := _node(v)) not in seen:
                        seen[node] = None
                        fresh.append((node, v))
                if not fresh:
                    continue
                lengths = np.cumsum([0, *(len(v) for _, v in fresh)])
                fresh_values = np.concatenate([v for _, v in fresh])
                own, sig = signatures(lengths, fresh_values, scheme, frequent)
                owner.append((own + len(nodes)).astype(np.int32))
                nodes += [node for node, _ in fresh]
                sizes.append(np.diff(lengths))
                sketch += sketches(lengths, fresh_values)
                sigs.append(sig)
                held += len(sig)
                if held >= FLUSH:
                    yield from flush(nodes, sizes, sketch, owner, sigs)
                    nodes, sizes, sketch, owner, sigs, held = [], [], [], [], [], 0
                    seen.clear()
        if nodes:
            yield from flush(nodes, sizes, sketch, owner, sigs)
        del nodes, sizes, sketch, owner, sigs, seen
        give_back()

    return run


def _counted(scheme: Scheme, shingle: int):
    """Documents -> how often they have each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_chunks(batch.column("text"), TEXT_BYTES):
                _, sig = signatures(*shingle_sets(list(dict.fromkeys(texts)), shingle), scheme)
                sig, n = np.unique(sig, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(n.astype(np.int32))], ["sig", "n"])

    return run


def frequent_signatures(rows: DataFrame, total: int, scheme: Scheme, shingle: int) -> Frequent:
    """The most frequent signatures of a sample of ``rows`` (by the hash of the text) with about ``SAMPLE_SHINGLES`` of ``total`` shingles.

    The sample only puts signatures in order; whatever it holds, no similar pair is lost.
    """
    share = max(1, math.ceil(total / SAMPLE_SHINGLES))
    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text")
    found = some.mapInArrow(_counted(scheme, shingle), "sig bigint, n int").groupBy("sig").agg(F.sum("n").cast("int").alias("n")) \
        .filter(F.col("n") >= LEAST_FOUND).orderBy(F.desc("n"), "sig").limit(MOST_FREQUENT).toArrow()  # bounded
    sig, n = (found.column(c).to_numpy() for c in ("sig", "n"))
    order = np.argsort(sig.view(np.uint64))
    return Frequent(sig.view(np.uint64)[order], n[order])


#: groups of a bucket: ``members`` are refs, told apart at ``home``; or nodes, and the home is null
MET = "sig bigint, home bigint, hot boolean, members array<bigint>"
_MET = pa.schema([("sig", pa.int64()), ("home", pa.int64()), ("hot", pa.bool_()), ("members", pa.list_(pa.int64()))])
GROUP = "sig bigint, members array<bigint>"
_GROUP = pa.schema([("sig", pa.int64()), ("members", pa.list_(pa.int64()))])


def _alike(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A name of the members ``values[cut[g]:cut[g + 1]]`` of each group, the same for the same members."""
    total = np.append(np.uint64(0), np.cumsum(mix(values.view(np.uint64))))
    return total[cut[1:]] - total[cut[:-1]]


def _match(scheme: Scheme):
    """One bucket: groups of refs that share a signature.

    Groups with the same members are given once.  Signatures that many documents
    of a batch share keep one name, so all their groups can be put together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places, refs = [], [], []
        heads: dict[int, set[int]] = {}
        bucket, held = 0, 0
        for batch in batches:
            passed = []
            for r in batch.to_pylist():
                if r["hashes"] is None:
                    passed.append({"sig": r["sig"], "members": r["members"]})
                    continue
                bucket = r["bucket"]
                if r["is_local"]:
                    full = np.frombuffer(r["hashes"], "<u8")
                    for f in full.view(np.int64).tolist():
                        heads.setdefault(f & KEY_MASK, set()).add(f)
                    keys.append((full & np.uint64(KEY_MASK)).astype(np.uint32))
                else:
                    keys.append(np.frombuffer(r["hashes"], "<u4"))
                refs.append(_joined(r["refs"], "<u4", "u1"))
                places.append(np.repeat(np.arange(held, held + len(refs[-1]), dtype=np.uint32), _joined(r["counts"], "u1", "<u2")))
                held += len(refs[-1])
            if passed:
                yield pa.RecordBatch.from_pylist(passed, _MET)
        if not keys:
            return
        key = np.concatenate(keys)
        del keys
        place = np.concatenate(places)
        del places
        use = _repeated(key, 2)
        key, place = key[use].astype(np.uint64), place[use].astype(np.int64)
        # a set of several batches is one
        ref, same = np.unique(np.concatenate(refs), return_inverse=True)
        del refs, use
        s, place, cut = _runs(key, same[place])
        member = ref[place]
        # groups with the same members
        alike = _alike(member, cut)
        many = np.flatnonzero(np.diff(cut) > 1)
        _, once = np.unique(alike[many], return_index=True)
        hot = np.array([x in heads for x in s[cut[:-1][many]].tolist()], bool) if heads else np.zeros(len(many), bool)
        keep = np.zeros(len(many), bool)
        keep[once] = True
        for g in many[hot].tolist():
            of_hot = member[cut[g]:cut[g + 1]].tolist()
            yield pa.RecordBatch.from_pylist([{"sig": name, "home": name & (1 << 62) - 1, "hot": True, "members": of_hot}
                                              for name in heads[int(s[cut[g]])]], _MET)
        cold = many[keep & ~hot]
        n = np.diff(cut)[cold]
        # members ascend; the few larger groups go anywhere: many that differ a little can have one least member
        home = np.where(n > SPREAD_GROUP, alike[cold], mix(member[cut[:-1][cold]].view(np.uint64)))
        name = mix(s[cut[:-1][cold]] + np.uint64(bucket << 32)).view(np.int64)
        ends = np.cumsum(n)
        for at in np.split(np.arange(len(cold)), np.searchsorted(ends, np.arange(MEMBERS_AT_ONCE, ends[-1] if len(ends) else 0, MEMBERS_AT_ONCE))):
            if len(at):
                begin = np.append(0, np.cumsum(n[at]))
                of_cold = member[np.repeat(cut[:-1][cold[at]] - begin[:-1], n[at]) + np.arange(begin[-1])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(name[at]), pa.array((home[at] >> np.uint64(2)).astype(np.int64)), pa.array(np.zeros(len(at), bool)),
                    pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(of_cold))], schema=_MET)
        del key, place, ref, same, s, cut, member, alike
        give_back()

    return run


def _told_apart(scheme: Scheme):
    """Rows of one place, groups of refs and the nodes of these with their sketches -> groups of nodes that the sketches do not tell apart.

    Groups with the same members are compared once; hot ones stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, hots, counts, members, refs, nodes, sizes, cells = [], [], [], [], [], [], [], []
        for batch in batches:
            is_group = pc.is_valid(batch.column("members"))
            some, told = batch.filter(is_group), batch.filter(pc.invert(is_group))
            if some.num_rows:
                sigs.append(some.column("sig").to_numpy())
                hots.append(some.column("hot").to_numpy(zero_copy_only=False))
                counts.append(pc.list_value_length(some.column("members")).to_numpy().astype(np.int64))
                members.append(some.column("members").flatten().to_numpy())
            if told.num_rows:
                for held, c in ((refs, "ref"), (nodes, "node"), (sizes, "size")):
                    held.append(told.column(c).to_numpy())
                cells.append(b"".join(told.column("sketch").to_pylist()))
        if not sigs:
            return
        sig, hot, n, member = (np.concatenate(x) for x in (sigs, hots, counts, members))
        ref, node, size = (np.concatenate(x) for x in (refs, nodes, sizes))
        sets = Sketched(size.astype(np.int64), np.frombuffer(b"".join(cells), np.uint8))
        del sigs, hots, counts, members, refs, nodes, sizes, cells
        order = np.argsort(ref, kind="stable")
        ref = ref[order]
        # a ref is one node, or seldom several
        low = np.searchsorted(ref, member)
        found = np.searchsorted(ref, member, "right") - low
        ends = np.cumsum(found)
        place = order[np.repeat(low - (ends - found), found) + np.arange(ends[-1])]
        cut = np.append(0, ends[np.cumsum(n) - 1])
        for g in np.flatnonzero(hot).tolist():
            yield pa.RecordBatch.from_pylist([{"sig": int(sig[g]), "members": node[place[cut[g]:cut[g + 1]]].tolist()}], _GROUP)
        cold = np.flatnonzero(~hot)
        _, once = np.unique(_alike(node[place], cut)[cold], return_index=True)
        cold = cold[np.sort(once)]
        n = np.diff(cut)[cold]
        begin = np.append(0, np.cumsum(n))
        of_cold = place[np.repeat(cut[:-1][cold] - begin[:-1], n) + np.arange(begin[-1])]
        out = []
        for i, (g, group) in enumerate(clusters(sets, of_cold, begin, scheme)):
            name = (int(sig[cold[g]]) * 1_000_003 + i) & 0xFFFFFFFFFFFFFFFF
            name = int(mix(np.array([name], np.uint64)).view(np.int64)[0])
            out.append({"sig": name, "members": node[group].tolist()})
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, _GROUP)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, _GROUP)
        del sig, member, ref, node, size, sets, order, low, found, ends, place, of_cold, out
        give_back()

    return run


def _groups(met: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """(sig, members) of the groups of ``met`` (``MET``), told apart by the sketches of ``sets``."""
    spark = met.sparkSession
    asked = met.filter("home IS NOT NULL")
    total = asked.agg(F.sum(F.size("members"))).first()[0] or 0
    places = max(2 * spark.sparkContext.defaultParallelism, math.ceil(total / APART_MEMBERS))
    asked = asked.withColumn("place", (F.col("home") % places).cast("int"))
    known = sets.filter("node IS NOT NULL").select(F.col("node").bitwiseAND(F.lit(REF_MASK)).alias("ref"), "node",
                                                   F.col("n_shingles").cast("int").alias("size"), "sketch")
    known = known.repartition("ref").dropDuplicates(["ref", "node"])
    told = asked.select("place", F.explode("members").alias("ref")).distinct().join(known, "ref")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    meeting = asked.select("place", "sig", "hot", "members", none("ref", "bigint"), none("node", "bigint"), none("size", "int"),
                           none("sketch", "binary")).unionByName(
        told.select("place", none("sig", "bigint"), none("hot", "boolean"), none("members", "array<bigint>"),
                    "ref", "node", "size", "sketch"))
    apart = meeting.repartitionById(places, F.col("place")).mapInArrow(_told_apart(scheme), GROUP)
    return met.filter("home IS NULL").select("sig", "members").unionByName(apart)


def _verify(scheme: Scheme, shingle: int):
    """Whether the sets of two text columns are similar."""

    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        rows = pa.concat_arrays([pa.array([x for pair in zip(a.to_pylist(), b.to_pylist(), strict=True) for x in pair],
                                          pa.string())])
        held: list[np.ndarray] = []
        for _, texts in text_chunks(rows, TEXT_BYTES):
            offsets, values = shingle_sets(texts, shingle)
            for i in range(len(texts)):
                held.append(values[offsets[i]:offsets[i + 1]])
                if len(held) == 2:
                    x, y = held
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    out.append(bool(len(x) and len(y)) and scheme.similar(both, len(x), len(y)))
                    held = []
        give_back()
        return pa.array(out, pa.bool_())

    return similar.asNondeterministic()


def cross_links(names: list[int], labels: list[int], sets: list[np.ndarray], scheme: Scheme) -> list[tuple[int, int]]:
    """Similar pairs that join different labels of a block, enough to join all that they join (prefix filter)."""
    parent = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    every, rank, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    scarce = np.lexsort((every, n)).argsort()  # places in order of frequency
    at = np.cumsum([0, *map(len, sets)])
    index: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    out = []
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), names[i])):
        own = rank[at[i]:at[i + 1]]
        m = len(own)
        keep = m - -(-scheme.threshold * m // 100) + 1
        prefix = own[np.argsort(scarce[own])][:keep]
        prefix = prefix[n[prefix] > 1].tolist()
        tried: set[int] = set()
        for token in prefix:
            for label, posting in index[token].items():
                if root(label) == root(labels[i]):
                    continue
                for j in posting:
                    if j in tried or 100 * len(sets[j]) < scheme.threshold * m:
                        continue
                    tried.add(j)
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if scheme.similar(both, m, len(sets[j])):
                        out.append((names[i], names[j]))
                        parent[root(labels[i])] = root(label)
                        break
        for token in prefix:
            index[token][labels[i]].append(i)
    return out


def _block_links(scheme: Scheme, shingle: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(block: pa.Table) -> pa.Table:
        sets: list[np.ndarray] = []
        for chunk in block.column("text").chunks:
            for _, texts in text_chunks(chunk, TEXT_BYTES):
                offsets, values = shingle_sets(texts, shingle)
                sets += [values[offsets[i]:offsets[i + 1]] for i in range(len(texts))]
        found = cross_links(block.column("node").to_pylist(), block.column("label").to_pylist(), sets, scheme)
        del sets
        give_back()
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())},
                        schema=schema)

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = Scheme(),
                 shingle: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, n_shingles, node, label, component_id) of every row, and verified links (u, v) between nodes.

    A node is a distinct set (64-bit name); the links join every two nodes that
    some chain of similar pairs joins, though not every similar pair is listed.
    ``label`` names the component, ``component_id`` is the least id reachable (one
    that several components hold names them all).  Without words the set is empty,
    node and label null and the component the row's own id; null ids are kept and
    count last; rows with equal texts share a node; an empty table gives no rows.
    Other columns are not read.
    """
    ship_package()
    with small_batches(docs.sparkSession, BATCH_BYTES):
        return _jaccard_join(docs, id_col, text_col, scheme, shingle, block)


def _jaccard_join(docs: DataFrame, id_col: str, text_col: str, scheme: Scheme, shingle: int, block: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = settled(rows.select("id", _set_rows(shingle, sketched=True)(F.col("text")).alias("s")).select("id", "s.*"), "sets")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(2 * spark.sparkContext.defaultParallelism, math.ceil(1.5 * total / BUCKET_SIGNATURES))
    frequent = frequent_signatures(rows, total, scheme, shingle)
    packed = rows.select("text").mapInArrow(_send(scheme, shingle, buckets, frequent), PACKED)
    met, folder = settled_at(packed.repartitionById(buckets, F.col("bucket")).mapInArrow(_match(scheme), MET), "met")
    member = settled(_groups(met, sets, scheme).select("sig", F.explode("members").alias("node")).distinct(), "groups")
    discard(spark, folder)
    sets = sets.drop("sketch")
    # one of each group, by one of four orders, is its centre
    centre = member.groupBy("sig").agg(F.min_by("node", F.xxhash64("node", F.col("sig") % 4)).alias("centre"), F.count("*").alias("n")) \
        .filter("n > 1").select("sig", "centre")
    spokes = member.join(centre, "sig").filter("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("n"))
    # the centre that a node meets most often is tried first
    order = Window.partitionBy("node").orderBy(F.desc("n"), "centre")
    pairs = settled(spokes.select(F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v"),
                                  (F.row_number().over(order) == 1).alias("first"))
                    .groupBy("u", "v").agg(F.max("first").alias("first")), "pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if wanted.count() <= MAX_BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    texts = rows.select("text", _set_rows(shingle)(F.col("text"))["node"].alias("node")).join(wanted, "node", "left_semi")
    texts = settled(texts.dropDuplicates(["node"]), "texts")

    def text_of(name: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), F.col("text").alias(f"{name}_text"))

    def verified(some: DataFrame) -> DataFrame:
        return settled(some.join(text_of("u"), "u").join(text_of("v"), "v").filter(
            _verify(scheme, shingle)(F.col("u_text"), F.col("v_text"))).select("u", "v"), "links")

    links = verified(pairs.filter("first").select("u", "v"))
    labels = connected_components(links)
    # the other links matter only between components
    named = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    rest = pairs.filter("NOT first").join(named("u"), "u", "left").join(named("v"), "v", "left").filter(
        F.coalesce("u_label", "u") != F.coalesce("v_label", "v")).select("u", "v")
    links = links.unionByName(verified(rest))
    labels = connected_components(links)

    # Groups that are still in several components: search all their cross pairs.  A pair of centre and member with
    # two labels was refuted above, so a group of two has nothing left.  Groups overlap much, so the components that
    # they connect are searched together, and a node's text moves once, not once a group.
    member = member.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
    loose = member.groupBy("sig").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")) \
        .filter("a <> b AND n > 2").select("sig", "a")
    open_ = settled(member.join(loose, "sig").groupBy("node", "label", "a").agg(F.count("*").alias("n")), "loose")
    if not open_.isEmpty():
        families = connected_components(open_.select(F.col("label").alias("u"), F.col("a").alias("v"))) \
            .select(F.col("node").alias("label"), F.col("label").alias("family"))
        nodes = open_.select("node", "label").distinct().join(families, "label")
        # nodes of a family's largest component need not meet each other
        shares = nodes.groupBy("family", "label").agg(F.count("*").alias("n")).groupBy("family").agg(
            F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
        shares = shares.select("family", F.col("top.label").alias("major"), F.ceil(F.col("top.n") / block).cast("int").alias("majors"),
                               F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("minors"))
        place, is_major = F.xxhash64("node"), F.col("label") == F.col("major")
        parts = nodes.join(shares, "family").withColumns({
            "own": F.when(is_major, F.col("minors") + F.pmod(place, F.col("majors"))).otherwise(F.pmod(place, F.col("minors"))).cast("int"),
            "last": F.when(is_major, F.col("minors") - 1).otherwise(F.col("minors") + F.col("majors") - 1)})
        parts = parts.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))) \
            .select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "label", "text")
        more = settled(parts.groupBy("family", "i", "j").applyInArrow(
            _block_links(scheme, shingle), "u bigint, v bigint").distinct(), "more-links")
        links = links.unionByName(more)
        labels = connected_components(links)

    classes = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least")) \
        .join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    whole = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    where = classes.join(whole, "label").select("node", "label", "component_id")
    members = sets.join(where, "node", "left").select(
        "id", "n_shingles", "node", "label", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return members, links


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row of ``docs`` for each component, one of its least id (nulls last), with the columns of ``docs``.

    Rows without words are linked with nothing and stay.
    """
    members, _ = jaccard_join(docs, id_col, text_col, **options)
    # the row travels as one value: its columns may have any name
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                        _set_rows(SHINGLE)(F.coalesce(F.col(text_col), F.lit("")))["node"].alias("node"))
    # components by label: unlinked texts may share an id, or have none
    first = members.filter("node IS NOT NULL").groupBy("label").agg(
        F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("node").alias("node"))).alias("one")) \
        .select(F.col("one.id").alias("first_id"), F.col("one.node").alias("first_node"))
    kept = keyed.filter("node IS NOT NULL").join(
        first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("node") == F.col("first_node")), "left_semi")
    kept = kept.dropDuplicates(["id", "node"]).unionByName(keyed.filter("node IS NULL"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
