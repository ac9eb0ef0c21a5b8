"""Exact repeated passages: anchors find where they may be, a Burrows-Wheeler transform settles where they are."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, discard, ship, skew_join
from lakeloom.llm.words import mix, text_bytes

#: Bytes of the k-grams that anchors are chosen among, and zero bytes between two texts.
GRAM, GAP = 16, 128
#: Bytes of text in a chunk, anchors in a bucket, contexts in a bucket, codes in one transform.
CHUNK_BYTES, BUCKET_ANCHORS, BUCKET_CONTEXTS, STEP = 4 << 20, 1_000_000, 50_000, 1 << 18
#: Bytes whose anchors are found at a time, so that arrays stay in the cache.
SLICE = 1 << 17
#: Contexts of one k-gram that are compared as they are, and that may meet in one task.
HOT, CROWD = 1024, 8192
_NONE = np.uint64(2**64 - 1)
_ZSTD = pa.Codec("zstd", 3)
_FAR = np.int64(2**63 - 1)


def _eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    h = buf.astype(np.uint64)
    for shift in (1, 2, 4):
        h = h[:-shift] | (h[shift:] << np.uint64(8 * shift))
    return h


def _slide(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over each window of `width` values, by doubling."""
    span = 1
    while span * 2 <= width:
        a = f(a[:-span], a[span:])
        span *= 2
    return f(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


class Texts:
    """Texts laid out with gaps of zeros, and their anchors.

    A string of `length` bytes holds length - GRAM + 1 k-grams. In each text every k-gram is an anchor
    that has the least hash of some run of that many; so two texts with a common string have a common
    anchor in it, at the same place of the string, whatever is around it.
    """

    def __init__(self, texts: list[bytes], docs: np.ndarray, length: int, copies: np.ndarray | None = None):
        self.length, self.docs, self.left = length, docs, length - GRAM
        self.copies = np.ones(len(docs), np.int64) if copies is None else copies
        sizes = np.array([len(t) for t in texts], np.int64)
        self.start = GAP + np.concatenate([[0], np.cumsum(sizes + GAP)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.end = self.start + sizes
        gap = b"\0" * GAP
        self.buf = np.frombuffer(gap + gap.join(texts) + gap * 2, np.uint8)
        places, prints, contexts, sides = [], [], [], []
        # A string has at least half of its bytes outside of the k-gram on one side of it.
        half = self.left // 2
        steps = sorted({*range(0, half - 7, 8), half - 8})
        long = sizes >= length
        opens, shuts = self.start[long], self.end[long] - GRAM + 1  # between them k-grams are of one text
        wide = length - GRAM + 1
        for a in range(0, len(self.buf), SLICE):
            lo, hi = max(0, a - GAP), min(len(self.buf), a + SLICE + 2 * GAP)
            eight = _eight(self.buf[lo:hi])
            n = len(eight) - (GRAM - 8)
            if n <= wide:
                continue
            h = mix(eight[:n] * np.uint64(0xD6E8FEB86659FD93) + mix(eight[GRAM - 8 :] + mix(eight[6 : 6 + n])))
            i, j = np.searchsorted(shuts, lo, "right"), np.searchsorted(opens, lo + n)
            turn = np.zeros(n + 1, np.int32)
            np.add.at(turn, np.maximum(opens[i:j] - lo, 0), 1)
            np.add.at(turn, np.minimum(shuts[i:j] - lo, n), -1)
            ok = np.cumsum(turn[:-1], dtype=np.int32) > 0
            h[~ok] = _NONE
            least = _slide(h, wide, np.minimum)
            pad = np.zeros(wide - 1, np.uint64)
            at = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), wide, np.maximum) == h) & ok)
            at = at[(at + lo >= a) & (at + lo < a + SLICE)]
            context = np.zeros(len(at), np.uint64)
            for off in range(-self.left, length, 8):
                context = mix(context * np.uint64(0x165667B19E3779F9) + eight[np.minimum(at + off, len(eight) - 1)])
            side = []
            for a0 in (-half, GRAM):
                x = np.zeros(len(at), np.uint64)
                for off in steps:
                    x = mix(x + eight[np.minimum(at + a0 + off, len(eight) - 1)])
                side.append(x >> np.uint64(52))
            places.append(at + lo), prints.append(mix(h[at]))  # least hashes are small; mixed again they are even
            contexts.append(context), sides.append(side[0] << np.uint64(12) | side[1])
        self.sides = np.concatenate(sides) if sides else np.zeros(0, np.uint64)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.place, self.print, context = cat(places, np.int64), cat(prints, np.uint64), cat(contexts, np.uint64)
        self.owner = np.searchsorted(self.start, self.place, "right") - 1
        # Zeros of a text aren't a gap: how far the text goes is part of the context.
        self.clip_left = np.minimum(self.left, self.place - self.start[self.owner])
        self.clip_right = np.minimum(length, self.end[self.owner] - self.place)
        self.context = mix(context + (self.clip_left * 256 + self.clip_right).astype(np.uint64))

    def classes(self, buckets: int) -> None:
        """Anchors of equal k-gram and context are a class; classes are in order of bucket. (Should the upper
        bits of two k-grams be equal, a class may come in several pieces, which does no harm.)"""
        bucket = ((self.print >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort((self.print >> np.uint64(20) << np.uint64(20)) | (self.context >> np.uint64(44)))
        f, c = self.print[order], self.context[order]
        new = np.concatenate([[True], (f[1:] != f[:-1]) | (c[1:] != c[:-1])]) if len(f) else np.zeros(0, bool)
        self.first = order[new]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(self.docs[self.owner[order]], np.flatnonzero(new)) if len(f) else np.zeros(0, np.int64)
        self.bucket = bucket[self.first]

    def buckets(self) -> list[tuple[int, int, int]]:
        """The buckets that classes are in, with where they begin and end."""
        cuts = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]])) if len(self.bucket) else np.zeros(0, np.int64)
        return list(zip(self.bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(self.bucket)], strict=True)) if len(cuts) else []


def _pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.view("<u8").ravel()


def _columns(*arrays) -> bytes:
    """Columns of whole numbers in one binary: of each, its least value, width and the differences. A column of
    equal numbers takes none."""
    out = [struct.pack("<I", len(arrays[0]))]
    for a in arrays:
        a = a.astype(np.int64)
        low = a.min() if len(a) else np.int64(0)
        rest = a.view(np.uint64) - np.int64(low).view(np.uint64)
        width = (int(rest.max()).bit_length() + 7) // 8 if len(a) else 0
        out += [struct.pack("<qB", int(low), width), _pack(rest, width)]
    return b"".join(out)


def _read_columns(data: bytes, count: int) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<I", data)[0], 4, []
    for _ in range(count):
        low, width = struct.unpack_from("<qB", data, at)
        rest = _unpack(data[at + 9 : at + 9 + n * width], n, width) if width else np.zeros(n, np.uint64)
        out.append((rest + np.int64(low).view(np.uint64)).view(np.int64))
        at += 9 + n * width
    return out


def _squeeze(data: bytes) -> bytes:
    return np.int64(len(data)).tobytes() + _ZSTD.compress(data, asbytes=True)


def _expand(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], decompressed_size=int(np.frombuffer(data, np.int64, 1)[0]), asbytes=True)


def _join(*parts: bytes) -> bytes:
    return b"".join(np.int64(len(p)).tobytes() + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int(np.frombuffer(data, np.int64, 1, at)[0])
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _deal(batches):
    """Rows (chunk, doc, copies, text) to a row for each chunk of a batch, its texts squeezed together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk, doc, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "doc", "copies"))
        data, offsets = text_bytes(batch.column("text"))
        raw, order = memoryview(np.ascontiguousarray(data)), np.argsort(chunk, kind="stable")
        out: list[bytes] = []
        parts = np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1)
        for own in parts:
            head = _columns(doc[own], copies[own], offsets[own + 1] - offsets[own])
            out.append(_join(head, _squeeze(b"".join(raw[offsets[i] : offsets[i + 1]] for i in own))))
        yield pa.RecordBatch.from_arrays([pa.array([int(chunk[own[0]]) for own in parts], pa.int64()), pa.array(out, pa.binary())], ["chunk", "blob"])


def _texts(table: pa.Table, length: int) -> Texts:
    texts, heads = [], []
    for blob in table.column("blob"):
        head, squeezed = _split(blob.as_py())
        heads.append(_read_columns(head, 3))
        data, ends = memoryview(_expand(squeezed)), np.cumsum(heads[-1][2]).tolist()
        texts += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    doc, copies = (np.concatenate([h[i] for h in heads]) for i in range(2))
    order = np.lexsort((np.array([hash_of(t) for t in texts]), doc))
    return Texts([texts[i] for i in order], doc[order], length, copies[order])


def hash_of(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=7).digest(), "big")


def _anchors(length: int, buckets: int):
    """A chunk's texts to the prints of its classes, a row for each bucket."""

    def run(table: pa.Table) -> pa.Table:
        texts = _texts(table, length)
        texts.classes(buckets)
        rows = [(b, _columns(texts.print[texts.first[i:j]] & np.uint64(2**40 - 1), texts.context[texts.first[i:j]] >> np.uint64(24), texts.sides[texts.first[i:j]], texts.least[i:j])) for b, i, j in texts.buckets()]
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

    return run


def _alone(gram: np.ndarray, side: np.ndarray) -> np.ndarray:
    """True where no other entry of the k-gram has the same side."""
    order = np.lexsort((side, gram))
    g, x = gram[order], side[order]
    same = (g[1:] == g[:-1]) & (x[1:] == x[:-1])
    out = np.empty(len(order), bool)
    out[order] = ~(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    return out


def _meet(crowd: int):
    """A bucket's classes to those whose k-gram has several, a row for each chunk: place, whether contexts differ
    (2: more than `crowd` do), smallest doc. Classes with which no other agrees on either side meet nobody."""

    def run(table: pa.Table) -> pa.Table:
        chunks, parts = table.column("chunk").to_pylist(), [_read_columns(b, 4) for b in table.column("blob").to_pylist()]
        gram, context, sides, doc = (np.concatenate([p[i] for p in parts]) for i in range(4))
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        place = np.concatenate([np.arange(len(p[0])) for p in parts])
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        same = g[1:] == g[:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        order = order[~(_alone(gram[order], sides[order] >> 12) & _alone(gram[order], sides[order] & 4095))]
        order = order[np.lexsort((context[order], gram[order]))]
        gram, context, doc, owner, place = (x[order] for x in (gram, context, doc, owner, place))
        if not len(gram):
            return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        other = np.concatenate([[True], gram[1:] != gram[:-1]])
        first = np.flatnonzero(other)
        size = np.diff(np.concatenate([first, [len(gram)]]))
        contexts = np.add.reduceat((other | np.concatenate([[True], context[1:] != context[:-1]])).astype(np.int64), first)
        differ = np.repeat((contexts > 1).astype(np.int64) + (contexts > crowd), size)
        least = np.repeat(np.minimum.reduceat(doc, first), size)
        order = np.lexsort((place, owner))
        owner, place, differ, least = owner[order], place[order], differ[order], least[order]
        bounds = np.searchsorted(owner, np.arange(len(parts) + 1))
        keep = [i for i in range(len(parts)) if bounds[i] < bounds[i + 1]]
        cols = [_columns(place[bounds[i] : bounds[i + 1]], differ[bounds[i] : bounds[i + 1]], least[bounds[i] : bounds[i + 1]]) for i in keep]
        return pa.table({"chunk": pa.array([chunks[i] for i in keep], pa.int64()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(keep), pa.int64()), "blob": pa.array(cols, pa.binary())})

    return run


def _kept(text, spans: np.ndarray) -> tuple[int, int, str]:
    """Bytes covered by spans (from, to), runs of them, and the hash of the rest."""
    digest, at, gone, runs = hashlib.sha256(), 0, 0, 0
    if len(spans):
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        reach = np.maximum.accumulate(spans[:, 1])
        new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
        begins, ends = spans[new, 0], reach[np.concatenate([new[1:], [True]])]
        gone, runs = int((ends - begins).sum()), len(begins)
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            digest.update(text[at:a])
            at = b
    digest.update(text[at:])
    return gone, runs, digest.hexdigest()


def _settle(length: int, buckets: int, context_buckets: int):
    """A chunk's texts and what its classes met elsewhere.

    kind 0: texts that are settled. kind 1: contexts that differ from others of their k-gram, by
    bucket. kind 2: the texts that wait for those, in one row.
    """

    def run(table: pa.Table, met: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("kind", "key", "chunk", "doc", "copies", "n_bytes", "n_removed", "n_spans", "sha", "blob")}

        def put(**row):
            for c in out:
                out[c].append(row.get(c))

        chunk = table.column("chunk")[0].as_py() if len(table) else None
        if chunk is None:
            return _settled(out)
        texts = _texts(table, length)
        texts.classes(buckets)
        least, differ = texts.least.copy(), np.zeros(len(texts.least), np.int64)
        starts = {b: i for b, i, _ in texts.buckets()}
        for b, blob in zip(met.column("bucket").to_pylist(), met.column("blob").to_pylist(), strict=True):
            place, unlike, low = _read_columns(blob, 3)
            place = place + starts[b]
            least[place], differ[place] = low, unlike
        doc = texts.docs[texts.owner]
        lo = texts.place - texts.clip_left
        hi = np.minimum(texts.place, texts.end[texts.owner] - length)
        gone = (least[texts.of] < doc) & (differ[texts.of] == 0) & (hi >= lo)
        rel = texts.start[texts.owner]
        spans = np.stack([lo - rel, hi + length - rel], axis=1)
        waits = (differ[texts.of] > 0) & (hi >= lo)
        which = np.unique(texts.of[waits])
        first = texts.first[which]
        rows = texts.buf[texts.place[first][:, None] + np.arange(-texts.left, length)[None, :]] if len(first) else np.zeros((0, texts.left + length), np.uint8)
        waiting = Contexts(rows, texts.clip_left[first], texts.clip_right[first] - GRAM, texts.least[which], 0, texts.left)
        # Contexts that go out get the numbers 0, 1, ... of this chunk; a class may have one for each part of its windows.
        classes, numbers, count = [], [], 0
        for level, reaches in ((1, [(0, texts.left)]), (2, _reaches(texts.left))):
            own = np.flatnonzero(differ[which] == level)
            for low, high in reaches if len(own) else []:
                near, at = waiting.take(own).narrow(low, high)
                if not len(at):
                    continue
                lead, kind, _ = near.distinct()
                classes.append(which[own[at]]), numbers.append(count + kind)
                near = near.take(lead)
                bucket = (near.keys() % np.uint64(context_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    few = near.take(part)
                    head = _columns(count + part, few.left, few.right, few.docs, np.full(len(part), low), np.full(len(part), high))
                    put(kind=1, key=int(bucket[part[0]]), chunk=chunk, blob=_join(head, _squeeze(few.rows.tobytes())))
                count += len(lead)
        classes, numbers = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (classes, numbers))
        order = np.argsort(classes, kind="stable")
        numbers, ends = numbers[order], np.searchsorted(classes[order], np.arange(len(texts.least) + 1))
        by_doc = np.searchsorted(texts.owner, np.arange(len(texts.docs) + 1))
        raw = memoryview(texts.buf)
        later, later_spans, later_places = [], [], []
        for d in range(len(texts.docs)):
            a, b = by_doc[d], by_doc[d + 1]
            text = raw[texts.start[d] : texts.end[d]]
            own = spans[a:b][gone[a:b]]
            if waits[a:b].any():
                w = np.flatnonzero(waits[a:b]) + a
                several = ends[texts.of[w] + 1] - ends[texts.of[w]]
                at = np.repeat(ends[texts.of[w]], several) + _within(several)
                later.append((d, len(own), len(at)))
                later_spans.append(own), later_places.append(np.stack([numbers[at], np.repeat(texts.place[w], several) - texts.left - texts.start[d]], axis=1))
            else:
                n, runs, sha = _kept(text, own)
                put(kind=0, doc=int(texts.docs[d]), copies=int(texts.copies[d]), n_bytes=len(text), n_removed=n, n_spans=runs, sha=sha)
        if later:
            d, n_own, n_places = np.array(later).T
            own, places = np.concatenate(later_spans), np.concatenate(later_places)
            heads = _columns(texts.docs[d], texts.copies[d], texts.end[d] - texts.start[d], n_own, n_places), _columns(own[:, 0], own[:, 1]), _columns(places[:, 0], places[:, 1])
            put(kind=2, key=chunk, chunk=chunk, blob=_join(*heads, _squeeze(b"".join(raw[texts.start[i] : texts.end[i]] for i in d))))
        return _settled(out)

    return run


_SETTLED = "kind int, key long, chunk long, doc long, copies long, n_bytes long, n_removed long, n_spans long, sha string, blob binary"


def _settled(out: dict[str, list]) -> pa.Table:
    kinds = {"kind": pa.int32(), "sha": pa.string(), "blob": pa.binary()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def suffix_array(codes: np.ndarray, width: int) -> np.ndarray:
    """Suffixes of codes (below 2 ** width, the last one unique) in order, by doubling prefixes."""
    n, per = len(codes), max(1, 62 // width)
    key = np.zeros(n, np.int64)
    for i in range(per):
        key = (key << width) | np.concatenate([codes[i:], np.zeros(min(i, n), np.int64)])
    span = per
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)]))
        if rank[order[-1]] == n - 1:
            return order
        ahead = np.concatenate([rank[span:] + 1, np.zeros(min(span, n), np.int64)])[:n]
        key = rank * (n + 1) + ahead
        span *= 2


def common_prefixes(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True where a suffix shares fewer than `length` codes with the one before it in `order`.

    All intervals of suffixes with a common prefix of 0, 1, 2, ... codes are extended by one code to the
    left at a time, breadth first: within the suffixes that begin with a code, a border falls where one
    falls between what follows it. Borders of the value v thus appear in round v + 1. No round after
    `length` is made, and none once no border is new.
    """
    last = codes[order - 1]  # the Burrows-Wheeler transform
    last = last.astype(np.uint16) if codes.max() < 1 << 16 else last  # which is sorted by its digits
    back = np.argsort(last, kind="stable")  # the suffix of rank back[q], extended to the left, has rank q
    symbol = last[back]
    other = np.concatenate([[True], symbol[1:] != symbol[:-1]])
    border = np.zeros(len(codes), bool)
    border[0] = True
    count = -1
    for _ in range(length):
        part = np.cumsum(border, dtype=np.int32)[back]
        border = other.copy()
        border[1:] |= part[1:] != part[:-1]
        now = int(border.sum())
        if now == count:
            break
        count = now
    return border


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _hash_columns(rows: np.ndarray, seed: np.ndarray) -> np.ndarray:
    out = seed = seed.astype(np.uint64)
    for i in range(rows.shape[1]):
        out = out * np.uint64(0xD6E8FEB86659FD93) + rows[:, i] + np.uint64(1)
    return mix(out ^ mix(seed))


class Contexts:
    """K-grams and what is around them, for the windows that reach `low` to `high` bytes to the left of the k-gram.

    All of these windows hold the core: the k-gram, the `low` bytes before it and the bytes after it that the one
    with the longest reach holds. `wide` = high - low more bytes on either side of the core are in some of them;
    left and right tell how many of those the text has. The k-th window begins k bytes after the row does.
    """

    def __init__(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray, docs: np.ndarray, low: int, high: int):
        self.rows, self.left, self.right, self.docs, self.low, self.high = rows, left, right, docs, low, high
        self.wide, self.end = high - low, rows.shape[1] - (high - low)

    def take(self, at) -> Contexts:
        return Contexts(self.rows[at], self.left[at], self.right[at], self.docs[at], self.low, self.high)

    def narrow(self, low: int, high: int) -> tuple[Contexts, np.ndarray]:
        """The contexts that have the core of a part of the windows, cut to it, and which they are."""
        near, far = low - self.low, self.high - high
        at = np.flatnonzero((self.left >= near) & (self.right >= far))
        rows = self.rows[at, far : self.rows.shape[1] - near] if near or far else self.rows[at]
        return Contexts(rows, np.minimum(self.left[at] - near, high - low), np.minimum(self.right[at] - far, high - low), self.docs[at], low, high), at

    def keys(self) -> np.ndarray:
        return _hash_columns(self.rows[:, self.wide : self.end], np.zeros(len(self.rows)))

    def inside(self) -> np.ndarray:
        """Which windows the text has: (contexts, windows)."""
        at = np.arange(self.wide + 1)[None, :]
        return (at >= self.wide - self.left[:, None]) & (at <= self.right[:, None])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of contexts that are equal, byte by byte, the one with the smallest doc, in order of core; of each context
        the number of that one; and of those their cores' number."""
        if not len(self.rows):
            return (np.zeros(0, np.int64),) * 3
        key = self.keys()
        whole = _hash_columns(self.rows, key ^ mix((self.left * 256 + self.right).astype(np.uint64)))
        order = np.lexsort((self.docs, whole, key))
        rows, reach = self.rows[order], (self.left * 256 + self.right)[order]
        unlike = np.ones(rows.shape, bool)
        unlike[1:] = rows[1:] != rows[:-1]
        other = unlike[:, self.wide : self.end].any(axis=1)
        new = unlike.any(axis=1)
        new[1:] |= reach[1:] != reach[:-1]
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        return order[new], kind, (np.cumsum(other) - 1)[new]


def _reaches(before: int) -> list[tuple[int, int]]:
    """All reaches of 0 to `before` bytes in parts that double from both ends on. Of a line in many texts, windows
    that reach far out of it differ in their core already, and those that hardly do are mostly equal."""
    out, a, step = [], 0, 1
    while 2 * (a + step) <= before:
        out.append((a, a + step - 1))
        a, step = a + step, 2 * step
    return [*out, (a, before - a), *[(before - j, before - i) for i, j in reversed(out)]]


def _windows(near: Contexts, group: np.ndarray) -> np.ndarray:
    """Of each context's windows, the smallest doc of all that are equal: (contexts, windows), _FAR where the
    text ends. group: numbers of cores, in order; a core is one code."""
    m, wide = len(near.rows), near.wide
    codes = np.empty((m, 2 * wide + 2), np.int64)
    codes[:, :wide] = near.rows[:, :wide].astype(np.int64) + m
    codes[:, wide] = m + 256 + np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    codes[:, wide + 1 : -1] = near.rows[:, near.end :].astype(np.int64) + m
    codes[:, -1] = np.arange(m)[::-1]  # every context ends in a code of its own; the last is the least
    order = suffix_array(codes.ravel(), int(codes[-1, wide]).bit_length())
    border = common_prefixes(codes.ravel(), order, wide + 1)
    context, offset = np.divmod(order, codes.shape[1])
    # Windows that lie in the text.
    inside = (offset <= wide) & (offset >= wide - near.left[context]) & (offset <= near.right[context])
    value = np.where(inside, near.docs[context], _FAR)
    group = np.cumsum(border) - 1
    least = np.minimum.reduceat(value, np.flatnonzero(border))[group]
    out = np.full((m, wide + 1), _FAR)
    out[context[inside], offset[inside]] = least[inside]
    return out


def _in_batches(near: Contexts, group: np.ndarray) -> np.ndarray:
    """_windows() of contexts, as many cores at a time as fit STEP codes. group: sorted."""
    out = np.full((len(near.rows), near.wide + 1), _FAR)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    ends, at = np.concatenate([starts[1:], [len(group)]]), 0
    while at < len(starts):
        to = at + 1
        while to < len(starts) and (ends[to] - starts[at]) * (2 * near.wide + 2) <= STEP:
            to += 1
        part = slice(starts[at], ends[to - 1])
        out[part] = _windows(near.take(part), group[part])
        at = to
    return out


def _least(near: Contexts, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest doc of all equal windows for each of the different contexts (_FAR where the text ends), and
    which of these each context is.

    Where more than `hot` contexts have one core, windows are halved by their reach: either half has a longer core,
    by which the contexts part or, cut to what those windows hold, are equal. Half of half, a window is its own core.
    """
    lead, kind, group = near.distinct()
    own, wide = near.take(lead), near.wide
    found = np.where(own.inside(), own.docs[:, None], _FAR)
    if not wide or not len(lead):
        return found, kind
    # A window has at least half of its other bytes on one side of the core: contexts whose halves both
    # stand alone with their core meet only their equals.
    half = wide // 2
    sides = [_hash_columns(own.rows[:, i:j], group) for i, j in ((wide - half, wide), (own.end, own.end + half))]
    meets = np.flatnonzero(~(_alone(group, sides[0]) & _alone(group, sides[1])))
    many = np.bincount(group[meets], minlength=1)[group[meets]] > hot
    some, many = meets[~many], meets[many]
    found[some] = _in_batches(own.take(some), group[some])
    if len(many):
        middle = (near.low + near.high) // 2
        for low, high in ((near.low, middle), (middle + 1, near.high)):
            part, at = own.take(many).narrow(low, high)
            least, which = _least(part, hot)
            found[many[at], near.high - high : near.high - low + 1] = least[which]
    return found, kind


def _least_docs(rows, left, right, docs, gram, length: int) -> np.ndarray:
    """Of each context's windows, the smallest doc of all contexts of its k-gram with the same window;
    _FAR where the text ends. rows: the bytes before the k-gram, it and those after it."""
    found, kind = _least(Contexts(rows, left, right - GRAM, docs, 0, length - GRAM), HOT)
    return found[kind]


def _resolve(length: int, hot: int):
    """A bucket's contexts to the smallest doc of each of their windows: runs (number, from, to, doc), a row for each
    chunk and part of the windows."""

    def run(table: pa.Table) -> pa.Table:
        parts: dict[tuple[int, int], list] = {}
        for chunk, blob in zip(table.column("chunk").to_pylist(), table.column("blob").to_pylist(), strict=True):
            head, squeezed = _split(blob)
            *head, low, high = _read_columns(head, 6)
            parts.setdefault((int(low[0]), int(high[0])), []).append((chunk, head, squeezed))
        chunks, out = [], []
        for (low, high), own in sorted(parts.items()):
            rows = np.concatenate([np.frombuffer(_expand(squeezed), np.uint8).reshape(len(head[0]), -1) for _, head, squeezed in own])
            number, left, right, doc = (np.concatenate([head[i] for _, head, _ in own]) for i in range(4))
            found, kind = _least(Contexts(rows, left, right, doc, low, high), hot)
            # Runs of windows with one smallest doc.
            edge = np.ones((len(found), found.shape[1] + 1), bool)
            edge[:, 1:-1] = found[:, 1:] != found[:, :-1]
            cls, lo = np.nonzero(edge[:, :-1])
            hi = np.nonzero(edge[:, 1:])[1]
            least = found[cls, lo]
            real = least != _FAR
            cls, lo, hi, least = cls[real], lo[real], hi[real], least[real]
            lo, hi = lo + (length - GRAM - high), hi + (length - GRAM - high)
            runs = np.searchsorted(cls, np.arange(len(found) + 1))
            bounds = np.cumsum([0, *[len(head[0]) for _, head, _ in own]])
            for i, (chunk, _, _) in enumerate(own):
                k = kind[bounds[i] : bounds[i + 1]]
                count = runs[k + 1] - runs[k]
                at = np.repeat(runs[k], count) + _within(count)
                chunks.append(chunk)
                out.append(_columns(np.repeat(number[bounds[i] : bounds[i + 1]], count), lo[at], hi[at], least[at]))
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "blob": pa.array(out, pa.binary())})

    return run


def _finish(length: int):
    def run(waiting: pa.Table, runs: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc", "copies", "n_bytes", "n_removed", "n_spans", "sha")}
        parts = [_read_columns(b, 4) for b in runs.column("blob").to_pylist()]
        cls, lo, hi, low = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4))
        order = np.argsort(cls, kind="stable")
        cls, lo, hi, low = cls[order], lo[order], hi[order], low[order]
        for blob in waiting.column("blob").to_pylist():
            docs, spans, places, squeezed = _split(blob)
            docs, copies, sizes, n_own, n_places = _read_columns(docs, 5)
            spans, (number, place), texts = np.stack(_read_columns(spans, 2), axis=1), _read_columns(places, 2), memoryview(_expand(squeezed))
            at, own_at, place_at = (np.concatenate([[0], np.cumsum(x)]).tolist() for x in (sizes, n_own, n_places))
            a, b = np.searchsorted(cls, number), np.searchsorted(cls, number, "right")
            for d, doc in enumerate(docs.tolist()):
                i, j = place_at[d], place_at[d + 1]
                count = b[i:j] - a[i:j]
                run_at = np.repeat(a[i:j], count) + _within(count)
                first = np.repeat(place[i:j], count)
                gone = low[run_at] < doc
                more = np.stack([first + lo[run_at], first + hi[run_at] + length], axis=1)[gone]
                text = texts[at[d] : at[d + 1]]
                removed, n_spans, sha = _kept(text, np.concatenate([spans[own_at[d] : own_at[d + 1]], more]))
                for c, v in zip(out, (doc, int(copies[d]), len(text), removed, n_spans, sha), strict=True):
                    out[c].append(v)
        return pa.table({c: pa.array(v, pa.string() if c == "sha" else pa.int64()) for c, v in out.items()})

    return run


def repeated_passages(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What each document keeps when passages that an earlier one has are cut: id_col, n_bytes, n_removed,
    n_spans, kept_sha256.

    A byte goes if a string of `length` bytes (40 to 120) that covers it also starts in a document with a
    smaller id; matches are judged on the input and never cross documents. Texts are UTF-8 bytes; null and
    empty ones have none. Ids are whole numbers, anything else is a TypeError. Null ids count as smaller than all
    others; rows with equal ids, so repeated rows too, take nothing from each other. Every row gives one row;
    other columns are dropped. A text of any length is searched whole, by one task that holds about twelve times its
    bytes; texts that wait for other contexts are packed by chunk, so one of more than 2 GB can't be.

    That all contexts of a k-gram are equal is judged by 40 bits of the k-gram's hash, 32 or less of its bucket and 40 of the
    contexts' own: of different ones, about one in 2 ** 80 pairs of a bucket would pass for equal.

    1. Texts are dealt into chunks. In each, anchors are chosen (see Texts); anchors of equal context are
       one class, which is what leaves the chunk, so a passage in many documents of a chunk goes out once.
    2. Classes meet by k-gram. Where all contexts of a k-gram are equal, the smallest id settles them.
    3. Contexts that differ are compared in buckets (those of a k-gram with more than CROWD of them in parts, by how
       far windows reach), byte by byte: a suffix array of them, its Burrows-Wheeler
       transform, and intervals of common prefixes extended breadth first up to `length`; each
       interval's smallest id settles its windows.
    4. Chunks cut the bytes that smaller ids have.
    """
    if not 40 <= length <= 120:
        raise ValueError("length must be between 40 and 120")
    ship(docs.sparkSession)
    ids, back = _ordered_ids(docs, id_col)
    rows = docs.select(ids.alias("doc"), F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b"")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, total // CHUNK_BYTES)
    buckets = max(1, total // 16 // BUCKET_ANCHORS)
    context_buckets = max(1, total // 200 // BUCKET_CONTEXTS)
    # Rows that are equal as a whole have one result; one row may be any share of them all.
    rows = rows.withColumn("hash", F.xxhash64("text"))
    again = cut(rows.groupBy("doc", "hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("doc", "hash"), "suffix-again")
    base = rows.withColumn("copies", F.lit(1).cast("long"))
    if again.limit(1).count():
        n = rows.count()
        several = skew_join(rows, again, ["doc", "hash"], n).groupBy("doc", "text", "hash").agg(F.count(F.lit(1)).alias("copies"))
        base = skew_join(rows, again.withColumn("_again", F.lit(1)), ["doc", "hash"], n, "left").where("_again IS NULL").select("doc", "text", "hash", F.lit(1).cast("long").alias("copies")).unionByName(several)
    base = base.select(F.pmod(F.xxhash64("doc", "hash"), F.lit(chunks)).alias("chunk"), "doc", "copies", "text").mapInArrow(_deal, "chunk long, blob binary")
    prints = base.groupBy("chunk").applyInArrow(_anchors(length, buckets), "bucket long, chunk long, blob binary")
    met = prints.groupBy("bucket").applyInArrow(_meet(CROWD), "chunk long, bucket long, blob binary")
    settled = base.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(_settle(length, buckets, context_buckets), _SETTLED)
    settled = cut(settled.select("key", "chunk", "doc", "copies", "n_bytes", "n_removed", "n_spans", "sha", "blob", "kind"), "suffix-settled", ("kind",))
    discard(again)
    names = "doc long, copies long, n_bytes long, n_removed long, n_spans long, sha string"
    runs = settled.where("kind = 1").select("key", "chunk", "blob").groupBy("key").applyInArrow(_resolve(length, HOT), "chunk long, blob binary")
    late = settled.where("kind = 2").select("chunk", "blob").groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInArrow(_finish(length), names)
    out = settled.where("kind = 0").select("doc", "copies", "n_bytes", "n_removed", "n_spans", "sha").unionByName(late)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return back(out).select(F.col("_id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"))


def _ordered_ids(docs: DataFrame, id_col: str):
    """Ids as whole numbers and what turns them back into a column _id. Null is the least. Other ids have no order
    that is known to be meant, so they are an error rather than a cast."""
    null = -(2**63)
    kind = docs.schema[id_col].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col(id_col).cast("long"), F.lit(null)), lambda out: out.withColumn("_id", F.when(F.col("doc") != null, F.col("doc")).cast(kind))
    raise TypeError(f"ids of {id_col} must be whole numbers, whose order decides; they are {kind}")
