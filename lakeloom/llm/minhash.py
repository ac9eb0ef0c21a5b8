"""Near-duplicates by min-max hashing: bands, sketches, then exact links on full shingle sets."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import BROADCAST_ROWS, components, cut, discard, free_names, ship, skew_join, spread_join
from lakeloom.llm.words import mix, shingle_sets, steps, text_bytes, words_of

#: Permutations; each gives a minimum and a maximum. 2 * PERMS = BANDS * ROWS.
PERMS, BANDS, ROWS = 100, 40, 5
#: Of the 2 * PERMS sketch bits of two sets with similarity J, (1 + J) / 2 agree: 0.9 at J = 0.8.
#: A pair of one band is looked at from 0.76 on, five deviations below that.
AGREE = 0.76
#: A member of a hot band may stand behind another that agrees this well and whose size is this near.
SAME, SIZES = 0.95, 0.9
#: Sets that are compared with one another at once, and their shingles at most (one set may have more).
BLOCK, BLOCK_SHINGLES = 512, 4 << 20
#: One in so many nodes is counted to see which bands are hot.
SAMPLE = 64
#: Members that stand for a part of a large group.
HEADS = 8

_FACTORS = mix(np.arange(1, PERMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SKETCH_WORDS = -(-2 * PERMS // 64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima and maxima of each non-empty set under every permutation: (sets, 2 * PERMS)."""
    out = np.empty((len(sets), 2 * PERMS), np.uint64)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= 1 << 16):
            n += len(sets[to])
            to += 1
        values = np.concatenate(sets[at:to])
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]])]).astype(np.int64)
        turned = np.empty_like(values)
        for p in range(PERMS):
            np.multiply(values, _FACTORS[p], out=turned)
            out[at:to, 2 * p] = np.minimum.reduceat(turned, first)
            out[at:to, 2 * p + 1] = np.maximum.reduceat(turned, first)
        at = to
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One key per band, (sets, BANDS). Keys of different bands never meet."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key


def sketches_of(sig: np.ndarray) -> np.ndarray:
    """One bit of each value, packed in 64-bit words."""
    bits = np.zeros((len(sig), _SKETCH_WORDS * 64), np.uint8)
    bits[:, : sig.shape[1]] = (mix(sig) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


def _hash_rows(k: int):
    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                sets = shingle_sets(words_of(data, offsets), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full]) if full else np.zeros((0, 2 * PERMS), np.uint64)
                keys, sketch = bands_of(sig).view(np.int64), sketches_of(sig)
                both = np.array([[len(sets[i]), int(sets[i].sum()), int(mix(sets[i]).sum())] for i in full], np.uint64).reshape(-1, 3) if full else np.zeros((0, 3), np.uint64)
                by = {i: j for j, i in enumerate(full)}
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in ("row", "doc")],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([both[by[i]].tobytes() if i in by else None for i in range(len(sets))], pa.binary()),
                        pa.array([keys[by[i]] if i in by else None for i in range(len(sets))], pa.list_(pa.int64())),
                        pa.array([sketch[by[i]].tobytes() if i in by else None for i in range(len(sets))], pa.binary()),
                    ],
                    ["row", "doc", "n", "set", "bands", "sketch"],
                )

    return run


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int32)
    for w in range(_SKETCH_WORDS):
        out += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return out


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - _differ(a, b) / (2 * PERMS)


def _stars(near: np.ndarray, node: np.ndarray) -> list[tuple[int, int]]:
    """What a symmetric boolean matrix connects, as pairs of each component's smallest node and another."""
    left, edges = np.ones(len(near), bool), []
    for s in range(len(near)):
        if not left[s]:
            continue
        left[s], todo, own = False, [s], [s]
        while todo:
            new = np.flatnonzero(near[todo.pop()] & left)
            left[new] = False
            own += new.tolist()
            todo += new.tolist()
        if len(own) > 1:
            members = np.unique(node[own])
            edges += [(int(members[0]), x) for x in members[1:].tolist()]
    return edges


def _merge(part: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The labels `part`, after labels x and y were linked pair by pair."""
    apart = x != y
    if not apart.any():
        return part
    x, y, wide = x[apart], y[apart], int(max(x.max(), y.max())) + 1
    up: dict[int, int] = {}

    def find(i):
        while i in up:
            i = up[i]
        return i

    for i, j in zip(*(z.tolist() for z in np.divmod(np.unique(np.minimum(x, y) * wide + np.maximum(x, y)), wide)), strict=True):
        i, j = sorted((find(i), find(j)))
        if i != j:
            up[j] = i
    old = np.array(sorted(up))
    new = np.array([find(i) for i in old.tolist()])
    at = np.minimum(np.searchsorted(old, part), len(old) - 1)
    return np.where(old[at] == part, new[at], part)


@dataclass
class Members:
    """Members of a band. Each stands for sets of low to high shingles whose sketches differ from its own in at most
    `radius` bits."""

    node: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    sketch: np.ndarray

    def take(self, at) -> Members:
        return Members(*[getattr(self, f.name)[at] for f in fields(self)])

    def __len__(self) -> int:
        return len(self.node)


def _together(every: list[Members]) -> Members:
    return Members(*[np.concatenate([getattr(m, f.name) for m in every]) for f in fields(Members)])


def reduce_band(m: Members, threshold: float) -> tuple[list[tuple[int, int]], Members]:
    """Pairs that connect all members that may be linked, and the members that later ones must meet.

    Two sets may be linked if their sizes allow it and their sketches differ in at most 1 - AGREE of the bits. A member
    that stands behind another is met through it: sketches obey the triangle inequality, so if x stands behind a
    leader at distance d, whatever is within r of x is within r + d of the leader. The leader's radius and sizes
    tell how far that goes; nothing that may be linked to a member behind is missed.
    """
    least, far, near = threshold - 1e-9, round(2 * PERMS * (1 - AGREE)), round(2 * PERMS * (1 - SAME))
    lead, part = np.zeros(0, np.int64), np.arange(len(m))
    low, high, radius = m.low.copy(), m.high.copy(), m.radius.copy()

    def may_link(a, b, d):
        sizes = np.minimum(high[a][:, None], high[b][None, :]) >= least * np.maximum(low[a][:, None], low[b][None, :])
        return sizes & (d <= far + radius[a][:, None] + radius[b][None, :])

    def may_stand(a, b, d):
        sizes = np.minimum(low[a][:, None], low[b][None, :]) >= SIZES * np.maximum(high[a][:, None], high[b][None, :])
        return sizes & (d + radius[a][:, None] <= near)

    def stand(i, j, d):
        radius[j] = max(radius[j], d + radius[i])
        low[j], high[j] = min(low[j], low[i]), max(high[j], high[i])

    for at in range(0, len(m), BLOCK):
        own = np.arange(at, min(at + BLOCK, len(m)))
        d = _differ(m.sketch[own], m.sketch[own])
        x, y = np.nonzero(np.triu(may_link(own, own, d), 1))
        part = _merge(part, part[own[x]], part[own[y]])
        behind = np.zeros(len(own), bool)
        for to in range(0, len(lead), BLOCK):
            some = lead[to : to + BLOCK]
            d_lead = _differ(m.sketch[own], m.sketch[some])
            x, y = np.nonzero(may_link(own, some, d_lead))
            part = _merge(part, part[own[x]], part[some[y]])
            can = may_stand(own, some, d_lead) & ~behind[:, None]
            for i in np.flatnonzero(can.any(axis=1)).tolist():
                j = int(np.flatnonzero(can[i])[0])
                # Sizes of the leader may have changed since.
                if min(low[own[i]], low[some[j]]) >= SIZES * max(high[own[i]], high[some[j]]):
                    stand(own[i], some[j], d_lead[i, j])
                    behind[i] = True
        can = may_stand(own, own, d)
        for j in range(len(own)):
            if behind[j]:
                continue
            for i in (np.flatnonzero(can[j + 1 :, j]) + j + 1).tolist():
                if not behind[i] and d[i, j] + radius[own[i]] <= near and min(low[own[i]], low[own[j]]) >= SIZES * max(high[own[i]], high[own[j]]):
                    stand(own[i], own[j], d[i, j])
                    behind[i] = True
        lead = np.concatenate([lead, own[~behind]])
    order = np.lexsort((m.node, part))
    new = np.concatenate([[True], part[order][1:] != part[order][:-1]]) if len(m) else np.zeros(0, bool)
    root = m.node[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    keep = root != m.node[order]
    return list(zip(root[keep].tolist(), m.node[order][keep].tolist(), strict=True)), Members(m.node[lead], low[lead], high[lead], radius[lead], m.sketch[lead])


def _pairs(out) -> list[pa.Array]:
    a, b = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    return [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]


def _members(batch) -> Members:
    column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    sketch = text_bytes(batch.column("sketch"))[0].view(np.uint64).reshape(-1, _SKETCH_WORDS)
    if "radius" in batch.schema.names:
        return Members(column("node"), column("low"), column("high"), column("radius"), sketch)
    return Members(column("node"), column("n"), column("n"), np.zeros(batch.num_rows, np.int64), sketch)


def _band_edges(threshold: float, leaders: bool = False):
    """Members, sorted by band (and salt), to pairs (a, b) of nodes that connect all that may be linked in a group of one
    band and salt. leaders: to rows (a, b, band, node, low, high, radius, sketch), where those of groups marked
    `hot` also give the members that other groups of the band must meet (a and b null)."""

    far, least = round(2 * PERMS * (1 - AGREE)), threshold - 1e-9

    def twos(m: Members, at: np.ndarray) -> list[tuple[int, int]]:
        """The pairs of members at, at + 1 that may be linked."""
        d = np.bitwise_count(m.sketch[at] ^ m.sketch[at + 1]).sum(axis=1)
        near = at[(d <= far + m.radius[at] + m.radius[at + 1]) & (np.minimum(m.high[at], m.high[at + 1]) >= least * np.maximum(m.low[at], m.low[at + 1]))]
        return list(zip(m.node[near].tolist(), m.node[near + 1].tolist(), strict=True))

    def run(batches):
        # Groups that end in a batch are done with it; the last one, which may go on, is held.
        key, held, out, kept, n = None, [], [], [], 0

        def close():
            nonlocal held, out
            band, _, hot = key
            if hot or sum(map(len, held)) > 1:
                pairs, left = reduce_band(_together(held), threshold)
                out += pairs
                if hot and leaders:
                    kept.append((band, left))
            held = []

        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c, b=batch: b.column(c).to_numpy(zero_copy_only=False) if c in b.schema.names else np.zeros(b.num_rows, np.int64)
            band, salt, hot, members = column("band"), column("salt"), column("hot").astype(bool), _members(batch)
            first = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (salt[1:] != salt[:-1])]))
            size = np.diff(np.concatenate([first, [len(band)]]))
            named = lambda i: (int(band[first[i]]), int(salt[first[i]]), bool(hot[first[i]]))  # noqa: B023, E731
            start = 0
            if key is not None:
                if named(0) == key:
                    held.append(members.take(slice(0, size[0])))
                    start = 1
                if start == 0 or len(first) > 1:
                    close()
            inner = np.arange(start, len(first) - 1)
            plain = inner[~hot[first[inner]]] if len(inner) else inner
            out += twos(members, first[plain[size[plain] == 2]])
            for i in [*plain[size[plain] > 2].tolist(), *np.setdiff1d(inner, plain).tolist()]:
                key, held = named(i), [members.take(slice(first[i], first[i] + size[i]))]
                close()
            if start < len(first):
                key, held = named(-1), [members.take(slice(first[-1], len(band)))]
            if sum(map(len, held)) > 8 * BLOCK:  # what a large group holds so far is paired and its leaders stay
                pairs, left = reduce_band(_together(held), threshold)
                out += pairs
                held = [left]
            n = len(out) + sum(len(m) for _, m in kept)
            if n > 50_000:
                yield from tables(out, kept)
                out, kept = [], []
        if held:
            close()
        yield from tables(out, kept)

    def tables(out, kept):
        if not leaders:
            yield pa.RecordBatch.from_arrays(_pairs(out), ["a", "b"])
            return
        names = ["a", "b", "band", "node", "low", "high", "radius", "sketch"]
        none = lambda n, kind=None: pa.nulls(n, kind or pa.int64())
        yield pa.RecordBatch.from_arrays([*_pairs(out), *[none(len(out)) for _ in range(5)], none(len(out), pa.binary())], names)
        if kept:
            m = _together([x for _, x in kept])
            band = np.repeat([b for b, _ in kept], [len(x) for _, x in kept])
            yield pa.RecordBatch.from_arrays([none(len(m)), none(len(m)), *[pa.array(np.asarray(c, np.int64)) for c in (band, m.node, m.low, m.high, m.radius)], pa.array([x.tobytes() for x in m.sketch], pa.binary())], names)

    return run


def _by_band(rows: DataFrame, threshold: float, leaders: bool) -> DataFrame:
    own = rows.repartition("band", "salt").sortWithinPartitions("band", "salt", "low", "node")
    return own.mapInArrow(_band_edges(threshold, leaders), "a long, b long" + ", band long, node long, low long, high long, radius long, sketch binary" * leaders)


def coarse_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that connect all nodes (node, n, bands, sketch) that share a band and may be linked.

    A band with at most a few thousand members is worked through by one task. Hotter ones show in a sample of
    the nodes; they are dealt over salts. There members are paired and most come to stand behind others; the
    leaders are dealt anew as long as that leaves half of them, and then block by block: a leader of one
    block meets those of every other block in tasks of their own.
    """
    member = lambda df: df.select(F.explode("bands").alias("band"), "node", F.col("n").alias("low"), F.col("n").alias("high"), F.lit(0).cast("long").alias("radius"), "sketch")
    most = 8 * BLOCK
    seen = member(nodes.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(SAMPLE)) == 0)).groupBy("band").agg((F.count(F.lit(1)) * SAMPLE).alias("size"))
    # Of ever so many bands, the hottest: those beyond them have less than that part of all members each.
    hot = cut(seen.where(F.col("size") >= 2 * most).orderBy(F.desc("size"), "band").limit(BROADCAST_ROWS), "minhash-hot")
    dealt = lambda level: F.pmod(F.xxhash64("node", F.lit(level)), F.ceil(F.coalesce("size", F.lit(1)) / most)).alias("salt")
    columns = ("node", "low", "high", "radius", "sketch")
    rows = member(nodes).join(F.broadcast(hot), "band", "left").select("band", dealt(0), F.col("size").isNotNull().alias("hot"), *columns)
    n_hot = hot.count()
    found = cut(_by_band(rows, threshold, n_hot > 0), "minhash-bands")
    parts, tables, level = [found.where("a IS NOT NULL").select("a", "b")], [hot, found], 0
    left = found.where("a IS NULL").drop("a", "b") if n_hot else None
    while left is not None and (count := left.count()):
        level += 1
        sizes = cut(left.groupBy("band").agg(F.count(F.lit(1)).alias("size")), f"minhash-sizes{level}")  # a row for each hot band
        tables.append(sizes)
        dealt_out = left.join(F.broadcast(sizes), "band")
        if dealt_out.where(F.col("size") > most).limit(1).count() and level < 8:
            now = cut(_by_band(dealt_out.select("band", dealt(level), F.lit(True).alias("hot"), *columns), threshold, True), f"minhash-bands{level}")
            parts.append(now.where("a IS NOT NULL").select("a", "b"))
            tables.append(now)
            left = now.where("a IS NULL").drop("a", "b")
            if left.count() * 2 <= count:
                continue
            dealt_out = left.join(F.broadcast(sizes), "band")  # sizes are an upper bound now
        blocks = F.ceil(F.col("size") / most)
        own = dealt_out.withColumn("own", F.pmod(F.xxhash64("node", F.lit(-level)), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        pair = (F.least("own", "other") * blocks + F.greatest("own", "other")).alias("salt")
        parts.append(cut(_by_band(own.select("band", pair, F.lit(False).alias("hot"), *columns), threshold, False), "minhash-blocks"))
        tables.append(parts[-1])
        left = None
    out = cut(reduce(DataFrame.unionByName, parts).distinct(), "minhash-pairs")
    discard(*tables)
    return out


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share; nothing on the diagonal that is of use."""
    m, size = len(sets), np.array([len(s) for s in sets])
    # Columns are the elements that two sets share.
    every, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1 if len(number) else np.zeros(0, bool)
    column = (np.cumsum(shared) - 1)[number]
    keep = shared[number]
    owner, column = owner[keep], column[keep]
    inter, width = np.zeros((m, m), np.float64), 8192
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k in range(len(edges) - 1):
        a, b = edges[k], edges[k + 1]
        if a < b:
            x = np.zeros((m, width), np.float32)
            x[owner[a:b], column[a:b] - k * width] = 1
            inter += x @ x.T
    return inter


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets have a similarity of at least the threshold: an exact boolean matrix."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        inter = np.array([[size[0], both], [both, size[1]]], np.float64)
    else:
        inter = _common(sets)
        inter[np.arange(len(sets)), np.arange(len(sets))] = size
    return 100 * inter >= round(100 * threshold) * (size[:, None] + size[None, :] - inter)


def _exact_edges(k: int, threshold: float):
    """Rows (grp, side, part, node, text), sorted by grp, to what links inside each group connect: the smallest part
    and another. Nodes of one part are connected as it is. Where a group has two sides, only links between them
    are looked for. A group has two blocks of rows at most."""

    def links(part, side, sets):
        near, part, side = similar(sets, threshold), np.array(part, np.int64), np.array(side)
        if side.min() != side.max():
            near &= side[:, None] != side[None, :]
        return _stars(near | (part[:, None] == part[None, :]), part)

    def run(batches):
        grp, part_of, side_of, sets, out = None, [], [], [], []
        for batch in batches:
            for part in steps(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                found = shingle_sets(words_of(data, offsets), k)
                for g, sd, p, s in zip(*[part.column(c).to_pylist() for c in ("grp", "side", "part")], found, strict=True):
                    if g != grp:
                        if len(sets) > 1:
                            out += links(part_of, side_of, sets)
                        grp, part_of, side_of, sets = g, [], [], []
                    part_of.append(p), side_of.append(sd), sets.append(s)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays(_pairs(out), ["a", "b"])
                out = []
        if len(sets) > 1:
            out += links(part_of, side_of, sets)
        yield pa.RecordBatch.from_arrays(_pairs(out), ["a", "b"])

    return run


def _exact(rows: DataFrame, k: int, threshold: float, name: str) -> DataFrame:
    """What the links of rows (grp, side, part, node, text) connect: (a, b), a the smallest part."""
    parts = rows.select("grp", "side", "part", "node", "text").repartition("grp").sortWithinPartitions("grp", "side", "node")
    return cut(parts.mapInArrow(_exact_edges(k, threshold), "a long, b long"), name)


def _wanted(threshold: float):
    """Rows (grp, side, part, node, n, sketch, prefix), sorted by grp, to those that may be linked to one of the
    other side and of another part: (grp, side, part, node)."""
    far, least = round(2 * PERMS * (1 - AGREE)), threshold - 1e-9

    def keep(side, part, n, sketch, prefix):
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = (part[a][:, None] != part[b][None, :]) & (_differ(sketch[a], sketch[b]) <= far)
        near &= np.minimum(n[a][:, None], n[b][None, :]) >= least * np.maximum(n[a][:, None], n[b][None, :])
        a, b = a[near.any(axis=1)], b[near.any(axis=0)]
        if not len(a):
            return a
        near = near[near.any(axis=1)][:, near.any(axis=0)]
        both = np.concatenate([a, b])
        shared = _common([prefix[i] for i in both])[: len(a), len(a) :]
        near &= shared > 0
        return np.concatenate([a[near.any(axis=1)], b[near.any(axis=0)]])

    def run(batches):
        grp, held = None, []

        def done():
            side, part, node, n = (np.array([h[i] for h in held], np.int64) for i in range(4))
            sketch = np.frombuffer(b"".join(h[4] for h in held), np.uint64).reshape(-1, _SKETCH_WORDS)
            at = keep(side, part, n, sketch, [h[5] for h in held])
            return pa.RecordBatch.from_arrays([pa.array([grp] * len(at), pa.string()), *[pa.array(x[at]) for x in (side, part, node)]], ["grp", "side", "part", "node"])

        for batch in batches:
            prefixes = [np.asarray(p, np.int64) for p in batch.column("prefix").to_numpy(zero_copy_only=False)]
            for g, *row in zip(*[batch.column(c).to_pylist() for c in ("grp", "side", "part", "node", "n", "sketch")], prefixes, strict=True):
                if g != grp and held:
                    yield done()
                    held = []
                grp = g
                held.append(row)
        if held:
            yield done()

    return run


def _sets(k: int, keep: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                sets = shingle_sets(words_of(*text_bytes(part.column("text"))), k)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], [*keep, "shingles"])

    return run


def cross_links(rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """What links between parts connect, (a, b), of rows (component, part, node, out, n, sketch, text) where `out` marks those
    whose links to other parts of their component are wanted. Exact, for a component of any size.

    In each component shingles are ordered by how many of its sets have them. Two sets with the similarity t share one
    of the first (1 - t) * n + 1 shingles of each. Nodes meet block by block as sketches and these first shingles; texts
    are fetched for those alone that may be linked to one of the other block, so a text that all of a
    component share brings nobody together.
    """
    hundred = round(100 * threshold)
    sets = cut(rows.select("component", "node", "text").mapInArrow(_sets(k, ("component", "node")), "component long, node long, shingles array<long>"), "minhash-sets")
    each = cut(sets.select("component", "node", F.explode("shingles").alias("shingle")), "minhash-shingles")
    often = cut(each.groupBy("component", "shingle").agg(F.count(F.lit(1)).alias("often")), "minhash-often")
    order = skew_join(each, often, ["component", "shingle"], each.count()).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("order"))
    # Shingles of one set alone meet nobody, but take a place.
    first = F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * hundred / 100) + 1).cast("int"))
    prefix = F.transform(F.filter(first, lambda x: x.often > 1), lambda x: x.shingle).alias("prefix")
    small = cut(rows.select("component", "part", "node", "out", "n", "sketch").join(order, "node").select("component", "part", "node", "out", "n", "sketch", prefix), "minhash-prefixes")
    blocks = small.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.ceil(F.sum(F.col("out").cast("int")) / BLOCK).alias("outs")).where("outs > 0")
    blocks = cut(blocks, "minhash-cross-blocks")
    dealt = spread_join(small, blocks, "component", F.col("node"), blocks.count(), "inner", salts=16)
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("node", F.lit(-1)), F.col("blocks"))).withColumn("o", F.pmod(F.xxhash64("node", F.lit(-2)), F.col("outs")))
    name = lambda o, b: F.concat_ws("/", "component", o, b).alias("grp")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ("part", "node", "n", "sketch", "prefix")
    left = dealt.where("out").withColumn("bb", every("blocks")).select(name("o", "bb"), F.lit(0).cast("long").alias("side"), *columns)
    right = dealt.withColumn("oo", every("outs")).select(name("oo", "b"), F.lit(1).cast("long").alias("side"), *columns)
    met = left.unionByName(right).repartition("grp").sortWithinPartitions("grp", "side", "node").mapInArrow(_wanted(threshold), "grp string, side long, part long, node long")
    met = cut(met, "minhash-met")
    found = _exact(met.join(rows.select("node", "text"), "node"), k, threshold, "minhash-cross")
    discard(sets, each, often, small, blocks, met)
    return found


def _verified(nodes: DataFrame, coarse: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(node, part) of the nodes in coarse groups: the smallest node that exact links reach.

    Groups of up to a block of sets are compared whole. A larger one is cut into blocks; what a block connects
    is a part, and HEADS members of each go to the next level, as long as that joins many. If a group
    still has several parts, the members outside of its largest one look for links to all others.
    Texts are fetched once.
    """
    known = cut(coarse.join(nodes.select("node", "row", "n", "sketch"), "node"), "minhash-known")
    sizes = known.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    members = skew_join(known, cut(sizes, "minhash-sizes"), "component", known.count())
    full = cut(texts.join(members, "row").select("component", "blocks", "node", "n", "sketch", "text"), "minhash-texts")
    one = {"part": F.col("node"), "side": F.lit(0)}
    roots = _exact(full.where("blocks = 1").withColumns({"grp": F.col("component").cast("string"), **one}), k, threshold, "minhash-links")
    parts = roots.select(F.col("b").alias("node"), F.col("a").alias("part"))
    big = full.where("blocks > 1")
    if not big.limit(1).count():
        return parts
    state = big.select("component", "node", F.col("node").alias("part"))
    level, now = 0, big.withColumns(one)
    while True:
        up = _exact(now.withColumn("grp", F.concat_ws("/", "component", F.pmod(F.xxhash64("part", F.lit(level)), "blocks"))), k, threshold, f"minhash-level{level}")
        joined, before = up.count(), state.select("part").distinct().count()
        state = cut(spread_join(state, up.toDF("a", "part"), "part", F.col("node"), joined, salts=16).select("component", "node", F.coalesce("a", "part").alias("part")), f"minhash-state{level}")
        level += 1
        if joined * 10 < before:
            break
        nth = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("node")))
        heads = state.withColumn("_nth", nth).where(F.col("_nth") <= HEADS).drop("_nth").join(big.select("node", "n", "text"), "node")
        blocks = heads.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
        now = heads.join(blocks, "component").withColumn("side", F.lit(0))
    counted = state.groupBy("component", "part").agg(F.count(F.lit(1)).alias("c"))
    main = cut(counted.groupBy("component").agg(F.max(F.struct("c", "part")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("component", F.col("top.part").alias("main")), "minhash-main")
    n_main = main.count()
    if n_main:
        rows = spread_join(state, main, "component", F.col("node"), n_main, "inner", salts=16).select("component", "part", "node", (F.col("part") != F.col("main")).alias("out"))
        rows = cut(rows.join(big.select("node", "n", "sketch", "text"), "node"), "minhash-rest")
        cross = cross_links(rows, k, threshold)
        discard(rows)
        joined = components(cross, "minhash-exact").toDF("part", "_to")
        state = spread_join(state, joined, "part", F.col("node"), joined.count(), salts=16).select("node", F.coalesce("_to", "part").alias("part"))
    return parts.union(state.select("node", "part"))


def _groups(rows: DataFrame, k: int, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """Of each of the stored rows (row, doc, text): row, doc, n, component_id, group; and the tables that can go when
    these are read."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)["doc"]
    hashed = cut(rows.mapInArrow(_hash_rows(k), f"row long, doc {kind}, n long, set binary, bands array<long>, sketch binary"), "minhash-rows")
    nodes = hashed.where("set IS NOT NULL").groupBy("set").agg(F.min("doc").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "set", "least", "row", "n", "bands", "sketch"), "minhash-nodes")
    pairs = coarse_pairs(nodes, threshold)
    coarse = components(pairs, "minhash-coarse")
    groups = _verified(nodes, coarse, rows.select("row", "text"), k, threshold)
    joined = cut(nodes.select("node", "set", "least").join(groups, "node", "left").select("set", "least", F.coalesce("part", "node").alias("group")), "minhash-groups")
    least = joined.groupBy("group").agg(F.min("least").alias("component_id"))
    named = cut(skew_join(joined.select("set", "group"), least, "group", joined.count()), "minhash-named")
    plain = hashed.select("row", "doc", "n", "set")
    out = skew_join(plain.where("set IS NOT NULL"), named, "set", plain.count()).select("row", "doc", "n", "component_id", "group")
    alone = plain.where("set IS NULL").select("row", "doc", "n", F.col("doc").alias("component_id"), F.lit(None).cast("long").alias("group"))
    discard(nodes, pairs, coarse, joined)
    return out.unionByName(alone), [hashed, named]


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The group of every document: id_col, n_shingles, component_id, kept, group.

    Words are maximal runs of anything but space and \\x09-\\x0D, A-Z lower-cased; a document is the set of
    its k-word shingles, or its whole sequence if it has fewer words. Two documents are linked if the
    Jaccard similarity of their sets is at least the threshold; component_id is the smallest id that
    links reach, kept tells whether it is the document's own. Documents without words (null, empty,
    blank) have n_shingles 0 and are linked with nothing. Repeated rows and ids each give a row; null ids
    never become a component_id unless a group has no other. Ids may have any type that can be ordered. Other
    columns are dropped; an empty table gives an empty result. A text of any length is one set; a task holds the
    sets of one block, or a single larger one.

    Equal sets are one node from the start. Nodes meet in bands of min-max values (see coarse_pairs()); pairs
    whose sketches agree make coarse groups, and only their texts are fetched for an exact comparison of
    whole sets of 64-bit hashes. See _verified() for groups of any size.
    """
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "minhash-base")
    out, _ = _groups(rows, k, threshold)
    discard(rows)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"), "group")


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each group: that with the smallest id (null last) and, of several rows with
    it, the first in the order they were stored in. Documents without words all stay. All columns stay as they
    are."""
    (row,) = free_names(docs, "_row")
    base = cut(docs.withColumn(row, F.monotonically_increasing_id()), "minhash-base")
    found, tables = _groups(base.select(F.col(row).alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text")), k, threshold)
    found = cut(found.where("group IS NOT NULL").select("row", "doc", "group"), "minhash-found")
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("w")).select(F.col("w.row").alias("row"))
    gone = cut(found.select("row").join(best, "row", "left_anti"), "minhash-gone")
    discard(*tables, found)
    return base.join(gone.withColumnRenamed("row", row), row, "left_anti").select(*docs.columns)
