"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, discard, ship
from lakeloom.llm.words import PLAIN, mix, shingle_hashes, steps, text_bytes, words_of

#: Bits of a fingerprint, the blocks it is cut into and the radius searched. At a similarity of 0.8
#: about 19 of 128 bits differ, with a deviation of 4.
BITS, BLOCKS, RADIUS = 128, 8, 34
#: Items, and bytes of them, that are held against the documents in one pass.
ITEMS, ITEM_BYTES = 20_000, 32 << 20

# Within RADIUS, one of BLOCKS blocks is within RADIUS // BLOCKS.
_WIDTH = BITS // BLOCKS
_MASKS = np.array([sum(1 << i for i in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(_WIDTH), r)], np.uint16)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash: (shingles, BITS)."""
    both = np.stack([shingles, mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    return np.unpackbits(np.ascontiguousarray(both).view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, (windows, BLOCKS) of 16 bits."""
    return np.packbits((sums > 0).astype(np.uint8), axis=1).view(np.uint16)


class ItemIndex:
    """Items: their fingerprints by block, their bags of shingles, and the shingles that items of each size have."""

    def __init__(self, ids: list, texts: list, k: int):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        words = words_of(data, offsets, PLAIN)
        self.ids, n_words, ks, bags, prints = [], [], [], [], []
        for i, a, b in zip(ids, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if a == b or i is None:
                continue
            shingles = shingle_hashes(words.hashes[a:b], k)
            self.ids.append(i), n_words.append(b - a), ks.append(min(k, b - a)), bags.append(np.unique(shingles, return_counts=True))
            prints.append(_pack(_signs(shingles).sum(axis=0, keepdims=True))[0])
        self.n_words, self.k = np.array(n_words, np.int64), np.array(ks, np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(u) for u, _ in bags])]).astype(np.int64)
        cat = lambda j, kind: np.concatenate([bag[j] for bag in bags]) if bags else np.zeros(0, kind)
        self.shingles, self.counts = cat(0, np.uint64), cat(1, np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        # Sizes: the shingles that items of that many words have, whichever they are.
        owner = np.repeat(np.arange(len(bags)), np.diff(self.first))
        self.sizes = {int(n): np.unique(self.shingles[self.n_words[owner] == n]) for n in np.unique(self.n_words)}
        self.every = np.unique(self.shingles)
        self.prints = np.array(prints, np.uint16).reshape(-1, BLOCKS)
        self.order = np.argsort(self.prints, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.prints, self.order, axis=0)

    def within(self, prints: np.ndarray) -> np.ndarray:
        """All items within RADIUS of a fingerprint: those whose value of a block is near its own are tried."""
        tried = []
        for b in range(BLOCKS):
            values = self.sorted[:, b]
            near = _MASKS ^ prints[b]
            a, z = np.searchsorted(values, near), np.searchsorted(values, near, "right")
            for lo, hi in zip(a[z > a].tolist(), z[z > a].tolist(), strict=True):
                tried.append(self.order[lo:hi, b])
        tried = np.unique(np.concatenate(tried)) if tried else np.zeros(0, np.int64)
        return tried[np.bitwise_count(self.prints[tried] ^ prints).sum(axis=1) <= RADIUS]

    def likeness(self, j: int, own: np.ndarray, often: np.ndarray) -> float:
        """Weighted Jaccard similarity of item j and a bag of distinct shingles and their numbers."""
        a, b = self.first[j], self.first[j + 1]
        theirs, counts = self.shingles[a:b], self.counts[a:b]
        at = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
        both = int(np.where(theirs[at] == own, np.minimum(often, counts[at]), 0).sum())
        return both / max(1, int(often.sum()) + int(counts.sum()) - both)

    def find(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[dict]:
        """For each text: {item: the best similarity of a window}."""
        words = words_of(data, offsets, PLAIN)
        found: list[dict] = [{} for _ in range(len(offsets) - 1)]
        for k in np.unique(self.k).tolist():
            if len(words.hashes) < k:
                continue
            every = shingle_hashes(words.hashes, k)
            at = np.flatnonzero(self.seen[(every >> np.uint64(44)).astype(np.int64)])
            at = at[_holds(self.every, every[at])]
            doc = np.searchsorted(words.first, at, "right") - 1
            inside = at + k <= words.first[doc + 1]
            at, doc = at[inside], doc[inside]
            if not len(at):
                continue
            for n in np.unique(self.n_words[self.k == k]).tolist():
                # The fewest hits that a window of this size, or a shorter text, can have.
                least = max(1, int(np.ceil(threshold * (n - k + 1) - 1e-9)))
                some = np.bincount(doc, minlength=len(found)) >= least
                of = at[some[doc]]
                of = of[_holds(self.sizes[n], every[of])]
                owner = np.searchsorted(words.first, of, "right") - 1
                for d in np.flatnonzero(np.bincount(owner, minlength=len(found)) >= least).tolist():
                    a, b = words.first[d], words.first[d + 1]
                    self._windows(n, k, of[owner == d] - a, every[a : b - k + 1], threshold, found[d])
        return found

    def _windows(self, n: int, k: int, places: np.ndarray, shingles: np.ndarray, threshold: float, found: dict) -> None:
        """Windows of n words where items of that size have enough of the shingles, whichever items these are: the
        windows are fingerprinted, the fingerprints within RADIUS looked up, and their items checked."""
        size = n - k + 1
        wide = min(size, len(shingles))
        # The intersection weighs at most the shingles in the window that such items have.
        need = int(np.ceil(threshold / (1 + threshold) * (size + wide) - 1e-9))
        if len(places) < need:
            return
        ahead = places[need - 1 :] - places[: len(places) - need + 1] < wide
        if not ahead.any():
            return
        hit = np.zeros(len(shingles) + 1, np.int32)
        hit[places + 1] = 1
        hit = np.cumsum(hit)
        lo = max(0, int(places[: len(ahead)][ahead][0]) - wide + 1)
        hi = min(len(shingles) - wide, int(places[need - 1 :][ahead][-1]))
        starts = np.arange(lo, hi + 1)
        starts = starts[hit[starts + wide] - hit[starts] >= need]
        at = 0
        while at < len(starts):
            some = starts[at : at + 256]
            some = some[some < some[0] + (1 << 16)]  # a stretch of text at a time
            base = some[0]
            sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_signs(shingles[base : some[-1] + wide]), axis=0, dtype=np.int32)])
            for s, prints in zip(some.tolist(), _pack(sums[some - base + wide] - sums[some - base]), strict=True):
                bag = None
                for j in self.within(prints).tolist():
                    if self.n_words[j] != n:
                        continue
                    bag = bag if bag is not None else np.unique(shingles[s : s + wide], return_counts=True)
                    like = self.likeness(j, *bag)
                    if like >= threshold - 1e-12 and like > found.get(j, 0):
                        found[j] = like
            at += len(some)


def _holds(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    at = np.searchsorted(table, values)
    inside = at < len(table)
    inside[inside] = table[at[inside]] == values[inside]
    return inside


def _search(index, threshold: float, kind: pa.DataType, hits: bool):
    """hits: rows that hold nothing are left out."""

    def run(batches):
        items = index.value
        for batch in batches:
            for part in steps(batch, "text"):
                found = items.find(*text_bytes(part.column("text")), threshold)
                if hits:
                    part, found = part.filter(pa.array([bool(f) for f in found])), [f for f in found if f]
                best = [sorted(((-v, items.ids[j]) for j, v in f.items())) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in part.schema.names if c != "text"],
                        pa.array([sorted(i for _, i in b) for b in best], pa.list_(kind)),
                        pa.array([b[0][1] if b else None for b in best], kind),
                        pa.array([-b[0][0] if b else 0.0 for b in best], pa.float64()),
                    ],
                    [*[c for c in part.schema.names if c != "text"], "item_ids", "best_item", "similarity"],
                )

    return run


class _Blocks:
    """The items in blocks of about ITEMS items and ITEM_BYTES bytes, however many there are. One block's index at a
    time is broadcast, and goes before the next one comes."""

    def __init__(self, benchmark: DataFrame, k: int, item_col: str, item_text_col: str):
        ship(benchmark.sparkSession)
        self.spark, self.k = benchmark.sparkSession, k
        self.items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
        n, size = self.items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        self.n = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))

    def index(self, b: int):
        own = self.items.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.n)) == b).distinct().collect()
        return self.spark.sparkContext.broadcast(ItemIndex([r["item"] for r in own], [r["text"] for r in own], self.k))


def _without(index, text_col: str, threshold: float):
    def run(batches):
        for batch in batches:
            for part in steps(batch, text_col):
                found = index.value.find(*text_bytes(part.column(text_col)), threshold)
                yield part.filter(pa.array([not f for f in found]))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, as find_leaks() sees it, with all of their columns. With several blocks
    of items, what a block leaves is stored before the next one comes."""
    blocks, last = _Blocks(benchmark, k, item_col, item_text_col), None
    for b in range(blocks.n):
        index = blocks.index(b)
        docs = docs.mapInArrow(_without(index, text_col, threshold), docs.schema)
        if b < blocks.n - 1:
            docs = cut(docs, "leaks-left")
            index.destroy()
            if last is not None:
                discard(last)
            last = docs
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Which benchmark items each document holds: id_col, text_hash, item_ids, best_item, similarity, contaminated.

    Words are runs of letters and digits (and anything outside ASCII), A-Z lower-cased. An item of n words
    is in a document if n of its words in a row (all of them, if it has fewer) have a weighted Jaccard
    similarity of at least the threshold with the item, over bags of k-word shingles; an item of fewer
    than k words is one shingle. item_ids are in order; best_item has the greatest similarity and of
    these the smallest id. Ids may be numbers or text. Null texts and texts without words hold nothing; null ids,
    texts without words and repeated rows of the benchmark do no harm; equal items are all reported. Every row of
    `docs` gives one row, repeated ones too. Other columns are dropped. A text of any length is searched whole;
    memory goes with its length.

    A window with that similarity shares most of its shingles with an item of its size, so only windows where items
    of that size have enough are fingerprinted; which item it is, the fingerprints tell. Items go to the
    executors in blocks of a fixed size, one pass over the documents for each block; documents aren't
    shuffled, and with several blocks they are stored first, so that each has one number in all passes.
    """
    blocks = _Blocks(benchmark, k, item_col, item_text_col)
    item = blocks.items.schema["item"].dataType
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("text_hash"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["_id"]
    found_in = f"item_ids array<{item.simpleString()}>, best_item {item.simpleString()}, similarity double"
    arrow = pa.string() if item.simpleString() == "string" else pa.from_numpy_dtype({"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8"}[item.simpleString()])
    if blocks.n == 1:
        out = rows.mapInArrow(_search(blocks.index(0), threshold, arrow, False), f"_id {kind}, text_hash long, _row long, {found_in}")
    else:
        rows, parts = cut(rows, "leaks-rows"), []
        for b in range(blocks.n):
            index = blocks.index(b)
            parts.append(cut(rows.select("_row", "text").mapInArrow(_search(index, threshold, arrow, True), f"_row long, {found_in}"), "leaks-found"))
            index.destroy()
        best = F.min(F.struct((-F.col("similarity")).alias("s"), "best_item"))
        hits = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), best.alias("b"))
        hits = hits.select("_row", "item_ids", F.col("b.best_item").alias("best_item"), (-F.col("b.s")).alias("similarity"))
        out = rows.drop("text").join(hits, "_row", "left").withColumns({"item_ids": F.coalesce("item_ids", F.array().cast(f"array<{item.simpleString()}>")), "similarity": F.coalesce("similarity", F.lit(0.0))})
    return out.select(F.col("_id").alias(id_col), "text_hash", "item_ids", "best_item", "similarity", F.col("best_item").isNotNull().alias("contaminated"))
