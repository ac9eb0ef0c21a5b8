"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, discard, free_names, ranked, skew_join, spread_join, uniform

WORD = r"[^\x20\x09-\x0D]+"
#: A probability this near to 0 or 1 counts as integral.
EPS = 1e-9
#: Documents of a source, about, that may be taken once more or less to make up for what rounding missed.
POOL = 96
#: Documents of more than a 32nd of their source are rounded first, then those of more than a 1024th, then the others.
STEP, STEPS = 32, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(items: DataFrame, weights: Sequence[float], cap: float, budget: float | None = None) -> DataFrame:
    """(source, source_size, n_docs, target) of items (source, size).

    Sources take the weights in turn, by code point, null last. Together they get the budget (all
    sizes, if None); no target goes above `cap` times its source's size, and what is cut off is
    shared by weight among the others until none is above. The driver reads three sums a round,
    however many sources there are.
    """
    sources = cut(items.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "mix-sources")
    n = sources.count()
    # A rank over ranges of the ordered sources: a range's rows are counted, then numbered inside it.
    parts = max(1, n // 100_000)
    order = [F.col("source").isNull(), F.col("source")]
    ranged = cut(sources.repartitionByRange(parts, *[c.asc() for c in order]).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    number = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = cut(ranged.join(F.broadcast(starts.drop("_n")), "_part").withColumn("weight", F.element_at(turn, (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))).drop("_part", "_start"), "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    budget = float(total) if budget is None else min(float(budget), cap * total)
    level, full = 0.0, -1
    limit = cap * F.col("source_size")
    while True:
        above = F.lit(level) * F.col("weight") >= limit if full >= 0 else F.lit(False)
        now, held, rest = weighed.agg(F.sum(above.cast("long")), F.sum(F.when(above, limit).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if not rest or now == full:
            break
        level, full = (budget - held) / rest, now
    target = F.least(limit, F.lit(level) * F.col("weight")) if full >= 0 else F.lit(0.0)
    discard(sources, ranged)
    return weighed.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _fold(rows: Column) -> Column:
    """Pivotal rounding along an array of (size, id, p, u), in order of size.

    A residual walks through the array. It and the next element exchange words until one of their
    two probabilities is 0 or 1; which of both ends is reached is drawn with the probabilities that
    leave the expectation as it was, so p * size summed over both never changes. The element that
    became integral goes to `done`, the other walks on. Returns (id, size, p, done).
    """

    def step(acc, x):
        # Words that may pass from the residual to x and back until one p is 0 or 1.
        out = F.least(acc.p * acc.size, (1 - x.p) * x.size)
        back = F.least((1 - acc.p) * acc.size, x.p * x.size)
        give = x.u * (out + back) < back  # drawn with the chance that keeps the mean
        move = F.when(give, out).otherwise(-back)
        pa, px = acc.p - move / acc.size, x.p + move / x.size
        a_done = (pa <= EPS) | (pa >= 1 - EPS)
        x_done = (px <= EPS) | (px >= 1 - EPS)
        up = lambda p: (p >= 0.5).cast("int")
        keep_x = a_done & ~x_done
        both = a_done & x_done
        first = acc.id.isNull()
        gone = (
            F.when(first, F.array().cast("array<struct<id:string,up:int>>"))
            .when(both, F.array(F.struct(acc.id.alias("id"), up(pa).alias("up")), F.struct(x.id.alias("id"), up(px).alias("up"))))
            .when(a_done, F.array(F.struct(acc.id.alias("id"), up(pa).alias("up"))))
            .otherwise(F.array(F.struct(x.id.alias("id"), up(px).alias("up"))))
        )
        none = F.lit(None)
        return F.struct(
            F.when(first | keep_x, x.id).when(both, none.cast("string")).otherwise(acc.id).alias("id"),
            F.when(first | keep_x, x.size).when(both, none.cast("double")).otherwise(acc.size).alias("size"),
            F.when(first, x.p).when(keep_x, px).when(both, none.cast("double")).otherwise(pa).alias("p"),
            F.concat(acc.done, gone).alias("done"),
        )

    start = F.expr("named_struct('id', cast(null as string), 'size', cast(null as double), 'p', cast(null as double), 'done', cast(array() as array<struct<id:string,up:int>>))")
    return F.aggregate(rows, start, step)


def _mend(rows: Column, want: Column, cap: int) -> Column:
    """Changes (id, delta) of the copies of a few drawn documents, (class, hash, id, size, base, up) in order, that bring a
    source within less than a document of what it wants more (or less, below 0).

    First those that were rounded down (or up) are rounded the other way, large ones before small ones and in
    random order among those of a size class, as long as that doesn't overshoot. Where more than a document of mean
    size is missed after that, because one large document is most of a source, whole copies follow, from none to
    `cap` of each. What is wanted is as often too much as too little, so chances stay about what they were.
    """
    less, more = lambda w, x: -w + EPS >= x.size, lambda w, x: (w + EPS >= x.size) & (x.base < cap)
    add = lambda acc, x, up: F.struct((acc.want - (up - x.up) * x.size).alias("want"), F.concat(acc.done, F.array(F.struct(x.id.alias("id"), x.size.alias("size"), x.base.alias("base"), x.up.alias("was"), up.cast("int").alias("up")))).alias("done"))
    again = lambda acc, x, up: F.struct((acc.want - (up - x.up) * x.size).alias("want"), F.concat(acc.done, F.array(F.struct(x.id.alias("id"), (up - x.was).cast("int").alias("delta")))).alias("done"))

    def flip(acc, x):
        return add(acc, x, F.when((x.up == 0) & more(acc.want, x), 1).when((x.up == 1) & less(acc.want, x), 0).otherwise(x.up))

    def whole(acc, x):
        n = F.greatest(-(x.base + x.up), F.least(cap - x.base - x.up, F.round(acc.want / x.size).cast("int")))
        return again(acc, x, x.up + F.when(far, n).otherwise(0))

    none = lambda kind: F.expr(f"cast(array() as array<struct<{kind}>>)").alias("done")
    flipped = F.aggregate(rows, F.struct(want.alias("want"), none("id:string,size:double,base:int,was:int,up:int")), flip)
    far = F.abs(flipped["want"]) * F.size(rows) > F.aggregate(rows, F.lit(0.0), lambda a, x: a + x.size)
    done = F.aggregate(flipped["done"], F.struct(flipped["want"].alias("want"), none("id:string,delta:int")), whole, lambda acc: acc.done)
    return F.filter(done, lambda x: x.delta != 0)


def round_copies(items: DataFrame, block: int = 32, seed: int = 0) -> DataFrame:
    """Fractions of copies of items (id, source, size, rate, count), rounded: (id, up), up 0 or 1, of those
    whose rate isn't whole. count: about how many items the source has here.

    A source's fractions are rounded in blocks of about `block` items, drawn by hash. What a block can't round is one
    item, which goes up a level of the tree, where `block` times fewer items stand; the last one of a source goes
    up or down by its chance. So each step but that one keeps what a source takes as it was, and all keep every item's
    mean. Blocks are made of small rows (size, id, p), however large a source is.
    """
    frac = F.col("rate") - F.floor("rate")
    todo = items.where((F.col("size") > 0) & (frac > EPS) & (frac < 1 - EPS))
    todo = todo.select("id", "source", F.col("size").cast("double").alias("size"), frac.alias("p"), F.col("count").cast("double").alias("left"))
    done, level = [], 0
    while True:
        blocks = F.greatest(F.lit(1.0), F.ceil(F.col("left") / block))
        key = F.pmod(F.xxhash64("id", F.lit(seed + 17 * level)), blocks.cast("long"))
        row = F.struct("size", F.xxhash64("id", F.lit(seed)).alias("h"), "id", "p", uniform(F.col("id"), seed=seed + 31 * level + 1).alias("u"))
        folded = todo.groupBy("source", key.alias("_block"), blocks.alias("left")).agg(_fold(F.array_sort(F.collect_list(row))).alias("r"))
        folded = cut(folded.select("source", "left", "r"), f"mix-level{level}")
        done.append(folded.select(F.inline("r.done")))
        todo = folded.where("r.id IS NOT NULL").select("r.id", "source", "r.size", "r.p", "left")
        level += 1
        if todo.where("left > 1").limit(1).count() == 0:
            break
    last = todo.select("id", (uniform(F.col("id"), seed=seed - 2) < F.col("p")).cast("int").alias("up"))
    return reduce(DataFrame.unionByName, [*done, last])


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """How many copies of each document a mix takes: id_col, occ, source, size, source_size,
    target, rate, copies.

    Sizes are words (maximal runs of anything but space and \\x09-\\x0D), of whole texts however long. Null and empty
    texts have size 0 and take part with floor(rate) copies, which add nothing. A null source is a source of
    its own and the last. Rows that are equal in id, source and text, with null ids too, are told apart by `occ`,
    counted from 0; they may change places. Nothing but hashes of these is drawn from, so reruns agree. An
    empty table gives an empty result; other columns are dropped.

    Copies are rounded by pivotal steps in a tree (round_copies()); about POOL documents of each source then make up
    for the one that was left over (_mend()).
    """
    rows = numbered(cut(sized_rows(docs, id_col, text_col, source_col), "mix-rows"))
    return _mixed(rows, weights, cap, budget, seed).select(F.col("_id").alias(id_col), "occ", "source", "size", "source_size", "target", "rate", "copies")


def _mixed(rows: DataFrame, weights: Sequence[float], cap: float, budget: float | None, seed: int) -> DataFrame:
    """The rows with source_size, target, rate and copies.

    Large documents are rounded first. What they take more or less than their part changes the rate of the smaller
    ones, which are rounded next: the mean of each stays as it was, and what is missed at last is the last
    small document's.
    """
    targets = source_targets(rows, weights, cap, budget)
    n_sources, n_bytes = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    # A key that is never null.
    keyed = lambda df: df.withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    meet = lambda df, small: spread_join(df, small, "source", F.col("row"), n_sources, "inner", size=n_bytes)
    size = F.col("size")
    step = sum(((size * STEP**k <= F.col("source_size")).cast("int") for k in range(1, STEPS)), F.lit(0))
    known = cut(meet(keyed(rows.withColumn("_source", F.col("source"))), keyed(targets)).withColumn("id", F.concat_ws("#", "hash", "occ")).withColumn("step", step), "mix-known")
    there = {r["step"] for r in known.select("step").distinct().collect()}
    state = keyed(targets).select("source", F.col("target").alias("want"), F.col("source_size").cast("double").alias("mass"))
    drawn = []
    for k in sorted(there):
        rate = F.when(F.col("mass") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.col("want") / F.col("mass")))).otherwise(0.0)
        own = meet(known.where(F.col("step") == k), state).withColumn("rate", rate).drop("want", "mass").withColumn("count", F.least(F.col("n_docs"), F.lit(STEP ** (k + 1) if k < STEPS - 1 else 2**62)))
        frac = F.col("rate") - F.floor("rate")
        own = own.join(round_copies(own, seed=seed + 101 * k), "id", "left").withColumn("base", F.floor("rate").cast("int")).withColumn("up", F.coalesce("up", (frac >= 1 - EPS).cast("int")))
        own = cut(own, f"mix-drawn{k}")
        drawn.append(own)
        spent = own.groupBy("source").agg(F.sum((F.col("base") + F.col("up")) * size).alias("spent"), F.sum("size").alias("gone"))
        state = cut(state.join(spent, "source", "left").select("source", (F.col("want") - F.coalesce("spent", F.lit(0))).alias("want"), (F.col("mass") - F.coalesce("gone", F.lit(0))).alias("mass")), f"mix-state{k}")
    if not drawn:
        return known.withColumns({"source": F.col("_source"), "rate": F.lit(0.0), "copies": F.lit(0).cast("long")})
    every = reduce(DataFrame.unionByName, drawn)
    pool = every.where((size > 0) & (uniform(F.col("id"), seed=seed - 1) * F.col("n_docs") < POOL))
    row = F.struct((-F.floor(F.log2("size"))).alias("class"), F.xxhash64("id", F.lit(seed - 3)).alias("h"), "id", size.cast("double").alias("size"), "base", "up")
    pool = pool.groupBy("source").agg(F.array_sort(F.collect_list(row)).alias("rows")).join(state, "source")
    mends = cut(pool.select(F.inline(_mend(F.col("rows"), F.col("want"), int(cap)))), "mix-mends")
    out = spread_join(every, mends, "id", F.col("row"), mends.count(), salts=1)
    first = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return out.withColumns({"source": F.col("_source"), "rate": first, "copies": (F.col("base") + F.col("up") + F.coalesce("delta", F.lit(0))).cast("long")})


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: Column | None = None) -> DataFrame:
    """Small rows (row, _id, hash, source, size) of the documents; no text is shuffled. hash: of id, source and text."""
    row = F.monotonically_increasing_id() if row is None else row
    hashed = F.xxhash64(F.col(id_col).cast("string"), F.col(id_col).isNull(), F.col(source_col), F.col(source_col).isNull(), F.col(text_col), F.col(text_col).isNull())
    return docs.select(row.alias("row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), hashed.alias("hash"))


def numbered(rows: DataFrame) -> DataFrame:
    """Stored rows with `occ`, counted from 0 among those of one hash. One hash may have any share of the rows."""
    n = rows.count()
    again = cut(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1"), "mix-again")
    if not again.limit(1).count():
        return rows.withColumn("occ", F.lit(0).cast("long"))
    known = cut(skew_join(rows, again, "hash", n, "left"), "mix-known")
    discard(again)
    several = known.where("_m IS NOT NULL").drop("_m")
    several = ranked(several, "hash", [F.col("row")], several.count(), F.col("row"), name="occ")
    return known.where("_m IS NULL").drop("_m").withColumn("occ", F.lit(0).cast("long")).unionByName(several)


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all of its columns.

    Texts are stored with a number of their own and move once, by that number, to meet their copies, so no id, text
    or source is a hot key; see mix_sources() for odd rows.
    """
    own, n, again = free_names(docs, "_row", "_n", "_again")
    base = cut(docs.withColumn(own, F.monotonically_increasing_id()), "mix-base")
    rows = numbered(cut(sized_rows(base, id_col, text_col, source_col, F.col(own)), "mix-rows"))
    taken = cut(_mixed(rows, weights, cap, budget, seed).where("copies > 0").select(F.col("row").alias(own), F.col("copies").alias(n)), "mix-taken")
    return base.join(taken, own).withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)
