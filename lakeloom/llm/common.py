"""What the operators share: shared scratch tables, salted joins, distributed ranks, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import lakeloom

#: A side with at most this many rows and bytes is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
#: A key with more than this share of the rows, and more than this many, is joined apart from the others.
HOT_SHARE, HOT_ROWS = 1000, 4096
#: Any number that a long holds is halved away in as many steps.
DOUBLINGS = 64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_own: dict[str, str] = {}
_folders: set[str] = set()
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a
    temporary folder of its own; a cluster has no folder that can be taken for shared, so it is an error there."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = tempfile.mkdtemp(prefix="lakeloom-")
        atexit.register(shutil.rmtree, path, True)
        _own[app] = f"file://{path}"
    return _own[app]


def _folder(spark: SparkSession) -> str:
    """This application's part of the shared folder. It goes when the driver's process ends."""
    app = spark.sparkContext.applicationId
    path = f"{scratch(spark)}/lakeloom/{app}"
    if app not in _folders:
        _folders.add(app)
        atexit.register(_delete, spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), path)
    return path


def _delete(jvm, conf, path: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001  at the end of the process the JVM may be gone before
        return


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a session: they may not have it on their path."""
    sc, package = spark.sparkContext, Path(lakeloom.__file__).parent
    if sc.applicationId in _shipped or not package.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="lakeloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/lakeloom-code.zip", "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, f"lakeloom/{file.relative_to(package)}")
    sc.addPyFile(f"{folder}/lakeloom-code.zip")
    _shipped.add(sc.applicationId)


def fresh(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage ends there,
    and the loss of an executor costs no more than the tasks that ran on it. Nothing needs the shuffle files
    that led to it any more, so Spark deletes them at once."""
    path, conf = fresh(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lakeloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_lakeloom_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def literal_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table of constants that never passes through Python on an executor."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(ddl)
    item = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in schema.fields]) for r in rows]
    one = spark.range(1).select(F.inline(F.array(*item)) if item else F.inline(F.expr(f"cast(array() as array<{schema.simpleString()}>)")))
    return one


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11) / F.lit(float(1 << 53))


def spread_join(big: DataFrame, small: DataFrame, on: str, salt_by: Column, rows: int, how: str = "left", salts: int = 64, size: int = 0) -> DataFrame:
    """Join a side with unique keys, of `rows` rows and `size` bytes (0: rows of a few numbers), to one
    where a key may hold most rows.

    Few rows and bytes are broadcast. More are copied once per salt, so that a hot key of the other
    side is dealt over `salts` tasks.
    """
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).join(small, [on, "_salt"], how).drop("_salt")


def skew_join(big: DataFrame, small: DataFrame, on: str | list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join a side with unique keys to one of `rows` rows where a key may hold most of them.

    Keys of more than a thousandth of the rows, a thousand at most, are counted out and meet a broadcast of their
    rows of `small`, without a shuffle; the others meet in one. Both sides should be stored tables, since
    `big` is read three times.
    """
    on = [on] if isinstance(on, str) else on
    hot = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(HOT_ROWS, rows // HOT_SHARE)).drop("_n")
    apart = F.broadcast(small.join(F.broadcast(hot), on, "left_semi"))
    if how == "left":
        apart = F.broadcast(hot.join(small, on, "left"))
    return big.join(F.broadcast(hot), on, "left_anti").join(small, on, how).unionByName(big.join(apart, on))


def ranked(df: DataFrame, key: str, order: list[Column], rows: int, spread: Column, block: int = 20_000, name: str = "rank") -> DataFrame:
    """A gapless rank from 0 within `key`, in order of (block, order).

    A key may hold any number of rows: they are dealt by the hash `spread` over blocks of about
    `block` rows, ranked there, and moved up by the rows of the blocks before theirs.
    """
    blocks = max(1, -(-rows // block))
    df = df.withColumn("_block", F.pmod(F.xxhash64(spread), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    return (
        df.withColumn("_in", F.row_number().over(inside) - 1)
        .join(starts, [key, "_block"])
        .withColumn(name, (F.col("_start") + F.col("_in")).cast("long"))
        .drop("_start", "_in", "_block")
    )


def _roots(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of the nodes of edges (a, b) with a < b: each hangs on its smallest neighbour if that
    is smaller than itself, and the root is where that leads."""
    hung = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).union(edges.select("a", F.col("a").alias("to")))
    up = cut(hung.groupBy("node").agg(F.min("to").alias("root")), f"{name}-0")
    nodes = up.count()
    for k in range(1, DOUBLINGS + 1):
        new = cut(skew_join(up.select("node", "root"), up.toDF("root", "_root"), "root", nodes).select("node", F.col("_root").alias("root"), (F.col("_root") != F.col("root")).alias("changed")), f"{name}-{k}")
        discard(up)
        changed = new.where("changed").limit(1).count()
        up = new.select("node", "root")
        up._lakeloom_path = new._lakeloom_path
        if not changed:
            return up
    raise RuntimeError(f"{name}: roots still change after {DOUBLINGS} doublings")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): a table (node, component), the smallest node of each.

    Each round hangs every node on its smallest neighbour, follows these links to the root by doubling,
    and goes on with the edges between roots until there are none. A root that no smaller one is next
    to has one beneath it after the round or hangs on another after the next one, so two rounds halve
    the roots at least, whatever the shape and the order of ids. Tables are in the shared folder; the
    driver only reads whether anything is left. A node that has an edge to itself only isn't given.
    """
    between = lambda a, b, df: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    left = cut(between("a", "b", edges), f"{name}-edges")
    labels = None
    for k in range(2 * DOUBLINGS):
        up, n = _roots(left, f"{name}-{k}"), left.count()
        if labels is None:
            labels, nodes = up.toDF("node", "component"), up.count()
            labels._lakeloom_path = up._lakeloom_path
        else:
            old, labels = labels, cut(skew_join(labels, up.toDF("component", "_root"), "component", nodes, "left").select("node", F.coalesce("_root", "component").alias("component")), f"{name}-labels{k}")
        half = cut(skew_join(left, up.toDF("a", "_a"), "a", n).select("_a", "b"), f"{name}-half{k}")
        new = cut(between("_a", "_b", skew_join(half, up.toDF("b", "_b"), "b", n)), f"{name}-edges{k}")
        discard(half)
        discard(left, *([old, up] if k else []))
        left = new
        if not left.limit(1).count():
            discard(left)
            return labels
    raise RuntimeError(f"{name}: components still meet after {2 * DOUBLINGS} rounds")
