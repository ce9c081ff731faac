"""What the operators of this package share: written intermediate tables, let-bindings, components."""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings while a table is written: the shuffle files behind it go once it is there, and batches for Python
#: workers hold a few megabytes, however long the texts are.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
_LOCAL_DEFAULT = "/tmp/checkpoints"
#: White space that separates words: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _LOCAL_DEFAULT
    return found.rstrip("/")


#: Tables that this process has written and not dropped.
_written: set[str] = set()


#: Sessions that are writing tables: how many at this moment, and their settings before.
_busy: dict[int, tuple[int, dict[str, str]]] = {}
_lock = threading.Lock()


@contextlib.contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """``_WRITING`` holds while any thread writes a table of the session; the last one out restores what was before."""
    session = spark._jsparkSession.hashCode()
    with _lock:
        n, before = _busy.get(session) or (0, {k: spark.conf.get(k) for k in _WRITING})
        _busy[session] = n + 1, before
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            n, before = _busy.pop(session)
            if n > 1:
                _busy[session] = n - 1, before
            else:
                for k, v in before.items():
                    spark.conf.set(k, v)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder as a table and returns a scan of it.

    This cuts lineage: a lost executor costs a re-read, not a recomputation, and the shuffle
    files behind the table are released as soon as it is written. ``drop`` removes a table that nothing
    needs any more; what is left goes with ``sweep``, at the latest when the process ends. The tables of an
    application stand in a folder with its id, so that those of a driver that was killed can be told and removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    with _writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written.add(path)
    scan = spark.read.schema(df.schema).parquet(path)
    scan._table = path
    return scan


def drop(*tables: DataFrame) -> None:
    """Removes materialised tables. All that was built on them must have been written itself."""
    for t in tables:
        _remove(t.sparkSession, t._table)


def sweep(spark: SparkSession) -> None:
    """Removes all tables that this process has written; results that were not stored elsewhere are lost."""
    for path in list(_written):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def _sweep_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            sweep(spark)


atexit.register(_sweep_at_exit)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often the body uses it.

    That includes uses within a lambda function, into which the optimiser would put the expression behind a column.
    """
    return F.transform(F.array(value), body)[0]


#: Makes a separator of words a blank and A-Z lower case.
_WORDS = bytes(0x20 if b == 0x20 or 9 <= b <= 13 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def split_words(text: bytes, table: bytes = _WORDS, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, as lists of those in about ``most`` bytes, so that a long text is never held as words whole.

    ``table`` translates each byte first; blanks then separate words.
    """
    begin = 0
    while begin < len(text):
        piece, size = b"", most
        while begin + len(piece) < len(text) and b" " not in piece:  # longer for a word beyond a piece
            piece = text[begin : begin + size].translate(table)
            size *= 2
        if begin + len(piece) < len(text):
            piece = piece[: piece.rfind(b" ") + 1]
        yield piece.split()
        begin += len(piece)


#: Marks a row without an id inside Python workers, where a column of whole numbers with nulls would turn into floats.
NO_ID = "__no_id"


def with_id(df: DataFrame, *others: str) -> DataFrame:
    """``doc_id`` as a long without nulls, whether it was null, and the columns named."""
    own = F.col("doc_id").cast("long")
    return df.select(F.coalesce(own, F.lit(0)).alias("doc_id"), own.isNull().alias(NO_ID), *others)


def null_id(df: DataFrame) -> DataFrame:
    """Undoes ``with_id``."""
    return df.withColumn("doc_id", F.when(~F.col(NO_ID), F.col("doc_id"))).drop(NO_ID)


def free_prefix(columns: Iterable[str]) -> str:
    """What none of the columns' names begins with, for columns of one's own beside them."""
    prefix = "__own"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the input lacks the columns {missing}")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


#: Bits of a screen, at least and at most: 1 to 4096 bitmaps of 4 KB, 16 MB in all.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 27
_MAP_BITS = 1 << 15


def parted(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` may be among the keys of ``wanted(key)``, a written table, and those of which it is not.

    The keys are hashed into a bitmap of about sixteen bits a key and at most ``MOST_BITS``, which is broadcast. The first part
    has all wanted rows, and more of the others the more keys there are, up to all of them. A null key is in the second.
    """
    own = free_prefix(df.columns)
    map_, at, bits, mark = (f"{own}{x}" for x in ("map", "at", "bits", "mark"))
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(size))
    maps = wanted.select(place.alias(at)).groupBy(F.floor(F.col(at) / _MAP_BITS).alias(map_)).agg(F.bitmap_construct_agg(F.col(at) % _MAP_BITS).alias(bits))
    # four bytes of the map, the first of which is the highest, become a number
    four = lambda i: F.conv(F.hex(F.substring(bits, i * 4 + 1, F.lit(4))), 16, 10).cast("long")
    maps = materialize(maps.select(map_, F.transform(F.sequence(F.lit(0), F.lit(_MAP_BITS // 32 - 1)), four).alias(bits)), "screen")
    hit = F.expr(f"shiftright(get({bits}, cast({at} div 32 as int)), cast((3 - {at} % 32 div 8) * 8 + {at} % 8 as int)) & 1L") == 1
    met = df.withColumn(map_, F.floor(place / _MAP_BITS)).withColumn(at, place % _MAP_BITS).join(F.broadcast(maps), map_, "left")
    met = met.withColumn(mark, F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull())
    return met.where(F.col(mark)).select(*df.columns), met.where(~F.col(mark)).select(*df.columns)


def screen(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be wanted, so that few others reach a later join."""
    return parted(df, key, wanted)[0]


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in ``gone(key)``, a written table; only rows that may be are exchanged."""
    maybe, others = parted(df, key, gone)
    return others.unionByName(maybe.join(gone.select(key).distinct(), key, "left_anti").select(*df.columns))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges(src, dst)`` as ``(node, component)``, the smallest node naming each.

    Alternates the large-star and the small-star step, whose work is linear in the edges each
    round and whose rounds grow with the logarithm of the longest chain. Minima are combined on
    the map side; the joins that follow them have a plain exchange on either side, so that a hub
    is split by adaptive execution. A node without an edge is not returned.
    """
    # every state is (a, b) with a > b: b is the smaller neighbour
    both = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
    state = materialize(both.where("a > b").distinct(), label)
    while not _is_star_forest(state):
        for large in (True, False):
            before, state = state, _star(state, label, large)
            drop(before)
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _is_star_forest(state: DataFrame) -> bool:
    """Whether every node but the smaller ends has one edge, and no smaller end has a smaller neighbour."""
    several = state.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    chained = state.join(state.select(F.col("b").alias("a")), "a", "left_semi").select("a")
    return is_empty(several.unionByName(chained))


def _star(state: DataFrame, label: str, large: bool) -> DataFrame:
    """Large star: every larger neighbour of a node is linked to its least neighbour (itself included).
    Small star: every smaller neighbour of a node, and the node, are linked to the least of them."""
    if large:
        near = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            state.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = state.select(F.col("b").alias("u"), F.col("a").alias("v"))
    else:
        near = state.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
    least = materialize(least, f"{label}-least")
    moved = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = materialize(moved.where("a > b").distinct(), label)
    drop(least)
    return out
