"""Session set-up, lineage cuts and size-checked joins shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Most keys that are ever treated as hot; what is broadcast for them is one row per key.
HOT_KEYS = 1024
#: Rows of one key from which it is split off a shuffle join.
HOT_ROWS = 50_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: ``spark.checkpoint.dir`` if the cluster names one, else one made for tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="quillspark-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of ``df`` with a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a columnar table in the shared folder and reads it back.

    Unlike :func:`cut` the copy is compressed and later reads prune its columns, so it suits wide
    tables that carry whole texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, key: str, floor: int = HOT_ROWS, most: int = HOT_KEYS) -> DataFrame:
    """The at most ``most`` values of ``key`` that hold at least ``floor`` rows, as one column ``key``.

    Counts are combined map-side; the result has at most ``most`` rows by construction, which is
    the bound that lets callers broadcast it.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") >= floor).orderBy(F.desc("_rows"), key).limit(most).select(key)


#: Tasks that rows of one hot key are spread over.
SPREAD = 997


def lookup(df: DataFrame, table: DataFrame, key: str, how: str = "left", hot: DataFrame | bool | None = None) -> DataFrame:
    """Joins ``df`` with ``table``, which has one row per ``key``, without sending a hot key to one task.

    Rows of hot keys (see :func:`hot_keys`) meet a broadcast of at most ``HOT_KEYS`` table rows where
    they are and are then spread over the shuffle by their content; all other rows take a shuffle join in the same pass, so ``df`` is
    read once besides the count of its keys. ``how`` is inner, left, left_semi or left_anti.
    Rows with a null key match nothing: they stay for left and left_anti. ``hot`` may be given where it is
    known already; False says that no key is hot.
    """
    if hot is False:
        return df.join(table, key, how)
    hot = hot_keys(df, key) if hot is None else hot
    extra = [c for c in table.columns if c != key]
    packed = table.select(key, F.struct(F.lit(1).alias("_there"), *[F.col(f"`{c}`") for c in extra]).alias("_v"))
    few = hot.join(packed.join(F.broadcast(hot), key, "left_semi"), key, "left").select(F.col(key).alias("_hot"), F.col("_v").alias("_v1"))
    content = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    apart = F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.pmod(content, F.lit(SPREAD)) + 1).otherwise(F.lit(0)).cast("int")
    tagged = df.join(F.broadcast(few), F.col(key) == F.col("_hot"), "left").withColumn("_apart", apart)
    cold = packed.where(F.col(key).isNotNull()).select(F.col(key).alias("_key2"), F.col("_v").alias("_v2"), F.lit(0).alias("_apart2"))
    met = tagged.join(cold, (F.col(key) == F.col("_key2")) & (F.col("_apart") == F.col("_apart2")), "left").withColumn("_v", F.coalesce("_v1", "_v2"))
    own = [F.col(f"`{c}`") for c in df.columns]
    if how == "left_anti":
        return met.where("_v IS NULL").select(*own)
    if how in ("inner", "left_semi"):
        met = met.where("_v IS NOT NULL")
    return met.select(*own) if how == "left_semi" else met.select(*own, *[F.col(f"_v.`{c}`").alias(c) for c in extra])


#: Pairs of a block that one task makes; a larger block is split.
BLOCK_PAIRS = 1_000_000
MOST_SALTS = 512
#: Buckets of keys that are counted before keys are; their numbers are broadcast.
BUCKETS = 65_536


def block_join(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of two tables with many rows a ``key``. Blocks of more than ``BLOCK_PAIRS`` pairs are split among as many
    tasks as it takes (by the hash of the left column ``by``), for at most ``HOT_KEYS`` keys: the largest ones."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket")
    sides = lambda c: left.where(F.col(key).isNotNull()).select(c, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.where(F.col(key).isNotNull()).select(c, F.lit(0).alias("a"), F.lit(1).alias("b")))
    pairs = (F.sum("a") * F.sum("b")).alias("n")
    # Counted by bucket first, which shuffles a bounded number of rows a task: no key has more pairs than its bucket.
    full = cut(sides(bucket).groupBy("_bucket").agg(pairs).where(F.col("n") > BLOCK_PAIRS).select("_bucket"))
    if full.isEmpty():
        return left.join(right, key)
    inside = lambda d: d.withColumn("_bucket", bucket).join(F.broadcast(full), "_bucket", "left_semi")
    sizes = inside(sides(F.col(key))).groupBy(key).agg(pairs).where(F.col("n") > BLOCK_PAIRS)
    big = cut(sizes.orderBy(F.desc("n")).limit(HOT_KEYS).select(key, F.least(F.ceil(F.col("n") / BLOCK_PAIRS), F.lit(MOST_SALTS)).cast("int").alias("_salts")))
    if big.isEmpty():
        return left.join(right, key)
    salts = F.coalesce("_salts", F.lit(1))
    a = left.join(F.broadcast(big), key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    b = right.join(F.broadcast(big), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return a.join(b, [key, "_salt"]).drop("_salt")


def hash_uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A reproducible uniform number in (0, 1) from the values of ``cols``."""
    bits = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(bits, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
