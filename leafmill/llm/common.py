"""What several operators share: word expressions, the shared folder, file access from executors."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that white space of ASCII parts.
SPACE = r"[\x20\x09-\x0D]+"
#: All that is no ASCII letter or digit and below U+0080.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, at: str = SPACE) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), at), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it within a lambda."""
    return F.transform(F.array(value), body)[0]


def doc_words(text: Column) -> Column:
    """The benchmark and licence tokenisation: A-Z lower-cased, words of ASCII alphanumerics and all non-ASCII."""
    return split_words(lower_ascii(text), NOT_WORD)


#: Words of a stretch, its surroundings aside.
STRETCH = 256


def stretches(words: Column, before: int, after: int, size: int = STRETCH) -> Column:
    """An array of structs that together hold the words: first (place of the stretch's first word), base (place of the first word in w) and w, the stretch's `size` words with up to `before` words and `after` words around it. Without words there is one empty stretch. What is exploded further carries a stretch along, never a whole text, so work stays in proportion to the text."""

    def cut_at(w: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size))
        base = lambda f: F.greatest(f - before, F.lit(0))
        return F.transform(firsts, lambda f: F.struct(f.alias("first"), base(f).alias("base"), F.slice(w, base(f) + 1, f - base(f) + size + after).alias("w")))

    return let(words, cut_at)


def runs_of(stretch: Column, k: int, size: int = STRETCH) -> Column:
    """Hashes of the runs of k words that begin within a stretch, in order."""
    w, start = stretch["w"], stretch["first"] - stretch["base"]
    end = F.least(start + size, F.size(w) - k + 1) - 1
    made = F.transform(F.sequence(start, end), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(end >= start, made).otherwise(F.expr("array()").cast("array<bigint>"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder, as a URI, that driver and executors share: under spark.checkpoint.dir, or where that is unset (tests on one machine) under the warehouse."""
    base = checkpoint_base(spark)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def checkpoint_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; set to a folder beside the warehouse where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not base:
        home = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        base = f"{home}-checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there: lineage ends, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.cut_path = path
    return made


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote, once all that reads them has been written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of numbers that are broadcast at most: some 50 bytes each, so 50 MB.
BROADCAST = 1_000_000
SALTS = 16


def meet(big: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner", most: int = BROADCAST) -> DataFrame:
    """big joined with small, which is in the shared folder and holds a few numbers a row, one row for each key or few. It is counted and broadcast up to `most` rows. Beyond, both are shuffled, and small goes out under SALTS numbers, by one of which (dealt by the column `spread`) each row of big meets it: so a key with a third of all rows is SALTS smaller ones."""
    if small.count() <= most:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return big.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"], how).drop("salt")


def free(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more. The driver's collector finds that out, and only then are executors told, so it takes a second round."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def filesystem(uri: str):
    """pyarrow's file system and the path in it, for file:, hdfs:, s3: and gs: folders."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_once(uri: str, name: str, write) -> str:
    """A new file in the folder at uri that write(stream) fills; its name holds a fresh id, so that a retried or speculative task never touches another attempt's file, and it is moved into place when whole. Returns its name."""
    system, folder = filesystem(uri)
    system.create_dir(folder, recursive=True)
    name = f"{name}-{uuid.uuid4().hex[:16]}"
    part = f"{folder}/_{name}.part"
    with system.open_output_stream(part) as out:
        write(out)
    system.move(part, f"{folder}/{name}")
    return name


