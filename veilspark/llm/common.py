"""Written tables in the cluster's shared folder, and column helpers that several operators use."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where that is unset, and on one machine, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-veil-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/veil-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, once nothing that is still to be computed reads it."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def others(df: DataFrame, own: list[str]) -> list[Column]:
    """df's columns but those with a name (in any case) that the operator's own columns take."""
    taken = {c.lower() for c in own}
    return [df[c] for c in df.columns if c.lower() not in taken]


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with so many underscores before it that no taken column (in any case) has it."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


#: A bitmap of hashes has so many bits (as a power of 2): 8 MB; for more hashes more, up to 128 MB.
MAP_BITS, MOST_MAP_BITS = 26, 30


def map_bits(n: int) -> int:
    """Bits (as a power of 2) of a bitmap of n hashes: 16 a hash, within the bounds."""
    return min(MOST_MAP_BITS, max(MAP_BITS, (16 * n).bit_length()))


def bitmap(hashes: DataFrame, column: str, bits: int = MAP_BITS) -> np.ndarray:
    """A bitmap of the highest bits of 64-bit hashes: tells which hashes can't be among them."""
    place = F.shiftrightunsigned(column, 64 - bits)
    bit = F.expr(f"shiftleft(1L, int(shiftrightunsigned({column}, {64 - bits}) & 63))")
    words = hashes.groupBy(F.shiftrightunsigned(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most 2 ** (bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def may_have(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the hashes may be among those of the bitmap."""
    at = h >> np.uint64(64 - len(bits).bit_length() + 1 - 6)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo: a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus == remainder
