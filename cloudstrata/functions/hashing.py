"""64-bit hashes with wraparound, safe under ANSI arithmetic."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudstrata.functions.numbering import placed
from cloudstrata.session import cut

#: Fixed values of the spatial hash: multipliers of the three coordinates and of the two mixing steps.
COORDINATES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
MIXERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SHIFTS = (30, 27, 31)


def signed(v: int) -> int:
    """The signed number with the bits of an unsigned one."""
    v &= (1 << 64) - 1
    return v - (1 << 64) if v >> 63 else v


def _times(df: DataFrame, column: str, factor: int) -> DataFrame:
    """column * factor modulo 2^64, by 16-bit limbs, so nothing overflows."""
    b = [factor >> s & 0xFFFF for s in (0, 16, 32, 48)]
    a = [f"__a{k}" for k in range(4)]
    keep = [c for c in df.columns if c != column]
    df = df.select(*keep, *[F.shiftrightunsigned(column, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")).alias(a[k]) for k in range(4)])
    sums = [sum((F.col(a[i]) * F.lit(b[k - i]).cast("long") for i in range(1, k + 1)), F.col(a[0]) * F.lit(b[k]).cast("long")).alias(f"__c{k}") for k in range(4)]
    df = df.select(*keep, *sums)
    for k in range(3):
        df = df.withColumn(f"__c{k + 1}", F.col(f"__c{k + 1}") + F.shiftrightunsigned(f"__c{k}", 16))
    low = [F.shiftleft(F.col(f"__c{k}").bitwiseAND(F.lit(0xFFFF).cast("long")), 16 * k) for k in range(4)]
    return df.select(*keep, low[0].bitwiseOR(low[1]).bitwiseOR(low[2]).bitwiseOR(low[3]).alias(column))


def spatial_hash(points: DataFrame, seed: int, out: str = "score") -> DataFrame:
    """Adds the unsigned 64-bit hash of raw_x, raw_y, raw_z and a seed, as a BIGINT with the same bits."""
    parts = [f"__h{k}" for k in range(3)]
    df = points.withColumns({p: F.col(f"raw_{a}").cast("long") for p, a in zip(parts, "xyz", strict=True)})
    for p, factor in zip(parts, COORDINATES, strict=True):
        df = _times(df, p, factor)
    df = df.withColumn(out, F.col(parts[0]).bitwiseXOR(F.col(parts[1])).bitwiseXOR(F.col(parts[2])).bitwiseXOR(F.lit(signed(seed)).cast("long"))).drop(*parts)
    for shift, factor in zip(SHIFTS, (*MIXERS, None), strict=True):
        df = df.withColumn(out, F.col(out).bitwiseXOR(F.shiftrightunsigned(out, shift)))
        if factor is not None:
            df = _times(df, out, factor)
    # a generator keeps filters on the hash from being pushed into its steps, where each would repeat those before it
    return df.select(*[c for c in df.columns if c != out], F.inline(F.array(F.struct(F.col(out).alias(out)))))


def unsigned_order(column: Column) -> Column:
    """A BIGINT whose signed order is the unsigned order of the bits."""
    return column.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def little_endian(column: Column) -> Column:
    """The eight bytes of a BIGINT, least first, as hexadecimal digits."""
    digits = F.lpad(F.hex(column.cast("long")), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)])


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    after, before = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    unequal = pc.fill_null(pc.not_equal(after, before), False).to_numpy(zero_copy_only=False)
    return unequal | (after.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))


def membership_id(rows: DataFrame, group: list[str], identity: Column, row_col: str = "row_id") -> DataFrame:
    """candidate_ and 24 digits of the SHA-256 over the source's identity and the group's distinct rows in order, eight bytes each, least first.

    Rows are sorted by group within partitions and the digest is fed as they stream by, so a
    group of any size takes the memory of a batch; a digest in order is one task's work. A group's identity is its least.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*group).schema}
    numbered = rows.select(*group, F.col(row_col).cast("long").alias("__row"), identity.cast("string").alias("__identity"))
    first = numbered.groupBy(*group).agg(F.min("__identity").alias("__identity"))
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group]
    together = numbered.alias("r").join(first.alias("f"), same).select(*[F.col(f"r.{g}").alias(g) for g in group], F.col("r.__row").alias("__row"), F.col("f.__identity").alias("__identity")).filter("__row is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, count, last, held = None, 0, None, None

        def out() -> pa.RecordBatch:
            values = [held.column(k) for k in range(len(group))]
            return pa.RecordBatch.from_arrays([*values, pa.array([f"candidate_{digest.hexdigest()[:24]}"]), pa.array([count], pa.int32())], names=[*group, "candidate_id", "point_count"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(len(group)).to_numpy()
            new = np.zeros(batch.num_rows, bool)
            if held is not None:
                joined = [pa.concat_arrays([held.column(k), batch.column(k).slice(0, 1)]) for k in range(len(group))]
                new[0] = any(_changes(c)[0] for c in joined)
            for k in range(len(group)):
                new[1:] |= _changes(batch.column(k))
            starts = np.flatnonzero(new).tolist()
            for begin, end in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if begin == end:
                    continue
                if held is None or new[begin]:
                    if held is not None:
                        yield out()
                    held, count, last = batch.slice(begin, 1), 0, None
                    digest = hashlib.sha256((batch.column(len(group) + 1)[begin].as_py() or "").encode())
                run_rows = own[begin:end]
                fresh = np.concatenate([[last is None or run_rows[0] != last], run_rows[1:] != run_rows[:-1]])
                digest.update(run_rows[fresh].astype("<i8").tobytes())
                count, last = count + int(fresh.sum()), run_rows[-1]
        if held is not None:
            yield out()

    return together.repartition(*group).sortWithinPartitions(*group, "__row").mapInArrow(run, ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "candidate_id string, point_count int"]))


#: Rows of a leaf, and digests of a node, of the trees below.
LEAF, FAN = 50_000, 1024


def merkle_root(leaves: DataFrame) -> str | None:
    """The root over digests (hexadecimal) in the order of leaf: each node is the SHA-256 of the digests of FAN below it, level by level, so no task has them all. None without leaves."""
    level = cut(leaves.select(F.col("leaf").cast("long").alias("leaf"), "digest"), "merkle")
    while True:
        n = level.count()
        if n <= 1:
            return level.first()["digest"] if n else None
        nodes = level.groupBy(F.floor(F.col("leaf") / FAN).alias("leaf")).agg(F.sort_array(F.collect_list(F.struct("leaf", "digest"))).alias("d"))
        level = cut(nodes.select("leaf", F.sha2(F.unhex(F.array_join(F.transform("d", lambda v: v["digest"]), "")), 256).alias("digest")), "merkle")


def table_digest(rows: DataFrame, order: list[str], columns: list[str]) -> str | None:
    """A digest of rows in an order that tells them apart: it changes with a value, a null, a row or the order, and not with partitions."""
    numbered = placed(rows.select(*dict.fromkeys([*order, *columns])), order, "__place")
    own = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    by_leaf = numbered.groupBy(F.floor(F.col("__place") / LEAF).alias("leaf")).agg(F.sort_array(F.collect_list(F.struct("__place", own.alias("h")))).alias("d"))  # LEAF digests
    return merkle_root(by_leaf.select("leaf", F.sha2(F.unhex(F.array_join(F.transform("d", lambda v: v["h"]), "")), 256).alias("digest")))


def content_key(value: object) -> str:
    """The name of a cached result: SHA-256 over canonical JSON of everything it depends on."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
