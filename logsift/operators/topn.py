"""Exact top-N of a grouped aggregate without shuffling every group: three-phase uniform threshold.

A plain ``groupBy`` sends every distinct key of every task through the shuffle,
though a report keeps twenty.  Here tasks first fold their own rows (no
shuffle) into a *partial table*: a row per task and key, sorted by the measure, in
the shared checkpoint folder.  Then, over that table:

1. every task's first N keys are sent; the N-th largest of their sums, ``t1``,
   is a lower bound of the N-th result;
2. every key that some task holds with at least ``t1 / tasks`` is sent too (a
   filter that the sorted files' statistics prune); a key that isn't sent at all
   sums to less than ``t1``.  A key's sum so far is its lower bound; its upper bound
   adds what tasks that didn't send it may hold.  ``t2`` is the N-th largest lower
   bound, and a key whose upper bound is below ``t2`` can't be among the N;
3. the rows of the surviving keys are aggregated in full.

Ties are exact: a key that could tie with the N-th survives.  A negative measure
would void the bounds; a partial table that has one is aggregated in full.  Sums
beyond bigint are NULL and rank first, as everywhere in the library.
"""

from __future__ import annotations

import sys
import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import split_requester
from ..functions.common import fmt_ts, top_n
from ..session import checkpoint_dir

FOLD_GROUPS = 1 << 20     # groups a task holds; beyond that it writes them and begins anew, as another task would
_MOST = (1 << 63) - 1
# functions that run in tasks travel by value, so executors need no installed copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _fold(rows: pa.Table, keys: list[str], how: dict[str, str]) -> pa.Table:
    """One row per key; ``how`` is sum, min or max by column."""
    out = rows.group_by(keys, use_threads=False).aggregate(list(how.items()))
    return out.rename_columns([n if n in keys else n.rsplit("_", 1)[0] for n in out.column_names]).select([*keys, *how])


class TopGroups:
    """The partial table of ``df`` by ``keys`` and the phases over it.

    ``values`` maps result columns to (``sum``, ``min`` or ``max``, column); ``measure`` names the sum
    that ranks.  ``sent`` tells, after :meth:`best`, how many rows every phase moved, beside the
    rows that a ``groupBy`` would move.
    """

    def __init__(self, df: DataFrame, keys: dict[str, Column], values: dict[str, tuple[str, Column]], measure: str):
        self.keys, self.measure = list(keys), measure
        self.kinds = {name: kind for name, (kind, _) in values.items()}
        self.sent: dict[str, int] = {}
        cast = {"sum": lambda c: c.cast("long")}
        narrow = df.select(*[c.alias(k) for k, c in keys.items()],
                           *[cast.get(kind, lambda c: c)(c).alias(name) for name, (kind, c) in values.items()])
        self.spark = df.sparkSession
        self.frame = self._stage(self._folded(narrow), "partial")

    def _stage(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{checkpoint_dir(self.spark)}/logsift-topn-{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _folded(self, narrow: DataFrame) -> DataFrame:
        keys, measure = self.keys, self.measure
        sums = [n for n, k in self.kinds.items() if k == "sum"]
        others = {n: k for n, k in self.kinds.items() if k != "sum"}
        # a sum is held in two halves, so that no number of rows overflows it
        how = {f"{n}.{half}": "sum" for n in sums for half in ("high", "low")} | others
        schema = T.StructType([narrow.schema[k] for k in keys] + [narrow.schema[n] for n in others]
                              + [T.StructField(f"{n}.{h}", T.LongType()) for n in sums for h in ("high", "low")]
                              + [T.StructField("part", T.StringType()), T.StructField("place", T.LongType())])

        def halves(b: pa.RecordBatch) -> pa.Table:
            cols = {k: b.column(k) for k in (*keys, *others)}
            for n in sums:
                v = pc.fill_null(b.column(n), 0).to_numpy(zero_copy_only=False)
                cols[f"{n}.high"], cols[f"{n}.low"] = pa.array(v >> 32), pa.array(v & 0xFFFFFFFF)
            return pa.table(cols)

        def run(batches):
            held, size, number = [], 0, 0
            task = TaskContext.get().partitionId()

            def out():
                rows = _fold(pa.concat_tables(held), keys, how)
                weight = rows[f"{measure}.high"].to_numpy() * 2.0 ** 32 + rows[f"{measure}.low"].to_numpy()
                rows = rows.take(pa.array(np.argsort(-weight, kind="stable")))
                rows = rows.append_column("part", pa.array([f"{task}-{number}"] * len(rows), pa.string()))
                rows = rows.append_column("place", pa.array(np.arange(len(rows), dtype=np.int64)))
                return rows.select(schema.names).combine_chunks().to_batches()

            for b in batches:
                if not b.num_rows:
                    continue
                held.append(_fold(halves(b), keys, how))
                size += len(held[-1])
                if size >= 2 * FOLD_GROUPS:
                    held = [_fold(pa.concat_tables(held), keys, how)]
                    size = len(held[0])
                    if size >= FOLD_GROUPS:
                        yield from out()
                        held, size, number = [], 0, number + 1
            if held:
                yield from out()

        folded = narrow.mapInArrow(run, schema)
        whole = {n: F.col(f"`{n}.high`").cast("decimal(28,0)") * F.lit(Decimal(1 << 32)) + F.col(f"`{n}.low`").cast("decimal(20,0)")
                 for n in sums}
        least = F.least(whole[measure], F.lit(Decimal(_MOST))).cast("long")
        return folded.select(*keys, *others, *[whole[n].cast("decimal(38,0)").alias(n) for n in sums], "part", "place", least.alias("weight"))

    def _nth(self, totals: DataFrame, n: int) -> int:
        """The n-th largest ``low``; 0 if there are fewer."""
        first = totals.orderBy(F.desc("low")).limit(n).agg(F.count(F.lit(1)), F.min("low")).first()
        return min(int(first[1]), _MOST) if first[0] == n else 0

    def _whole(self, rows: DataFrame) -> DataFrame:
        fits = {n: F.sum(n) for n, k in self.kinds.items() if k == "sum"}
        sums = [F.when(s.between(F.lit(Decimal(-_MOST - 1)), F.lit(Decimal(_MOST))), s.cast("decimal(19,0)")).try_cast("long").alias(n)
                for n, s in fits.items()]
        ends = [(F.min if k == "min" else F.max)(n).alias(n) for n, k in self.kinds.items() if k != "sum"]
        return rows.groupBy(*self.keys).agg(*sums, *ends).select(*self.keys, *self.kinds)

    def best(self, n: int) -> DataFrame:
        """Keys and values of the ``n`` groups of the largest measure (ties by keys)."""
        rows = self.frame
        shape = rows.agg(F.count(F.lit(1)), F.count_distinct("part"), F.min("weight"),
                         F.count(F.when(F.col("place") < n, 1))).first()
        self.sent = {"every_group": shape[0], "phase_1": shape[3]}
        if not shape[0] or shape[2] < 0:
            return top_n(self._whole(rows), self.measure, n, self.keys, sums=True)
        parts, low = shape[1], F.sum(F.col("weight").cast("decimal(38,0)")).alias("low")
        t1 = self._nth(rows.where(F.col("place") < n).groupBy(*self.keys).agg(low), n)
        least = -(-t1 // parts)                                  # a key that a task doesn't send has less there
        sent = self._stage(rows.where((F.col("weight") >= least) | (F.col("place") < n)).groupBy(*self.keys).agg(
            low, F.count(F.lit(1)).alias("parts")), "bounds")
        t2 = self._nth(sent, n)
        rest = F.lit(Decimal(max(0, least - 1))) * (F.lit(parts) - F.col("parts")).cast("decimal(12,0)")
        alive = sent.where(F.col("low") + rest >= F.lit(Decimal(t2))).select(*[F.col(k).alias(f"own {k}") for k in self.keys])
        same = [F.col(k).eqNullSafe(F.col(f"own {k}")) for k in self.keys]
        left = rows.join(alive, same, "left_semi")
        self.sent |= {"phase_2": int(sent.agg(F.sum("parts")).first()[0] or 0), "survivors": alive.count()}
        return top_n(self._whole(left), self.measure, n, self.keys, sums=True)


def vpc_top_connections_tput(df: DataFrame, top_n_rows: int = 20) -> DataFrame:
    """:func:`~logsift.operators.vpc.vpc_top_connections` by three-phase top-N."""
    groups = TopGroups(df.where(F.col("srcaddr").isNotNull() & F.col("dstaddr").isNotNull()),
                       {"source_ip": F.col("srcaddr"), "destination_ip": F.col("dstaddr")},
                       {"total_bytes": ("sum", F.col("bytes")), "total_packets": ("sum", F.col("packets")), "flow_count": ("sum", F.lit(1))},
                       "total_bytes")
    return groups.best(top_n_rows)


def vpc_top_ips_tput(df: DataFrame, top_n_rows: int = 20) -> DataFrame:
    """:func:`~logsift.operators.vpc.vpc_top_ips` by three-phase top-N."""
    roles = df.select(F.explode(F.array(F.struct(F.col("srcaddr").alias("ip"), F.lit("Source IP").alias("type")),
                                        F.struct(F.col("dstaddr").alias("ip"), F.lit("Destination IP").alias("type")))).alias("r"),
                      "bytes", "packets").where("r.ip is not null")
    groups = TopGroups(roles, {"ip": F.col("r.ip"), "type": F.col("r.type")},
                       {"total_bytes": ("sum", F.col("bytes")), "total_packets": ("sum", F.col("packets"))}, "total_bytes")
    return groups.best(top_n_rows).select("ip", "total_bytes", "type", "total_packets")


def ct_top_ips_tput(df: DataFrame, top_n_rows: int = 20) -> DataFrame:
    """:func:`~logsift.operators.cloudtrail.ct_top_ips` by three-phase top-N."""
    groups = TopGroups(df.where(F.col("source_ip_address").isNotNull()), {"ip": F.col("source_ip_address")},
                       {"access_count": ("sum", F.lit(1)), "fu": ("min", F.col("event_time")), "fl": ("min", F.col("event_time_local")),
                        "lu": ("max", F.col("event_time")), "ll": ("max", F.col("event_time_local"))}, "access_count")
    return groups.best(top_n_rows).select(
        "ip", fmt_ts("fu").alias("first_access_utc"), fmt_ts("fl").alias("first_access_local"),
        fmt_ts("lu").alias("last_access_utc"), fmt_ts("ll").alias("last_access_local"), "access_count")


def s3_requesters_tput(df: DataFrame, top_n_rows: int = 20) -> DataFrame:
    """:func:`~logsift.operators.s3.s3_requesters` by three-phase top-N (the cut first, then rows with ``N/A`` go)."""
    split = df.select(split_requester("requester").alias("r"), "remote_ip")
    groups = TopGroups(split, {"requester_arn": F.col("r.arn"), "source_ip": F.coalesce(F.col("remote_ip"), F.col("r.ip"))},
                       {"request_count": ("sum", F.lit(1))}, "request_count")
    return groups.best(top_n_rows).where((F.col("requester_arn") != "N/A") & (F.col("source_ip") != "N/A"))
