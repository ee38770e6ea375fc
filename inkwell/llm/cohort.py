"""Cohort retention by secondary sort.

Rows are dealt by client and sorted by client and time; a scan passes them once, in batches. The first
row that may start a client fixes its start, every change of period gives one user, and nothing else is
remembered, so distinct users are counted without a hash set, however long a client's history is. The
client's segment rides along as its first row, so no join is needed either.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import bound_batches, column_of, materialise

DAY = 86_400_000_000
#: A client of more than a PARTS-th of all rows, and of LEAST_ROWS, is dealt in pieces; so there are
#: fewer than PARTS such clients, whatever the input.
PARTS = 512
LEAST_ROWS = 1_000
_NONE = np.iinfo(np.int64).max
_CELL = ("state", "segment", "cohort", "period")


class _Open:
    """The client that a batch ended in: its key, first row's attributes, starts, and runs of periods."""

    def __init__(self, key, hot, segment, starts, runs):
        self.key, self.hot, self.segment, self.starts, self.runs = key, hot, segment, starts, runs


def _joined(one: tuple, two: tuple) -> tuple:
    """Runs (period, cents) of a client and those that follow; the period at the joint may be one."""
    if len(one[0]) and len(two[0]) and one[0][-1] == two[0][0]:
        two = (two[0], two[1].copy())
        two[1][0] += one[1][-1]
        one = (one[0][:-1], one[1][:-1])
    return np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])


def _micros(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False)


def _scan(period_days: int, cohort_days: int):
    def rows(client, hot, segments, starts, runs):
        """A row for each run: ``starts`` by state and client, ``runs`` by state (client's number, period, cents)."""
        cohorts = [np.floor_divide(s, DAY * cohort_days) for s in starts]
        moved = (starts[0] != _NONE) & (starts[1] != _NONE) & (cohorts[0] != cohorts[1])
        for state, (g, period, cents) in enumerate(runs):
            if len(g):
                columns = [pa.array(client[g]), pa.array(hot[g]), pa.array(np.full(len(g), state, np.int32)), segments.take(pa.array(g)), pa.array(cohorts[state][g]), pa.array(period), pa.array(moved[g]), pa.array(cents)]
                yield pa.RecordBatch.from_arrays(columns, names=["client", "hot", "state", "segment", "cohort", "period", "moved", "cents"])

    def closed(o: _Open):
        one = lambda x: np.array([x])
        runs = [(np.zeros(len(p), np.int64), p, c) for p, c in o.runs]
        return rows(one(o.key[0]), one(o.hot), pa.array([o.segment], pa.string()), [one(s) for s in o.starts], runs)

    def run(batches):
        open_: _Open | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            client, piece, order, cents = (column_of(batch, c).to_numpy(zero_copy_only=False) for c in ("_client", "_piece", "_order", "_cents"))
            early, hot = (column_of(batch, c).to_numpy(zero_copy_only=False) for c in ("_early", "_hot"))
            ts = _micros(column_of(batch, "_ts"))
            at = np.flatnonzero(np.concatenate([[True], (client[1:] != client[:-1]) | (piece[1:] != piece[:-1])]))
            g = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(client))))
            segments = column_of(batch, "_segment").take(pa.array(at))
            given = [_micros(column_of(batch, c).take(pa.array(at))) for c in ("_start0", "_start1")]
            goes_on = open_ is not None and open_.key == (client[0], piece[0])
            if open_ is not None and not goes_on:
                yield from closed(open_)
            if goes_on:
                segments = pa.concat_arrays([pa.array([open_.segment], pa.string()), segments.slice(1)])
            starts, runs = [], []
            for state, known in enumerate((early, np.ones(len(early), np.bool_))):
                start = np.where(hot[at], given[state], _NONE)
                signs = np.flatnonzero((order == 1) | ((order == 2) & known))
                who, first = np.unique(g[signs], return_index=True)
                start[who] = np.where(hot[at][who], start[who], ts[signs[first]])
                if goes_on and open_.starts[state] != _NONE:
                    start[0] = open_.starts[state]
                live = np.flatnonzero(known & (order > 0) & (start[g] != _NONE) & (ts >= start[g]))
                period = np.floor_divide(ts[live] - start[g[live]], DAY * period_days)
                change = np.flatnonzero(np.concatenate([[True], (g[live][1:] != g[live][:-1]) | (period[1:] != period[:-1])])) if len(live) else np.zeros(0, np.int64)
                of, sums = g[live][change], np.add.reduceat(cents[live], change) if len(live) else np.zeros(0, np.int64)
                period = period[change]
                if goes_on:
                    own = int(np.searchsorted(of, 0, "right"))
                    p, c = _joined(open_.runs[state], (period[:own], sums[:own]))
                    of, period, sums = np.concatenate([np.zeros(len(p), np.int64), of[own:]]), np.concatenate([p, period[own:]]), np.concatenate([c, sums[own:]])
                starts.append(start)
                runs.append((of, period, sums))
            last = len(at) - 1
            cut = [int(np.searchsorted(of, last)) for of, _, _ in runs]
            yield from rows(client[at], hot[at], segments, starts, [(of[:k], p[:k], c[:k]) for k, (of, p, c) in zip(cut, runs, strict=True)])
            open_ = _Open((client[-1], piece[-1]), hot[-1], segments[last].as_py(), [s[last] for s in starts], [(p[k:], c[k:]) for k, (_, p, c) in zip(cut, runs, strict=True)])
        if open_ is not None:
            yield from closed(open_)

    return run, "client long, hot boolean, state int, segment string, cohort long, period long, moved boolean, cents long"


def cohort_retention(clicks: DataFrame, clients: DataFrame, as_of: dt.datetime, period_days: int = 1, cohort_days: int = 1, start_kind: str = "signup", parts: int = PARTS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Users and cents by state, segment, cohort and period: what was known at ``as_of`` (state 0) and
    what is known now (state 1).

    ``clicks`` has click_id, ts, arrived_at, client_id, kind and value. Equal rows count once, in all
    their columns, also those not named here; rows without ts or client_id are left out. State 0 has the
    rows with arrived_at before ``as_of``; a null arrived_at is in state 1 only. A client's start is its
    least known ts of ``start_kind``; a client without one gives no rows. Its cohort is the start's day
    since 1970, in units of ``cohort_days``, its periods are whole ``period_days`` since the start, to the
    microsecond. Clicks at the very time of the start count, whatever their kind. A null value, or one
    that is no finite number, counts 0 cents. ``clients`` has client_id and segment: null or missing is
    '', of several rows of a client the least segment counts. Times are taken without a zone. Empty tables
    give no rows.

    Clients with many rows are dealt in pieces: their starts are found beforehand, by an aggregation
    that is combined in each task, and what the pieces count is put together again by client. There are
    fewer than ``parts`` of them, so their table is small enough to be sent to all tasks. A task holds a
    batch, and of the client that it is at one number for each period.
    """
    spark = clicks.sparkSession
    bound_batches(spark)
    begins = F.coalesce(F.col("kind") == start_kind, F.lit(False))
    early = F.coalesce(F.col("arrived_at").cast("timestamp_ntz") < F.lit(as_of).cast("timestamp_ntz"), F.lit(False))
    value = F.col("value").cast("double")
    cents = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.floor(value * 100 + 0.5)).otherwise(0).cast("long")
    named = [F.col("client_id").cast("long").alias("_client"), F.col("ts").cast("timestamp_ntz").alias("_ts"), early.alias("_early"), F.when(~begins, 3).when(early, 1).otherwise(2).cast("int").alias("_order")]
    given = clicks.where("ts is not null and client_id is not null")

    least = lambda c: F.min(F.when(c, F.col("_ts")))
    total = clicks.count()
    cut = max(least_rows, total // parts)
    often = given.select(*named).groupBy("_client").agg(F.count("*").alias("_n"), least(F.col("_order") == 1).alias("_start0"), least(F.col("_order") < 3).alias("_start1")).where(F.col("_n") > cut)
    often = materialise(often.withColumn("_pieces", F.ceil(F.col("_n") / cut).cast("int")).drop("_n"), "often")
    few = F.broadcast(often.select("_client"))  # fewer than ``parts`` rows
    labels = clients.where("client_id is not null").select(F.col("client_id").cast("long").alias("_client"), F.col("segment").cast("string").alias("_segment"))
    theirs = labels.join(few, "_client").groupBy("_client").agg(F.min("_segment").alias("_segment"))
    often = F.broadcast(often.join(F.broadcast(theirs), "_client", "left"))

    events = given.distinct().select(*named, cents.alias("_cents"), F.xxhash64("ts", "click_id").alias("_deal")).join(often, "_client", "left")
    events = events.withColumn("_hot", F.col("_pieces").isNotNull()).withColumn("_piece", F.when(F.col("_hot"), F.pmod("_deal", "_pieces")).otherwise(0).cast("int")).drop("_deal", "_pieces")
    labels = labels.join(few, "_client", "left_anti").groupBy("_client").agg(F.min("_segment").alias("_segment"))
    labels = labels.withColumns({"_order": F.lit(0), "_early": F.lit(False), "_hot": F.lit(False), "_piece": F.lit(0), "_cents": F.lit(0).cast("long")})
    rows = events.unionByName(labels, allowMissingColumns=True)
    rows = rows.repartition("_client", "_piece").sortWithinPartitions("_client", "_piece", F.asc_nulls_first("_ts"), "_order")
    run, schema = _scan(period_days, cohort_days)
    each = rows.mapInArrow(run, schema)

    crc = F.crc32(F.col("client").cast("string").cast("binary"))
    each = each.withColumn("segment", F.coalesce("segment", F.lit(""))).withColumn("_own", F.when(F.col("hot"), F.col("client")))
    cells = each.groupBy(*_CELL, "_own").agg(F.count("*").alias("users"), F.sum(crc).alias("users_crc32"), F.sum(F.col("moved").cast("long")).alias("moved"), F.sum("cents").alias("cents"))
    own = F.col("_own").isNotNull()  # a client in pieces is one user
    once = cells.select(*_CELL, F.when(own, 1).otherwise(F.col("users")).alias("users"), F.when(own, F.crc32(F.col("_own").cast("string").cast("binary"))).otherwise(F.col("users_crc32")).alias("users_crc32"), F.when(own, F.least("moved", F.lit(1))).otherwise(F.col("moved")).alias("moved"), "cents")
    return once.groupBy(*_CELL).agg(*[F.sum(c).cast("long").alias(c) for c in ("users", "users_crc32", "moved", "cents")]).select("state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents")


def delayed(clicks: DataFrame) -> DataFrame:
    """Clicks of which every third arrives later than its row says, by up to 99 days: the query's table."""
    h = F.crc32(F.col("click_id").cast("string").cast("binary"))
    at = F.col("arrived_at").cast("timestamp_ntz")
    return clicks.withColumn("arrived_at", F.when(h % 3 == 0, at + F.make_dt_interval((h % 100).cast("int"))).otherwise(at))


def oracle() -> str:
    """DuckDB SQL of the query; DuckDB has no crc32, so that is folded over the bits."""
    crc = lambda x: f"xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda s: [256 + ord(s), 0, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: CASE WHEN b >= 256 THEN xor(a, b - 256) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    return f"""
        WITH c AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
        h AS (SELECT click_id, {crc('click_id')} AS h FROM (SELECT DISTINCT click_id FROM c)),
        u AS (SELECT client_id, {crc('client_id')} AS crc FROM (SELECT DISTINCT client_id FROM c)),
        k AS (SELECT client_id, ts, kind, value, CASE WHEN h % 3 = 0 THEN arrived_at + to_days(CAST(h % 100 AS INTEGER)) ELSE arrived_at END AS arrived FROM c LEFT JOIN h USING (click_id)),
        s AS (SELECT 0 AS state, * FROM k WHERE arrived < TIMESTAMP '2024-02-15 00:00:00' UNION ALL SELECT 1 AS state, * FROM k),
        b AS (SELECT state, client_id, min(epoch_us(ts)) AS start FROM s WHERE kind = 'signup' GROUP BY ALL),
        m AS (SELECT client_id FROM b GROUP BY client_id HAVING count(*) = 2 AND min(start // {DAY}) <> max(start // {DAY})),
        p AS (SELECT state, client_id, start // {DAY} AS cohort, (epoch_us(ts) - start) // {DAY} AS period, sum(CAST(coalesce(floor(100 * value + 0.5), 0) AS BIGINT)) AS cents
              FROM s JOIN b USING (state, client_id) WHERE epoch_us(ts) >= start GROUP BY ALL),
        g AS (SELECT client_id, min(segment) AS segment FROM clients GROUP BY client_id)
        SELECT CAST(state AS INTEGER) AS state, coalesce(segment, '') AS segment, cohort, period, count(*) AS users, CAST(sum(crc) AS BIGINT) AS users_crc32,
               count(m.client_id) AS moved, CAST(sum(cents) AS BIGINT) AS cents
        FROM p JOIN u USING (client_id) LEFT JOIN g USING (client_id) LEFT JOIN m USING (client_id) GROUP BY ALL"""
