"""Outages, downtime, time to retry, held alerts and recovery over sample histories."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.scan import (
    DEFAULT_CHUNK_S,
    KEY,
    by_time,
    chunked_scan,
    pack,
    previous_row,
    so_far,
    time_chunk,
    unpack,
)

NODE_KEYS = ("cluster_id", "node")
# Default thresholds and timeouts.
ROUTER_THRESHOLD = 3
WATCHDOG_THRESHOLD = 2
ALERT_HOLD_S = 30.0
OUTAGE_TIMEOUT_S = 600.0
REJOIN_TIMEOUT_S = 900.0


def _order() -> list[Column]:
    return [F.col("ts").asc(), F.col("seq").asc()]


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def failover_rto(
    ops_events: DataFrame,
    keys: Sequence[str] = ("cluster_id",),
    *,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """Seconds from a failover to the first retry after it.

    A failover is consumed by the first retry, and replaced by a later failover, so a
    retry matches exactly when the event before it in its cluster is a failover. The
    failed node comes from that failover. Failovers with ``routing_impact`` false, where
    the column exists, are ignored.
    """
    events = ops_events.where(F.col("event").isin("FAILOVER", "RETRY"))
    if "routing_impact" in ops_events.columns:
        events = events.where((F.col("event") == "RETRY") | F.col("routing_impact"))
    paired = previous_row(
        pack(events.withColumn("__node", F.col("node")), keys),
        ["ts", "seq"],
        by_time(F.col("ts"), chunk_s, split=True),
        F.struct("event", "ts", F.col("__node").alias("node")),
        "__prev",
    )
    matched = paired.where((F.col("event") == "RETRY") & (F.col("__prev.event") == "FAILOVER"))
    return unpack(matched).select(
        *keys,
        "ts",
        "node",
        F.col("__prev.node").alias("failed_node"),
        _seconds(F.col("ts"), F.col("__prev.ts")).alias("elapsed_seconds"),
    )


def _failure_runs(probes: DataFrame, chunk_s: float) -> DataFrame:
    """Add ``failures``: consecutive failed probes up to and including each row.

    That is the running count of failures minus its value at the last healthy probe.
    The count only grows, so that value is a running maximum over healthy rows.
    """
    scanned = chunked_scan(
        probes,
        _order(),
        by_time(F.col("ts"), chunk_s),
        local={
            "__bad": lambda w: F.sum(F.when(F.col("healthy"), 0).otherwise(1)).over(so_far(w)),
            "__ok_at": lambda w: F.max(F.when(F.col("healthy"), F.col("__bad"))).over(so_far(w)),
        },
        summary={"__bads": F.max("__bad"), "__last_ok": F.max("__ok_at")},
        carry={
            "__seen": lambda w: F.coalesce(F.sum("__bads").over(w), F.lit(0)),
            "__base": lambda w: F.max(F.col("__seen") + F.col("__last_ok")).over(w),
        },
    )
    open_run = F.col("__seen") + F.col("__bad") - F.coalesce("__base", F.lit(0))
    return scanned.withColumn(
        "failures", F.coalesce(F.col("__bad") - F.col("__ok_at"), open_run)
    ).drop("__bad", "__ok_at", "__seen", "__base")


def probe_outages(
    probes: DataFrame,
    keys: Sequence[str] = NODE_KEYS,
    *,
    threshold: int = ROUTER_THRESHOLD,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """The probe at which each run of failures reaches the threshold; one row per run."""
    runs = _failure_runs(pack(probes.select(*keys, "ts", "seq", "healthy"), keys), chunk_s)
    found = runs.where(~F.col("healthy") & (F.col("failures") == threshold))
    return unpack(found).select(*keys, F.col("ts").alias("outage_ts"), "seq")


def downtime(
    probes: DataFrame,
    keys: Sequence[str] = NODE_KEYS,
    *,
    threshold: int = ROUTER_THRESHOLD,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """Time from each outage to the first healthy probe after it.

    Between an outage and its recovery there are only failures, so among the outage rows
    and the healthy rows a recovery is a healthy row right after an outage.
    """
    runs = _failure_runs(pack(probes.select(*keys, "ts", "seq", "healthy"), keys), chunk_s)
    kept = runs.where(F.col("healthy") | (F.col("failures") == threshold))
    paired = previous_row(kept, ["ts", "seq"], None, F.struct("healthy", "ts"), "__prev")
    recovered = paired.where(F.col("healthy") & ~F.col("__prev.healthy"))
    return unpack(recovered).select(
        *keys,
        F.col("__prev.ts").alias("outage_ts"),
        F.col("ts").alias("recovered_ts"),
        _seconds(F.col("ts"), F.col("__prev.ts")).alias("downtime_s"),
    )


def node_failovers(
    probes: DataFrame,
    failures: DataFrame,
    nodes: DataFrame,
    scope: Sequence[str] = ("cluster_id",),
    *,
    primary_count: int = 1,
    threshold: int = ROUTER_THRESHOLD,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """Failovers of nodes by probes and by requests, when they ended, and whether traffic was hit.

    A node that is up fails over at the ``threshold``-th failed probe in a row (``cause`` probe), or at one failed request
    (``cause`` request), whichever comes first, and is up again at its next healthy probe. ``probes`` has the scope,
    node, ts, seq and healthy; ``failures`` the same without healthy, one row for each failed request; ``nodes`` the scope, node and
    priority. ``routing_impact`` tells whether the node was among the ``primary_count`` first by priority of the nodes that were up,
    which take the traffic, when it failed; it is null for nodes that ``nodes`` does not list.

    Between two healthy probes of a node there is one failover at most, so a count of healthy probes numbers them;
    how many better nodes are down is a running sum over the failovers and recoveries of blocks of nodes.
    """
    scope = list(scope)
    keys = [*scope, "node"]
    rows = probes.select(*keys, "ts", "seq", "healthy", F.lit("probe").alias("cause")).unionByName(
        failures.select(*keys, "ts", "seq", F.lit(False).alias("healthy"), F.lit("request").alias("cause"))
    )
    is_probe = F.col("cause") == "probe"
    ok, bad = is_probe & F.coalesce("healthy", F.lit(False)), is_probe & ~F.coalesce("healthy", F.lit(False))
    scanned = chunked_scan(
        pack(rows.select(*keys, "ts", "seq", "cause", ok.alias("ok"), bad.alias("bad")), keys),
        _order(),
        by_time(F.col("ts"), chunk_s),
        local={
            "__bad": lambda w: F.sum(F.col("bad").cast("long")).over(so_far(w)),
            "__oks": lambda w: F.sum(F.col("ok").cast("long")).over(so_far(w)),
            "__ok_at": lambda w: F.max(F.when(F.col("ok"), F.col("__bad"))).over(so_far(w)),
        },
        summary={"__bads": F.max("__bad"), "__all_oks": F.max("__oks"), "__last_ok": F.max("__ok_at")},
        carry={
            "__seen": lambda w: F.coalesce(F.sum("__bads").over(w), F.lit(0)),
            "__ups": lambda w: F.coalesce(F.sum("__all_oks").over(w), F.lit(0)),
            "__base": lambda w: F.max(F.col("__seen") + F.col("__last_ok")).over(w),
        },
    )
    in_a_row = F.coalesce(F.col("__bad") - F.col("__ok_at"), F.col("__seen") + F.col("__bad") - F.coalesce("__base", F.lit(0)))
    triggers = (F.col("bad") & (in_a_row >= threshold)) | (F.col("cause") == "request")
    moment = F.struct("ts", "seq", "cause")
    # A healthy probe ends the time before it.
    time_up = F.col("__ups") + F.col("__oks") - F.col("ok").cast("long")
    found = unpack(
        scanned.withColumn("__up", time_up).where(F.col("ok") | triggers).groupBy(KEY, "__up").agg(
            F.min(F.when(triggers, moment)).alias("down"), F.min(F.when(F.col("ok"), moment)).alias("back")
        ).where("down is not null")
    )
    parts = _by_blocks(found.join(_ranks(nodes, scope), keys, "left"), primary_count).select(
        *scope, "__block", "ts", "seq", "__d", "__of"
    )
    summed = chunked_scan(
        pack(parts, [*scope, "__block"]),
        # What happens at the same moment does not count.
        [*_order(), F.col("__of").isNull().asc()],
        by_time(F.col("ts"), chunk_s),
        local={"__here": lambda w: F.sum("__d").over(so_far(w))},
        summary={"__sum": F.sum("__d")},
        carry={"__earlier": lambda w: F.sum("__sum").over(w)},
    )
    down = F.col("__here") + F.coalesce("__earlier", F.lit(0))
    asked = unpack(summed.withColumn("__down", down).where(F.col("__of").isNotNull()))
    # One row for each failover again: its blocks are disjoint.
    one = asked.groupBy(*scope, "__of").agg(F.sum("__down").alias("__down"), F.first(F.struct("ts", "seq")).alias("down"))
    return one.select(
        *scope, "__of.node", F.col("down.ts").alias("failover_ts"), "down.seq", "__of.cause", F.col("__of.back").alias("recovered_ts"),
        (F.col("__of.ahead") - F.col("__down") < primary_count).alias("routing_impact"),
    )


def _ranks(nodes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """``__ahead``, the number of better nodes of the scope, by priority, then name, and ``__levels``, the bits of the largest.

    Nodes without a priority have no better ones and are better than none; ``__counts`` is false for them.
    """
    counts = F.col("priority").isNotNull() & F.col("node").isNotNull()
    listed = nodes.groupBy(*scope, "node").agg(F.min("priority").alias("priority")).withColumn("__counts", counts)
    of_scope = Window.partitionBy(*scope, "__counts")
    ahead = F.when(counts, F.rank().over(of_scope.orderBy("priority", "node")) - 1).otherwise(0)
    levels = F.length(F.bin(F.max("__ahead").over(of_scope)))
    return listed.withColumn("__ahead", ahead).withColumn("__levels", levels).drop("priority")


def _by_blocks(found: DataFrame, primary_count: int) -> DataFrame:
    """Failovers as questions to blocks of ranks, and their changes of the blocks that their nodes are in.

    The ranks before one are disjoint blocks of sizes of powers of two, one for each bit set in it, and a rank is in one block of
    each size: rows grow with the logarithm of the nodes, not with their number. A question has the failover in ``__of``; who is
    among the first anyhow, or not listed, asks a block that nothing changes.
    """
    ahead = F.col("__ahead")
    levels = F.sequence(F.lit(0), F.col("__levels") - 1)

    def block(level: Column | int, number: Column) -> Column:
        return (number * 64 + level).cast("long")

    def shifted(level: Column) -> Column:
        return F.call_function("shiftright", ahead, level)

    none = F.array().cast("array<bigint>")
    # Only blocks of even number are ever whole before a rank.
    mine = F.transform(F.filter(levels, lambda b: shifted(b) % 2 == 0), lambda b: block(b, shifted(b)))
    before = F.transform(F.filter(levels, lambda b: shifted(b) % 2 == 1), lambda b: block(b, shifted(b) - 1))
    free = ahead.isNull() | (ahead < max(primary_count, 1))
    of = F.struct("node", "__up", "down.cause", F.col("back.ts").alias("back"), ahead.alias("ahead"))
    nobody = F.when(F.lit(False), of)

    def row(blocks: Column, moment: str, change: int, failover: Column) -> Column:
        return F.transform(
            F.coalesce(blocks, none),
            lambda b: F.struct(b.alias("__block"), F.col(f"{moment}.ts").alias("ts"), F.col(f"{moment}.seq").alias("seq"), F.lit(change).alias("__d"), failover.alias("__of")),
        )

    changed = F.when(F.col("__counts"), mine)
    asks = F.when(free, F.array(block(63, F.coalesce(ahead, F.lit(-1))))).otherwise(before)
    # Moments without a time change nothing.
    begins, ends = (F.when(F.col(f"{moment}.ts").isNotNull(), changed) for moment in ("down", "back"))
    rows = F.concat(row(begins, "down", 1, nobody), row(ends, "back", -1, nobody), row(asks, "down", 0, of))
    rest = [c for c in found.columns if not c.startswith("__") and c not in ("node", "down", "back")]
    return found.select(*rest, F.inline(rows))


def respawn_counts(downtimes: DataFrame, keys: Sequence[str] = NODE_KEYS) -> DataFrame:
    """Recoveries and total downtime per node."""
    return downtimes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("respawns"), F.sum("downtime_s").alias("downtime_s")
    )


def alert_hold(
    samples: DataFrame,
    keys: Sequence[str] = NODE_KEYS,
    *,
    hold_s: float = ALERT_HOLD_S,
    until: dt.datetime | None = None,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """Runs of zero status that lasted at least ``hold_s``, and when they fired.

    A status holds until the next sample says otherwise: a run fires at its start plus the hold,
    unless a sample other than zero comes before. The last run of a key has no such sample and
    fires; with ``until`` only what has fired by then is given. Samples without a value say nothing.
    """
    marked = previous_row(
        pack(samples.where(F.col("value").isNotNull()).select(*keys, "ts", "seq", (F.col("value") == 0).alias("zero")), keys),
        ["ts", "seq"],
        by_time(F.col("ts"), chunk_s),
        F.col("zero"),
        "__before",
    )
    # Starts and ends of runs alternate, so the edge before an end is its start.
    edges = marked.where(F.col("zero") != F.coalesce("__before", F.lit(False)))
    paired = previous_row(edges, ["ts", "seq"], None, F.col("ts"), "zero_since")
    ended = unpack(paired.where(~F.col("zero"))).select(*keys, "zero_since", F.col("ts").alias("ended"))
    newest = unpack(edges).groupBy(*keys).agg(F.max_by(F.struct("zero", "ts"), F.struct("ts", "seq")).alias("edge"))
    open_ = newest.where("edge.zero").select(*keys, F.col("edge.ts").alias("zero_since"), F.lit(None).cast("timestamp").alias("ended"))
    firing = F.timestamp_micros(F.unix_micros("zero_since") + F.lit(int(hold_s * 1_000_000)))
    fired = ended.unionByName(open_).withColumn("firing_ts", firing)
    in_time = F.col("ended").isNull() | (F.col("firing_ts") <= F.col("ended"))
    if until is not None:
        in_time = in_time & (F.col("firing_ts") <= F.lit(until))
    return fired.where(in_time).select(*keys, "zero_since", "firing_ts")


def recovery_phases(
    samples: DataFrame,
    targets: DataFrame,
    *,
    keys: Sequence[str] = NODE_KEYS,
    polls: DataFrame | None = None,
    baseline: DataFrame | None = None,
    outage_timeout_s: float = OUTAGE_TIMEOUT_S,
    rejoin_timeout_s: float = REJOIN_TIMEOUT_S,
) -> DataFrame:
    """Outage and rejoin phases for each target ``(keys, t0)``.

    Outage passes at the first sample not ALIVE within its timeout of ``t0``. Rejoin
    then waits for the first ALIVE sample after the outage (after the outage timeout,
    when none was seen). With ``polls``, a poll without a sample counts as MISSING.
    ``baseline`` gives ``passed`` per cluster. Samples meet targets on time slices as
    wide as both timeouts, so a node's whole history never goes to one task.
    """
    keys = list(keys)
    id_cols = [*keys, "t0"]
    span = outage_timeout_s + rejoin_timeout_s
    watch = targets.select(*id_cols)

    def slice_of(ts: Column) -> Column:
        return time_chunk(ts, span)

    end = F.timestamp_micros(F.unix_micros("t0") + F.lit(int(span * 1_000_000)))
    sliced = watch.withColumn("__slice", F.explode(F.sequence(slice_of(F.col("t0")), slice_of(end))))
    if polls is None:
        seen = samples.select(*keys, "ts", "state").withColumn("__slice", slice_of(F.col("ts")))
        matched = sliced.join(seen, [*keys, "__slice"])
    else:
        poll_keys = [k for k in keys if k in polls.columns]
        ticks = polls.select(*poll_keys, "ts").withColumn("__slice", slice_of(F.col("ts")))
        matched = (
            sliced.join(ticks, [*poll_keys, "__slice"])
            .join(samples.select(*keys, "ts", "state"), [*keys, "ts"], "left")
            .withColumn("state", F.coalesce("state", F.lit("MISSING")))
        )
    since = _seconds(F.col("ts"), F.col("t0"))
    matched = matched.where((since >= 0) & (since <= F.lit(span))).select(*id_cols, "ts", "state")

    alive = F.col("state") == "ALIVE"
    outage_at = matched.where(~alive & (_seconds(F.col("ts"), F.col("t0")) <= outage_timeout_s))
    outages = outage_at.groupBy(*id_cols).agg(F.min("ts").alias("outage_ts"))
    gave_up = F.timestamp_micros(F.unix_micros("t0") + F.lit(int(outage_timeout_s * 1_000_000)))
    progress = watch.join(outages, id_cols, "left").withColumn(
        "__from", F.coalesce("outage_ts", gave_up)
    )
    waited = _seconds(F.col("ts"), F.col("__from"))
    rejoins = (
        matched.where(alive)
        .join(progress, id_cols)
        .where((waited > 0) & (waited <= rejoin_timeout_s))
        .groupBy(*id_cols)
        .agg(F.min("ts").alias("rejoin_ts"))
    )
    wide = progress.join(rejoins, id_cols, "left")
    phases = [
        F.struct(F.lit("outage-detected").alias("phase"), F.col("outage_ts").isNotNull().alias("passed"), F.col("outage_ts").alias("at")),
        F.struct(F.lit("rejoin-confirmed").alias("phase"), F.col("rejoin_ts").isNotNull().alias("passed"), F.col("rejoin_ts").alias("at")),
    ]
    if baseline is not None:
        base_keys = [k for k in keys if k in baseline.columns]
        wide = wide.join(
            baseline.select(*base_keys, F.col("passed").alias("__baseline")), base_keys, "left"
        )
        phases.insert(
            0,
            F.struct(
                F.lit("baseline-visibility").alias("phase"),
                F.coalesce("__baseline", F.lit(True)).alias("passed"),
                F.col("t0").alias("at"),
            ),
        )
    return wide.select(*id_cols, F.inline(F.array(*phases)))


def phase_rollup(phases: DataFrame, keys: Sequence[str], scopes: DataFrame | None = None) -> DataFrame:
    """Whether every phase passed; a scope without phases passes."""
    rolled = phases.groupBy(*keys).agg(F.every("passed").alias("passed"))
    if scopes is None:
        return rolled
    return (
        scopes.select(*keys).distinct().join(rolled, list(keys), "left").fillna(True, ["passed"])
    )
