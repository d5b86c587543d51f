"""Status codes, lifecycle and role as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State names as the fleet reports them.
SUCCESS_STATUSES = (200, 201, 302)
WARMING_STATES = ("STARTING", "UPDATING", "DEPLOYING", "RESTARTING", "PENDING", "RECOVERING")
FAILED_STATES = ("FAILED", "STOPPING", "STOPPED", "UNHEALTHY")
GPU_KEYS = ("GPU", "AMD_GPU", "NVIDIA_GPU", "STANDBY_GPU")
ACCELERATOR_PREFIX = "accelerator_type:"


def success_flag(status: Column) -> Column:
    """1.0 for a successful HTTP status, else 0.0."""
    return F.when(status.isin(*SUCCESS_STATUSES), 1.0).otherwise(0.0)


def item_succeeded(response: Column, error: Column) -> Column:
    return response.isNotNull() & error.isNull()


def is_routable(status: Column) -> Column:
    return status.isin("primary", "reserve")


def router_role(status: Column) -> Column:
    """Role of a node by its router status; null status means no router row."""
    status = F.trim(status)
    return (
        F.when(status.isNull(), "unmanaged")
        .when(status == "primary", "active")
        .when(status == "reserve", "standby")
        .otherwise("unavailable")
    )


def router_lifecycle(status: Column) -> Column:
    """Lifecycle judged by router status alone."""
    return (
        F.when(is_routable(status), "LIVE")
        .when(status.isin("respawning", "starting"), "WARMING")
        .otherwise("OFFLINE")
    )


def lifecycle_from_flags(
    running: Column, warming: Column, failed: Column, joined: Column, usable: Column
) -> Column:
    """Lifecycle from whether any replica runs, warms up or failed; first match wins."""
    return (
        F.when(running, "LIVE")
        .when(warming, "WARMING")
        .when(failed, "FAILED")
        .when(~usable, F.when(joined, "FAILED").otherwise("OFFLINE"))
        .when(joined, "IDLE")
        .otherwise("OFFLINE")
    )


def resolve_lifecycle(states: Column, joined: Column, usable: Column) -> Column:
    """Lifecycle from an array of replica states."""
    return lifecycle_from_flags(
        F.exists(states, lambda s: s == "RUNNING"),
        F.exists(states, lambda s: s.isin(*WARMING_STATES)),
        F.exists(states, lambda s: s.isin(*FAILED_STATES)),
        joined,
        usable,
    )


def replica_priority(state: Column) -> Column:
    """0 running, 1 warming, 2 failed, 3 anything else."""
    return (
        F.when(state == "RUNNING", 0)
        .when(state.isin(*WARMING_STATES), 1)
        .when(state.isin(*FAILED_STATES), 2)
        .otherwise(3)
    )


def has_gpu(resources: Column) -> Column:
    """Whether a resource map advertises a GPU or an accelerator type."""
    return F.exists(
        F.map_keys(resources),
        lambda key: key.isin(*GPU_KEYS) | key.startswith(ACCELERATOR_PREFIX),
    )


def is_alive_gpu_worker(state: Column, is_head: Column, resources: Column) -> Column:
    return (
        (state == "ALIVE")
        & ~F.coalesce(is_head, F.lit(False))
        & F.coalesce(has_gpu(resources), F.lit(False))
    )


def memory_pct(used: Column, total: Column) -> Column:
    """Used share in percent, 0 when the total is not positive."""
    return F.when(total > 0, used / F.nullif(total, F.lit(0)) * 100.0).otherwise(0.0)
