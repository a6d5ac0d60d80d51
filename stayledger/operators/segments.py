"""Stored segments: all audience definitions met in one pass, their sizes, and the campaigns and flows limited to them.

Definitions are rows (id, chain_group_id, code, definition). Those of a chain become one array of segment ids per member, built
in a single scan of the member frame whatever their number; definitions are read in portions of ``PORTION``, so that
a plan stays of bounded size, and each portion adds one scan.
"""

from __future__ import annotations

import json
from collections import defaultdict
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stayledger.functions.scalars import moment
from stayledger.functions.sizing import small
from stayledger.operators.engage import automation_candidates, segment_condition

#: Definitions that one scan evaluates.
PORTION = 200

# The settings of a flow's trigger_config that its trigger takes, by trigger.
TRIGGER_SETTINGS = {"ota_booking_received": ("delay_minutes",), "direct_booking_received": ("delay_minutes",),
                    "points_expiring": ("min_points",), "inactive_member": ("days_inactive",)}


def segment_members(frame: DataFrame, segments: DataFrame, as_of: date) -> DataFrame:
    """segment_id, chain_group_id, member_id: who belongs to each active segment now.

    ``frame`` has a row per member with what the definitions ask for, such as member 360 with the tier progress. A segment holds
    members of its own chain only. A definition that cannot be read is an error that names the segment.
    """
    rows = segments.where("is_active") if "is_active" in segments.columns else segments
    rows = rows.select("id", "chain_group_id", "definition").orderBy("id")
    found, portion = [], []
    for r in rows.toLocalIterator():
        portion.append(r)
        if len(portion) == PORTION:
            found.append(_portion(frame, portion, as_of))
            portion = []
    if portion or not found:
        found.append(_portion(frame, portion, as_of))
    key = dict(segments.dtypes)["id"]
    return reduce(DataFrame.unionByName, found).withColumn("segment_id", F.col("segment_id").cast(key))


def _portion(frame: DataFrame, rows: list, as_of: date) -> DataFrame:
    by_chain: dict = defaultdict(list)
    for r in rows:
        try:
            condition = segment_condition(r.definition, as_of)
        except (KeyError, ValueError, IndexError) as problem:
            raise ValueError(f"segment {r.id}: {problem}") from problem
        by_chain[r.chain_group_id].append(F.when(condition, F.lit(r.id)))
    member_of = F.array().cast("array<string>")
    for chain, tests in by_chain.items():
        member_of = F.when(F.col("chain_group_id") == F.lit(chain), F.array_compact(F.array(*tests)).cast("array<string>")).otherwise(member_of)
    return frame.select("chain_group_id", "member_id", F.explode(member_of).alias("segment_id"))


def segment_sizes(segments: DataFrame, membership: DataFrame, as_of: date) -> DataFrame:
    """The segments with ``estimated_size`` and ``last_computed_at``; empty ones have size 0."""
    counted = membership.groupBy(F.col("segment_id").alias("id")).agg(F.count("*").alias("_n"))
    kept = [c for c in segments.columns if c not in ("estimated_size", "last_computed_at")]
    return segments.select(*kept).join(small(counted), "id", "left") \
        .select(*kept, F.coalesce("_n", F.lit(0)).cast("bigint").alias("estimated_size"), moment(as_of).alias("last_computed_at"))


def campaign_audience(campaigns: DataFrame, membership: DataFrame, members: DataFrame) -> DataFrame:
    """campaign_id, member_id: the members of a campaign's segment, or those of its chain where it has none.

    Both kinds are told apart by one key, (segment) or (chain), so that members are met in a single equi-join
    and a chain's campaigns without a segment do not meet the members of other chains.
    """
    asked = campaigns.select(F.col("id").alias("campaign_id"), _audience(F.col("segment_id"), F.col("chain_group_id")).alias("_of"))
    listed = membership.select("member_id", _audience(F.col("segment_id"), F.lit(None)).alias("_of"))
    everyone = members.select(F.col("id").alias("member_id"), _audience(F.lit(None), F.col("chain_group_id")).alias("_of"))
    return small(asked).join(listed.unionByName(everyone), "_of").select("campaign_id", "member_id")


def _audience(segment: Column, chain: Column) -> Column:
    return F.coalesce(F.concat(F.lit("segment "), segment.cast("string")), F.concat(F.lit("chain "), chain.cast("string")))


def _settings(trigger: str, config: str | None) -> dict:
    """What a flow's stored configuration gives its trigger; other entries concern delivery."""
    stored = json.loads(config) if config else {}
    return {k: stored[k] for k in TRIGGER_SETTINGS.get(trigger, ()) if k in stored}


def flow_candidates(automations: DataFrame, frames: dict[str, DataFrame], membership: DataFrame, as_of: date) -> DataFrame:
    """automation_id, member_id, booking_id, due_at: whom each active flow applies to, due by ``as_of``.

    The delay or number of days comes from the flow's ``trigger_config``. Flows with the same trigger and settings share one
    scan. A flow reaches members of its chain, and of its segment if it names one.
    """
    flows = automations.where("status = 'active'").select("id", "chain_group_id", "trigger_type", "trigger_config", "segment_id")
    groups = defaultdict(list)
    for r in flows.select("id", "trigger_type", "trigger_config").toLocalIterator():
        groups[r.trigger_type, json.dumps(_settings(r.trigger_type, r.trigger_config), sort_keys=True)].append(r.id)
    chains = frames["members"].select(F.col("id").alias("member_id"), "chain_group_id")
    owners = frames["bookings"].where("member_id IS NOT NULL").select(F.col("id").alias("booking_id"), "member_id")
    listed = membership.select("member_id", F.col("segment_id").alias("_member_of"))
    parts = []
    for (trigger, settings), ids in groups.items():
        found = automation_candidates(trigger, frames, as_of, due_only=True, **json.loads(settings))
        if "member_id" not in found.columns:
            found = found.join(owners, "booking_id")
        kinds = dict(frames["bookings"].dtypes)
        found = found.select("member_id", F.col("booking_id") if "booking_id" in found.columns else F.lit(None).cast(kinds["id"]).alias("booking_id"),
                             F.col("due_at") if "due_at" in found.columns else moment(as_of).alias("due_at"))
        asked = small(flows.where(F.col("id").isin(ids)).select(F.col("id").alias("automation_id"), "chain_group_id", "segment_id"))
        parts.append(found.join(chains, "member_id").join(asked, "chain_group_id"))
    if not parts:
        return chains.where("false").select(F.lit(None).cast("string").alias("automation_id"), "member_id",
                                            F.lit(None).cast("string").alias("booking_id"), moment(as_of).alias("due_at"))
    every = reduce(DataFrame.unionByName, parts)
    limited = every.where(F.col("segment_id").isNotNull()) \
        .join(listed.withColumnsRenamed({"_member_of": "segment_id"}), ["member_id", "segment_id"], "left_semi")
    return every.where(F.col("segment_id").isNull()).unionByName(limited.select(*every.columns)) \
        .select("automation_id", "member_id", "booking_id", "due_at")
