"""Named queries on stored segments, the campaigns and the flows that are limited to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayledger.operators import pms, segments
from stayledger.plans.binding import STAY_DAY
from stayledger.plans.engagement import member_360
from stayledger.plans.loyalty import tier_progress
from stayledger.plans.registry import ORACLES, query

#: The segment of each campaign; the others reach their whole chain.
_SEGMENT_OF = {0: 1, 1: 2, 2: 3, 3: 4, 5: 6, 6: 7, 7: 8}

_MEMBERSHIP = f"""full_ AS (SELECT v.*, p.tier_progress_pct FROM ({ORACLES['member_360']}) v LEFT JOIN ({ORACLES['tier_progress']}) p ON p.member_id = v.member_id),
membership AS (SELECT 1 AS segment_id, member_id FROM full_ WHERE chain_group_id = 0 AND tier_sort_order >= 3 AND status = 'active'
  UNION ALL SELECT 2, member_id FROM full_ WHERE chain_group_id = 1 AND is_churned
  UNION ALL SELECT 3, member_id FROM full_ WHERE chain_group_id = 2 AND (recruited_via_ota OR bookings_total > 14)
  UNION ALL SELECT 4, member_id FROM full_ WHERE chain_group_id = 3 AND date_part('month', birth_date) = 6
  UNION ALL SELECT 5, member_id FROM full_ WHERE chain_group_id = 4
  UNION ALL SELECT 7, member_id FROM full_ WHERE chain_group_id = 1 AND status <> 'active'
  UNION ALL SELECT 8, member_id FROM full_ WHERE chain_group_id = 2 AND tier_progress_pct >= 40)"""


def _membership(f):
    progress = tier_progress(f).select("member_id", "tier_progress_pct")
    return segments.segment_members(member_360(f).join(progress, "member_id", "left"), f.segments, STAY_DAY)


@query("segment_sizes", f"""WITH {_MEMBERSHIP}
SELECT s.id AS segment_id, s.chain_group_id, s.code, count(m.member_id) AS estimated_size, TIMESTAMP '{STAY_DAY}' AS last_computed_at
FROM {{segments}} s LEFT JOIN membership m ON m.segment_id = s.id GROUP BY ALL""")
def segment_sizes(f):
    return segments.segment_sizes(f.segments, _membership(f), STAY_DAY) \
        .select(F.col("id").alias("segment_id"), "chain_group_id", "code", "estimated_size", "last_computed_at")


@query("campaign_audience", f"""WITH {_MEMBERSHIP},
aimed AS (SELECT c.id AS campaign_id, c.chain_group_id, a.segment_id FROM {{campaigns}} c
  LEFT JOIN (VALUES {', '.join(f'({c}, {s})' for c, s in _SEGMENT_OF.items())}) AS a(campaign_id, segment_id) ON a.campaign_id = c.id)
SELECT CAST(campaign_id AS BIGINT) AS campaign_id, member_id FROM aimed JOIN membership USING (segment_id)
UNION ALL SELECT CAST(campaign_id AS BIGINT), m.id FROM aimed JOIN {{members}} m ON m.chain_group_id = aimed.chain_group_id WHERE segment_id IS NULL""")
def campaign_audience(f):
    of = F.create_map(*[F.lit(x) for pair in _SEGMENT_OF.items() for x in pair])
    campaigns = f.campaigns.withColumn("segment_id", F.try_element_at(of, F.col("id").cast("int")))
    return segments.campaign_audience(campaigns, _membership(f), f.members)


@query("flow_candidates", f"""WITH {_MEMBERSHIP},
found AS (SELECT 'ota' AS kind, b.member_id, b.id AS booking_id, b.booked_at + INTERVAL 7 MINUTE AS due_at FROM {{bookings}} b
    WHERE b.channel = 'ota' AND b.member_id IS NOT NULL AND b.booked_at + INTERVAL 7 MINUTE <= TIMESTAMP '{STAY_DAY}'
  UNION ALL SELECT 'inactive', m.id, NULL, TIMESTAMP '{STAY_DAY}' FROM {{members}} m LEFT JOIN (SELECT member_id, max(arrival_date) AS last FROM {{bookings}}
    WHERE status <> 'cancelled' GROUP BY 1) l ON l.member_id = m.id
    WHERE m.status = 'active' AND (l.last IS NULL OR l.last <= DATE '{STAY_DAY}' - 400)
  UNION ALL SELECT 'birthday', id, NULL, TIMESTAMP '{STAY_DAY}' FROM {{members}} WHERE status = 'active' AND date_part('month', birth_date) = 6
    AND date_part('day', birth_date) = 1
  UNION ALL SELECT 'check_out', member_id, id, check_out_at FROM {{bookings}} WHERE status = 'checked_out' AND member_id IS NOT NULL
    AND check_out_at <= TIMESTAMP '{STAY_DAY}')
SELECT CAST(w.id AS BIGINT) AS automation_id, x.member_id, x.booking_id, x.due_at FROM {{flows}} w
JOIN (VALUES ('ota_booking_received', 'ota'), ('inactive_member', 'inactive'), ('birthday', 'birthday'), ('check_out', 'check_out')) AS k(trigger_type, kind)
  ON k.trigger_type = w.trigger_type JOIN found x ON x.kind = k.kind JOIN {{members}} m ON m.id = x.member_id AND m.chain_group_id = w.chain_group_id
WHERE w.status = 'active' AND (w.segment_id IS NULL OR EXISTS (SELECT 1 FROM membership s WHERE s.segment_id = w.segment_id AND s.member_id = x.member_id))""")
def flow_candidates(f):
    frames = {"members": f.members, "bookings": f.bookings, "status_history": pms.status_history_from_bookings(f.bookings)}
    return segments.flow_candidates(f.flows, frames, _membership(f), STAY_DAY)
