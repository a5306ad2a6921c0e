"""SQL (DuckDB) for what is read: the values that were written."""

from __future__ import annotations

SECOND = "date_trunc('second', ts)"
UNSURE = "day(ts) <= 12 AND day(ts) <> month(ts)"
STATUS = "o_orderstatus AS status, o_orderpriority AS priority FROM orders"

ORACLES = {
    "parse_timestamp_forms": f"""SELECT event_id, CASE WHEN k IN (4, 15) THEN NULL WHEN k IN (10, 11) AND {UNSURE} THEN NULL WHEN k = 1 THEN {SECOND} - INTERVAL 330 MINUTE WHEN k = 14 THEN {SECOND} + INTERVAL 180 MINUTE WHEN k IN (6, 8) THEN date_trunc('minute', ts)
 WHEN k = 11 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) ELSE {SECOND} END AS at FROM (SELECT *, event_id % 16 AS k FROM events)""",
    # The offsets before and after: the first that leads back to the same clock counts, for skipped times that before.
    "parse_timestamp_zones": """WITH l AS (SELECT l, zone FROM (SELECT DISTINCT CAST(ts AS DATE) + INTERVAL 150 MINUTE AS l FROM events UNION SELECT CAST(o_orderdate AS DATE) + INTERVAL 150 MINUTE FROM orders), (SELECT unnest(['UTC', 'Europe/Paris', 'America/New_York', 'Asia/Kathmandu']) AS zone)),
u AS (SELECT *, l - (timezone(zone, (l - INTERVAL 14 HOUR) AT TIME ZONE 'UTC') - (l - INTERVAL 14 HOUR)) AS a, l - (timezone(zone, (l + INTERVAL 14 HOUR) AT TIME ZONE 'UTC') - (l + INTERVAL 14 HOUR)) AS b FROM l)
SELECT CAST(l AS DATE) AS day, zone, CASE WHEN timezone(zone, a AT TIME ZONE 'UTC') = l THEN a WHEN timezone(zone, b AT TIME ZONE 'UTC') = l THEN b ELSE a END AS at FROM u""",
    "scan_delimited_layouts": "SELECT c_custkey AS customer_id, c_name || CASE c_custkey % 4 WHEN 0 THEN ', Ltd' WHEN 1 THEN '; \"x\"' WHEN 2 THEN '' ELSE chr(10) || 'next line' END AS name, c_mktsegment AS segment FROM customer",
    "scan_json_shapes": f"SELECT o_orderkey AS id, {STATUS} WHERE o_orderkey % 10 IN (0, 1, 2, 4) AND o_orderkey % 50 <> 0 OR o_orderkey % 100 = 3 UNION ALL SELECT -count(*), 'bad', NULL FROM orders WHERE o_orderkey % 50 = 0",
}
