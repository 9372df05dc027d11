"""Queries of the general operators outside the topic-map pipeline, with their SQL twins."""

from __future__ import annotations

import re

from gistmap.functions import timestamps
from gistmap.operators.turns import WS
from gistmap.runtime import table


def p4_found(spark, d):
    return timestamps.found_stamps(table(spark, d, "conversations"), table(spark, d, "raw_entries"))


def _twin() -> str:
    """The cascade in DuckDB: the same patterns and tables, but its own calendar and zone rules."""
    re2 = lambda p: p.replace("'", "''")
    cases = " ".join(f"WHEN regexp_matches(s, '{re2(p)}') THEN regexp_replace(s, '{re2(p)}', '{re.sub(r'[$]([0-9])', chr(92) * 2 + r'\1', out).replace(chr(92) * 2, chr(92))}')" for _, p, out in timestamps.CASCADE)
    months = ", ".join(f"'{w}': {k}" for k, ws in timestamps.MONTHS.items() for w in ws.split())
    zones = ", ".join(f"'{k}': {v}" for k, v in timestamps.ZONE_LETTERS.items())
    return f"""
WITH st AS (
  SELECT 'conversations' AS origin, export_id AS row_id, timestamp AS stamp, coalesce(account_zone, 'UTC') AS dz, coalesce(locale = 'en-US', false) AS us FROM conversations
  UNION ALL SELECT 'raw_entries', entry_id, time, coalesce(account_zone, 'UTC'), coalesce(locale = 'en-US', false) FROM raw_entries),
fs AS (SELECT *, string_split(CASE {cases} END, '|') AS f FROM (SELECT *, trim(regexp_replace(stamp, '{WS}', ' ', 'g'), ' ') AS s FROM st WHERE stamp IS NOT NULL)),
ps AS (SELECT origin, row_id, stamp, dz, f[1] AS kind, f[11] AS sign, f[2] AS first, try_cast(f[2] AS BIGINT) AS y,
  CASE WHEN f[1] = 's' AND NOT us THEN try_cast(f[4] AS INT) ELSE coalesce(try_cast(f[3] AS INT), map {{{months}}}[lower(f[3])]) END AS m,
  CASE WHEN f[1] = 's' AND NOT us THEN try_cast(f[3] AS INT) ELSE try_cast(f[4] AS INT) END AS d,
  CASE WHEN f[9] = '' THEN try_cast(f[5] AS INT) WHEN try_cast(f[5] AS INT) BETWEEN 1 AND 12 THEN try_cast(f[5] AS INT) % 12 + CASE WHEN lower(f[9]) = 'p' THEN 12 ELSE 0 END END AS h,
  try_cast(f[6] AS INT) AS mi, coalesce(try_cast(nullif(f[7], '') AS INT), 0) AS sec, try_cast(substr(rpad(f[8], 6, '0'), 1, 6) AS BIGINT) AS us6, f[10] AS z FROM fs),
ds AS (SELECT *, CASE WHEN kind = 'w' AND y BETWEEN 1 AND 9999 AND d BETWEEN 1 AND 7 AND m BETWEEN 1 AND weekofyear(make_date(y, 12, 28)) THEN make_date(y, 1, 4) - (isodow(make_date(y, 1, 4)) - 1)::INT + ((m - 1) * 7 + d - 1)::INT
  WHEN kind <> 'e' AND kind <> 'w' AND y BETWEEN 1 AND 9999 THEN try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', y, m, d) AS DATE) END AS day FROM ps),
ls AS (SELECT *, CASE WHEN h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND sec BETWEEN 0 AND 59 THEN epoch(day)::BIGINT + h * 3600 + mi * 60 + sec END AS loc,
  CASE WHEN regexp_matches(z, '^[+-]\\d{{2}}') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (z[2:3]::INT * 60 + coalesce(try_cast(nullif(regexp_extract(z, '^[+-]\\d{{2}}:?(\\d{{2}})$', 1), '') AS INT), 0)) ELSE map {{{zones}}}[lower(z)] END AS off,
  CASE WHEN z = '' THEN dz WHEN contains(z, '/') THEN z END AS region FROM ds),
us AS (SELECT *, CASE WHEN loc IS NOT NULL AND off IS NULL AND region IS NOT NULL THEN epoch(timezone(region, make_timestamp(loc * 1000000)))::BIGINT END AS late FROM ls),
ms AS (SELECT *, CASE WHEN kind = 'e' THEN (CASE WHEN sign = '-' THEN -1 ELSE 1 END) * CASE WHEN length(first) <= 11 THEN y * 1000000 + us6 WHEN length(first) <= 14 THEN y * 1000 WHEN length(first) <= 17 THEN y ELSE y // 1000 END
  WHEN off IS NOT NULL THEN (loc - off * 60) * 1000000 + us6
  WHEN epoch(timezone(region, to_timestamp(late - 3600)))::BIGINT = loc THEN (late - 3600) * 1000000 + us6 ELSE late * 1000000 + us6 END AS micros FROM us)
SELECT origin, row_id, coalesce(strftime(make_timestamp(micros), '%Y-%m-%dT%H:%M:%S.%fZ'), '') AS utc FROM ms
WHERE NOT (regexp_matches(stamp, '{timestamps.TARGET}') AND micros IS NOT NULL)
"""


QUERIES = {"p4_found": p4_found}
ORACLES: dict[str, str] = {"p4_found": _twin()}
