"""Where queries and their oracles are registered, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.plans import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    """Registers a query under its name; `sql` goes on from the views' WITH clause."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (v.WITH if views else "") + sql
        return f

    return add


def r6(c: Column | str, name: str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0).alias(name)


#: SQL: lost exposures and slots of the frames of a table; groups of behavior frames.
SLOTS = """
, k AS (SELECT *, row_number() OVER w - 1 AS i, acquired_time_us - lag(acquired_time_us) OVER w AS gap FROM {source}
  WINDOW w AS (PARTITION BY recording_id ORDER BY frame_id)),
p AS (SELECT recording_id, median(gap) AS period, min_by(acquired_time_us, frame_id) AS t0, count(*) AS n FROM k GROUP BY recording_id),
x AS (SELECT k.*, period, n >= 3 AND period > 0 AS ok, CASE WHEN n >= 3 AND period > 0 THEN (acquired_time_us - t0) / period - i END AS excess FROM k JOIN p USING (recording_id)),
m AS (SELECT *, median(excess) OVER (w ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) - median(excess) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS shift
  FROM x WINDOW w AS (PARTITION BY recording_id ORDER BY i)),
q AS (SELECT *, CASE WHEN ok AND gap > 1.5 * period AND round_even(shift, 0) >= 1 AND abs(shift - round_even(shift, 0)) <= 0.35 THEN CAST(round_even(shift, 0) AS BIGINT) ELSE 0 END AS missed FROM m),
slots AS (SELECT recording_id, frame_id, acquired_time_us, received_time_us, missed, CAST(i + sum(missed) OVER (PARTITION BY recording_id ORDER BY i) AS BIGINT) AS slot FROM q),
groups AS (SELECT recording_id, frame_id AS behavior_frame_id, ratio, row_number() OVER (PARTITION BY recording_id ORDER BY frame_id) - 1 AS slot
  FROM t_frames JOIN t_ratios USING (recording_id) WHERE frame_id % ratio = 0)
"""

#: SQL: sums over neighbours of the difference to the frame before.
AUTOCORRELATION = """, g AS (SELECT a.recording_id, a.frame_id, a.pos, a.v - b.v AS d FROM t_pixels a JOIN t_pixels b ON a.recording_id = b.recording_id AND b.frame_id = a.frame_id - 1 AND a.pos = b.pos),
c AS (SELECT *, d - avg(d) OVER (PARTITION BY recording_id, frame_id) AS x FROM g),
h AS (SELECT c.recording_id, c.frame_id, sum(c.x * r.x) FILTER (c.pos % 8 < 7 AND r.pos = c.pos + 1) / 56 AS across, sum(c.x * r.x) FILTER (r.pos = c.pos + 8) / 56 AS down, sum(c.x * c.x) FILTER (r.pos = c.pos) / 64 AS power
  FROM c JOIN c r ON c.recording_id = r.recording_id AND c.frame_id = r.frame_id AND r.pos IN (c.pos, c.pos + 1, c.pos + 8) GROUP BY ALL)
"""
