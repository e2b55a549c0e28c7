"""Queries over the event stream, run until all files are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.columns import rnd
from riskweave.plans.catalog import register
from riskweave.streaming import events as ev


@register("stream_tumbling", "select cast(date_trunc('day', ts) as date) d, event_type, count(*) n, round(sum(value), 4) + 0e0 total from events group by 1, 2")
def stream_tumbling(s, d):
    out = ev.drained(ev.tumbling(ev.events(s, d)))
    return out.select(F.to_date("start").alias("d"), "event_type", "n", rnd("total", 4).alias("total"))


@register("stream_sliding", "select cast(s as varchar) start, event_type, count(*) n from events, (select unnest([0, 1]) k), lateral (select date_trunc('day', ts) - case when k = 1 then interval 1 day else interval 0 day end s) group by 1, 2")
def stream_sliding(s, d):
    out = ev.drained(ev.tumbling(ev.events(s, d), "2 days", "1 day"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@register("stream_sessions", "select user_id, cast(min(ts) as date) d, count(*) n from (select *, sum(new) over (partition by user_id order by ts, event_id) g from (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 12 hour then 1 else 0 end new from events)) group by user_id, g")
def stream_sessions(s, d):
    out = ev.drained(ev.sessions(ev.events(s, d)))
    return out.select("user_id", F.to_date("start").alias("d"), "n")


@register("stream_smoothed", "select event_type, max(n) n, round(sum(value * pow(0.9, n - k) * case when k = 1 then 1 else 0.1 end), 5) + 0e0 ema from (select event_type, value, row_number() over (partition by event_type order by ts, event_id) k, count(*) over (partition by event_type) n from events) group by 1")
def stream_smoothed(s, d):
    return ev.drained(ev.smoothed(ev.events(s, d)), "update", ("event_type",)).withColumn("ema", F.round("ema", 5) + F.lit(0.0))
