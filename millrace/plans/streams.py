"""Registered streaming queries: each must give what its batch twin gives."""

from millrace.streaming import drops, streams as st
from pyspark.sql import functions as F

from . import quality
from .define import Registry
from .ledger import LINES, SUM
from .relations import KIND, SEVERITY, X, log

plans = Registry()
add = plans.add
events = lambda t: st.read(t.spark, f"{t.sf_dir}/events.parquet")

add("st1_change_queue", lambda t: st.apply_changes(events(t).select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 10 == 0, "delete").otherwise("upsert").alias("op")), "user_id", "event_id", "op"), """
  select user_id, event_id, event_type, 'upsert' as op from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1 and event_id % 10 <> 0""")
add("st2_daily_counters", lambda t: closed(t, lambda end: st.daily_counters(events(t), end=end)), "select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n, cast(sum(cast(value as decimal(18, 2))) as double) as total from events group by 1, 2")
add("st4_posted_once", lambda t: st.posted_once(events(t)).withColumn("event_date", F.col("event_date").cast("string")), "select event_id, job_id, event_type, cast(event_date as varchar) as event_date, source_table, source_id, ledger, amount from " + LINES)
add("st5_job_balances", lambda t: st.latest_state(st.job_balances(events(t)), ["job_id"]), f"select job_id, count(*) as postings, {SUM.format('amount')} as balance from {LINES} x where ledger = 'WIP' group by 1")


def closed(t, windows):
    """All windows of a stream that ends with what is there."""
    end = st.folder(t.spark)
    return st.appended(windows(end), end=end)


def log_folder(t):
    """The log of the events as text files; one folder a run."""
    path = st.folder(t.spark)
    log(t).write.text(path)
    return path


def drop_folder(t):
    path = st.folder(t.spark)
    t["documents"].select("doc_id", "text").write.parquet(path)
    return path


add("st3_log_alerts", lambda t: closed(t, lambda end: drops.log_alerts(drops.log_lines(t.spark, log_folder(t)), end=end)), f"with {X} select left(s, 10) as day, 'EQ-' || user_id as equipment, {KIND} as alert_type, count(*) as n, {SEVERITY} as severity from x where event_type in ('error', 'signup', 'view') group by 1, user_id, event_type")
add("st6_dropped_documents", lambda t: st.appended(drops.dropped_documents(t.spark, drop_folder(t), "doc_id long, text string")), quality.ORACLES["i04_corpus_manifest"])
QUERIES, ORACLES = plans.queries, plans.oracles
