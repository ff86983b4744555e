"""Every query by name, over the surrogate tickets, with the SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property
from typing import ClassVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import metrics
from .functions.scalar import poisson_steps, seconds_between
from .operators.ordered import asof_join, next_time, quantiles
from .oracles import _days, _list, _pct, _ts, with_tables
from .plans import analysis, checks, explain, features, isotonic, labels, load, model_frames, models, reports, resampling, scope, sentences, stages, together
from .sources import catalog, documents, surrogate, tables
from .sources.surrogate import PARAMS as P
from .sources.surrogate import RANKS

Query = Callable[[SparkSession, str], DataFrame]
_SPARK: dict[str, Callable[[Layers], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Layers:
    """The layers over one folder, each planned once. Whoever makes one closes it when its rows are read."""

    #: Of each session, those that queries share which were given none; they close at the end of the process at the latest.
    _shared: ClassVar[WeakKeyDictionary[SparkSession, dict[tuple, Layers]]] = WeakKeyDictionary()

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.settled: list[DataFrame] = []
        #: Folders of what was written on the way to a layer, such as counts for quantiles.
        self.beside: set[str] = set()

    def __enter__(self) -> Layers:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Delete what was written for these layers."""
        while self.settled:
            tables.discard(self.settled.pop())
        while self.beside:
            tables.delete(self.spark, self.beside.pop())
        for name in [n for n in vars(self) if n not in ("spark", "sf_dir", "settled", "beside")]:
            delattr(self, name)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Layers:
        """The layers of these files in this session; what was written for one query serves the others, while it is there."""
        shared = cls._shared.setdefault(spark, {})
        key = tables.stamp(spark, [f"{sf_dir}/{t}.parquet" for t in surrogate.TABLES])
        found = shared.get(key)
        if found is None or not all(map(tables.present, found.settled)):
            found = shared[key] = cls(spark, sf_dir)
        return found

    @classmethod
    def close_shared(cls, spark: SparkSession) -> None:
        """Close what the queries of a session share."""
        for found in cls._shared.pop(spark, {}).values():
            found.close()

    def _settle(self, make: Callable[[Layers], DataFrame], name: str) -> DataFrame:
        with tables.noted() as found:
            df = make(self)
        self.beside |= found
        self.settled.append(tables.settle(df, name))
        return self.settled[-1]

    def _spans(self) -> DataFrame:
        return stages.status_intervals(self.tickets, self.rel, surrogate.stage_map(self.spark), P)

    def table(self, name: str) -> DataFrame:
        return surrogate.read(self.spark, self.sf_dir, name)

    def _kept(name: str, make: Callable[[Layers], DataFrame]) -> cached_property:  # noqa: N805
        """A layer that others read several times: a table, written when first needed."""
        return cached_property(lambda s: s._settle(make, name))

    issues = _kept("issues", lambda s: surrogate.issues(s.spark, s.sf_dir))
    rel = cached_property(lambda s: surrogate.relations(s.spark, s.sf_dir, s.issues))
    tickets = _kept("tickets", lambda s: scope.tickets(s.rel, P))
    thresholds = _kept("thresholds", lambda s: labels.peer_thresholds(s.tickets, P))
    labels = _kept("labels", lambda s: labels.late_labels(s.tickets, s.thresholds, P))
    intervals = _kept("intervals", lambda s: s._spans())
    # made in the pass that makes the intervals, where nobody has written these: they are not shuffled again
    ticket_stages = _kept("ticket-stages", lambda s: stages.ticket_stages(s.tickets, s.intervals if "intervals" in vars(s) else s._spans()))
    flow = cached_property(lambda s: stages.ticket_flow(s.tickets, s.ticket_stages))
    base = cached_property(lambda s: analysis.analysis_base(s.labels, s.flow, s.rel.issues))
    points = _kept("points", lambda s: features.points(s.tickets, s.labels, P))
    scope = _kept("scope", lambda s: features.scope_issues(s.rel.issues, P))
    changes = _kept("changes", lambda s: features.rewindable(s.rel.changelog, s.points))
    first_after = cached_property(lambda s: features.first_after(s.points, s.changes))
    net = cached_property(lambda s: features.net_changes(s.points, s.changes))
    spans = _kept("spans", lambda s: features.assignee_spans(s.rel.changelog, s.scope, P))
    assignee_load = _kept("assignee-load", lambda s: features.assignee_load(s.spans, s.scope, P))
    project_load = _kept("project-load", lambda s: features.project_load(s.scope, P))
    prior = cached_property(lambda s: features.reporter_prior(s.rel.issues, P))
    peer = _kept("peer", lambda s: features.trailing_stats(s.labels, ["project_key", "issue_type"], P))
    project = _kept("project", lambda s: features.trailing_stats(s.labels, ["project_key"], P))
    activity = cached_property(lambda s: features.activity_until(s.points, s.tickets, s.rel.changelog, s.rel.comments))
    state = cached_property(lambda s: features.state_at(s.points, s.intervals))
    parts = cached_property(lambda s: features.Parts(s.points, s.first_after, s.net, s.spans, s.assignee_load, s.project_load, s.prior, s.peer, s.project, s.activity, s.state))
    features = _kept("features", lambda s: features.features(s.rel, s.parts, surrogate.priority_ranks(s.spark), P))
    frame = cached_property(lambda s: model_frames.model_frame(s.features, s.labels))
    known = cached_property(lambda s: model_frames.known_at(s.frame, P.train_cutoff))
    scored = _kept("scored", lambda s: model_frames.baselines(s.frame.filter("split = 'test' and is_late is not null"), s.known))


def _query(sql: str) -> Callable[[Callable[[Layers], DataFrame]], Callable[[Layers], DataFrame]]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[Layers], DataFrame]) -> Callable[[Layers], DataFrame]:
        _SPARK[f.__name__], _SQL[f.__name__] = f, with_tables(sql)
        return f

    return add


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# scope and labels


@_query("SELECT * FROM tickets")
def tickets(x: Layers) -> DataFrame:
    return x.tickets


@_query("SELECT coalesce(exclusion_reason, 'kept') AS reason, count(*) AS n FROM tickets GROUP BY ALL")
def scope_exclusions(x: Layers) -> DataFrame:
    return analysis.counts_by(x.tickets, "exclusion_reason", "reason", "kept")


@_query("SELECT * FROM bulk")
def bulk_events(x: Layers) -> DataFrame:
    return scope.bulk_closed(scope.in_scope(x.rel.issues, P), x.rel.changelog, P)


@_query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2")
def bulk_hours(x: Layers) -> DataFrame:
    return x.table("events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n")).filter("n >= 2")


@_query("SELECT * REPLACE (round(threshold_days, 6) AS threshold_days) FROM peer_thresholds")
def peer_thresholds(x: Layers) -> DataFrame:
    return _round(x.thresholds, 6, "threshold_days")


@_query("SELECT * REPLACE (round(threshold_days, 6) AS threshold_days) FROM late_labels")
def late_labels(x: Layers) -> DataFrame:
    return _round(x.labels, 6, "threshold_days")


@_query("SELECT label_status AS status, count(*) AS n FROM late_labels GROUP BY ALL")
def label_status(x: Layers) -> DataFrame:
    return analysis.counts_by(x.labels, "label_status", "status")


@_query("SELECT threshold_level AS level, count(*) AS n FROM late_labels WHERE label_status IN ('labelled', 'open_known_late') GROUP BY ALL")
def threshold_levels(x: Layers) -> DataFrame:
    return analysis.counts_by(x.labels.filter(F.col("label_status").isin("labelled", "open_known_late")), "threshold_level", "level")


@_query(f"SELECT split, count(is_late) AS n_all, {_pct('is_late')} AS late_pct_all, count(is_late_delivered_only) AS n_delivered, {_pct('is_late_delivered_only')} AS late_pct_delivered FROM late_labels WHERE split <> 'train' OR train_eligible GROUP BY split")
def late_rate_by_split(x: Layers) -> DataFrame:
    return analysis.late_rate_by_split(x.labels)


@_query("SELECT train_eligible, label_status, count(*) AS n FROM late_labels GROUP BY ALL")
def train_eligible(x: Layers) -> DataFrame:
    return x.labels.groupBy("train_eligible", "label_status").agg(F.count("*").alias("n"))


@_query(f"SELECT l.project_key, count(*) AS n, round(any_value(t.threshold_days), 1) AS threshold_days, {_pct('is_late')} AS late_pct FROM late_labels l LEFT JOIN peer_thresholds t ON t.level = 'project' AND t.project_key = l.project_key WHERE label_status = 'labelled' GROUP BY l.project_key")
def project_summary(x: Layers) -> DataFrame:
    return analysis.project_summary(x.labels, x.thresholds)


# stages


@_query("SELECT * FROM status_intervals")
def status_intervals(x: Layers) -> DataFrame:
    return x.intervals


_EVENT_STAGE = "CASE event_type WHEN 'view' THEN 'Building' WHEN 'click' THEN 'In review' WHEN 'purchase' THEN 'Done' ELSE 'Waiting' END"


@_query(f"""SELECT user_id, stage, count(*) AS spans, sum(seconds)::BIGINT AS seconds FROM (
    SELECT user_id, {_EVENT_STAGE} AS stage, date_diff('second', ts, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-02-01')) AS seconds FROM events) GROUP BY ALL""")
def user_stage_seconds(x: Layers) -> DataFrame:
    """Events as stages that last until the user's next one; boundaries of seconds are counted. A user may have any share of the events."""
    events = x.table("events").select("user_id", "ts", "event_id", F.expr(_EVENT_STAGE).alias("stage"))
    spans = next_time(events, ["user_id"], "ts", [F.col("event_id")], "end_at", 5 * 86_400)
    end = F.coalesce("end_at", F.lit("2024-02-01").cast("timestamp_ntz"))
    return spans.groupBy("user_id", "stage").agg(F.count("*").alias("spans"), F.sum(seconds_between(F.col("ts"), end)).alias("seconds"))


_STAGE_DAYS = ("waiting_days", "building_days", "in_review_days", "resolved_gap_days")


@_query(f"SELECT issue_key, {', '.join(f'round({c} * 86400)::BIGINT AS {c.removesuffix('days')}seconds' for c in _STAGE_DAYS)}, first_active_at, first_review_at, review_rounds, reopen_count FROM ticket_stages")
def stage_durations(x: Layers) -> DataFrame:
    seconds = [F.round(F.col(c) * 86400).cast("long").alias(f"{c.removesuffix('days')}seconds") for c in _STAGE_DAYS]
    return x.ticket_stages.select("issue_key", *seconds, "first_active_at", "first_review_at", "review_rounds", "reopen_count")


@_query("SELECT review_rounds, reopen_count, count(*) AS n FROM ticket_stages GROUP BY ALL")
def review_rounds(x: Layers) -> DataFrame:
    return x.ticket_stages.groupBy("review_rounds", "reopen_count").agg(F.count("*").alias("n"))


@_query("SELECT issue_key, project_key, issue_type, is_delivered, lead_days, cycle_days, wait_to_first_review_days FROM ticket_flow")
def flow_times(x: Layers) -> DataFrame:
    return x.flow.select("issue_key", "project_key", "issue_type", "is_delivered", "lead_days", "cycle_days", "wait_to_first_review_days")


@_query("SELECT status, count(*) AS n FROM status_intervals WHERE stage = 'Unmapped' GROUP BY ALL")
def unmapped_statuses(x: Layers) -> DataFrame:
    return checks.unmapped_statuses(x.intervals)


# analysis


@_query("SELECT issue_key, lead_days, is_late, split, created_year::INT AS created_year, priority, has_assignee, entered_review, entered_active, component_count::INT AS component_count, link_count, comment_count, review_rounds FROM analysis_base")
def analysis_base(x: Layers) -> DataFrame:
    return x.base.select("issue_key", "lead_days", "is_late", "split", "created_year", "priority", "has_assignee", "entered_review", "entered_active", "component_count", "link_count", "comment_count", "review_rounds")


@_query("SELECT * FROM lead_time_profile")
def lead_time_profile(x: Layers) -> DataFrame:
    return analysis.lead_time_profile(x.base)


_SHARE = lambda c: f"round(100 * sum({c}_days) / sum(lead_days), 1) AS {c}_pct"


@_query(f"SELECT project_key, count(*) AS tickets, {_SHARE('waiting')}, {_SHARE('building')}, {_SHARE('in_review')}, {_SHARE('resolved_gap')} FROM analysis_base GROUP BY project_key")
def stage_share(x: Layers) -> DataFrame:
    return analysis.stage_share(x.base)


@_query(f"""SELECT project_key, count(*) AS tickets, {_pct('entered_active')} AS entered_active_pct, {_pct('entered_review')} AS entered_review_pct, {_pct('review_rounds > 0')} AS any_rework_pct, {_pct('reopen_count > 0')} AS reopened_pct,
    round(median(wait_to_first_review_days), 2) AS median_wait_to_review_days, round(quantile_cont(wait_to_first_review_days, 0.75), 2) AS p75_wait_to_review_days, round(median(cycle_days), 2) AS median_cycle_days,
    round(avg(review_rounds) FILTER (entered_review), 2) AS mean_rounds_when_reviewed FROM analysis_base GROUP BY project_key""")
def review_flow(x: Layers) -> DataFrame:
    return analysis.review_flow(x.base)


_CAPPED = lambda c: f"CASE WHEN {c} >= 2 THEN '2+' ELSE {c}::INT::VARCHAR END"
_YES = lambda c: f"CASE WHEN {c} THEN 'yes' ELSE 'no' END"


@_query(f"""WITH levels AS (SELECT is_late, issue_type, {_YES('has_assignee')} AS "has_assignee_at_snapshot", {_YES('entered_review')} AS "entered_review", {_CAPPED('component_count')} AS "component_count_at_snapshot",
    {_CAPPED('link_count')} AS "link_count_at_snapshot", {_CAPPED('review_rounds')} AS "review_rounds (known late)" FROM analysis_base),
    long AS (UNPIVOT levels ON COLUMNS(* EXCLUDE (is_late)) INTO NAME factor VALUE level)
    SELECT factor, level, count(*) AS tickets, {_pct('is_late')} AS late_pct FROM long GROUP BY factor, level HAVING factor <> 'issue_type' OR count(*) >= {P.factor_min}""")
def factor_profile(x: Layers) -> DataFrame:
    return analysis.factor_profile(x.base, P)


@_query(f"SELECT project_key, created_year::INT AS created_year, count(*) AS tickets, round(median(lead_days), 1) AS median_days, {_pct('is_late')} AS late_pct FROM analysis_base GROUP BY ALL")
def trend(x: Layers) -> DataFrame:
    return analysis.trend(x.base)


_MEAN = lambda c: f"round(sum(tickets * {c}) / sum(tickets), 1) AS weighted_{c}"


@_query(f"SELECT project_key, sum(tickets)::BIGINT AS tickets, {_MEAN('median_days')}, {_MEAN('p75_days')}, {_MEAN('late_pct')} FROM lead_time_profile GROUP BY project_key")
def weighted_rollup(x: Layers) -> DataFrame:
    return analysis.weighted_rollup(analysis.lead_time_profile(x.base))


@_query(f"SELECT year(created)::INT AS year, count(*) AS tickets, {_pct('is_late')} AS all_labelled, {_pct('is_late_delivered_only')} AS delivered_only FROM late_labels WHERE label_status IN ('labelled', 'open_known_late') AND year(created) BETWEEN 1996 AND 2000 GROUP BY ALL")
def late_trend(x: Layers) -> DataFrame:
    return analysis.late_trend(x.labels, 1996, 2000)


@_query("SELECT project_key, issue_type, count(*) AS n, round(quantile_cont(lead_days, 0.25), 6) AS low, round(quantile_cont(lead_days, 0.5), 6) AS mid, round(quantile_cont(lead_days, 0.9), 6) AS high FROM kept WHERE lead_days IS NOT NULL GROUP BY ALL")
def exact_quantiles(x: Layers) -> DataFrame:
    return _round(quantiles(x.tickets.filter("exclusion_reason is null"), ["project_key", "issue_type"], "lead_days", {"low": 0.25, "mid": 0.5, "high": 0.9}), 6, "low", "mid", "high")


# load and checks: orders as raw documents, of which some were written twice


def _raw(x: Layers) -> dict[str, DataFrame]:
    text = lambda t: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.when(F.col("o_orderkey") % 3 == 0, "+0200").otherwise("+0000"))
    orders = x.table("orders")
    docs = orders.select(F.col("o_orderkey").cast("string").alias("issue_key"), F.col("o_orderstatus").alias("project_key"), F.when(F.col("o_orderkey") % 41 == 0, "no date").otherwise(text("o_orderdate")).alias("created"), text("o_orderdate").alias("updated"), F.lit(None).cast("string").alias("resolution_date"), F.lit("2001-02-30").alias("due_date"))
    again = docs.filter(F.col("issue_key").cast("long") % 50 == 0)
    lines = x.table("lineitem").select(F.col("l_orderkey").cast("string").alias("issue_key"), F.col("l_linenumber").cast("string").alias("history_id"), F.lit("1998-01-02T03:04:05.678+0100").alias("created"), F.col("l_returnflag").alias("field"), F.col("l_linestatus").alias("to_string"))
    some = lines.filter(F.col("issue_key").cast("long") % 7 != 0).join(docs.select("issue_key"), "issue_key", "left_semi").unionByName(lines.filter(F.col("issue_key").cast("long") % 50 == 0))
    texts = orders.select(F.col("o_orderkey").cast("string").alias("issue_key"), F.repeat(F.lit("t"), (F.col("o_orderkey") % 9).cast("int")).alias("summary"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("description"))
    said = lines.select("issue_key", F.col("history_id").alias("comment_id"), "created", F.lit(None).cast("string").alias("updated"), F.col("field").alias("author"))
    return {"issues": docs.unionByName(again), "changelog": some, "comments": said, "issue_text": texts}


_SOURCE_LINES = "SELECT l_orderkey AS k, l_linenumber AS h, l_returnflag AS f, l_linestatus AS s FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE l_orderkey % 50 = 0"


@_query("""SELECT o_orderkey::VARCHAR AS issue_key, CASE WHEN o_orderkey % 41 <> 0 THEN o_orderdate - CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END END AS created, o_orderdate - CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS updated, NULL::DATE AS due_date FROM orders""")
def dedupe_latest(x: Layers) -> DataFrame:
    return load.load(_raw(x)).issues.select("issue_key", "created", "updated", "due_date")


@_query(f"""WITH s AS ({_SOURCE_LINES}), own AS (SELECT s.* FROM s JOIN orders ON o_orderkey = k WHERE o_orderstatus IN ('F', 'O'))
    SELECT k::VARCHAR AS issue_key, h::VARCHAR AS history_id, TIMESTAMP '1998-01-02 02:04:05.678' AS created, f AS field, s AS to_string FROM own WHERE k % 50 <> 0 UNION ALL SELECT DISTINCT k::VARCHAR, h::VARCHAR, TIMESTAMP '1998-01-02 02:04:05.678', f, s FROM own WHERE k % 50 = 0""")
def conditional_dedupe(x: Layers) -> DataFrame:
    return load.load(_raw(x), ("F", "O")).changelog


@_query("SELECT o_orderkey::VARCHAR AS issue_key, (o_orderkey % 9)::INT AS summary_length, CASE WHEN o_orderkey % 2 = 0 THEN length(o_orderpriority) END::INT AS description_length FROM orders WHERE o_orderstatus = 'P'")
def text_lengths(x: Layers) -> DataFrame:
    return load.load(_raw(x), ("P",)).text_stats


@_query("SELECT count(*) AS n, count(DISTINCT k) AS keys FROM (SELECT CASE WHEN l_orderkey % 10 <> 0 THEN l_orderkey END AS k FROM lineitem) WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_check(x: Layers) -> DataFrame:
    parents = x.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("issue_key"))
    children = x.table("lineitem").select(F.when(F.col("l_orderkey") % 10 != 0, F.col("l_orderkey")).alias("issue_key"))
    return checks.orphans(children, parents).agg(F.count("*").alias("n"), F.count_distinct("issue_key").alias("keys"))


@_query(f"""WITH s AS ({_SOURCE_LINES}), t AS (SELECT * FROM s WHERE k IN (SELECT o_orderkey FROM orders)), loaded AS (SELECT * FROM t WHERE k % 50 <> 0 UNION ALL SELECT DISTINCT * FROM t WHERE k % 50 = 0)
    SELECT *, loaded > source OR source - loaded > in_doubled AS problem FROM (SELECT (SELECT count(*) FROM loaded) AS loaded, (SELECT count(*) FROM s) AS source, (SELECT count(*) FROM s WHERE k % 50 = 0 AND k IN (SELECT o_orderkey FROM orders)) AS in_doubled)""")
def lost_rows(x: Layers) -> DataFrame:
    raw = _raw(x)
    return checks.lost_rows(load.load(raw).changelog, raw["changelog"], checks.doubled_keys(raw["issues"]))


@_query("SELECT o_orderkey::VARCHAR AS issue_key, 2::BIGINT AS n FROM orders WHERE o_orderkey % 50 = 0")
def doubled_keys(x: Layers) -> DataFrame:
    return checks.doubled_keys(_raw(x)["issues"])


@_query("SELECT 'created' AS \"column\", (count(*) FILTER (o_orderkey % 41 = 0) + count(*) FILTER (o_orderkey % 41 = 0 AND o_orderkey % 50 = 0))::BIGINT AS n FROM orders UNION ALL SELECT 'updated', 0")
def unparseable_dates(x: Layers) -> DataFrame:
    return checks.unparseable(_raw(x)["issues"], ["created", "updated"])


@_query("""SELECT *, round(coalesce(known / nullif(able, 0), 0), 4) AS share, coalesce(known / nullif(able, 0), 0) < 0.9 AS problem FROM (SELECT count(*) FILTER (label_status IN ('labelled', 'open_known_late')) AS known, count(*) FILTER (label_status IN ('labelled', 'open_known_late', 'open_unlabelled')) AS able
    FROM late_labels WHERE split = 'test' AND NOT starts_with(label_status, 'excluded:') AND label_status <> 'not_delivered')""")
def labelable_share(x: Layers) -> DataFrame:
    return checks.labelable_share(x.labels)


# features


@_query("SELECT * FROM points")
def points(x: Layers) -> DataFrame:
    return x.points


@_query("SELECT issue_key, point, field, from_string, from_len::INT AS from_len FROM first_after")
def first_after(x: Layers) -> DataFrame:
    return x.first_after


@_query("SELECT issue_key, point, component_net::BIGINT AS component_net, link_net::BIGINT AS link_net FROM net_after")
def net_after(x: Layers) -> DataFrame:
    return x.net


@_query("SELECT issue_key, assignee, start_at, end_at FROM assignee_spans")
def assignee_spans(x: Layers) -> DataFrame:
    return x.spans.drop("seq")


@_query("SELECT assignee, ts, open_n::BIGINT AS open_n FROM assignee_load")
def open_count(x: Layers) -> DataFrame:
    return x.assignee_load


@_query("SELECT project_key, ts, open_n::BIGINT AS open_n FROM project_load")
def project_open_count(x: Layers) -> DataFrame:
    return x.project_load


@_query("SELECT issue_key, prior_n FROM reporter_prior")
def prior_count(x: Layers) -> DataFrame:
    return x.prior


@_query("SELECT * FROM peer_stats")
def trailing_stats(x: Layers) -> DataFrame:
    return x.peer


@_query("SELECT * FROM project_stats")
def trailing_project_stats(x: Layers) -> DataFrame:
    return x.project


@_query("SELECT * FROM activity")
def activity_until(x: Layers) -> DataFrame:
    return x.activity


@_query("SELECT * FROM state")
def state_at(x: Layers) -> DataFrame:
    return x.state


@_query("SELECT * REPLACE (component_count::BIGINT AS component_count, link_count::BIGINT AS link_count, title_length::BIGINT AS title_length, description_length::BIGINT AS description_length, project_open::BIGINT AS project_open, assignee_open::BIGINT AS assignee_open) FROM features")
def feature_table(x: Layers) -> DataFrame:
    return x.features.withColumns({c: F.col(c).cast("long") for c in ("component_count", "link_count", "title_length", "description_length", "project_open", "assignee_open")})




@_query("SELECT c.name AS \"column\", 0::BIGINT AS n FROM (VALUES " + ", ".join(f"('{c}')" for c in features.LATER_COLUMNS) + ") AS c(name)")
def filled_at_creation(x: Layers) -> DataFrame:
    return checks.filled_at_creation(x.features, features.LATER_COLUMNS)


# as-of joins by themselves: purchases look up the user's last views and clicks


def _asks(x: Layers) -> DataFrame:
    return x.table("events").filter("event_type = 'purchase'").select("event_id", "user_id", "ts")


def _seen(x: Layers, kind: str) -> DataFrame:
    return x.table("events").filter(F.col("event_type") == kind).select(F.col("user_id").alias("who"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at"), F.col("event_id").alias("n"), "value")


_SEEN = lambda kind: f"(SELECT user_id AS who, date_trunc('hour', ts) AS at, event_id AS n, value FROM events WHERE event_type = '{kind}' QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id DESC) = 1)"


@_query(f"SELECT event_id, user_id, ts, n AS view_id, value AS view_value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN {_SEEN('view')} v ON p.user_id = v.who AND p.ts >= v.at")
def asof_ge(x: Layers) -> DataFrame:
    return asof_join(_asks(x), _seen(x, "view"), {"user_id": "who"}, "ts", "at", {"n": "view_id", "value": "view_value"}, ["n"], seconds=5 * 86_400)


@_query(f"SELECT event_id, user_id, hour, n AS view_id, n IS NOT NULL AS found FROM (SELECT event_id, user_id, date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN {_SEEN('view')} v ON p.user_id = v.who AND p.hour > v.at")
def asof_strict(x: Layers) -> DataFrame:
    asks = _asks(x).select("event_id", "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return asof_join(asks, _seen(x, "view"), {"user_id": "who"}, "hour", "at", {"n": "view_id"}, ["n"], strict=True, seconds=5 * 86_400, matched="found")


@_query(f"""WITH a AS (SELECT event_id, user_id, ts, n AS view_id, n % 150 AS next_user FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN {_SEEN('view')} v ON p.user_id = v.who AND p.ts >= v.at)
    SELECT event_id, user_id, ts, view_id, next_user, n AS click_id FROM a ASOF LEFT JOIN {_SEEN('click')} c ON a.next_user = c.who AND a.ts >= c.at""")
def asof_chained(x: Layers) -> DataFrame:
    first = asof_join(_asks(x), _seen(x, "view"), {"user_id": "who"}, "ts", "at", {"n": "view_id"}, ["n"], seconds=5 * 86_400).withColumn("next_user", F.col("view_id") % 150)
    return asof_join(first, _seen(x, "click"), {"next_user": "who"}, "ts", "at", {"n": "click_id"}, ["n"], seconds=5 * 86_400)


# models: baselines, metrics, explanations


@_query("SELECT issue_key, point, project_score FROM scored")
def baseline_project(x: Layers) -> DataFrame:
    return x.scored.select("issue_key", "point", "project_score")


@_query("SELECT issue_key, point, peer_score FROM scored")
def baseline_peer(x: Layers) -> DataFrame:
    return x.scored.select("issue_key", "point", "peer_score")


_AUC = "round(sum(pos * ((n_all - pos_all) - (n_upto - pos_upto) + 0.5 * (n - pos))) / nullif(max(pos_all * (n_all - pos_all)), 0), 9)"


@_query("SELECT point, round(sum(pos * pos_upto / n_upto) / max(pos_all), 9) AS average_precision FROM ranked_scores GROUP BY point")
def average_precision(x: Layers) -> DataFrame:
    return metrics.score_counts(x.scored, "is_late", "peer_score", ["point"]).groupBy("point").agg(F.round(metrics.average_precision(), 9).alias("average_precision"))


@_query(f"SELECT point, {_AUC} AS roc_auc FROM ranked_scores GROUP BY point")
def roc_auc(x: Layers) -> DataFrame:
    return metrics.score_counts(x.scored, "is_late", "peer_score", ["point"]).groupBy("point").agg(F.round(metrics.roc_auc(), 9).alias("roc_auc"))


@_query("""SELECT point, round(avg((p - is_late::INT) ** 2), 9) AS brier, round(-avg(CASE WHEN is_late THEN ln(p) ELSE ln(1 - p) END), 9) AS log_loss FROM (SELECT *, least(greatest(peer_score, 1e-6), 1 - 1e-6) AS p FROM scored) GROUP BY point""")
def brier_logloss(x: Layers) -> DataFrame:
    return x.scored.groupBy("point").agg(F.round(metrics.brier("is_late", "peer_score"), 9).alias("brier"), F.round(metrics.log_loss("is_late", "peer_score"), 9).alias("log_loss"))


_TOP = """SELECT {keys}, max(k) AS k, round(sum(late) FILTER (rank <= k) / max(k), 9) AS precision, round(sum(late) FILTER (rank <= k) / greatest(sum(late), 1), 9) AS recall, round((sum(late) FILTER (rank <= k) / max(k)) / nullif(avg(late), 0), 9) AS lift FROM (
    SELECT *, is_late::INT AS late, row_number() OVER (PARTITION BY {keys} ORDER BY peer_score DESC, (issue_key * 2654435761) % 1000003, issue_key) AS rank, greatest(ceil(0.1 * count(*) OVER (PARTITION BY {keys})), 1)::BIGINT AS k FROM scored) GROUP BY {keys}"""
_TIE = lambda: F.struct((F.col("issue_key") * F.lit(2654435761)) % 1000003, F.col("issue_key"))


@_query(_TOP.format(keys="point"))
def precision_top(x: Layers) -> DataFrame:
    return _round(metrics.top_fraction(x.scored, "is_late", "peer_score", _TIE(), ["point"]), 9, "precision", "recall", "lift")


@_query("""SELECT bin::INT AS bin, round(avg(peer_score) * 10000) / 10000 AS predicted, round(avg(is_late::INT) * 10000) / 10000 AS observed, count(*) AS n FROM (
    SELECT *, greatest(ceil((row_number() OVER (ORDER BY peer_score, issue_key) - 1) * 10 / greatest(count(*) OVER () - 1, 1)) - 1, 0) AS bin FROM scored WHERE point = 'creation') GROUP BY bin""")
def calibration_table(x: Layers) -> DataFrame:
    return metrics.calibration_table(x.scored.filter("point = 'creation'"), "is_late", "peer_score", "issue_key")


@_query(f"""WITH g AS (SELECT point, project_key, peer_score AS s, count(*) AS n, sum(is_late::INT) AS pos FROM scored GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER d AS n_upto, sum(pos) OVER d AS pos_upto, sum(n) OVER o AS n_all, sum(pos) OVER o AS pos_all FROM g WINDOW d AS (PARTITION BY point, project_key ORDER BY s DESC), o AS (PARTITION BY point, project_key)),
    t AS ({_TOP.format(keys='point, project_key')})
    SELECT r.point, r.project_key, max(n_all)::BIGINT AS n, round(max(pos_all) / max(n_all), 9) AS late_rate, round(sum(pos * pos_upto / n_upto) / max(pos_all), 9) AS average_precision, {_AUC} AS roc_auc, any_value(t.precision) AS precision, any_value(t.lift) AS lift
    FROM r JOIN t ON t.point = r.point AND t.project_key = r.project_key GROUP BY r.point, r.project_key HAVING max(pos_all) BETWEEN 1 AND max(n_all) - 1""")
def per_group_metrics(x: Layers) -> DataFrame:
    keys = ["point", "project_key"]
    counts = metrics.score_counts(x.scored, "is_late", "peer_score", keys)
    rates = counts.groupBy(*keys).agg(F.max("_n_all").alias("n"), F.max("_pos_all").alias("_p"), F.round(metrics.average_precision(), 9).alias("average_precision"), F.round(metrics.roc_auc(), 9).alias("roc_auc"))
    rates = rates.filter("_p between 1 and n - 1").withColumn("late_rate", F.round(F.col("_p") / F.col("n"), 9)).drop("_p")
    top = _round(metrics.top_fraction(x.scored, "is_late", "peer_score", _TIE(), keys), 9, "precision", "lift")
    return rates.join(top.select(*keys, "precision", "lift"), keys)


_TYPICAL = ["title_length", "description_length", "project_open", "assignee_open", "link_count", "component_count"]


@_query(f"SELECT point, project_key, {', '.join(f'coalesce(a.{c}, o.{c}) AS {c}' for c in _TYPICAL)} FROM (SELECT point, project_key, {', '.join(f'median({c})::DOUBLE AS {c}' for c in _TYPICAL)} FROM known GROUP BY ALL) a JOIN (SELECT point, {', '.join(f'median({c})::DOUBLE AS {c}' for c in _TYPICAL)} FROM known GROUP BY ALL) o USING (point)")
def typical_fallback(x: Layers) -> DataFrame:
    return model_frames.typical_values(x.known, _TYPICAL)


#: A linear model stands in for the trained one, so that SQL can follow.
_WEIGHTS = {"priority_rank": 0.75, "link_count": 0.25, "assignee_open": -0.125, "project_open": 0.0078125, "peer_late_rate": 0.5, "title_length": -0.00390625, "reporter_prior_tickets": 0.0625}
_LINEAR = "SELECT issue_key, point, f.name AS feature, CASE f.name " + " ".join(f"WHEN '{c}' THEN coalesce({c}, 0) * {w} * 25.0::DOUBLE" for c, w in _WEIGHTS.items()) + " END AS points FROM features, (VALUES " + ", ".join(f"('{c}')" for c in _WEIGHTS) + ") AS f(name)"
_THEME = "CASE " + " ".join(f"WHEN list_contains({_list(names)}, feature) THEN '{theme}'" for theme, names in model_frames.THEMES.items()) + " END"


def _contributions(x: Layers) -> DataFrame:
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in _WEIGHTS.items()}
    long = model_frames.long_form(x.features, ["issue_key", "point"], values)
    return long.withColumn("points", model_frames.points_of(F.col("value"), F.lit(0.5))).drop("value")


@_query(f"SELECT issue_key, point, {_THEME} AS theme, round(sum(points) * 10) / 10 AS points FROM ({_LINEAR}) GROUP BY ALL")
def theme_totals(x: Layers) -> DataFrame:
    return model_frames.theme_totals(_contributions(x), ["issue_key", "point"])


@_query(f"SELECT issue_key, point, rank::INT AS rank, feature, {_THEME} AS theme, round(points * 10) / 10 AS points FROM (SELECT *, row_number() OVER (PARTITION BY issue_key, point ORDER BY abs(points) DESC, feature) AS rank FROM ({_LINEAR})) WHERE rank <= 5")
def topk_reasons(x: Layers) -> DataFrame:
    return model_frames.top_reasons(_contributions(x), ["issue_key", "point"])


@_query("SELECT CASE WHEN reporter_prior_tickets IS NULL THEN -1 ELSE (reporter_prior_tickets >= 1)::INT + (reporter_prior_tickets >= 2)::INT + (reporter_prior_tickets >= 5)::INT END::INT AS bin, count(*) AS n, round(avg(link_count * 0.25::DOUBLE * 25) * 100) / 100 AS mean FROM features WHERE point = 'creation' GROUP BY ALL")
def binned_dependence(x: Layers) -> DataFrame:
    rows = x.features.filter("point = 'creation'").withColumn("points", F.col("link_count") * 0.25 * 25)
    return model_frames.binned_means(rows, "reporter_prior_tickets", "points", [1, 2, 5])


@_query(f"SELECT has_assignee, count(*) AS n, {_pct('is_late')} AS late_pct FROM features JOIN late_labels l USING (issue_key) WHERE point = 'creation' AND is_late IS NOT NULL GROUP BY ALL")
def late_by_assigned(x: Layers) -> DataFrame:
    return analysis.late_by_assigned(x.features, x.labels)


@_query(f"SELECT ((assignee_open >= 1)::INT + (assignee_open >= 3)::INT + (assignee_open >= 10)::INT)::INT AS bucket, count(*) AS n, min(assignee_open)::BIGINT AS least, max(assignee_open)::BIGINT AS most, {_pct('is_late')} AS late_pct FROM features JOIN late_labels l USING (issue_key) WHERE point = 'creation' AND is_late IS NOT NULL AND assignee_open IS NOT NULL GROUP BY ALL")
def workload_buckets(x: Layers) -> DataFrame:
    return analysis.workload_buckets(x.features, x.labels)


# what leaves the models: the linear stand-in's scores and explanations


_PARTS = "parts AS (SELECT issue_key, point, f.name AS feature, CASE f.name " + " ".join(f"WHEN '{c}' THEN coalesce({c}, 0) * {w}::DOUBLE" for c, w in _WEIGHTS.items()) + " END AS contribution FROM features, (VALUES " + ", ".join(f"('{c}')" for c in _WEIGHTS) + ") AS f(name))"
_CHANCES = f"""{_PARTS}, chances AS (SELECT issue_key, point, 1 / (1 + exp(1.5 - sum(contribution))) AS score FROM parts GROUP BY ALL),
    shown AS (SELECT c.*, m.project_key, l.issue_type, l.is_late, label_status, round(greatest(least(score, 0.95), 0.05), 3) AS shown, strftime(l.created, '%Y-%m-%d') AS filed, round(date_diff('second', l.created, TIMESTAMP '{P.snapshot}') / 86400.0::DOUBLE * 10) / 10 AS age_days
        FROM chances c JOIN features m ON m.issue_key = c.issue_key AND m.point = c.point JOIN late_labels l ON l.issue_key = c.issue_key),
    cuts AS (SELECT point, quantile_cont(score, 0.9) AS cutoff FROM shown WHERE is_late IS NOT NULL GROUP BY point),
    risky AS (SELECT shown.*, score >= cutoff - 1e-12 AS top FROM shown JOIN cuts USING (point))"""


def _parts(x: Layers) -> DataFrame:
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in _WEIGHTS.items()}
    return model_frames.long_form(x.features, ["issue_key", "point"], values, value="contribution")


def _flagged(x: Layers) -> DataFrame:
    rows = x.features.select("issue_key", "point", "project_key").join(x.labels.select("issue_key", "issue_type", "is_late", "label_status", "created"), "issue_key")
    scored = reports.scored_tickets(_parts(x), rows, -1.5, P)
    return reports.flag_top(scored, scored.filter("is_late is not null")).withColumn("top", F.col("score") >= F.col("cutoff") - 1e-12)


@_query(f"WITH {_CHANCES} SELECT issue_key, point, round(score, 9) AS score, shown, filed, age_days FROM shown")
def scored_tickets(x: Layers) -> DataFrame:
    return _round(_flagged(x), 9, "score").select("issue_key", "point", "score", "shown", "filed", "age_days")


@_query(f"WITH {_CHANCES} SELECT point, round(cutoff, 9) AS cutoff, count(*) FILTER (top) AS n_top, count(*) AS n FROM risky JOIN cuts USING (point) WHERE is_late IS NOT NULL GROUP BY ALL")
def top_tenth(x: Layers) -> DataFrame:
    return _flagged(x).filter("is_late is not null").groupBy("point", F.round("cutoff", 9).alias("cutoff")).agg(F.count_if("top").alias("n_top"), F.count("*").alias("n"))


@_query(f"WITH {_CHANCES} SELECT issue_key, project_key, issue_type, shown, age_days, top FROM risky WHERE label_status = 'open_unlabelled' AND point = 'day7' AND project_key IN ('BUILDING', 'MACHINERY') ORDER BY shown DESC, issue_key")
def open_tickets(x: Layers) -> DataFrame:
    return reports.open_tickets(_flagged(x), "day7", ("BUILDING", "MACHINERY"))


@_query(f"WITH {_CHANCES} SELECT point, project_key, top, count(*) AS n, count(*) FILTER (is_late) AS late, {_pct('is_late')} AS late_pct FROM risky WHERE is_late IS NOT NULL GROUP BY ALL")
def backtest_rates(x: Layers) -> DataFrame:
    return reports.backtest_rates(_flagged(x))


@_query("SELECT issue_key, point FROM features WHERE point = 'creation' ORDER BY md5(concat_ws(':', issue_key, '7')) LIMIT 100")
def seeded_sample(x: Layers) -> DataFrame:
    """A hundred rows: the sample is the feature."""
    return reports.sample(x.features.filter("point = 'creation'").select("issue_key", "point"), F.col("issue_key"), 100, 7)


@_query(f"WITH {_PARTS} SELECT feature, {_THEME} AS theme, round(avg(abs(contribution)), 9) AS mean_abs FROM parts GROUP BY feature")
def feature_importance(x: Layers) -> DataFrame:
    return _round(reports.mean_sizes(_parts(x), []), 9, "mean_abs")


@_query(f"WITH {_PARTS}, sums AS (SELECT issue_key, point, {_THEME} AS theme, sum(contribution) AS s FROM parts GROUP BY ALL) SELECT theme, list_position({_list(tuple(model_frames.THEMES))}, theme)::BIGINT AS place, round(avg(abs(s)), 9) AS mean_abs FROM sums GROUP BY theme")
def theme_importance(x: Layers) -> DataFrame:
    return _round(reports.theme_importance(_parts(x), ["issue_key", "point"]), 9, "mean_abs")


@_query(f"WITH {_PARTS}, means AS (SELECT project_key, feature, round(avg(abs(contribution)), 9) AS mean_abs FROM parts p JOIN (SELECT issue_key, point, project_key FROM features) USING (issue_key, point) GROUP BY ALL) SELECT project_key, rank::INT AS rank, feature, {_THEME} AS theme, mean_abs FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY mean_abs DESC, feature) AS rank FROM means) WHERE rank <= 5")
def project_top_features(x: Layers) -> DataFrame:
    parts = _parts(x).join(x.features.select("issue_key", "point", "project_key"), ["issue_key", "point"])
    return _round(reports.top_features(parts, "project_key"), 9, "mean_abs")


@_query("""WITH rows AS (SELECT description_length AS x, link_count * 6.25::DOUBLE AS y FROM features WHERE point = 'creation'), cuts AS (SELECT list_distinct(quantile_cont(x, [0, 1/6, 2/6, 3/6, 4/6, 5/6, 1])) AS e FROM rows),
    placed AS (SELECT y, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(e, lambda c: c < x AND c > list_min(e) AND c < list_max(e))) END AS bin FROM rows, cuts) SELECT bin::INT AS bin, count(*) AS n, round(avg(y), 6) AS mean FROM placed GROUP BY ALL""")
def quantile_dependence(x: Layers) -> DataFrame:
    rows = x.features.filter("point = 'creation'").select("description_length", (F.col("link_count") * 6.25).alias("y"))
    return reports.quantile_bins(rows, "description_length", "y", 6)


@_query("SELECT project_key, round(avg(100 * is_late::INT) FILTER (has_assignee)) AS assigned_pct, round(avg(100 * is_late::INT) FILTER (NOT has_assignee)) AS unassigned_pct FROM (SELECT issue_key, project_key, has_assignee FROM features WHERE point = 'creation') JOIN late_labels l USING (issue_key, project_key) WHERE is_late IS NOT NULL GROUP BY project_key")
def late_by_project_and_assigned(x: Layers) -> DataFrame:
    return reports.late_by_project_and_assigned(x.features, x.labels)


@_query("""WITH first_given AS (SELECT issue_key, created FROM changelog WHERE field = 'assignee' AND to_value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY issue_key ORDER BY created) = 1)
    SELECT count(*) AS n, count_if(epoch(g.created) - epoch(f.t_at) BETWEEN 1 AND 864000)::BIGINT AS soon, count_if(g.issue_key IS NULL)::BIGINT AS never FROM features f LEFT JOIN first_given g ON g.issue_key = f.issue_key WHERE point = 'creation' AND has_assignee""")
def assigned_after_creation(x: Layers) -> DataFrame:
    """Within ten days: the surrogate's changes are days apart."""
    return reports.assigned_after_creation(x.features, x.rel.changelog, 864_000)


@_query("""WITH rates AS (SELECT CASE WHEN assignee_open >= 11 THEN 4 WHEN assignee_open >= 6 THEN 3 WHEN assignee_open >= 3 THEN 2 WHEN assignee_open >= 1 THEN 1 ELSE 0 END AS bucket, round(avg(100 * is_late::INT)) AS rate
    FROM features JOIN late_labels l USING (issue_key) WHERE point = 'creation' AND has_assignee AND is_late IS NOT NULL GROUP BY bucket) SELECT min(rate) AS least, max(rate) AS most FROM rates""")
def workload_range(x: Layers) -> DataFrame:
    return reports.workload_range(x.features, x.labels)


@_query(f"SELECT project_key, created_year::INT AS year, count(*) AS tickets, round(median(lead_days), 1) AS median_days, {_pct('is_late')} AS late_pct FROM analysis_base WHERE created_year BETWEEN 1996 AND 1999 GROUP BY ALL")
def late_by_project_year(x: Layers) -> DataFrame:
    return analysis.trend(x.base).filter("created_year between 1996 and 1999").withColumnRenamed("created_year", "year")


_MIX = lambda x: f"(xor({x}, {x} >> 16) * {resampling.MIXER}) % 4294967296"
_TIMES = " + ".join(f"(u > {c!r}::DOUBLE)::INT" for c in poisson_steps())


def _bootstrap_sql(replicates: int) -> str:
    """Each row as often as drawn, for each replicate and model; precision at each score, from sums over equal scores."""
    return f"""seeds AS (SELECT s.*, replicate, (('0x' || substr(md5(issue_key::VARCHAR), 1, 8))::BIGINT + replicate * {resampling.STEP}) % 4294967296 AS x0 FROM scored s, range(1, {replicates + 1}) AS r(replicate) WHERE point = 'creation'),
    once AS (SELECT *, {_MIX('x0')} AS x1 FROM seeds), twice AS (SELECT *, {_MIX('x1')} AS x2 FROM once), drawn AS (SELECT *, (xor(x2, x2 >> 16) % 1073741824 + 0.5::DOUBLE) / 1073741824 AS u FROM twice), weighted AS (SELECT *, {_TIMES} AS w FROM drawn),
    long AS (SELECT replicate, 'peer' AS model, peer_score AS s, is_late, w FROM weighted UNION ALL SELECT replicate, 'project', project_score, is_late, w FROM weighted),
    sums AS (SELECT replicate, model, s, sum(w) AS n, coalesce(sum(w) FILTER (is_late), 0) AS late FROM long GROUP BY ALL HAVING sum(w) > 0),
    upto AS (SELECT replicate, model, late, late * sum(late) OVER w / sum(n) OVER w AS part FROM sums WINDOW w AS (PARTITION BY replicate, model ORDER BY s DESC)),
    ap AS (SELECT replicate, model, sum(part) / sum(late) AS ap FROM upto GROUP BY ALL),
    draws AS (SELECT replicate::INT AS replicate, max(ap) FILTER (model = 'project') AS project_score, max(ap) FILTER (model = 'peer') AS peer_score FROM ap GROUP BY replicate)"""


def _draws(x: Layers, replicates: int) -> DataFrame:
    bits = F.conv(F.substring(F.md5(F.col("issue_key").cast("string")), 1, 8), 16, 10).cast("long")
    return resampling.bootstrap(x.scored.filter("point = 'creation'"), "is_late", ["project_score", "peer_score"], "issue_key", replicates, bits=bits)


@_query(f"WITH {_bootstrap_sql(10)} SELECT replicate, round(peer_score, 9) AS peer_score, round(project_score, 9) AS project_score FROM draws")
def bootstrap_draws(x: Layers) -> DataFrame:
    return _round(_draws(x, 10), 9, "peer_score", "project_score")


@_query(f"""WITH {_bootstrap_sql(1000)}, named AS (SELECT 'project_score' AS name, project_score AS v FROM draws UNION ALL SELECT 'peer_score', peer_score FROM draws UNION ALL SELECT 'peer_score - project_score', peer_score - project_score FROM draws)
    SELECT name, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high, CASE WHEN contains(name, ' - ') THEN quantile_cont(v, 0.025) > 0 END AS wins FROM named GROUP BY name""")
def bootstrap_intervals(x: Layers) -> DataFrame:
    return _round(resampling.intervals(_draws(x, 1000), ["project_score", "peer_score"]), 9, "mean", "low", "high")


@_query(f"""WITH {_bootstrap_sql(1000)} SELECT 'peer_score' AS model, 'project_score' AS against, round(avg(peer_score - project_score), 9) AS mean, round(quantile_cont(peer_score - project_score, 0.025), 9) AS low, round(quantile_cont(peer_score - project_score, 0.975), 9) AS high FROM draws""")
def model_differences(x: Layers) -> DataFrame:
    """What one model's draws gain over another's."""
    rows = resampling.intervals(_draws(x, 1000), ["project_score", "peer_score"]).filter("name like 'peer_score - %'")
    return _round(rows.select(F.split("name", " - ")[0].alias("model"), F.split("name", " - ")[1].alias("against"), "mean", "low", "high"), 9, "mean", "low", "high")


_PRIORITY_ORDER = tuple(name for name, _ in RANKS)


@_query(f"SELECT list_position({_list(_PRIORITY_ORDER)}, priority)::INT AS place, priority, count(*) AS n, {_pct('is_late')} AS late_pct FROM analysis_base WHERE priority IN {_PRIORITY_ORDER} GROUP BY priority")
def priority_profile(x: Layers) -> DataFrame:
    return analysis.priority_profile(x.base, _PRIORITY_ORDER)


@_query("""WITH own AS (SELECT point, is_late_delivered_only AS late, peer_score AS s FROM scored WHERE is_late_delivered_only IS NOT NULL), counts AS (SELECT point, s, count(*) AS n, sum(late::INT) AS pos FROM own GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER d AS n_upto, sum(pos) OVER d AS pos_upto, sum(n) OVER o AS n_all, sum(pos) OVER o AS pos_all FROM counts WINDOW d AS (PARTITION BY point ORDER BY s DESC), o AS (PARTITION BY point)),
    clipped AS (SELECT point, late, least(greatest(s, 1e-6), 1 - 1e-6) AS p FROM own), losses AS (SELECT point, round(avg((p - late::INT) ** 2), 9) AS brier, round(-avg(CASE WHEN late THEN ln(p) ELSE ln(1 - p) END), 9) AS log_loss FROM clipped GROUP BY point)
    SELECT point, max(n_all)::BIGINT AS n, round(max(pos_all) / max(n_all), 9) AS late_rate, round(sum(pos * pos_upto / n_upto) / max(pos_all), 9) AS average_precision, round(sum(pos * ((n_all - pos_all) - (n_upto - pos_upto) + 0.5 * (n - pos))) / max(pos_all * (n_all - pos_all)), 9) AS roc_auc, any_value(brier) AS brier, any_value(log_loss) AS log_loss
    FROM r JOIN losses USING (point) GROUP BY point HAVING max(pos_all) BETWEEN 1 AND max(n_all) - 1""")
def delivered_only_metrics(x: Layers) -> DataFrame:
    """How the peers' score does on delivered tickets alone; points with both outcomes."""
    rows = x.scored.filter("is_late_delivered_only is not null")
    counts = metrics.score_counts(rows, "is_late_delivered_only", "peer_score", ["point"])
    ranks = counts.groupBy("point").agg(F.max("_n_all").alias("n"), F.max("_pos_all").alias("_p"), metrics.average_precision().alias("average_precision"), metrics.roc_auc().alias("roc_auc")).filter("_p between 1 and n - 1").withColumn("late_rate", F.col("_p") / F.col("n"))
    losses = rows.groupBy("point").agg(metrics.brier("is_late_delivered_only", "peer_score").alias("brier"), metrics.log_loss("is_late_delivered_only", "peer_score").alias("log_loss"))
    return _round(ranks.drop("_p").join(losses, "point"), 9, "late_rate", "average_precision", "roc_auc", "brier", "log_loss")


_CUTOFFS = (datetime(1996, 7, 1), datetime(1997, 7, 1), datetime(1998, 1, 1))
_KNOWN_AT = lambda c: f"created < {_ts(c)} AND is_late IS NOT NULL AND (coalesce(resolution_date < {_ts(c)}, FALSE) OR {_days('created', _ts(c))} > threshold_days)"
_YEAR_AFTER = lambda c: f"created >= {_ts(c)} AND created < {_ts(c.replace(year=c.year + 1))} AND is_late IS NOT NULL"


@_query(" UNION ALL ".join(f"SELECT point, {_ts(c)} AS cutoff, count(*) FILTER ({_KNOWN_AT(c)}) AS n_train, count(*) FILTER ({_KNOWN_AT(c)} AND is_late) AS late_train, count(*) FILTER ({_YEAR_AFTER(c)}) AS n_valid, count(*) FILTER ({_YEAR_AFTER(c)} AND is_late) AS late_valid FROM model_frame GROUP BY point" for c in _CUTOFFS))
def fold_sizes(x: Layers) -> DataFrame:
    """Each fold's rows: what was known at its cutoff, and the year after it; all folds in one pass."""
    counts = [F.struct(F.lit(c).cast("timestamp_ntz").alias("cutoff"), *(F.count_if(h & late).alias(n) for k, side in enumerate(("train", "valid")) for h in [together.fold_flags(c)[k]] for n, late in ((f"n_{side}", F.lit(True)), (f"late_{side}", F.col("is_late"))))) for c in _CUTOFFS]
    return x.frame.groupBy("point").agg(F.array(*counts).alias("folds")).select("point", F.explode("folds").alias("f")).select("point", "f.*")


@_query("""WITH c AS (SELECT peer_score AS score, count(*) AS n, sum(is_late::INT) AS pos FROM scored WHERE point = 'creation' GROUP BY peer_score), p AS (SELECT *, row_number() OVER up AS i, sum(n) OVER up AS n_upto, sum(pos) OVER up AS pos_upto FROM c WINDOW up AS (ORDER BY score)),
    means AS (SELECT a.i AS first, b.i AS last, (b.pos_upto - a.pos_upto + a.pos) / (b.n_upto - a.n_upto + a.n) AS mean FROM p a JOIN p b ON b.i >= a.i),
    least AS (SELECT first, last, min(mean) OVER (PARTITION BY first ORDER BY last DESC) AS mean FROM means)
    SELECT score, round(max(mean), 9) AS calibrated, any_value(n) AS n FROM least JOIN p ON p.i = last GROUP BY score""")
def isotonic_map(x: Layers) -> DataFrame:
    """The calibrated value of each score: the greatest, over starts below it, of the least mean, over ends above it."""
    rows = x.scored.filter("point = 'creation'").select("is_late", F.col("peer_score").alias("score"))
    fitted = isotonic.Isotonic.fit(rows, "is_late", "score")
    return _round(fitted.apply(rows.groupBy("score").agg(F.count("*").alias("n")), "score"), 9, "calibrated")


def _numbers(x: Layers, point: str) -> DataFrame:
    """Model rows of a point, outcomes as numbers."""
    return x.frame.filter(F.col("point") == point).withColumn("is_late", F.col("is_late").cast("double"))


def _only_spark(f: Callable[[Layers], DataFrame]) -> Callable[[Layers], DataFrame]:
    """Register a query that SQL cannot express; tests compare it with plain versions."""
    _SPARK[f.__name__] = f
    return f


@_only_spark
def tune_scores(x: Layers) -> DataFrame:
    """The average precision of each C on each fold, all fitted together."""
    return _round(together.tune_together("creation", _numbers(x, "creation"), _CUTOFFS, [p["C"] for p in models.LOGISTIC_GRID], models.MIN_TRAIN, models.MIN_VALID), 6, "average_precision")


@_only_spark
def ablation_scores(x: Layers) -> DataFrame:
    """How the model does without each group of columns, in the test window."""
    rows = _numbers(x, "creation")
    found = explain.ablations("logistic", "creation", model_frames.known_at(rows, P.train_cutoff), rows.filter("split = 'test' and is_late is not null"), {"C": 0.3})
    return _round(x.spark.createDataFrame([(f["name"], f["average_precision"], f["roc_auc"]) for f in found], "name string, average_precision double, roc_auc double"), 6, "average_precision", "roc_auc")


@_only_spark
def stability(x: Layers) -> DataFrame:
    """How the ranking of features moves in 20 refits on resampled rows and in refits on what was known earlier, all fitted together."""
    rows = _numbers(x, "creation")
    train = model_frames.known_at(rows, P.train_cutoff)
    found = explain.stability_together("creation", train, train, 0.3, "issue_key", _CUTOFFS[1:])
    named = [(f"resample {f['resample']}" if "resample" in f else f"known at {f['known_at']:%Y-%m-%d}", f["spearman"], f["top3_overlap"], f["top3"]) for f in found]
    return _round(x.spark.createDataFrame(named, "refit string, spearman double, top3_overlap int, top3 array<string>"), 6, "spearman")


def _trained(x: Layers, point: str) -> together.Linear | None:
    """The model of what was known at the cutoff; None where that lacks an outcome."""
    return together.fit_together(_numbers(x, point), point, [together.Spec("trained", model_frames.known_at_flag(P.train_cutoff).cast("int"), 0.3)])[0]


def _features(point: str) -> list[str]:
    """The columns that the trained model rests on."""
    return [c for names in together.plain_columns(point) for c in names]


@_query("SELECT count(*) AS n, 0::BIGINT AS off FROM model_frame WHERE point = 'creation'")
def contributions_add_up(x: Layers) -> DataFrame:
    """For how many tickets the trained model's contributions miss its log-odds by over 1e-6; for none where there is no model."""
    rows, model = _numbers(x, "creation").drop("score"), _trained(x, "creation")
    if model is None:
        return rows.agg(F.count("*").alias("n"), F.count_if(F.lit(False)).alias("off"))
    sums = together.contributions_together(rows, ["issue_key"], [model]).groupBy("issue_key").agg(F.sum("contribution").alias("_sum"))
    scored = together.scored_together(rows, [model]).select("issue_key", F.col("scores")[0].alias("_p")).join(sums, "issue_key")
    return scored.agg(F.count("*").alias("n"), F.count_if(F.abs(F.log(F.col("_p") / (1 - F.col("_p"))) - F.col("_sum") - model.base()) > 1e-6).alias("off"))


@_only_spark
def trained_importance(x: Layers) -> DataFrame:
    """The mean size of each feature's contribution to the trained model, by theme; null where there is no model."""
    model = _trained(x, "creation")
    sizes = together.importance_together(_numbers(x, "creation"), [model])["trained"] if model else dict.fromkeys(_features("creation"))
    rows = x.spark.createDataFrame(list(sizes.items()), "feature string, mean_abs double")
    return _round(rows.withColumn("theme", model_frames.theme_of(F.col("feature"))), 6, "mean_abs")


@_only_spark
def permutation_drops(x: Layers) -> DataFrame:
    """How much average precision in the test window falls when a column's values are dealt anew; null where there is no model."""
    rows = _numbers(x, "creation")
    model = _trained(x, "creation")
    # what is dealt and scored goes through Python once for each feature and repeat
    test = rows.filter("split = 'test' and is_late is not null").select("issue_key", "is_late", *_features("creation"))
    score = (lambda df: together.scored_together(df, [model]).withColumn("score", F.col("scores")[0])) if model else None
    return _round(explain.permutation_drops(test, score, "issue_key", _features("creation")), 6, "drop", "drop_deviation")


_SAID = {
    "link_count": "CASE WHEN link_count = 0 THEN 'No linked tickets' WHEN link_count = 1 THEN '1 linked ticket' ELSE link_count || ' linked tickets' END",
    "component_count": "CASE WHEN component_count = 0 THEN 'No component set' WHEN component_count = 1 THEN '1 component set' ELSE component_count || ' components set' END",
    "reporter_prior_tickets": "CASE WHEN reporter_prior_tickets IS NULL THEN 'Reporter unknown' WHEN reporter_prior_tickets = 0 THEN 'First ticket this reporter has filed' WHEN reporter_prior_tickets = 1 THEN 'Reporter has filed 1 earlier ticket' ELSE 'Reporter has filed ' || reporter_prior_tickets || ' earlier tickets' END",
    "assignee_open": "CASE WHEN assignee_open IS NULL THEN 'Not assigned ' || CASE point WHEN 'creation' THEN 'when filed' ELSE 'by day 7' END ELSE 'Assigned ' || CASE point WHEN 'creation' THEN 'when filed' ELSE 'by day 7' END || ' (assignee has ' || assignee_open || ' other open tickets)' END",
    "priority_rank": "CASE WHEN priority_rank IS NULL THEN 'No priority set' ELSE 'Priority is in the ' || CASE WHEN priority_rank >= 0.9 THEN 'top' WHEN priority_rank >= 0.65 THEN 'upper' WHEN priority_rank >= 0.4 THEN 'middle' WHEN priority_rank >= 0.15 THEN 'lower' ELSE 'bottom' END || ' part of its project''s scale' END",
    "peer_n": "CASE WHEN peer_n IS NULL THEN 'No similar resolved tickets to compare with' WHEN peer_n < 30 THEN 'Only ' || peer_n || ' similar tickets resolved so far to compare with' ELSE 'Compared with the last ' || peer_n || ' similar tickets' END",
    "issue_type": "coalesce('Issue type: ' || issue_type, 'Issue type not available')",
    "workflow_family": "CASE workflow_family WHEN 'jira_review' THEN 'Review happens in Jira statuses (Patch Available)' ELSE 'Review happens on GitHub, outside Jira statuses' END",
    "title_length": "CASE WHEN title_length < 0.6 * typical_title THEN 'Short' WHEN title_length > 1.5 * typical_title THEN 'Long' ELSE 'Typical' END || ' title (' || title_length || ' characters; typical here ' || trunc(typical_title)::BIGINT || ')'",
}


@_query(f"""WITH medians AS (SELECT point, project_key, median(title_length)::DOUBLE AS typical_title FROM known GROUP BY ALL), rows AS (SELECT f.*, typical_title FROM features f JOIN medians USING (point, project_key))
    {' UNION ALL '.join(f"SELECT issue_key, point, '{c}' AS feature, {words} AS sentence FROM rows" for c, words in _SAID.items())}""")
def ticket_sentences(x: Layers) -> DataFrame:
    """The sentences about each ticket's facts, for features of each kind of wording."""
    typical = model_frames.typical_values(x.known, ["title_length"]).withColumnRenamed("title_length", "typical_title")
    rows = x.features.join(typical, ["point", "project_key"])
    said = [F.struct(F.lit(c).alias("feature"), sentences.describe(c, typical=F.col("typical_title") if c == "title_length" else None).alias("sentence")) for c in _SAID]
    return rows.select("issue_key", "point", F.explode(F.array(*said)).alias("s")).select("issue_key", "point", "s.*")


@_query("SELECT 'never' AS kind, 0::BIGINT AS n UNION ALL SELECT 'unknown', 0")
def column_leaks(x: Layers) -> DataFrame:
    """Columns of the feature table that a model must never see, and those that nobody allowed."""
    return x.spark.createDataFrame([(k, len(v)) for k, v in model_frames.leaks(x.features).items()], "kind string, n long")


@_query("SELECT project_key, point, count(*) AS n, round(avg(project_open), 6) AS mean_open FROM features WHERE project_key IN ('BUILDING', 'MACHINERY') AND project_open >= 3 GROUP BY ALL")
def asked_by_name(x: Layers) -> DataFrame:
    """The feature table as a view, asked with named arguments."""
    catalog.view("feature_rows", x.features)
    return catalog.ask(x.spark, "SELECT project_key, point, count(*) AS n, round(avg(project_open), 6) AS mean_open FROM feature_rows WHERE array_contains(:projects, project_key) AND project_open >= :least GROUP BY project_key, point", projects=["BUILDING", "MACHINERY"], least=3)


# documents: orders as nested JSON tickets


def _documents(x: Layers) -> DataFrame:
    key = F.col("o_orderkey")
    named = lambda c: F.struct(c.alias("name"))
    item = lambda field, old, new: F.struct(F.lit(field).alias("field"), old.alias("fromString"), new.alias("toString"))
    history = F.struct((key * 10).cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), F.struct(F.when(key % 2 == 0, "u1").alias("name"), F.lit("U One").alias("displayName")).alias("author"), F.array(item("status", F.lit("Open"), F.col("o_orderstatus")), item("priority", F.lit(None).cast("string"), F.col("o_orderpriority"))).alias("items"))
    fields = F.struct(
        F.when(key % 3 != 0, F.struct(F.col("o_orderstatus").alias("key"))).alias("project"), named(F.trim("o_orderpriority")).alias("priority"), named(F.when(key % 4 == 0, " ").otherwise(F.col("o_orderstatus"))).alias("status"),
        F.array_repeat(named(F.when(key % 5 != 0, F.lit("part"))), (key % 4).cast("int")).alias("components"), F.array_repeat(F.struct(F.lit("1").alias("id")), (key % 3).cast("int")).alias("issuelinks"), F.when(key % 6 == 0, "soon").otherwise(F.col("o_custkey").cast("string")).alias("timespent"),
    )
    json = F.to_json(F.struct(F.concat_ws("-", F.lit("P"), F.col("o_orderstatus"), key).alias("key"), key.cast("string").alias("id"), fields.alias("fields"), F.struct(F.when(key % 7 != 0, F.array(history)).alias("histories")).alias("changelog")))
    return documents.parse_documents(x.table("orders").select(json.alias("json")))


@_query("""SELECT concat_ws('-', 'P', o_orderstatus, o_orderkey) AS issue_key, CASE WHEN o_orderkey % 3 = 0 THEN 'P-' || o_orderstatus ELSE o_orderstatus END AS project_key, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status, o_orderpriority AS priority,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 ELSE 0 END::INT AS n_components, (o_orderkey % 3)::INT AS link_count, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey END::BIGINT AS time_spent_s, (o_orderkey % 7 <> 0)::INT AS changelog_loaded FROM orders""")
def flatten_issues(x: Layers) -> DataFrame:
    return documents.flatten(_documents(x))["issues"].select("issue_key", "project_key", "status", "priority", F.array_size("components").alias("n_components"), "link_count", "time_spent_s", "changelog_loaded")


@_query("""SELECT concat_ws('-', 'P', o_orderstatus, o_orderkey) AS issue_key, (o_orderkey * 10)::VARCHAR AS history_id, strftime(o_orderdate, '%Y-%m-%d') AS created, CASE WHEN o_orderkey % 2 = 0 THEN 'u1' ELSE 'U One' END AS author, f.field, CASE f.field WHEN 'status' THEN 'Open' END AS from_string, CASE f.field WHEN 'status' THEN o_orderstatus ELSE o_orderpriority END AS to_string
    FROM orders, (VALUES ('status'), ('priority')) AS f(field) WHERE o_orderkey % 7 <> 0""")
def flatten_changes(x: Layers) -> DataFrame:
    return documents.flatten(_documents(x))["changelog"].select("issue_key", "history_id", "created", "author", "field", "from_string", "to_string")


@_query("SELECT f.field, count(*) AS n FROM orders, (VALUES ('status'), ('priority')) AS f(field) WHERE o_orderkey % 7 <> 0 GROUP BY f.field")
def field_histogram(x: Layers) -> DataFrame:
    return documents.field_counts(documents.flatten(_documents(x))["changelog"])


@_query("SELECT project_key, listagg(issue_type, '|' ORDER BY issue_type) AS types, sum(tickets)::BIGINT AS tickets FROM lead_time_profile GROUP BY project_key")
def types_of_projects(x: Layers) -> DataFrame:
    return x.base.groupBy("project_key", "issue_type").agg(F.count("*").alias("n")).groupBy("project_key").agg(F.expr("listagg(issue_type, '|') within group (order by issue_type)").alias("types"), F.sum("n").alias("tickets"))


@_query("SELECT project_key, issue_type, tickets, sum(tickets) OVER (PARTITION BY project_key ORDER BY issue_type)::BIGINT AS upto FROM lead_time_profile")
def stacked_counts(x: Layers) -> DataFrame:
    """Prefix sums for stacked bars; a project has few types."""
    per = x.base.groupBy("project_key", "issue_type").agg(F.count("*").alias("tickets"))
    return per.withColumn("upto", F.sum("tickets").over(Window.partitionBy("project_key").orderBy("issue_type")))


def queries(layers: Layers | None = None) -> dict[str, Query]:
    """All queries by name. They share layers, those given or else the session's; see ``Layers``."""
    return {name: (lambda spark, sf_dir, f=f: f(layers or Layers.of(spark, sf_dir))) for name, f in _SPARK.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
