"""A sentence for each feature of a ticket: the fact, not what it does to the estimate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import length_word

NO_PEERS = "No similar resolved tickets to compare with"
#: The wording of each feature by its value: missing, 0 (or false), 1 (or true), any other one. A case that is
#: not given is worded as "other". {n} is the value as a whole number, {d} with one decimal, {p} in percent, {s} as text, {when}
#: the prediction point, {typical} the project's median, {length} how the value compares with it, {rate} and {all_rate} late rates.
WORDING = {
    "assignee_open": {"missing": "Not assigned {when}", "other": "Assigned {when} (assignee has {n} other open tickets)"},
    "has_assignee": {"zero": "Still unassigned on day 7", "other": "Assigned by day 7"},
    "reporter_prior_tickets": {"missing": "Reporter unknown", "zero": "First ticket this reporter has filed", "one": "Reporter has filed {n} earlier ticket", "other": "Reporter has filed {n} earlier tickets"},
    "reporter_first_time": {"zero": "Returning reporter", "other": "First-time reporter"},
    "commenters_by_day7": {"zero": "Nobody had commented by day 7", "one": "{n} person had commented by day 7", "other": "{n} people had commented by day 7"},
    "priority_rank": {"missing": "No priority set", "other": "Priority is in the {band} part of its project's scale"},
    "issue_type": {"other": "Issue type: {s}"},
    "component_count": {"zero": "No component set", "one": "{n} component set", "other": "{n} components set"},
    "link_count": {"zero": "No linked tickets", "one": "{n} linked ticket", "other": "{n} linked tickets"},
    "title_length": {"other": "{length} title ({n} characters; typical here {typical})"},
    "description_length": {"zero": "No description", "other": "{length} description ({n} characters; typical here {typical})"},
    "project_open": {"other": "{n} other tickets open in the project (typical {typical})"},
    "project_key": {"other": "{s}: {rate} of past tickets here ran late (all projects {all_rate})"},
    "workflow_family": {"other": "{family}"},
    "peer_n": {"missing": NO_PEERS, "other": "{peers}"},
    "peer_median_lead_days": {"missing": NO_PEERS, "other": "Similar recent tickets took a median of {d} days"},
    "peer_late_rate": {"missing": NO_PEERS, "other": "{p} of similar recent tickets ran late"},
    "project_median_lead_days": {"other": "Recent tickets in the project took a median of {d} days"},
    "project_late_rate": {"other": "{p} of recent tickets in the project ran late"},
    "events_by_day7": {"zero": "No changes recorded in the first week", "one": "{n} change recorded in the first week", "other": "{n} changes recorded in the first week"},
    "comments_by_day7": {"zero": "No comments in the first week", "one": "{n} comment in the first week", "other": "{n} comments in the first week"},
    "days_since_activity_day7": {"other": "{d} days since the last activity on day 7"},
    "stage_at_day7": {"other": "Still {stage} on day 7"},
    "days_in_stage_day7": {"other": "{d} days in its current stage on day 7"},
    "entered_active_by_day7": {"zero": "No work had started by day 7", "other": "Work had started by day 7"},
    "entered_review_by_day7": {"zero": "Not yet in review on day 7", "other": "Had reached review by day 7"},
    "review_rounds_by_day7": {"zero": "No review rounds yet", "one": "{n} review round so far", "other": "{n} review rounds so far"},
}
#: How a stage is worded.
STAGES = {"Waiting": "waiting to be worked on", "Building": "being worked on", "In review": "in review", "Done": "marked done"}
#: Columns whose values are words.
TEXTS = frozenset({"issue_type", "project_key", "workflow_family", "stage_at_day7"})


def _percent(share: Column) -> Column:
    return F.format_string("%.0f%%", share * 100)


def describe(feature: str, typical: Column | None = None, rate: Column | None = None, all_rate: Column | None = None, stages: dict[str, str] = STAGES) -> Column:
    """The sentence of ``feature``, which is a column beside point and, if asked for, what is ``typical`` and late rates.

    ``stages`` words the stages; others appear in lower case. Missing values that have no wording are "not available".
    """
    cases = WORDING[feature]
    text = F.col(feature).cast("string")
    number = F.lit(None).cast("double") if feature in TEXTS else F.col(feature).cast("double")
    number = F.when(~F.isnan(number), number)
    typical, rate, all_rate = (F.lit(None).cast("double") if c is None else c for c in (typical, rate, all_rate))
    stage = F.lower(text)
    for name, words in stages.items():
        stage = F.when(text == name, words).otherwise(stage)
    whole = lambda v: v.cast("long").cast("string")
    fills = {
        "n": whole(number), "d": F.format_string("%.1f", number), "p": _percent(number), "stage": stage,
        "when": F.when(F.col("point") == "creation", "when filed").otherwise("by day 7"),
        "typical": whole(typical), "length": length_word(number, typical), "rate": _percent(F.coalesce(rate, all_rate)), "all_rate": _percent(all_rate),
        "band": F.when(number >= 0.9, "top").when(number >= 0.65, "upper").when(number >= 0.4, "middle").when(number >= 0.15, "lower").otherwise("bottom"),
        "family": F.when(text == "jira_review", "Review happens in Jira statuses (Patch Available)").otherwise("Review happens on GitHub, outside Jira statuses"),
        "peers": F.when(number < 30, F.format_string("Only %d similar tickets resolved so far to compare with", number.cast("long"))).otherwise(F.format_string("Compared with the last %d similar tickets", number.cast("long"))),
        "s": text,  # last, as a value may hold braces
    }

    def worded(case: str) -> Column:
        out = F.lit(cases.get(case, cases["other"]))
        for name, fill in fills.items():
            if f"{{{name}}}" in cases.get(case, cases["other"]):
                out = F.replace(out, F.lit(f"{{{name}}}"), fill)
        return out

    missing = worded("missing") if "missing" in cases else F.lit(feature.replace("_", " ").capitalize() + " not available")
    if feature in TEXTS:
        return F.when(text.isNull(), missing).otherwise(worded("other"))
    return F.when(number.isNull(), missing).when(number == 0, worded("zero")).when(number.cast("long") == 1, worded("one")).otherwise(worded("other"))
