"""Inputs of the registered queries, all derived from the benchmark tables."""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctpulse.functions.text import content_hash
from acctpulse.operators import alerts as AL
from acctpulse.operators import briefs as B
from acctpulse.operators.daily import active_users_30d, events_daily, with_seats
from acctpulse.operators.rollup import account_rollup
from acctpulse.operators.scoring import current_health, health_components, score_accounts
from acctpulse.operators.trend import flag_history
from acctpulse.plans.snapshots import score_snapshots
from acctpulse.session import staged
from acctpulse.sources import adapters
from acctpulse.sources.readers import select_renamed

AS_OF = "2024-01-31 00:00:00"
SCAN_AT = "2024-01-31 01:00:00"
SNAPSHOTS = ["2024-01-10 00:00:00", "2024-01-17 00:00:00", "2024-01-24 00:00:00", AS_OF]
# Not at midnight, over four months; in January every other day: more snapshots than the detail view shows.
DENSE_SNAPSHOTS = [
    "2023-12-20 06:00:00", *(f"2024-01-{d:02d} 06:00:00" for d in range(8, 31, 2)), "2024-02-09 06:00:00", "2024-03-10 06:00:00",
]
BATCH_CUTS = ["2024-01-11 12:00:00", "2024-01-21 18:00:00"]
MODEL = "stub-1"


def stub_generator() -> B.BatchFn:
    """Deterministic stand-in for the text generator."""

    def answer(prompt: str) -> tuple[str, int, int]:
        text = json.dumps({"summary": f"{len(prompt)} characters", "recommended_action": "call"})
        return text, len(prompt), len(text)

    return B.per_prompt(answer)


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def sources(self) -> dict[str, DataFrame]:
        return adapters.sources(self.spark, self.sf_dir)

    @property
    def companies(self) -> DataFrame:
        return self.sources["companies"]

    @property
    def users(self) -> DataFrame:
        return self.sources["users"]

    @property
    def events(self) -> DataFrame:
        return self.sources["events"]

    @property
    def tickets(self) -> DataFrame:
        return self.sources["tickets"]

    def rollup(self, mode: str = "exact") -> DataFrame:
        return account_rollup(**self.sources, as_of=AS_OF, mode=mode)

    @cached_property
    def accounts(self) -> DataFrame:
        return self.rollup()

    @cached_property
    def daily(self) -> DataFrame:
        return events_daily(self.events, self.users).drop("max_id")

    def batch(self, number: int) -> DataFrame:
        """Daily facts of one of three consecutive event batches, cut in the middle of a day."""
        at, cuts = F.col("occurred_at"), [F.lit(c).cast("timestamp_ntz") for c in BATCH_CUTS]
        wanted = [at < cuts[0], (at >= cuts[0]) & (at < cuts[1]), at >= cuts[1]][number]
        return events_daily(self.events.filter(wanted), self.users)

    def components(self, mode: str = "exact") -> DataFrame:
        accounts = self.accounts if mode == "exact" else self.rollup(mode)
        seated = with_seats(accounts, active_users_30d(self.daily, AS_OF))
        return health_components(seated, None, AS_OF)

    def health(self, mode: str = "exact") -> DataFrame:
        return current_health(self.components(mode))

    def scored(self, mode: str = "exact") -> DataFrame:
        return score_accounts(self.health(mode), AS_OF)

    def snapshots(self, times=SNAPSHOTS, mode: str = "exact", seats: str = "distinct") -> DataFrame:
        return score_snapshots(
            **self.sources, as_ofs=times, mode=mode, seats=seats, login_event=adapters.LOGIN_EVENT
        )

    @cached_property
    def scores(self) -> DataFrame:
        """Score history as weekly runs would have stored it. The back-fill is staged: comparing neighbours reads it twice."""
        return flag_history(staged(self.snapshots(), "snapshots"))

    def stage_scores(self) -> None:
        """Compute the history once, for queries that use it in several branches."""
        self.scores = staged(self.scores, "scores")

    @cached_property
    def notes(self) -> DataFrame:
        return adapters.notes(self.spark, self.sf_dir)

    @cached_property
    def alerts(self) -> DataFrame:
        return adapters.alert_log(self.spark, self.sf_dir)

    @cached_property
    def context(self) -> DataFrame:
        return B.brief_hash(
            B.brief_context(self.accounts, self.scores, self.daily, self.alerts, self.notes, AS_OF)
        )

    def briefs_for(self, hashed: DataFrame) -> DataFrame:
        """Stored briefs: up to date, outdated or missing, by account id; each with an older predecessor."""
        kind = F.col("company_id") % 3
        newest = F.when(kind == 0, F.col("prompt_hash")).otherwise(content_hash(F.col("prompt_hash")))
        at = F.lit("2024-01-30 03:00:00").cast("timestamp_ntz")
        versions = F.array(
            F.struct(newest.alias("prompt_hash"), at.alias("generated_at"), F.lit("brief of ").alias("head")),
            F.struct(F.lit("old").alias("prompt_hash"), (at - F.make_dt_interval(F.lit(7))).alias("generated_at"),
                     F.lit("old brief of ").alias("head")),
        )
        rows = hashed.filter(kind != 2).select("company_id", "company_name", F.inline(versions))
        return rows.select(
            "company_id",
            F.concat("head", "company_name").alias("summary"),
            F.lit("call").alias("recommended_action"),
            "prompt_hash",
            F.lit(100).cast("bigint").alias("input_tokens"),
            F.lit(10).cast("bigint").alias("output_tokens"),
            F.lit(MODEL).alias("model"),
            "generated_at",
        )

    @cached_property
    def plain_briefs(self) -> DataFrame:
        """Stored briefs that do not depend on a context."""
        return self.briefs_for(
            self.companies.select(
                F.col("id").alias("company_id"), F.col("name").alias("company_name"),
                F.sha2("name", 256).alias("prompt_hash"),
            )
        )

    # The brief queries use the context in several branches, so it is staged once per query.

    @cached_property
    def staged_context(self) -> DataFrame:
        return staged(self.context, "context")

    @cached_property
    def briefs(self) -> DataFrame:
        return self.briefs_for(self.staged_context)

    @cached_property
    def gated(self) -> DataFrame:
        return B.brief_gates(self.staged_context, self.briefs)

    @cached_property
    def queue(self) -> DataFrame:
        return staged(B.brief_queue(self.gated), "queue")

    @cached_property
    def answers(self) -> DataFrame:
        """Generator output, stored before it is used: evaluating it again would call the generator again."""
        return staged(B.generate(self.queue, stub_generator(), 8), "answers")

    @cached_property
    def at_risk(self) -> DataFrame:
        names = select_renamed(self.companies, {"id": "company_id", "name": "company_name", "plan": "plan"})
        return AL.at_risk_accounts(self.scores, names)

    @cached_property
    def staged_at_risk(self) -> DataFrame:
        return staged(self.at_risk, "at_risk")
