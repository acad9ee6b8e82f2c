"""Operators over generated source tables with hot keys: one user has a third of the events, one company a third of the
users, tickets and score snapshots.

    python tools/skew_bench.py 3000000 /path/to/work [operator ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from acctpulse.operators.accounts import score_history  # noqa: E402
from acctpulse.operators.daily import events_daily  # noqa: E402
from acctpulse.operators.rollup import account_rollup  # noqa: E402
from acctpulse.operators.trend import flag_at_risk, score_drop_history, score_trend  # noqa: E402
from acctpulse.plans.snapshots import score_snapshots  # noqa: E402
from acctpulse.session import local_session  # noqa: E402

AS_OF = "2024-01-31 00:00:00"
TIMES = [f"2024-01-{d} 00:00:00" for d in ("10", "17", "24", "31")]


def skewed(key: str, n: int, hot: int = 0) -> str:
    """A key of ``n`` values of which one holds a third of the rows."""
    return f"if(pmod(xxhash64(id, '{key}'), 3) = 0, {hot}, pmod(xxhash64(id, 'x{key}'), {n}))"


def tables(spark: SparkSession, n: int) -> dict[str, DataFrame]:
    users, companies = max(1, n // 15), max(1, n // 300)
    second = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, pmod(xxhash64(id, 't'), 2592000))"
    return {
        "companies": spark.range(companies).selectExpr(
            "id", "concat('c', id) name", "element_at(array('trial', 'starter', 'pro'), int(id % 3) + 1) plan", "id * 100 mrr_cents",
            "cast(null as timestamp_ntz) churned_at", "timestamp_ntz'2023-06-01' created_at"),
        "users": spark.range(users).selectExpr(
            "id", "concat(id, '@example.com') email", f"bigint({skewed('c', companies)}) company_id", "'member' role",
            "timestamp_ntz'2023-06-01' created_at", f"{second} last_login"),
        "events": spark.range(n).selectExpr(
            "id", f"bigint({skewed('u', users)}) user_id", "concat('type', pmod(xxhash64(id, 'e'), 6)) event_type",
            f"{second} occurred_at", "cast(null as string) metadata"),
        "tickets": spark.range(n // 6).selectExpr(
            "id", f"bigint({skewed('k', companies)}) company_id", "'s' subject", "element_at(array('open', 'resolved'), int(id % 2) + 1) status",
            "element_at(array('low', 'critical'), int(id % 2) + 1) severity", f"{second} created_at", "cast(null as timestamp_ntz) resolved_at"),
        "scores": spark.range(n).selectExpr(
            f"bigint({skewed('s', companies)}) company_id", "int(pmod(xxhash64(id, 'v'), 101)) score", "false at_risk",
            "named_struct('login_recency', 1, 'adoption', 1, 'ticket_health', 1, 'mrr_tier', 1, 'seat_util', 1) components",
            "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, id) scored_at"),
    }


def main() -> None:
    n, work = int(sys.argv[1]), sys.argv[2].rstrip("/")
    spark = local_session("skew-bench", os.environ.get("BENCH_CPUS", "8"), 64)
    spark.sparkContext.setLogLevel("ERROR")
    for name, df in tables(spark, n).items():
        df.write.mode("ignore").parquet(f"{work}/{n}/{name}")
    t = {name: spark.read.parquet(f"{work}/{n}/{name}") for name in tables(spark, n)}
    source = {k: t[k] for k in ("companies", "users", "events", "tickets")}
    runs = {
        "scan": lambda: t["events"].groupBy("event_type").count(),
        "account_rollup": lambda: account_rollup(**source, as_of=AS_OF),
        "account_rollup_fanout": lambda: account_rollup(**source, as_of=AS_OF, mode="fanout"),
        "events_daily": lambda: events_daily(t["events"], t["users"]),
        "score_snapshots": lambda: score_snapshots(**source, as_ofs=TIMES, mode="exact", seats="distinct", login_event="type0"),
        "score_trend": lambda: score_trend(t["scores"]),
        "score_drop_history": lambda: score_drop_history(t["scores"]),
        "score_history": lambda: score_history(t["scores"]),
        "flag_at_risk": lambda: flag_at_risk(t["scores"]),
    }
    times = {}
    for name in sys.argv[3:] or runs:
        start = time.perf_counter()
        runs[name]().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 2)
    print(json.dumps({"events": n, "seconds": times}))


if __name__ == "__main__":
    main()
