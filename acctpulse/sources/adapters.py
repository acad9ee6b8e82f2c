"""The benchmark tables seen as the four source tables, plus the hand-written tables of the data model.

Whole tables throughout: every supplier is a company, every customer a user, every order a ticket, every
event an event, every conversation turn a note and every document a generator response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acctpulse.functions.text import content_hash

RAW_SCHEMAS: dict[str, str] = {
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
    "documents": "doc_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

LOGIN_EVENT = "signup"
# Shift that moves order dates next to the event month, and the day from which tickets may still be open.
ORDER_SHIFT_DAYS = 8218
OPEN_SINCE = "2001-06-15"
# Added to an account id to make it one that does not exist.
UNKNOWN_ACCOUNT = 1_000_000_000


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def _company_count(spark: SparkSession, sf_dir: str) -> Column:
    """Number of companies as an uncorrelated scalar subquery."""
    return raw(spark, sf_dir, "supplier").agg(F.count("*")).scalar()


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as id",
        "s_name as name",
        """element_at(array('trial', 'starter', 'pro', 'enterprise', 'legacy'), s_nationkey % 5 + 1) as plan""",
        "bigint(floor(greatest(s_acctbal, 0.0d))) * 100 as mrr_cents",
        "if(s_acctbal < 0, timestamp_ntz'2024-01-05' + make_dt_interval(int(s_suppkey % 25)), null) as churned_at",
        "timestamp_ntz'2023-06-01' as created_at",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    logins = (
        events(spark, sf_dir).filter(f"event_type = '{LOGIN_EVENT}'")
        .groupBy("user_id").agg(F.max("occurred_at").alias("last_login"))
    )
    people = raw(spark, sf_dir, "customer").withColumn("company_id", F.col("c_custkey") % _company_count(spark, sf_dir))
    return people.join(logins, F.expr("c_custkey = user_id"), "left").selectExpr(
        "c_custkey as id",
        "concat(lower(c_name), '@example.com') as email",
        "company_id",
        "case c_nationkey % 5 when 0 then 'admin' when 4 then 'viewer' else 'member' end as role",
        "timestamp_ntz'2023-06-15' as created_at",
        "last_login",
    )


_EVENT_COLUMNS = ("event_id as id", "user_id", "event_type", "ts as occurred_at", "props as metadata")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").selectExpr(*_EVENT_COLUMNS)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files."""
    stream = spark.readStream.schema(RAW_SCHEMAS["events"]).parquet(f"{sf_dir}/events.parquet*")
    return stream.selectExpr(*_EVENT_COLUMNS)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = "map('1', 'critical', '2', 'high', '3', 'medium')"
    orders = raw(spark, sf_dir, "orders").withColumns(
        {
            "company_id": F.col("o_custkey") % _company_count(spark, sf_dir),
            "done": F.expr(f"o_orderdate < timestamp_ntz'{OPEN_SINCE}' or o_orderstatus = 'F'"),
        }
    )
    return orders.selectExpr(
        "o_orderkey as id",
        "company_id",
        "concat('ticket ', o_orderkey) as subject",
        "case when done then 'resolved' when o_orderstatus = 'O' then 'open' else 'pending' end as status",
        f"coalesce(element_at({levels}, left(o_orderpriority, 1)), 'low') as severity",
        f"o_orderdate + interval {ORDER_SHIFT_DAYS} days as created_at",
        f"if(done, o_orderdate + interval {ORDER_SHIFT_DAYS + 1} days, null) as resolved_at",
    )


SOURCES = {"companies": companies, "users": users, "events": events, "tickets": tickets}


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: build(spark, sf_dir) for name, build in SOURCES.items()}


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as account notes. Some of them name an account that does not exist."""
    turns = raw(spark, sf_dir, "conversations").withColumn("known", F.col("conv_id") % _company_count(spark, sf_dir))
    rows = turns.selectExpr(
        "conv_id",
        "turn",
        f"if(conv_id % 10 = 7, conv_id + {UNKNOWN_ACCOUNT}, known) as company_id",
        "role as author",
        "text as note",
        """timestamp_ntz'2024-01-02'
             + make_dt_interval(int(conv_id % 20), int(turn), int(floor(conv_id / 20)), 0) as created_at""",
    )
    note_id = content_hash(F.col("conv_id"), F.col("turn")).alias("note_id")
    return rows.select(note_id, "company_id", "author", "note", "created_at")


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per critical ticket and per account, partly acknowledged; some accounts do not exist."""
    critical = tickets(spark, sf_dir).filter("severity = 'critical'").selectExpr(
        f"company_id + if(id % 50 = 0, {UNKNOWN_ACCOUNT}, 0) as company_id",
        "'critical_ticket' as alert_type",
        "concat('critical: ', subject) as message",
        "id % 3 = 0 as acknowledged",
        "created_at",
    )
    drops = companies(spark, sf_dir).selectExpr(
        "id as company_id",
        "'score_drop' as alert_type",
        "concat('drop: ', name) as message",
        "id % 4 = 0 as acknowledged",
        "if(id % 2 = 0, timestamp_ntz'2024-01-31 00:30:00', timestamp_ntz'2024-01-30 09:00:00') as created_at",
    )
    log = critical.unionByName(drops)
    alert_id = content_hash(F.col("company_id"), F.col("alert_type"), F.col("message"))
    return log.select(alert_id.alias("alert_id"), "*")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as generator responses: bare text, complete, partial and nested JSON objects, arrays, mixed
    text."""
    partial = "to_json(named_struct('summary', text))"
    return raw(spark, sf_dir, "documents").selectExpr(
        "doc_id as company_id",
        f"""case doc_id % 7
              when 0 then to_json(named_struct('summary', text, 'recommended_action', 'call them'))
              when 1 then concat('  \\n', {partial}, '\\n ')
              when 2 then to_json(array(text))
              when 3 then concat('Here it is: ', {partial})
              when 4 then '{{"summary": null, "recommended_action": "x"}}'
              when 5 then to_json(named_struct('summary', text, 'recommended_action', array('call', 'write')))
              else concat(' ', text, ' ') end as text""",
    )
