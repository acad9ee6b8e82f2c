"""Brief context, gates, generator isolation and response parsing."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from acctpulse.functions.text import components_json, content_hash, dollars, trend_phrase
from acctpulse.operators import briefs as B
from acctpulse.schemas import STORE_SCHEMAS

NOW = datetime(2024, 1, 31)
PARTS = (25, 20, 20, 4, 5)


def test_dollars_round_half_to_even(rows):
    cases = [(0, "0"), (49, "0"), (50, "0"), (150, "2"), (250, "2"), (251, "3"), (123456, "1235"), (99900, "999")]
    df = rows(cases, "c long, expected string").select("expected", dollars(F.col("c")).alias("got"))
    assert [r.got for r in df.collect()] == [e for _, e in cases] == [f"{c / 100:.0f}" for c, _ in cases]


def test_trend_phrase(rows):
    cases = [(60, 50), (50, 60), (50, 50), (50, None), (50, 0), (None, None)]
    df = rows(cases, "c int, p int").select(trend_phrase(F.col("c"), F.col("p")).alias("t"))
    assert [r.t for r in df.collect()] == [
        "improved from 50 to 60", "declined from 60 to 50", "stable at 50", "stable at 50", "stable at 50",
        "stable at None",
    ]


def test_components_json(spark):
    df = spark.createDataFrame([(PARTS,), (None,)], "c struct<login_recency:int,adoption:int,ticket_health:int,mrr_tier:int,seat_util:int>")
    assert [r[0] for r in df.select(components_json(F.col("c"))).collect()] == [
        '{"adoption": 20, "mrr_tier": 4, "seat_util": 5, "login_recency": 25, "ticket_health": 20}', "{}"
    ]


def test_hash_separates_fields(rows):
    cases = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("", "c"), ("-", "c")]
    df = rows(cases, "a string, b string").select(content_hash(F.col("a"), F.col("b")).alias("h"))
    assert len({r.h for r in df.collect()}) == len(cases)


def context(rows):
    accounts = rows(
        [(i, f"Co {i}", "pro", 12345, None, 5, 1, None, None, None, 0, 0, 3, 1, NOW) for i in (1, 2, 3)],
        STORE_SCHEMAS["dim_accounts"],
    )
    day = timedelta(days=1)
    scores = rows(
        [(1, 50, False, PARTS, NOW - day), (1, 55, False, PARTS, NOW), (2, 80, False, PARTS, NOW - day), (2, 40, True, PARTS, NOW)],
        STORE_SCHEMAS["fact_health_score"],
    )
    daily = rows(
        [(1, NOW.date(), "view", 3, 1), (1, NOW.date() - day, "view", 4, 2), (1, NOW.date(), "click", 9, 1)],
        STORE_SCHEMAS["fact_events_daily"],
    )
    alerts = rows([(f"a{i}", 1, "t", f"m{i}", i == 0, NOW - i * day) for i in range(6)], STORE_SCHEMAS["alert_log"])
    notes = rows([("n1", 2, 'O"Hara', "naïve ✓", NOW), ("n0", 2, "x", "old", NOW - day)], STORE_SCHEMAS["crm_notes"])
    return B.brief_context(accounts, scores, daily, alerts, notes, NOW)


def test_context_and_prompt(rows):
    got = {r.company_id: r for r in B.brief_prompt(context(rows)).collect()}
    one, two, three = got[1], got[2], got[3]
    assert [tuple(e) for e in one.recent_events] == [("click", 9), ("view", 7)]
    assert [a.message for a in one.open_alerts] == ["m1", "m2", "m3"]
    assert one.last_cs_note is None and two.last_cs_note.note == "naïve ✓"
    assert (three.latest_score, three.prev_score, three.at_risk, three.recent_events) == (None, None, False, [])
    assert one.prompt.split("\n")[2:9] == [
        "ACCOUNT: Co 1",
        "PLAN: PRO | MRR: $123/mo | SEATS: 5",
        "HEALTH SCORE: improved from 50 to 55.",
        'SCORE BREAKDOWN: {"adoption": 20, "mrr_tier": 4, "seat_util": 5, "login_recency": 25, "ticket_health": 20}',
        "RECENT ACTIVITY (30d): click (9 times), view (7 times)",
        "OPEN TICKETS: 3 total, 1 critical",
        "LAST CS NOTE: No CS notes recorded yet.",
    ]
    assert "HEALTH SCORE: declined from 80 to 40. This account is flagged AT-RISK.\n" in two.prompt
    assert 'LAST CS NOTE: CS note from O"Hara: "naïve ✓"\n' in two.prompt
    assert "SCORE BREAKDOWN: {}\nRECENT ACTIVITY (30d): no recent activity\n" in three.prompt
    assert one.prompt.endswith('(1-2 sentences)"\n}')


def test_gates(rows):
    hashed = B.brief_hash(context(rows))
    hashes = {r.company_id: r.prompt_hash for r in hashed.collect()}
    stored = [
        (2, "s", "a", hashes[2], 1, 1, "m", NOW), (2, "s", "a", "older", 1, 1, "m", NOW - timedelta(days=1)),
        (3, "s", "a", "older", 1, 1, "m", NOW),
    ]
    gate = lambda briefs: {r.company_id: r.gate for r in B.brief_gates(hashed, rows(briefs, STORE_SCHEMAS["ai_summaries"])).collect()}
    assert gate(stored) == {1: "no_change", 2: "cached", 3: "generate"}
    assert gate([]) == {1: "no_change", 2: "generate", 3: "generate"}
    stale = [(2, "s", "a", "newer", 1, 1, "m", NOW + timedelta(days=1)), *stored]
    assert gate(stale)[2] == "generate"


def test_generator_sees_only_open_gates_and_isolates_failures(rows):
    queue = rows(
        [(1, "h1", "generate", "good"), (2, "h2", "generate", "bad"), (3, "h3", "cached", "good"), (4, "h4", "no_change", "good")],
        "company_id long, prompt_hash string, gate string, prompt string",
    )

    def call(prompt):
        if prompt == "bad":
            raise ValueError("boom")
        return ' {"summary": "S", "recommended_action": null} ', 10, 2

    out = {r.company_id: r for r in B.generate(queue, B.per_prompt(call), parallelism=2).collect()}
    assert sorted(out) == [1, 2]
    assert (out[2].text, out[2].input_tokens, out[2].error) == (None, None, "ValueError: boom")
    briefs = B.to_briefs(rows([tuple(r) for r in out.values()], B.RESPONSE_FIELDS), "m", NOW).collect()
    assert [(r.company_id, r.summary, r.recommended_action, r.prompt_hash) for r in briefs] == [(1, "S", None, "h1")]


def test_batch_generator(rows):
    queue = rows([(1, "h", "generate", "abc")], "company_id long, prompt_hash string, gate string, prompt string")

    def batch(frames):
        for pdf in frames:
            yield pd.DataFrame(
                {"company_id": pdf.company_id, "prompt_hash": pdf.prompt_hash, "text": pdf.prompt.str.upper(),
                 "input_tokens": 1, "output_tokens": 1, "error": None}
            )

    assert [r.text for r in B.generate(queue, batch, 2).collect()] == ["ABC"]


def test_parse(rows):
    cases = {
        "full": ('{"summary": "s", "recommended_action": "a"}', ("object", "s", "a")),
        "blanks": (' \n {"summary": "s", "recommended_action": "a"} \t', ("object", "s", "a")),
        "no action": ('{"summary": "s"}', ("object", "s", "")),
        "no summary": (' {"recommended_action": "a"} ', ("object", '{"recommended_action": "a"}', "a")),
        "null action": ('{"summary": "s", "recommended_action": null}', ("object", "s", None)),
        "null summary": ('{"summary": null}', ("invalid", None, None)),
        "nested summary": ('{"summary": {"x": 1}}', ("invalid", None, None)),
        "number": ('{"summary": 5, "recommended_action": true}', ("object", "5", "true")),
        "array": ('[{"summary": "s"}]', ("invalid", None, None)),
        "bare string": ('"s"', ("invalid", None, None)),
        "null": ("null", ("invalid", None, None)),
        "prose": ('Sure: {"summary": "s"}', ("raw", 'Sure: {"summary": "s"}', "")),
        "cut off": ('{"summary": "s', ("raw", '{"summary": "s', "")),
        "empty": ("  ", ("raw", "", "")),
        "unicode": ('{"summary": "na\\u00efve \\"q\\"\\n✓"}', ("object", 'naïve "q"\n✓', "")),
    }
    df = rows([(k, v[0]) for k, v in cases.items()], "name string, text string")
    got = {r.name: (r.status, r.summary, r.recommended_action) for r in B.parse_briefs(df).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_cost(rows):
    df = rows([(1_000_000, 200_000), (0, 0), (333, 777)], "i long, o long")
    got = [r[0] for r in df.select(B.brief_cost(F.col("i"), F.col("o"))).collect()]
    assert got == [round((i * 0.00025 + o * 0.00125) / 1000, 4) for i, o in [(1_000_000, 200_000), (0, 0), (333, 777)]]


def test_mixes_that_print_alike_differ(rows):
    schema = "recent_events array<struct<type:string,count:bigint>>, latest_score int, prev_score int, at_risk boolean, open_tickets long, last_cs_note struct<author:string,note:string,date:string>"
    mixes = [[("a:1,b", 2)], [("a", 1), ("b", 2)], [('a","count":1},{"type":"b', 2)], []]
    df = rows([(m, 1, 1, False, 0, None) for m in mixes], schema)
    assert len({r.prompt_hash for r in B.brief_hash(df).collect()}) == len(mixes)


def test_nested_action_gives_no_brief(rows):
    df = rows([('{"summary": "s", "recommended_action": {"a": 1}}',), ('{"summary": "s", "recommended_action": ["a"]}',),
               ('{"summary": "s", "recommended_action": null}',)], "text string")
    assert [r.status for r in B.parse_briefs(df).collect()] == ["invalid", "invalid", "object"]
