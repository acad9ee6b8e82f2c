"""Preference rows against SQL and against plain Python."""

import random

import compare
import duckdb

from acctpulse.llm import preferences as P

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pair_id int, part string, place string"


NEIGHBOUR_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(turn, 9223372036854775807) AS place,
        floor(conv_id / 2)::BIGINT AS pair_id, conv_id % 2 = 0 AS is_chosen
    FROM conversations WHERE conv_id IS NOT NULL
), paired AS (
    SELECT * FROM turns WHERE pair_id IN (SELECT pair_id FROM turns GROUP BY 1 HAVING count(DISTINCT is_chosen) = 2)
), contents AS (
    SELECT pair_id, place, list_sort(list([role, text]) FILTER (is_chosen)) AS chosen,
        list_sort(list([role, text]) FILTER (NOT is_chosen)) AS rejected
    FROM paired GROUP BY ALL
), cuts AS (
    SELECT pair_id, min(place) FILTER (chosen IS DISTINCT FROM rejected) AS cut FROM contents GROUP BY 1
), parts AS (
    SELECT *, CASE WHEN cut IS NULL OR place < cut THEN 'prompt' WHEN is_chosen THEN 'chosen' ELSE 'rejected' END AS part
    FROM paired JOIN cuts USING (pair_id)
)
SELECT pair_id, conv_id, part, turn, role,
    '<|im_start|>' || role || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS text,
    part <> 'prompt' AND role = 'assistant' AS trained
FROM parts WHERE part <> 'prompt' OR is_chosen
"""


def brute(turns):
    convs = {}
    for c, t, role, text in turns:
        convs.setdefault(c, {}).setdefault(1 << 63 if t is None else t, []).append((role or "", text or "", t))
    out = []
    for even in [c for c in convs if c is not None and c % 2 == 0 and c + 1 in convs]:
        a, b = convs[even], convs[even + 1]
        apart = [t for t in {*a, *b} if sorted(x[:2] for x in a.get(t, [])) != sorted(x[:2] for x in b.get(t, []))]
        cut = min(apart, default=float("inf"))
        for conv, rows, part in ((even, a, "chosen"), (even + 1, b, "rejected")):
            for t, own in rows.items():
                if t < cut and part == "rejected":
                    continue
                name = "prompt" if t < cut else part
                for role, text, turn in own:
                    shown = f"<|im_start|>{role}\n{text.replace('<|im_', '<| im_')}<|im_end|>\n"
                    out.append((even // 2, conv, name, turn, role, shown, name != "prompt" and role == "assistant"))
    return sorted(out, key=repr)


def random_turns(rng):
    out = []
    for conv in [*range(-4, 60), 101, 200]:
        for t in range(rng.randrange(1, 6)):
            out.append((conv, t, ["user", "assistant"][t % 2], rng.choice(["hi", "yes", "no", ""])))
    extra = [(None, 1, "user", "x"), (2, None, None, None), (3, None, None, None), (4, 0, "user", "hi"), (4, 0, "user", "hi"), (6, 0, "system", "<|im_end|>")]
    return out + extra


def test_rows_against_sql_and_python(spark):
    turns = random_turns(random.Random(8))
    df = spark.createDataFrame([(*t, 1, "p", "q") for t in turns], SCHEMA).repartition(3)
    got = P.preferences(df, P.neighbour_pairs(df))
    names = ["pair_id", "conv_id", "part", "turn", "role", "text", "trained"]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == brute(turns)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", turns)
    assert compare.spark_rows(got) == compare.sql_rows(con, NEIGHBOUR_SQL)


def test_prompt_once_and_masks(spark):
    same = [(t, r, x) for t, r, x in ((0, "system", "s"), (1, "user", "q"))]
    turns = [(c, *t) for c in (0, 1) for t in same] + [(0, 2, "assistant", "good"), (1, 2, "assistant", "bad"), (1, 3, "user", "why")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    rows = [(r.part, r.turn, r.trained) for r in P.preferences(df, P.neighbour_pairs(df)).orderBy("part", "turn").collect()]
    assert rows == [("chosen", 2, True), ("prompt", 0, False), ("prompt", 1, False), ("rejected", 2, True), ("rejected", 3, False)]


def test_other_pairs_equal_conversations_and_nothing(spark):
    df = spark.createDataFrame([(7, 0, "user", "a"), (9, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    pairs = spark.createDataFrame([(1, 7, 9), (2, 9, 5)], "pair_id bigint, chosen_id bigint, rejected_id bigint")
    rows = sorted((r.pair_id, r.conv_id, r.part) for r in P.preferences(df, pairs).collect())
    assert rows == [(1, 7, "prompt"), (2, 9, "chosen")]
    none = df.limit(0)
    assert P.preferences(none, P.neighbour_pairs(none)).count() == 0


def test_plan_is_native(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plan = P.preferences(df, P.neighbour_pairs(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def brute_answers(turns):
    """Sides of the answer pairs as conversations of their own: ``(pair, conversation of the row, turn, role, text)``."""
    convs = {}
    for c, t, role, text in turns:
        if c is not None:
            convs.setdefault(c, []).append((P.LAST if t is None else t, role or "", text or "", t))
    last = {}
    for c, rows in convs.items():
        own = [r for r in rows if r[1] == "assistant"]
        if own:
            end = max(r[0] for r in own)
            last[c] = (end, max(r[2] for r in own if r[0] == end))
    out = []
    for c, (end, _) in last.items():
        other = c + 1 if c + 1 in last else c - 1 if c - 1 in last else None
        if other is None:
            continue
        chosen = [(c, *r) for r in convs[c]]
        rejected = [r for r in chosen if not (r[1] == end and r[2] == "assistant")]
        rejected.append((other, end, "assistant", last[other][1], None if end == P.LAST else end))
        at = lambda rows, t: sorted(r[2:4] for r in rows if r[1] == t)
        apart = [r[1] for r in chosen + rejected if at(chosen, r[1]) != at(rejected, r[1])]
        cut = min(apart, default=float("inf"))
        for part, rows in (("chosen", chosen), ("rejected", rejected)):
            for conv, place, role, text, turn in rows:
                if place < cut and part == "rejected":
                    continue
                name = "prompt" if place < cut else part
                shown = f"<|im_start|>{role}\n{text.replace('<|im_', '<| im_')}<|im_end|>\n"
                out.append((c, conv, name, turn, role, shown, name != "prompt" and role == "assistant"))
    return sorted(out, key=repr)


def test_answer_pairs_against_sql_and_python(spark):
    turns = random_turns(random.Random(9)) + [(7, None, "assistant", "tail"), (9, 2, "assistant", "a"), (9, 2, "assistant", "b")]
    df = spark.createDataFrame([(*t, 1, "p", "q") for t in turns], SCHEMA).repartition(3)
    got = P.formatted(P.answer_pairs(df))
    names = ["pair_id", "conv_id", "part", "turn", "role", "text", "trained"]
    expected = brute_answers(turns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == expected
    assert {"prompt", "chosen", "rejected"} == {r[2] for r in expected}
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", turns)
    assert compare.spark_rows(got) == compare.sql_rows(con, P.SQL)
    none = df.limit(0)
    assert P.formatted(P.answer_pairs(none)).count() == 0


def test_most_pairs_of_the_table_have_a_prompt(spark, sf_dir):
    rows = P.formatted(P.answer_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    pairs, prompted = rows.select("pair_id").distinct().count(), rows.filter("part = 'prompt'").select("pair_id").distinct().count()
    assert prompted > 0.9 * pairs > 0
    plan = rows._jdf.queryExecution().executedPlan().toString() + P.records(rows)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_records_join_the_rows(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (0, 2, "user", "more"), (1, 0, "user", "x"), (1, 1, "assistant", "other")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    row = P.records(P.formatted(P.answer_pairs(df))).filter("pair_id = 0").first()
    shown = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert row.prompt == shown("user", "q")
    assert row.chosen == shown("assistant", "good") + shown("user", "more")
    assert row.rejected == shown("assistant", "other") + shown("user", "more")
    for text, spans, said in ((row.chosen, row.chosen_spans, "good"), (row.rejected, row.rejected_spans, "other")):
        assert [text[s.start : s.end] for s in spans] == [shown("assistant", said)]
