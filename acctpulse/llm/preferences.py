"""Preference formatting of chat: shared prompt once, chosen and rejected completions masked.

Everything is built-in DataFrame functions. The result has a row per rendered turn, so neither a conversation nor a
pair is ever collected in one place, however many turns it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
# Place of turns without a number.
LAST = (1 << 63) - 1


def rendered(role, text) -> F.Column:
    """One turn between its markers. A marker spelled out in a text is broken by a space, so a text cannot forge a turn."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), plain, F.lit(CLOSE))


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """``(pair_id, chosen_id, rejected_id)``: each conversation with an even id as chosen, the next as rejected.

    A conversation without such a partner is in no pair.
    """
    ids = turns.select("conv_id").filter("conv_id IS NOT NULL").distinct()
    pair = F.floor(F.col("conv_id") / 2).cast("bigint")
    sides = ids.groupBy(pair.alias("pair_id")).agg(
        F.min(F.when(F.col("conv_id") % 2 == 0, F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(F.col("conv_id") % 2 != 0, F.col("conv_id"))).alias("rejected_id"),
    )
    return sides.filter("chosen_id IS NOT NULL AND rejected_id IS NOT NULL")


def answer_pairs(turns: DataFrame) -> DataFrame:
    """Two sides of every conversation with an assistant's turn, as rows for :func:`formatted`; ``pair_id`` is its id.

    The chosen side is the conversation as it stands. In the rejected one, the assistant's last turn is replaced by that of
    another conversation: the one with the next id, or else the one before (``conv_id`` names it). A conversation with neither is
    in no pair. Where the last turn number holds several of the assistant's rows, one takes the place of all of them, and the
    greatest text stands for them elsewhere.
    """
    place = F.coalesce(F.col("turn"), F.lit(LAST)).alias("place")
    known = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", place, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    last = F.max(F.struct("place", "text")).alias("last")
    answers = known.filter(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(last)

    def beside(step: int, name: str) -> DataFrame:
        key = F.try_subtract(F.col("conv_id"), F.lit(step))
        return answers.select(key.alias("key"), F.struct("conv_id", F.col("last.text").alias("text")).alias(name))

    sides = answers.join(beside(1, "after"), F.col("conv_id") == F.col("key"), "left").drop("key")
    sides = sides.join(beside(-1, "before"), F.col("conv_id") == F.col("key"), "left")
    found = sides.select("conv_id", F.col("last.place").alias("end"), F.coalesce("after", "before").alias("other")).filter("other IS NOT NULL")
    own = known.join(found.select("conv_id", "end"), "conv_id")
    stays = (F.col("place") != F.col("end")) | (F.col("role") != TRAINED_ROLE)
    names = F.filter(F.array(F.lit("chosen"), F.when(stays, F.lit("rejected"))), lambda x: x.isNotNull())
    kept = own.select(F.col("conv_id").alias("pair_id"), F.explode(names).alias("side"), "conv_id", "turn", "role", "text")
    return kept.unionByName(found.select(
        F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "other.conv_id",
        F.when(F.col("end") != LAST, F.col("end")).alias("turn"), F.lit(TRAINED_ROLE).alias("role"), "other.text",
    ))


def preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """:func:`formatted` for pairs ``(pair_id, chosen_id, rejected_id)`` of conversations.

    Rows of conversations that are in no pair, or have no ``conv_id``, are in no result, and a pair of which one side has no
    rows keeps the other side as completion.
    """
    sides = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.col("chosen_id").alias("conv_id"), F.lit("chosen").alias("side")),
        F.struct(F.col("rejected_id").alias("conv_id"), F.lit("rejected").alias("side")),
    )).alias("of")).select("pair_id", "of.*")
    return formatted(turns.select("conv_id", "turn", "role", "text").join(sides, "conv_id"))


def formatted(sides: DataFrame) -> DataFrame:
    """``pair_id, conv_id, part, turn, role, text, trained``, a row per rendered turn of every pair.

    ``sides`` has a row ``(pair_id, side, conv_id, turn, role, text)`` per turn of the ``chosen`` and the ``rejected`` side. The
    prompt is the longest common prefix of turns: all turn numbers before the first at which the two sides do not hold the
    same roles and texts. It is rendered once, from the chosen side (``part`` = ``prompt``). What follows is ``chosen`` or
    ``rejected``; ``trained`` marks the assistant's turns there, and all else is masked. Inside a part, rows are ordered by
    ``turn``, then ``role`` and ``text``.

    Two equal sides are all prompt. A turn number that is repeated holds all its rows; rows without a turn number come last.
    Null role and text are empty. No rows give no rows. Other columns, whatever their names, are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    place = F.coalesce(F.col("turn"), F.lit(LAST)).alias("place")
    rows = sides.select("pair_id", "side", "conv_id", "turn", place, role.alias("role"), text.alias("text"))

    # A turn's rows as a number that does not depend on their order, made on the map side.
    mark = F.xxhash64("role", "text")
    signature = [F.count("*").alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(mark, F.lit(1))).alias("mixed")]
    states = rows.groupBy("pair_id", "place", "side").agg(*signature)
    turn = states.groupBy("pair_id", "place").agg(*(
        F.max(F.when(F.col("side") == s, F.struct("n", "total", "mixed"))).alias(s) for s in ("chosen", "rejected")
    ))
    cuts = turn.groupBy("pair_id").agg(F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("place"))).alias("cut"))
    joined = rows.join(cuts, "pair_id")
    shared = F.col("cut").isNull() | (F.col("place") < F.col("cut"))
    parts = joined.withColumn("part", F.when(shared, F.lit("prompt")).otherwise(F.col("side")))
    once = parts.filter((F.col("part") != "prompt") | (F.col("side") == "chosen"))
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED_ROLE)
    return once.select(
        "pair_id", "conv_id", "part", "turn", "role", rendered(F.col("role"), F.col("text")).alias("text"), trained.alias("trained")
    )


def records(rows: DataFrame) -> DataFrame:
    """``pair_id, prompt, chosen, rejected, chosen_spans, rejected_spans``, a row per pair, for a trainer.

    Texts are the rendered turns of a part one after another; the spans ``(start, end)``, in code points of the completion
    and end exclusive, are what is trained on. All turns of a pair meet in one row, so this is for pairs that fit a trainer's
    input; the rows themselves have no such bound.
    """
    key = F.struct(F.coalesce(F.col("turn"), F.lit(LAST)).alias("place"), "role", "text", "trained")
    of = lambda part: F.array_sort(F.collect_list(F.when(F.col("part") == part, key))).alias(part)
    pairs = rows.groupBy("pair_id").agg(of("prompt"), of("chosen"), of("rejected"))

    def whole(part: str) -> F.Column:
        return F.array_join(F.transform(part, lambda x: x["text"]), "").alias(part)

    def spans(part: str) -> F.Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(seen, x):
            end = seen["at"] + F.length(x["text"])
            more = F.when(x["trained"], F.array(F.struct(seen["at"].alias("start"), end.alias("end"))))
            return F.struct(end.alias("at"), F.concat(seen["spans"], F.coalesce(more, F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"))

        return F.aggregate(part, start, step, lambda seen: seen["spans"]).alias(f"{part}_spans")

    return pairs.select("pair_id", whole("prompt"), whole("chosen"), whole("rejected"), spans("chosen"), spans("rejected"))


SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(turn, 9223372036854775807) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), answers AS (
    SELECT conv_id, place AS last, max(text) AS answer FROM turns t
    WHERE role = 'assistant' AND place = (SELECT max(place) FROM turns u WHERE u.conv_id = t.conv_id AND u.role = 'assistant')
    GROUP BY conv_id, place
), swapped AS (
    SELECT a.conv_id, a.last, coalesce(n.conv_id, p.conv_id) AS other, coalesce(n.answer, p.answer) AS answer
    FROM answers a LEFT JOIN answers n ON n.conv_id = a.conv_id + 1 LEFT JOIN answers p ON p.conv_id = a.conv_id - 1
    WHERE coalesce(n.conv_id, p.conv_id) IS NOT NULL
), sides AS (
    SELECT conv_id AS pair_id, true AS is_chosen, conv_id, turn, place, role, text FROM turns JOIN swapped USING (conv_id)
    UNION ALL SELECT conv_id, false, conv_id, turn, place, role, text FROM turns JOIN swapped USING (conv_id)
    WHERE NOT (place = last AND role = 'assistant')
    UNION ALL SELECT conv_id, false, other, nullif(last, 9223372036854775807), last, 'assistant', answer FROM swapped
), contents AS (
    SELECT pair_id, place, list_sort(list([role, text]) FILTER (is_chosen)) AS chosen,
        list_sort(list([role, text]) FILTER (NOT is_chosen)) AS rejected
    FROM sides GROUP BY ALL
), cuts AS (
    SELECT pair_id, min(place) FILTER (chosen IS DISTINCT FROM rejected) AS cut FROM contents GROUP BY 1
), parts AS (
    SELECT *, CASE WHEN cut IS NULL OR place < cut THEN 'prompt' WHEN is_chosen THEN 'chosen' ELSE 'rejected' END AS part
    FROM sides JOIN cuts USING (pair_id)
)
SELECT pair_id, conv_id, part, turn, role,
    '<|im_start|>' || role || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS text,
    part <> 'prompt' AND role = 'assistant' AS trained
FROM parts WHERE part <> 'prompt' OR is_chosen
"""
