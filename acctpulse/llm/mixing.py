"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acctpulse.session import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST_EPOCHS = 1.5, 2
BUCKET_ROWS = 50_000


def word_count(text) -> F.Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS
) -> DataFrame:
    """``(source, source_size, n_docs, target)``, one row per source.

    Sources in code-point order (null last) take the weights in turn. The budget, ``share`` of all sizes, is shared by
    weight, no source above ``epochs`` times its size: sources are filled in order of size to weight, and the first
    that needs less than an equal level stays at its cap, which leaves more for the rest.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # One row per source from here on: windows over all of them are small.
    everything = Window.partitionBy(F.lit(0))
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(order, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("order", order).withColumn("weight", weight.cast("bigint"))
    cap = F.lit(epochs) * F.col("source_size")
    tight = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), "order")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum(
        "weight"
    ).over(tight.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= cap)
    # The level of the first source that is not capped holds for all that follow it.
    common = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), "order", "level"))).over(everything)
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(common["level"] * F.col("weight"))
    return leveled.select("source", "source_size", "n_docs", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = MOST_EPOCHS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: how many words of each document the mix takes.

    Every source is a queue of its documents in shuffled order (MD5 of the document id), once per epoch. A document's
    virtual finish time is the source's running size up to it divided by the source's target. The queues are merged in
    order of finish time, and the merged list is cut where the running total would pass the budget.

    Both running totals are made in two steps, so no task holds a whole source or the whole list: totals of
    buckets (of shuffle order, then of finish time), added up over the buckets, and a window inside a bucket. Buckets
    hold about ``bucket_rows`` rows, also of a source that has a third of all documents.

    Null text has size 0 and is never taken; a null source is a source of its own; a null ``doc_id`` is shuffled as
    an empty id. Rows with equal ids and sizes are interchangeable. No rows give no rows. Other columns, whatever
    their names, are not read.
    """
    return _Mix(docs, weights, share, epochs, bucket_rows).light.select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, in the columns of ``docs``, under any names.

    Null and empty texts are never taken; null ids and sources, repeated rows and rows that share an id are treated as ``mix``
    does, each for itself. No rows give no rows.
    """
    plan = _Mix(docs, **options)
    own = docs.select(F.struct(*map(F.col, _quoted(docs))).alias("row"), "doc_id", "source", "text")
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    taken = plan.taken(_sized(own, "row")).filter("taken > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("turn")).select("row.*")


def _quoted(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    queue = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    size = word_count(F.col("text"))
    return docs.select("doc_id", "source", size.alias("size"), F.md5(text_id).alias("shuffle"), queue.alias("queue"), *more)


class _Mix:
    """The numbers a mix needs: slots of the queues, and the place where the merged list is cut."""

    def __init__(self, docs, weights=WEIGHTS, share=SHARE, epochs=MOST_EPOCHS, bucket_rows=BUCKET_ROWS):
        self.epochs = epochs
        sizes = staged(_sized(docs), "sizes")
        targets = staged(source_targets(sizes, weights, share, epochs), "targets")
        n_docs, total = targets.agg(F.sum("n_docs"), F.sum("source_size")).first()
        self.slots = -(-(n_docs or 0) // bucket_rows) or 1
        self.budget = share * (total or 0)
        per_slot = sizes.groupBy("queue", self._slot()).agg(F.sum("size").alias("slot_size"))
        earlier = Window.partitionBy("queue").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("slot_size").over(earlier), F.lit(0))
        queue = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("queue")
        self.per_slot = staged(
            per_slot.select("queue", "slot", before.alias("slot_before")).join(
                targets.select(queue, "source_size", "target"), "queue"
            ),
            "slots",
        )
        queued = staged(self._queued(sizes), "queued")
        self.cut = self._cut(queued)
        self.light = self._taken(queued)

    def _slot(self) -> F.Column:
        """Bucket of the shuffle order: the leading digits of the hash."""
        lead = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("bigint")
        return F.floor(lead * F.lit(self.slots) / F.lit(float(1 << 32))).alias("slot")

    def _queued(self, rows: DataFrame) -> DataFrame:
        """``reached``: size of the queue up to and with a document."""
        inside = Window.partitionBy("queue", "slot").orderBy("shuffle", "doc_id", "size")
        running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        joined = rows.select("*", self._slot()).join(self.per_slot, ["queue", "slot"])
        return joined.withColumn("reached", F.col("slot_before") + running)

    def _turns(self, queued: DataFrame) -> DataFrame:
        """A row per document and epoch with its finish time."""
        epoch = F.explode(F.sequence(F.lit(0), F.lit(self.epochs - 1))).alias("epoch")
        turns = queued.filter("size > 0").select("queue", "size", "reached", "source_size", "target", epoch)
        finish = _finish(F.col("epoch"))
        # Targets add up to the budget: the cut lies near time 1, and the sizes are spread evenly over the times up to it.
        return turns.select("queue", "size", finish.alias("finish"), F.floor(finish * self.slots * self.epochs).alias("band"))

    def _cut(self, queued: DataFrame) -> tuple[float, str] | None:
        """Finish time and queue of the last turn that is taken."""
        turns = self._turns(queued)
        bands = turns.groupBy("band").agg(F.sum("size").alias("band_size"))
        # One row per band, a small part of the rows.
        order = Window.partitionBy(F.lit(0)).orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
        running = bands.withColumn("upto", F.sum("band_size").over(order))
        over = running.filter(F.col("upto") > self.budget).orderBy("band").first()
        if over is None:
            return float("inf"), ""
        before = over.upto - over.band_size
        peers = Window.partitionBy("band").orderBy("finish", "queue").rangeBetween(Window.unboundedPreceding, 0)
        inside = turns.filter(F.col("band") == over.band).withColumn("upto", before + F.sum("size").over(peers))
        last = inside.filter(F.col("upto") <= self.budget).agg(F.max(F.struct("finish", "queue")).alias("last")).first().last
        # Nothing in this band: the cut is its beginning.
        return (last.finish, last.queue) if last else (over.band / (self.slots * self.epochs), "")

    def _taken(self, queued: DataFrame) -> DataFrame:
        finish, queue = map(F.lit, self.cut)
        turns = [
            ((_finish(F.lit(e)) < finish) | ((_finish(F.lit(e)) == finish) & (F.col("queue") <= queue))).cast("bigint")
            for e in range(self.epochs)
        ]
        taken = F.when(F.col("size") > 0, sum(turns[1:], turns[0]) * F.col("size")).otherwise(F.lit(0))
        return queued.withColumn("taken", taken.cast("bigint"))

    def taken(self, rows: DataFrame) -> DataFrame:
        """``taken`` for sized rows that carry further columns."""
        return self._taken(self._queued(rows))


def _finish(epoch: F.Column) -> F.Column:
    return (F.col("reached") + epoch * F.col("source_size")) / F.col("target")


SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '')) AS shuffle, coalesce('=' || source, '') AS queue
    FROM documents
), sources AS (
    SELECT queue, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY queue
), ranked AS (
    SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM sources
), leveled AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE)
        / sum(weight) OVER rest::DOUBLE AS level
    FROM ranked
    WINDOW before AS (ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        rest AS (ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), shared AS (
    SELECT queue, source_size, CASE WHEN level * weight >= 2 * source_size THEN (2 * source_size)::DOUBLE ELSE
        weight * first_value(level) OVER (ORDER BY level * weight >= 2 * source_size, source_size::DOUBLE / weight, place)
        END AS target
    FROM leveled
), queued AS (
    SELECT doc_id, source, queue, size, source_size, target, shuffle,
        row_number() OVER (ORDER BY queue, shuffle, doc_id, size) AS row_no,
        sum(size) OVER (PARTITION BY queue ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS reached
    FROM sized JOIN shared USING (queue)
), turns AS (
    SELECT row_no, queue, size, (reached + epoch * source_size)::DOUBLE / target AS finish
    FROM queued, (VALUES (0), (1)) e (epoch) WHERE size > 0
), merged AS (
    SELECT row_no, size, sum(size) OVER (ORDER BY finish, queue RANGE UNBOUNDED PRECEDING) AS total FROM turns
), taken AS (
    SELECT row_no, sum(size)::BIGINT AS taken FROM merged
    WHERE total <= 1.5::DOUBLE * (SELECT sum(size) FROM sized)::DOUBLE GROUP BY row_no
)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued LEFT JOIN taken USING (row_no)
"""
