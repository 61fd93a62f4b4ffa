"""Batches of deliveries: by size, their offsets, payload and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.keys import batch_key
from ..functions.positions import highest
from .transactions import CAP, RANGE, _far


def numbered(rows: DataFrame, order: str, bucket: Column) -> DataFrame:
    """Adds ``rn``, 1 and up in ``order``, without one task that orders everything.

    ``bucket`` must rise with ``order``; rows are numbered inside buckets, which start after the rows before them.
    """
    dealt = rows.withColumn("_bucket", bucket)
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    return dealt.join(before, "_bucket").withColumn("rn", F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy(order))).drop("_bucket", "_before")


def size_batches(rows: DataFrame, order: str, bucket: Column, size: int = 100) -> DataFrame:
    """Adds ``batch_no``: so many rows a batch, in order."""
    return numbered(rows, order, bucket).withColumn("batch_no", F.floor((F.col("rn") - 1) / size).cast("bigint")).drop("rn")


def batch_offsets(batches: DataFrame, by: str = "batch_no") -> DataFrame:
    """Each batch's greatest position, taken as a pair."""
    return batches.groupBy(by).agg(highest().alias("max_position"))


def batched(events: DataFrame, cap: int = CAP, size: int = 100, tx: str = "transaction_id", leads: bool = False) -> DataFrame:
    """The events with ``delivery_batch``, and ``pending`` for those of transactions that are still open (no batch).

    A transaction from its (last) begin to its commit is a batch; one with more than ``cap`` events is cut there, and what follows
    is loose. So are events without a transaction or whose begin isn't here; they make batches of ``size`` in log order.
    ``leads`` adds a column that is true for one event of each batch. No task sorts a transaction whole.
    """
    kind = "event_type" if "event_type" in events.columns and "kind" not in events.columns else "kind"  # of events, or of log records
    at = F.struct(F.coalesce("binlog_file", F.lit("")).alias("f"), F.coalesce("position", F.lit(0)).alias("p"))
    has = F.col(tx).isNotNull()
    own, names = Window.partitionBy(tx), events.columns
    begins = events.where(has & (F.col(kind) == "tx_begin")).groupBy(F.col(tx).alias("_tx")).agg(F.max(at).alias("_begin"))
    placed = events.where(has).withColumn("_at", at).join(begins, F.col(tx) == F.col("_tx"), "left").drop("_tx")
    # without a begin, all is loose and nothing of it is sorted by transaction; what is before the begin isn't delivered
    begun = _far(placed.where(F.col("_at") >= F.col("_begin")), tx, cap + 1)
    near = begun.where(~F.col("_far")).withColumn("_n", F.row_number().over(own.orderBy("_at", F.col(kind) != "tx_begin", F.col(kind) == "tx_commit")))
    near = near.withColumn("_closed", F.min(F.when(F.col(kind) == "tx_commit", F.col("_n"))).over(own)).withColumn("_last", F.max("_n").over(own))
    inside = F.col("_n") <= F.least(F.lit(cap + 1), F.coalesce("_closed", F.col("_n")))
    whole = F.coalesce((F.col("_closed") <= cap + 1) | (F.col("_last") > cap), F.lit(False))
    labelled = near.withColumn("_in", inside).withColumn("delivery_batch", F.when(inside & whole, F.concat(F.lit("tx-"), F.col(tx).cast("string"))))
    labelled = labelled.withColumn("pending", inside & ~whole).withColumn("leads", inside & whole & (F.col("_n") == 1))
    loose = labelled.where(~F.col("_in")).select(*names, "_at").unionByName(begun.where("_far").select(*names, "_at")).unionByName(placed.where("_begin is null").select(*names, "_at")).unionByName(events.where(~has).withColumn("_at", at))
    bucket = F.struct(F.col("_at.f").alias("f"), F.floor(F.col("_at.p") / RANGE).alias("p"))
    loose = numbered(loose, "_at", bucket).withColumn("delivery_batch", F.concat(F.lit("loose-"), F.floor((F.col("rn") - 1) / size).cast("string")))
    loose = loose.withColumn("pending", F.lit(False)).withColumn("leads", (F.col("rn") - 1) % size == 0)
    out = [*names, "delivery_batch", "pending", *(["leads"] if leads else [])]
    return labelled.where("_in").select(*out).unionByName(loose.select(*out))


def figures(top: Column, done: Column) -> list[Column]:
    """What is counted of batches that have ``leads`` (see ``batched``), by sums and maxima alone, so that the pass that writes them can tell."""
    return [F.count_if(F.col("leads")).alias("batches_delivered"), F.count_if(done).alias("events_delivered"), F.count_if(~done).alias("events_pending"), F.max(F.when(done, top)).alias("top"), F.min(F.when(~done, top)).alias("open")]


def measured(batches: DataFrame) -> tuple[DataFrame, Observation]:
    """The batches without ``leads``, and their figures: ``batches_delivered``, ``events_delivered``, ``events_pending``, the greatest
    position delivered (``top``) and the least that is pending (``open``), each a struct or null. They are there once an action has
    gone over the rows; write them in that action, last in its plan, and no other scan is needed. A retried task counts once.
    """
    seen = Observation()
    place = F.when(F.col("binlog_file").isNotNull(), F.struct("binlog_file", F.coalesce("position", F.lit(0)).cast("long").alias("position")))
    return batches.observe(seen, *figures(place, ~F.col("pending"))).drop("leads"), seen


def summary(batches: DataFrame) -> DataFrame:
    """One row about what ``batched`` gives: batches, events delivered and pending, and the last position.

    With ``leads`` batches are counted by a sum; without, their names are, which takes a table of them in each task.
    """
    batches_delivered = F.count_if(F.col("leads")) if "leads" in batches.columns else F.countDistinct("delivery_batch")
    done = ~F.col("pending")
    top = F.max(F.when(done & F.col("binlog_file").isNotNull(), F.struct("binlog_file", F.coalesce("position", F.lit(0)).alias("position"))))
    return batches.agg(batches_delivered.alias("batches_delivered"), F.count_if(done).alias("events_delivered"), F.count_if(~done).alias("events_pending"), top["binlog_file"].alias("last_binlog_file"), top["position"].alias("last_position"))


def payloads(batches: DataFrame, by: str, key: str = "idempotency_key", tx: str = "transaction_id") -> DataFrame:
    """What a webhook is sent about each batch: counts, greatest position, its only transaction, and the batch's key."""
    agg = batches.groupBy(by).agg(
        F.count("*").alias("event_count"),
        highest().alias("top"),
        F.min(tx).alias("_lo"),
        F.max(tx).alias("_hi"),
        batch_key(key).alias("batch_key"),
    )
    return agg.select(by, "event_count", F.col("top.binlog_file").alias("max_binlog_file"), F.col("top.position").alias("max_binlog_position"), F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("transaction_id"), "batch_key")


def statistics(log: DataFrame, tx: str = "transaction_id") -> DataFrame:
    """One row: events submitted, delivered with their transaction, delivered alone, and transactions still open."""
    has = lambda kind: F.max(F.col("kind") == kind)
    # loose events are the group without a transaction
    per_tx = log.groupBy(tx).agg(F.count("*").alias("events"), has("tx_begin").alias("begun"), has("tx_commit").alias("committed"))
    whole, begun, loose = F.col("begun") & F.col("committed"), F.col("begun"), F.col(tx).isNull()
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("events"))), F.lit(0)).cast("bigint")
    return per_tx.agg(total(F.lit(True)).alias("events_submitted"), total(whole & ~loose).alias("tx_events_delivered"), total(~begun | loose).alias("non_tx_events"), F.count_if(begun & ~F.col("committed") & ~loose).alias("pending_transactions"))
