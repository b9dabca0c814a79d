"""Threads kept up to date batch by batch.

A ledger holds which thread each letter got when it came, and which threads
were merged since. A batch looks its letters up, joins its chains and the
threads they touch into components, and appends: labels of new letters, and the
threads that now belong to a smaller one. Nothing stored is computed anew, so a
batch costs what it touches. Threads are named by their smallest chain, so
batches in any order, and all at once, give the same threads; a replayed batch
does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkb.operators.components import connected_components, follow
from loomkb.operators.ledger import Ledger, Snapshot
from loomkb.storage import materialize

LABELS, MERGES = "letter string, thread long", "thread long, merged_into long"
#: Chains have a label of their own beside those of letters.
CHAIN = "\u0000"


def merged_into(at: Snapshot) -> DataFrame:
    """(thread, root) of all threads that belong to another one now."""
    merges = at.table("merges", MERGES)
    # a thread is merged once: afterwards its letters are those of its root
    return follow(merges.groupBy(F.col("thread").alias("node")).agg(F.min("merged_into").alias("parent"))).select(F.col("node").alias("thread"), F.col("parent").alias("root"))


def ingested(before: Snapshot, letters: DataFrame) -> dict[str, DataFrame]:
    """Labels and merges to append for letters (chain, letter); letter names its content, null letters say nothing."""
    chains = letters.select("chain").where("chain IS NOT NULL").distinct()
    named = chains.select("chain", F.concat(F.lit(CHAIN), F.col("chain").cast("string")).alias("letter"))
    given = materialize(letters.select("chain", "letter").where("chain IS NOT NULL AND letter IS NOT NULL").distinct().unionByName(named), "given")
    roots = materialize(merged_into(before), "roots")
    labels = before.table("labels", LABELS).select("letter", "thread")
    # the batch is the small side: stored labels are read, not moved
    found = labels.join(given, "letter").join(roots, "thread", "left").select("chain", "letter", F.coalesce("root", "thread").alias("root"))
    found = materialize(found, "found")
    fresh = given.join(found.select("letter").distinct(), "letter", "left_anti")
    hubs = fresh.groupBy("letter").agg(F.min("chain").alias("hub"))
    edges = found.select(F.col("chain").alias("a"), F.col("root").alias("b")).unionByName(fresh.join(hubs, "letter").select(F.col("chain").alias("a"), F.col("hub").alias("b")))
    component = materialize(connected_components(edges), "component")
    placed = fresh.join(component, fresh["chain"] == component["node"], "left")
    moved = found.select("root").distinct().join(component.where("node <> component"), F.col("root") == F.col("node"))
    return {
        "labels": placed.groupBy("letter").agg(F.min(F.coalesce("component", "chain")).alias("thread")),
        "merges": moved.select(F.col("root").alias("thread"), F.col("component").alias("merged_into")),
    }


def ingest(ledger: Ledger, application: str, batch: int, letters: DataFrame) -> int:
    """Take a batch of letters (chain, letter) into the ledger; the version that holds it."""
    return ledger.commit(application, batch, lambda before: ingested(before, letters))


def batch_writer(ledger: Ledger, application: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream of letters."""

    def write(rows: DataFrame, batch: int) -> None:
        ingest(ledger, application, batch, rows)

    return write


def threads(at: Snapshot) -> tuple[DataFrame, DataFrame]:
    """((letter, thread), (chain, thread)) as of a version."""
    now = at.table("labels", LABELS).join(materialize(merged_into(at), "roots"), "thread", "left").select("letter", F.coalesce("root", "thread").alias("thread"))
    chain = F.startswith(F.col("letter"), F.lit(CHAIN))
    return now.where(~chain), now.where(chain).select(F.substring("letter", 2, 20).cast("long").alias("chain"), "thread")
