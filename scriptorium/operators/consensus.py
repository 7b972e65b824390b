"""Consensus of several annotators under configurable tracks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import confidence_rank
from scriptorium.schemas import CONFIDENCE_RANK, CONSENSUS_COLUMNS


@dataclass(frozen=True)
class Track:
    """Which rows count, how many models must agree, and how a group becomes one row."""

    name: str
    models: tuple[str, ...] = ()
    agreement: str = "partial"
    min_models: int = 2
    min_confidence: str = "medium"
    resolve_type: str = "majority"


# The standard tracks.
TRACKS = (
    Track("conservative", agreement="full", min_models=3, min_confidence="high"),
    Track("moderate"),
    Track("liberal", agreement="any", min_models=1, min_confidence="low", resolve_type="all"),
)


def parse_track(name: str, settings: dict) -> Track:
    """A track from its settings in a configuration file; missing ones take the defaults."""
    got = {k: v for k, v in settings.items() if k in ("agreement", "min_models", "min_confidence", "resolve_type")}
    return Track(name, models=tuple(settings.get("models") or ()), **got)


def qualified(clustered: DataFrame, track: Track) -> DataFrame:
    """Rows that pass the track's filters, with n_models, models_agreed and agreement of their groups.

    Models and confidence filter rows first; the group's figures are those of the rows left. A confidence
    that is not known never passes, an unknown floor is the lowest.
    """
    rows = clustered
    if track.models:
        rows = rows.where(F.col("model_label").isin(*track.models))
    rows = rows.where(confidence_rank(F.col("confidence")) >= CONFIDENCE_RANK.get(track.min_confidence, 1))
    # one shuffle by group serves these windows and those that choose a group's row
    group = W.partitionBy("group_id")
    rows = rows.withColumn("c_labels", F.array_sort(F.collect_set("model_label").over(group))).withColumn("c_types", F.size(F.collect_set("soc_type").over(group)))
    rows = rows.withColumn("n_models", F.size("c_labels")).withColumn("models_agreed", F.array_join("c_labels", ", ")).withColumn("agreement", F.when(F.col("c_types") == 1, "full").otherwise("partial"))
    rows = rows.where(F.col("n_models") >= track.min_models).drop("c_labels", "c_types")
    return rows.where("agreement = 'full'") if track.agreement == "full" else rows


def majority_rows(rows: DataFrame) -> DataFrame:
    """One row of each group: of the type with most rows (then highest mean confidence, then first seen) the best (confidence, length, first)."""
    ranked = rows.withColumn("c_rank", confidence_rank(F.col("confidence")))
    of_type = W.partitionBy("group_id", "soc_type")
    votes = ranked.withColumn("c_votes", F.count("*").over(of_type)).withColumn("c_mean", F.avg("c_rank").over(of_type)).withColumn("c_first", F.min("row_id").over(of_type))
    order = W.partitionBy("group_id").orderBy(F.desc("c_votes"), F.desc("c_mean"), "c_first", F.desc("c_rank"), F.desc(F.length("passage")), "row_id")
    return votes.withColumn("c_n", F.row_number().over(order)).where("c_n = 1").drop("c_rank", "c_votes", "c_mean", "c_first", "c_n")


def longest_rows(rows: DataFrame) -> DataFrame:
    """One row of each group: the first of the longest passages."""
    order = W.partitionBy("group_id").orderBy(F.desc(F.length("passage")), "row_id")
    return rows.withColumn("c_n", F.row_number().over(order)).where("c_n = 1").drop("c_n")


def apply_track(clustered: DataFrame, track: Track) -> DataFrame:
    """The track's consensus rows; order them by (source_file, chunk_index, chunk_id, group_id, row_id)."""
    rows = qualified(clustered, track)
    if track.resolve_type == "majority":
        rows = majority_rows(rows)
    elif track.resolve_type == "longest":
        rows = longest_rows(rows)
    return rows.select("group_id", "row_id", *[c for c in CONSENSUS_COLUMNS if c in rows.columns])


def ordered(consensus: DataFrame) -> DataFrame:
    return consensus.orderBy("source_file", "chunk_index", "chunk_id", "group_id", "row_id")
