"""Task and card state as append-only logs read by latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave import schema
from litweave.functions.arrays import empty


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest `order`. An aggregate, so a key with very many
    versions is reduced before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*log.columns)



def stringify(df: DataFrame, name: str) -> Column:
    """Text of a result column: strings unchanged, anything else as JSON."""
    kind = df.schema[name].dataType.simpleString()
    return F.col(name) if kind == "string" else F.to_json(name)


def board_json(boards: DataFrame) -> DataFrame:
    """boards (columns of the board schema) → (task_id, topic, status, blackboard)."""
    columns = [F.col(c) for c in boards.columns]
    return boards.select(
        "task_id", "topic", "status", F.to_json(F.struct(*columns)).alias("blackboard")
    )


def save_tasks(boards: DataFrame, path: str) -> None:
    """Append the state of tasks, stamped with the current time."""
    stamped = board_json(boards).withColumn("updated_at", F.current_timestamp())
    stamped.write.mode("append").parquet(path)


def read_boards(tasks: DataFrame) -> DataFrame:
    """Typed boards from stored JSON; fields the JSON lacks take their defaults."""
    parsed = tasks.select(F.from_json("blackboard", schema.BOARD).alias("b")).select("b.*")
    now = F.unix_timestamp().cast("double")
    defaults = {
        "plan": empty("struct<name:string,status:string,note:string>"),
        "candidates": empty("string"),
        "cards": F.create_map().cast(f"map<string,struct<{schema.CARD_FIELDS}>>"),
        "critic_feedback": empty(
            "struct<passed:boolean,issues:array<string>,suggestions:array<string>,method:string>"
        ),
        "status": F.lit("planning"),
        "artifacts": empty("string"),
        "created_at": now,
        "updated_at": now,
    }
    return parsed.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def load_task(tasks: DataFrame, task_id: str) -> DataFrame:
    """The board of one task; an unknown id gives no row."""
    return read_boards(tasks.where(F.col("task_id") == task_id))


def list_tasks(tasks: DataFrame) -> DataFrame:
    """(task_id, topic, status), newest first."""
    return tasks.orderBy(F.desc("updated_at"), "task_id").select("task_id", "topic", "status")


def task_summary(tasks: DataFrame) -> DataFrame:
    """(task_id, topic, status, cards, artifacts): number of cards and files of each task."""
    return read_boards(tasks).select(
        "task_id", "topic", "status", F.size(F.map_keys("cards")).alias("cards"), "artifacts"
    )


def remember_cards(cards: DataFrame, path: str) -> None:
    """Append extracted cards (paper_id, card_json) to the card memory."""
    stamped = cards.select("paper_id", "card_json", F.current_timestamp().alias("updated_at"))
    stamped.write.mode("append").parquet(path)


def recall_cards(wanted: DataFrame, memory_cards: DataFrame) -> DataFrame:
    """(paper_id, card_json) for wanted papers; null where no card is remembered."""
    newest = latest(memory_cards, ["paper_id"], ["updated_at"])
    return wanted.join(newest.select("paper_id", "card_json"), "paper_id", "left")
