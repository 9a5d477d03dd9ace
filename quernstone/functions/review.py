"""Scores of a reviewing model: parsing, grades, order and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score of a note the model left out, of each part; least sum that is kept, by profile.
DEFAULT, LEAST = 3, {"dense": 4, "balanced": 6, "sparse": 7}
_SHAPE = "array<struct<index:int,insight_score:double,knowledge_score:double,final_score:double,verdict:string,reason:string>>"


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5).cast("int")


def grade(final: Column) -> Column:
    return F.when(final >= 8, "优").when(final >= 6, "良").when(final >= 4, "中").otherwise("差")


def reviewed(notes: DataFrame, answers: DataFrame, least: int = LEAST["balanced"], group: str = "batch_no", pos: str = "pos") -> DataFrame:
    """group, pos, insight, knowledge, final, kept, place of every note.

    ``notes``: group, pos (from 0 within its group); ``answers``: group, answer,
    the text of a model: a JSON array with index (from 1; of several entries of
    one the last counts, those of no note don't), the scores of two parts (1 to
    5, 3 where missing) and a final one, which else is their sum. Notes that
    are missing, and all of a group whose answer can't be read, get 3 and 3.
    place: of those kept, by final score and then by pos.
    """
    parsed = F.from_json(F.regexp_extract("answer", r"(?s)\[.*\]", 0), _SHAPE)
    rows = answers.select(group, F.posexplode(parsed).alias("at", "r")).where("r is not null")
    index = F.greatest(F.lit(0), F.coalesce(F.col("r.index"), F.lit(1)) - 1)
    last = rows.groupBy(group, index.alias(pos)).agg(F.max_by("r", "at").alias("r"))
    score = lambda c: F.greatest(F.lit(1), F.least(F.lit(5), rounded(F.coalesce(F.col(c), F.lit(float(DEFAULT))))))
    both = notes.select(group, pos).join(last, [group, pos], "left").select(group, pos, score("r.insight_score").alias("insight"), score("r.knowledge_score").alias("knowledge"), F.col("r.final_score").alias("given"))
    final = F.coalesce(rounded(F.col("given")), F.col("insight") + F.col("knowledge"))
    done = both.select(group, pos, "insight", "knowledge", final.alias("final")).withColumn("kept", F.col("final") >= least)
    order = Window.partitionBy(group, "kept").orderBy(F.desc("final"), pos)
    return done.withColumn("place", F.when(F.col("kept"), F.row_number().over(order)))


def stats(rows: DataFrame, group: str = "batch_no") -> DataFrame:
    """group, mean_final, kept, dropped."""
    return rows.groupBy(group).agg(F.round(F.avg("final"), 6).alias("mean_final"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


def band(similarity: Column, high: float = 0.8, mid: float = 0.6) -> Column:
    """high, mid or plain: how near a note is to what is there; none is dropped for it."""
    return F.when(similarity >= high, "high").when(similarity >= mid, "mid").otherwise("plain")
