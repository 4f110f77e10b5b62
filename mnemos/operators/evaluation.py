"""Retrieval over conversations: turns to remember, questions to recall, and a gate on the metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.plans.search import Recall

#: How far a metric may fall before the gate closes.
LARGEST_DROP = 0.001


def anchor_name(text: Column) -> Column:
    """A name as an anchor: what is no ASCII letter or digit becomes one hyphen, none at the ends."""
    return F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), F.lit("-"))


def turns_to_remember(turns: DataFrame, graph: int = 0) -> DataFrame:
    """Remember inputs (without a writing time and vector) of conversation turns, and their turn.

    ``turns``: conversation, session, turn, speaker, text, caption, session_at. Each is one fact,
    "speaker: text" with the caption of a shared image behind it and typographic apostrophes,
    said at the time of its session, filed under its conversation, its session and its speaker.
    Null texts are empty; turns without a speaker or conversation aren't filed."""
    caption = F.when(F.coalesce(F.trim("caption"), F.lit("")) != "", F.concat(F.lit(" [shared image: "), F.col("caption"), F.lit("]"))).otherwise(F.lit(""))
    value = F.replace(F.concat(F.col("speaker"), F.lit(": "), F.coalesce("text", F.lit("")), caption), F.lit("'"), F.lit("\u2019"))
    topics = F.array(F.concat(F.lit("conv-"), F.col("conversation")), F.concat(F.lit("session-"), F.col("session").cast("string")))
    rows = turns.where("speaker is not null and conversation is not null")
    return rows.select(
        F.lit(graph).cast("smallint").alias("graph_id"), value.alias("value"), F.transform(topics, F.lower).alias("topics"),
        F.array(F.lower(anchor_name(F.col("speaker")))).alias("entities"), F.col("session_at").alias("said_at"), F.col("turn"),
    )


def evidence(questions: DataFrame, question: str = "question_id", found: str = "evidence") -> DataFrame:
    """(``question``, turn): every well-formed turn id in the evidence strings, once."""
    ids = F.regexp_extract_all(F.col("e"), F.lit(r"D\d+:\d+"), F.lit(0))
    return questions.select(question, F.explode(found).alias("e")).select(question, F.explode(ids).alias("turn")).distinct()


def question_words(text: Column) -> Column:
    """The plain words a question is asked by."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))


def questions_to_recalls(questions: DataFrame, top: int = 10, graph: int = 0) -> list[Recall]:
    """A batch of recalls, the driver holds it as any batch that is asked: the words of
    each question beside the topic of its conversation. ``questions``: question_id, conversation, question, evidence.
    A question whose evidence names no turn can't be scored and is left out."""
    asked = questions.join(evidence(questions).select("question_id").distinct(), "question_id", "left_semi")
    rows = asked.select("question_id", "conversation", question_words(F.col("question")).alias("words")).collect()
    return [Recall(tuple(r["words"]), topics=(f"conv-{r['conversation']}".lower(),), graph_id=graph, top=top, query_id=r["question_id"]) for r in rows]


def dropped(base: DataFrame, head: DataFrame, keys: Sequence[str], metrics: Sequence[str], most: float = LARGEST_DROP) -> DataFrame:
    """(``keys``, metric, base, head): the metrics that fell by more than ``most``; null keys (the total) count as equal. The gate holds while it is empty."""

    def long(df: DataFrame, name: str) -> DataFrame:
        values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("v")
        return df.select(*keys, values).select(*keys, "v.metric", f"v.{name}")

    a, b = long(base, "base").alias("a"), long(head, "head").alias("b")
    same = F.col("a.metric") == F.col("b.metric")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.join(b, same)
    return both.where(F.round(F.col("base") - F.col("head"), 12) > most).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.metric").alias("metric"), "base", "head")
