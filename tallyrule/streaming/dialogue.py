"""Dialogues: history by windows, and the same fold as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """messages with history: the messages so far, this one included, as (role, text)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("history", F.collect_list(F.struct("role", "text")).over(w))


def exchanges(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, order, prompt, response: each user message with the answer that follows it, null if none does."""
    w = Window.partitionBy(key).orderBy(order)
    paired = messages.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).where("role = 'user'")
    return paired.select(key, order, F.col("text").alias("prompt"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("response"))


def until_error(turns: DataFrame, key: str, order: str, error: str) -> DataFrame:
    """The turns of each item up to its first error, that one included."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col(error).isNotNull().cast("int")).over(w), F.lit(0))
    return turns.withColumn("__before", before).where("__before = 0").drop("__before")


def generate(prompts: DataFrame, answer: Callable[[list[tuple[str, str]]], str], key: str = "conv_id", order: str = "turn", system: str | None = None, retries: int = 5, delay: float = 0.0) -> DataFrame:
    """key, order, prompt, response, error: the answers of a generator, each turn seeing the earlier ones.

    A conversation's turns run one after another in one task, conversations side by side. An answer that fails is asked for
    again, retries times in all and delay seconds apart; then its error stands in place of the answer."""
    kinds = {f.name: f.dataType.simpleString() for f in prompts.schema}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        said = [("system", system)] if system else []
        out = []
        for at, prompt in rows.sort_values(order)[[order, "prompt"]].itertuples(index=False):
            said.append(("user", prompt))
            text, error = None, None if prompt else "empty prompt"
            for attempt in range(retries if prompt else 0):
                if attempt and delay:
                    time.sleep(delay)
                try:
                    text, error = answer(list(said)), None
                    break
                except Exception as e:  # the generator's own failures become a column
                    error = str(e)
            said.append(("assistant", text or ""))
            out.append((rows[key].iloc[0], at, prompt, text, error))
        return pd.DataFrame(out, columns=[key, order, "prompt", "response", "error"])

    return prompts.select(key, order, "prompt").groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, prompt string, response string, error string")


def replay(prompts: DataFrame, responses: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, order, prompt, response, error from answers that are there already (key, order, response): no generator is asked."""
    out = prompts.select(key, order, "prompt").join(responses.select(key, order, "response"), [key, order], "left")
    return out.withColumn("error", F.when(F.col("response").isNull(), F.lit("no response")))


def fold_stream(messages: DataFrame) -> DataFrame:
    """conv_id, turn, n_messages, n_chars of a stream of messages: the running length of each conversation.

    State is the two counts; messages of a conversation come in order of their turns."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, chars = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values("turn")
        out = []
        for turn, text in rows[["turn", "text"]].itertuples(index=False):
            n, chars = n + 1, chars + len(text or "")
            out.append((key[0], turn, n, chars))
        state.update((n, chars))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "n_messages", "n_chars"])

    return messages.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, n_messages long, n_chars long", "n long, chars long", "append", "NoTimeout")


def history_stream(messages: DataFrame, error: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, late, history of a stream of messages (conv_id, turn, role, text): as `history`, turn by turn.

    State holds each conversation's messages, its last turn and whether it has ended; a restart goes on from it. Within a
    batch messages are taken in the order of their turns, null first. One that comes in a later batch than a message of its
    own or a later turn is late: it comes out without a history, and later ones don't see it. With error, the name of a
    column, a conversation ends with its first message that has one, as with `until_error`: later ones don't come out."""
    kinds = "conv_id {}, turn long, role string, text string, late boolean, history array<struct<role:string,text:string>>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        roles, texts, last, ended = state.get if state.exists else ([], [], None, False)
        roles, texts, seen, out = list(roles), list(texts), len(roles) > 0, []
        before = last
        rows = pd.concat(list(frames)).sort_values("turn", na_position="first", kind="stable")
        for turn, role, text, failed in rows[["turn", "role", "text", "__error"]].itertuples(index=False):
            turn = None if pd.isna(turn) else int(turn)
            if ended:
                break
            late = seen and (turn is None or (before is not None and turn <= before))
            if not late:
                roles.append(role)
                texts.append(text)
                last, ended = turn, bool(failed)
            out.append((key[0], turn, role, text, late, None if late else [{"role": r, "text": t} for r, t in zip(roles, texts, strict=True)]))
        state.update((roles, texts, last, ended))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "late", "history"]).astype({"turn": "Int64"})

    failed = F.col(error).isNotNull() if error else F.lit(False)
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", failed.alias("__error"))
    kinds = kinds.format(messages.schema["conv_id"].dataType.simpleString())
    return rows.groupBy("conv_id").applyInPandasWithState(step, kinds, "roles array<string>, texts array<string>, last long, ended boolean", "append", "NoTimeout")
