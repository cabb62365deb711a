r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
its context, and of the whole only that reply is trainable. A turn reads

    <turn ROLE>
    TEXT
    </turn>

Inside a text a backslash and `<` are written with a backslash before them, in
a role a backslash and `>`. So no text can hold a mark, and reading back gives
exactly what was written. A conversation that doesn't end with an assistant
turn gets one more example of all its turns, in which nothing is trainable, so
that no turn is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
TURN = re.compile(r"<turn ([^\\>]*(?:\\.[^\\>]*)*)>\n([^\\<]*(?:\\.[^\\<]*)*)\n</turn>\n", re.DOTALL)


def escaped(text: Column, mark: str) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(mark), F.lit("\\" + mark))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of an example."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def expand(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 1), formatted, loss_start, loss_stop, final.

    The trainable reply is formatted[loss_start:loss_stop], counted in code
    points, still escaped; where nothing is trainable both are equal. final
    marks the example that holds the whole conversation. Turns stand in the
    order of (turn, role, text), nulls first, so ties have one order; repeated rows are
    repeated turns. A null text or role counts as empty. Rows without a conv_id
    are one conversation. No rows give none. Other columns are ignored.

    An example holds its whole context, so a conversation is as large as its
    longest example, a row; examples of one conversation are dealt out before they are made.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    own = lambda t: escaped(t["text"], "<")
    piece = lambda t: F.concat(F.lit("<turn "), escaped(t["role"], ">"), F.lit(">\n"), own(t), F.lit("\n</turn>\n"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == ASSISTANT) | (i == n))
    one = turns.select("conv_id", "turns", F.posexplode(ends).alias("example", "end")).withColumn("last", F.element_at("turns", F.col("end")))
    formatted = F.array_join(F.transform(F.slice("turns", 1, F.col("end")), piece), "")
    out = one.select("conv_id", (F.col("example") + 1).alias("example"), formatted.alias("formatted"), F.when(F.col("last.role") == ASSISTANT, F.length(own(F.col("last")))).otherwise(0).alias("reply"), (F.col("end") == n).alias("final"))
    stop = F.length("formatted") - len("\n</turn>\n")
    return out.select("conv_id", "example", "formatted", (stop - F.col("reply")).alias("loss_start"), stop.alias("loss_stop"), "final")


def read_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each example its length and its reply, and of the final one the turns."""
    for frame in frames:
        rows = []
        for conv_id, example, formatted, start, stop, final in frame.itertuples(index=False):
            turns = read_turns(formatted) if final else None
            digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest() if final else None
            rows.append((conv_id, example, len(formatted), unescape(formatted[start:stop]), len(turns) if final else None, digest))
        yield pd.DataFrame(rows, columns=["conv_id", "example", "chars", "reply", "n_turns", "turns_sha256"]).astype({"conv_id": "Int64", "n_turns": "Int64"})


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the examples."""
    columns = examples.select("conv_id", "example", "formatted", "loss_start", "loss_stop", "final")
    read = columns.mapInPandas(read_back, "conv_id bigint, example int, chars bigint, reply string, n_turns bigint, turns_sha256 string")
    replies = F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"])
    whole = read.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.array_join(replies, "").alias("loss"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
