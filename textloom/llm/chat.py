"""Chat formatting from an event log: reconstruct conversations, then render them with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: The template: <s> once, then for each turn [INST role] text [/INST] or, for the assistant, text </s>.
BEGIN, OPEN, MIDDLE, CLOSE = "<s>", "[INST ", "]", "[/INST]"
REPLY, END = "[REPLY]", "</s>"
#: No marker can occur in an escaped text, since each holds < or [.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsq;"))
#: Turns of a part; a long conversation is rendered as several parts.
PART_TURNS = 64
TURN = re.compile(r"\[INST ([^\]]*)\]([^\[<]*)(?:\[/INST\])|\[REPLY\]([^\[<]*)</s>")

RENDERED = "conv_id long, part long, formatted string, loss_spans array<struct<start:int,end:int>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    for plain, coded in ESCAPES:
        text = text.replace(plain, coded)
    return text


def unescape(text: str) -> str:
    for plain, coded in reversed(ESCAPES):
        text = text.replace(coded, plain)
    return text


def messages_as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished messages as the event log of a chat that led to them.

    An assistant's text was streamed, regenerated and streamed again: an opening message, a delta of a first try, a
    'regenerate', and the text in two deltas. Any other text was sent as a draft and then edited. Rows that share a
    turn are branches of it, in order of (role, text), and all of them stay; null text is empty.
    """
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    half = (F.length(text) / 2).cast("int")

    def step(k: int, kind: str, content: F.Column) -> F.Column:
        return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), content.alias("text"))

    streamed = F.array(
        step(0, "message", F.lit("")), step(1, "delta", F.left(text, half)), step(2, "regenerate", F.lit("")),
        step(3, "delta", F.left(text, half)), step(4, "delta", F.substr(text, half + 1)),
    )
    sent = F.array(step(0, "message", F.left(text, half)), step(1, "edit", text))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.row_number().over(w).alias("branch"), F.when(F.col("role") == "assistant", streamed).otherwise(sent).alias("steps"))
    events = rows.select("*", F.explode("steps").alias("step"))
    return events.select("conv_id", (F.col("turn") * 8 + F.col("step.k")).alias("seq"), "step.kind", "turn", "branch", "role", "step.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log (conv_id, seq, kind, turn, branch, role, text), in order of seq.

    Kinds: 'message' and 'edit' set a message's text, 'delta' appends to it, 'regenerate' empties it (the
    deltas that follow build it anew) and 'delete' removes it. Any other or null kind counts as 'message'. A
    later event without a role keeps the message's role. Only events since a message's last setting one
    count, so the fold is an aggregate over (conversation, turn, branch), not over a whole conversation.

    Events with equal seq apply in order of (kind, text). A log that repeats an event applies it again. Null
    conv_ids form one conversation; a null turn comes first. An empty log gives no messages. A message of very many deltas is
    one row of its aggregate. Other columns than those named are not read, so they cannot clash.

    Returns conv_id, turn, branch, role, text.
    """
    keys = ["conv_id", "turn", "branch"]
    e = events.select(*keys, F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("text", F.lit("")).alias("text")).alias("at"), "role")
    folded = e.groupBy(*keys).agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"),
        F.max(F.when(F.col("at.kind") != "delta", F.col("at"))).alias("reset"),
        F.max("at").alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("at.kind") == "delta", F.col("at")))).alias("deltas"),
    )
    after = F.filter("deltas", lambda d: F.col("reset").isNull() | (d > F.col("reset")))
    first = F.when(F.col("reset.kind") == "regenerate", F.lit("")).otherwise(F.coalesce(F.col("reset.text"), F.lit("")))
    text = F.concat(first, F.array_join(F.transform(after, lambda d: d["text"]), ""))
    return folded.filter(F.col("last.kind") != "delete").select(*keys, F.coalesce("role", F.lit("user")).alias("role"), text.alias("text"))


def render_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A turn's marked text, and the span in it that the loss covers."""
    body = escape(text)
    if role == "assistant":
        return f"{REPLY}{body}{END}", (len(REPLY), len(REPLY) + len(body))
    return f"{OPEN}{escape(role).replace(']', '&rsq;')}{MIDDLE}{body}{CLOSE}", None


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a rendered part."""
    for m in TURN.finditer(formatted):
        yield ("assistant", unescape(m[3])) if m[3] is not None else (unescape(m[1].replace("&rsq;", "]")), unescape(m[2]))


def render(messages: DataFrame) -> DataFrame:
    """Render final messages (conv_id, turn, branch, role, text) with the template, in parts of PART_TURNS turns.

    Parts of a conversation are consecutive rows of one partition; a part's text and loss spans (code
    points, end exclusive) stand alone, and the parts concatenated are the conversation. Memory is bounded
    by a part, however long the conversation. Null role is 'user', null text empty; messages that share a
    turn come in order of (branch, role, text). An empty table gives an empty table. A very long text makes one long part. Other
    columns are not read.
    """

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, part, turns, pieces, spans, length = None, 0, 0, [], [], 0
        out: list[tuple] = []

        def close() -> None:
            if pieces:
                out.append((conv[0], part, "".join(pieces), spans))

        for frame in frames:
            for key, role, text in zip(frame["key"], frame["role"], frame["text"]):
                if conv is None or conv[1] != key or turns == PART_TURNS:
                    close()
                    part = part + 1 if conv is not None and conv[1] == key else 0
                    conv, turns, spans = (None if key == "null" else int(key), key), 0, []
                    pieces, length = ([BEGIN], len(BEGIN)) if part == 0 else ([], 0)
                marked, span = render_turn(role, text)
                if span:
                    spans.append({"start": length + span[0], "end": length + span[1]})
                pieces.append(marked)
                length += len(marked)
                turns += 1
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "part", "formatted", "loss_spans"]).astype({"conv_id": "Int64"})
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "part", "formatted", "loss_spans"]).astype({"conv_id": "Int64"})

    rows = messages.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("key"), "turn", "branch",
        F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartition(shuffle_partitions(messages.sparkSession), "key").sortWithinPartitions("key", "turn", "branch", "role", "text")
    return dealt.mapInPandas(parts, RENDERED)


def digests(rendered: DataFrame) -> DataFrame:
    """Read rendered parts back: turn count and digest, and what the loss mask covers, for each conversation.

    Takes the parts as render() yields them, a conversation's in order in one partition; hashes are updated
    part by part, so nothing is gathered.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            out = []
            for conv, part, formatted, spans in zip(frame["conv_id"], frame["part"], frame["formatted"], frame["loss_spans"]):
                if part == 0:
                    if held:
                        out.append(held)
                    held = [None if pd.isna(conv) else int(conv), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = unescape(formatted[span["start"] : span["end"]])
                    held[3] += len(text)
                    held[4].update(text.encode())
                held[5] += len(formatted)
            if out:
                yield result(out)
        if held:
            yield result([held])

    def result(rows: list[list]) -> pd.DataFrame:
        rows = [(c, n, t.hexdigest(), k, x.hexdigest(), f) for c, n, t, k, x, f in rows]
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return rendered.mapInPandas(read, DIGEST)


def format_chats(events: DataFrame) -> DataFrame:
    """Fold an event log into final messages and render them; see fold and render."""
    return render(fold(events))


#: The digests of the default conversations in SQL; the template's lengths are those above.
ORACLE = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsq;')) AS body FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(body + CASE WHEN role = 'assistant' THEN length('[REPLY]</s>') ELSE length('[INST ][/INST]') + length(role) END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
