"""Chat formatting: logs of events folded to messages, messages rendered by a template that can be read
back.

Events of a conversation, by their sequence number:

    start       opens message `message` at place `turn` with a role and perhaps a first piece of text
    delta       appends `text` to the message's current version
    edit        replaces its text
    regenerate  starts a new version, empty, that deltas fill

A message is the last version of its text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealtide.llm.cluster import phased, stored

START, DELTA, EDIT, REGENERATE = "start", "delta", "edit", "regenerate"

#: The template: a turn is OPEN role CLOSE text END. Inside roles and texts the mark ESC stands
#: before every control string's first character and before itself, so no control string occurs
#: there.
OPEN, CLOSE, END = "<s>[", "]\n", "</s>\n"
ESC = "\\"
_ESCAPE = re.compile(r"\\|\]|<(?=/?s>)|\[(?=/?INST\])")
_TURN = re.compile(
    r"<s>\[((?:[^\\\]]++|\\.)*+)\]\n((?:[^\\<]++|\\.|<(?!/?s>))*+)</s>\n", re.DOTALL
)


def escaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: ESC + m[0], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it."""
    head = f"{OPEN}{escaped(role)}{CLOSE}"
    body = escaped(text)
    return head + body + END, len(head), len(head) + len(body)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of formatted turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return out


@phased
def folded(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of logs with conv_id, seq, kind, message, turn,
    role, text.

    Messages are folded one by one, so a conversation that holds a third of all events is spread
    over its messages. A message's text is what its last edit or regeneration (or its start) left,
    and the deltas after it, in order of (seq, kind, text). Its turn and role are those of the first
    start, be they null; a message without one has the least seq as turn and no role. Null texts are empty. Events
    without conv_id or message are left out; repeated events count as often as they come; other
    columns are ignored.
    """
    order = "struct(seq, kind, coalesce(text, '') as text)"
    key = ["conv_id", "message"]
    known = events.where("conv_id is not null and message is not null").select(
        *key,
        F.expr(order).alias("event"),
        "seq",
        "kind",
        "turn",
        "role",
    )
    heads = known.groupBy(*key).agg(
        F.max(F.when(F.col("kind") != DELTA, F.col("event"))).alias("base"),
        F.min(
            F.when(F.col("kind") == START, F.struct("event", "turn", "role"))
        ).alias("opened"),
        F.min("seq").alias("least"),
    )
    pieces = (
        known.join(heads.select(*key, "base"), key)
        .where(F.col("base").isNull() | (F.col("event") >= F.col("base")))
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list("event")).alias("events"))
    )
    # A regeneration brings no text of its own.
    text = f"concat_ws('', transform(events, e -> if(e.kind = '{REGENERATE}', '', e.text)))"
    # Equal bases come twice; only the last of them counts.
    keep = "filter(events, (e, i) -> e.kind = 'delta' or i = size(filter(events, x -> x.kind <> 'delta')) - 1)"
    return (
        pieces.withColumn("events", F.expr(keep))
        .withColumn("text", F.expr(text))
        .join(heads.select(*key, "opened", "least"), key)
        .select(
            "conv_id",
            F.when(F.col("opened").isNull(), F.col("least")).otherwise(F.col("opened.turn")).alias("turn"),
            F.col("opened.role").alias("role"),
            "text",
            "message",
        )
    )


@phased
def formatted(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, message, formatted, loss_from, loss_to): every message rendered; the loss mask
    is the text of assistant turns.

    Positions are code points within the turn. The formatted conversation is its turns, joined in
    order of (turn, message, formatted), null turns last. Null roles and texts are empty; messages without conv_id
    are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            turns = [rendered(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            loss = [(a, b) if r == "assistant" else (0, 0) for r, (_, a, b) in zip(roles, turns, strict=True)]
            yield pa.record_batch(
                [
                    batch.column("conv_id"),
                    batch.column("turn"),
                    batch.column("message"),
                    pa.array([t for t, _, _ in turns], pa.string()),
                    pa.array([a for a, _ in loss], pa.int64()),
                    pa.array([b for _, b in loss], pa.int64()),
                ],
                ["conv_id", "turn", "message", "formatted", "loss_from", "loss_to"],
            )

    rows = messages.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("message").cast("bigint").alias("message"),
        "role",
        "text",
    )
    return rows.mapInArrow(
        run,
        "conv_id bigint, turn bigint, message bigint, formatted string, loss_from bigint, loss_to bigint",
    )


@phased
def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from
    formatted turns.

    turns_sha256: of role, newline, text, newline of each turn; loss_*: of the text under the loss
    mask, unescaped. The turns of a conversation stream in order through one task, which holds one
    turn and the running digests only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def done() -> tuple:
            n, whole, chars, loss, size = state
            return now, n, whole.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to"))
            for conv_id, turn, a, b in zip(*columns, strict=True):
                if state is None or conv_id != now:
                    if state is not None:
                        out.append(done())
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parsed(turn):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                masked = unescaped(turn[a:b])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(turn)
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names)
        if state is not None:
            yield pa.record_batch([pa.array([x]) for x in done()], names)

    return (
        turns.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "message", "formatted")
        .mapInArrow(
            run,
            "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
            "formatted_chars bigint",
        )
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with `message`, their number within the conversation, from 0, in order of turn (null ones
    last), role and text.

    As in plans/numbering.py, rows are dealt out in ranges, so that no window holds a conversation.
    """
    keys = ["conv_id", F.asc_nulls_last("turn"), "role", "text", "_row"]
    dealt = stored(
        rows.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        # The range in the upper bits, the place in it below.
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_place", 33))
        .drop("_row")
    )
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        dealt.groupBy("conv_id", "_range")
        .agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )
    return dealt.join(ranges, ["conv_id", "_range"]).selectExpr(
        "conv_id", "turn", "role", "text", "_before + _place - _first as message"
    )


@phased
def logged(conversations: DataFrame, piece: int = 64) -> DataFrame:
    """Events that a chat service would log for the rows of `conversations`, with seq in order of the
    turns.

    A message's text streams in deltas of `piece` code points. Every third turn streams a text that
    is edited to the final one, and every fifth assistant turn one that is thrown away by a
    regeneration. Every row is a message, numbered over its whole conversation, so a turn may have
    any number of rows; rows without turn come last and stream plainly. Rows without conv_id are
    left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        "role",
        text.alias("text"),
    )
    rows = _numbered(rows.where("conv_id is not null"))
    pieces = (
        f"transform(sequence(0, cast(ceil(length(text) / {piece}) as int)), "
        f"i -> substring(text, i * {piece} + 1, {piece}))"
    )
    deltas = f"transform({pieces}, t -> struct('{DELTA}' as kind, t as text))"
    event = "array(struct('{0}' as kind, {1} as text))"
    start, edit = event.format(START, "''"), event.format(EDIT, "text")
    redo = f"concat({event.format(DELTA, 'reverse(text)')}, {event.format(REGENERATE, chr(39) * 2)})"
    listed = (
        f"concat({start}, case when turn % 3 = 2 then concat({event.format(DELTA, 'upper(text)')}, {edit}) "
        f"when role = 'assistant' and turn % 5 = 1 then concat({redo}, {deltas}) else {deltas} end)"
    )
    return rows.selectExpr("conv_id", "turn", "message", "role", f"posexplode({listed}) as (at, event)").selectExpr(
        "conv_id",
        "message * 2147483648 + at as seq",
        "event.kind as kind",
        "message",
        "turn",
        "role",
        "event.text as text",
    )
