"""Chat formatting from event logs.

A conversation is a log of events, in order of ``seq``: ``message`` opens a message with its role and first text,
``delta`` appends streamed text, ``edit`` replaces a message's text and ``regenerate`` starts it again from nothing.
Both of the latter drop the messages that stood after the edited one at that moment. :func:`fold` reconstructs the
final messages, :func:`render` writes each in the template, and :func:`parse` reads the template back.

Template, per message::

    ### Role:
    text
    </turn>

In texts and roles every backslash, ``#`` and ``<`` gets a backslash before it, so that no text can hold a control
string, and removing those backslashes restores the text exactly. A conversation's document is the concatenation of its
messages' pieces by position; pieces stay rows of their own, so one endless conversation is never held in one place.
The loss mask covers the text of assistant messages.

Folding and rendering work message by message, so one conversation with most of the rows spreads over all tasks. Only
the digests of a whole conversation must see its pieces in order; they stream over sorted rows in constant memory.

The raw events are looked at for edits and regenerations first. Only conversations that have one need their messages in
order; every event is folded once.

Defined results: an edit or regeneration of a dropped message opens it again at that moment, a delta doesn't; a message
that was only ever given deltas goes with any edit of an earlier message; rows of a null conversation are one
conversation; a null text or role is empty; a null delta adds nothing; deltas, edits and regenerations of a
message that was never opened have the role of none (empty); events with equal ``seq`` are ordered by kind, role and
text; repeated ``message`` events of one message number are separate messages only if their ``seq`` differ, see
:func:`events_of_turns`; an empty log gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoscope.llm.common import cut, text_or_empty

LOSS_ROLE = "assistant"
#: Characters per streamed delta when turns are replayed as events.
DELTA_CHARS = 512
#: Control strings of the template, before the role and after the text.
HEAD, TAIL = "### ", "\n</turn>\n"

#: Kinds of events that drop the messages after theirs.
BRANCHING = ("edit", "regenerate")
#: Most ids of conversations with edits that are broadcast.
BROADCAST_IDS = 100_000

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string"


def events_of_turns(turns: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """Replay finished turns (conv_id, turn, role, text) as a log: each opens empty, then streams its text in deltas.

    Rows of one conversation with the same turn are messages of their own, ordered by role and text.
    """
    rows = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"),
        turns["turn"].cast("long").alias("turn"),
        text_or_empty("role").alias("role"),
        text_or_empty("text").alias("text"),
    )
    # Numbers within (conversation, turn): such groups are the repeated rows of one turn, not the conversation.
    same = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = rows.withColumn("copy", F.row_number().over(same))
    n = F.ceil(F.char_length("text") / F.lit(delta_chars)).cast("int")
    part = lambda i: F.struct(F.lit("delta").alias("kind"), i.alias("step"), F.lit(None).cast("string").alias("role"), F.substring(F.col("text"), (i - 1) * delta_chars + 1, F.lit(delta_chars)).alias("text"))
    opened = F.struct(F.lit("message").alias("kind"), F.lit(0).alias("step"), F.col("role").alias("role"), F.lit("").alias("text"))
    deltas = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), part)).otherwise(F.array().cast("array<struct<kind:string,step:int,role:string,text:string>>"))
    log = rows.select("conv_id", "turn", "copy", F.explode(F.concat(F.array(opened), deltas)).alias("e"))
    # The order key of the replay: by turn (null first), then copy, then step.
    return log.select("conv_id", F.struct("turn", "copy").alias("message"), F.struct("turn", "copy", F.col("e.step").alias("step")).alias("seq"), "e.kind", "e.role", "e.text")


def _messages(e: DataFrame) -> DataFrame:
    """Messages (conv_id, message, role, text, seq of the last start, cut: seq of the last edit) before any is dropped."""
    starts = F.col("kind").isin("message", *BRANCHING)
    entry = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), text_or_empty("text").alias("text"))
    folded = e.groupBy("conv_id", "message").agg(
        F.max(F.when(starts, entry)).alias("start"),
        F.max(F.when(F.col("kind").isin(*BRANCHING), F.col("seq"))).alias("cut"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("named"),
        # One message's own deltas; a message is the record that is built here.
        F.sort_array(F.collect_list(F.when(F.col("kind") == "delta", entry))).alias("deltas"),
    )
    base = F.when(F.col("start.kind") == "regenerate", F.lit("")).otherwise(F.coalesce("start.text", F.lit("")))
    fresh = F.when(F.col("start").isNull(), F.col("deltas")).otherwise(F.filter("deltas", lambda d: d["seq"] > F.col("start.seq")))
    text = F.concat(base, F.array_join(F.transform(fresh, lambda d: d["text"]), ""))
    return folded.select("conv_id", "message", F.coalesce("named.role", F.lit("")).alias("role"), text.alias("text"), "start.seq", "cut")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, seq, kind, message, role, text).

    ``message`` and ``seq`` may be of any orderable type; messages stand in order of ``message``. Building the result
    runs a job that writes the ids of conversations with edits.
    """
    e = events.select("conv_id", "seq", "kind", "message", "role", "text")
    columns = ["conv_id", "message", "role", "text"]
    edited = cut(e.where(F.col("kind").isin(*BRANCHING)).select(F.col("conv_id").alias("edited")).distinct())
    n_edited = edited.limit(BROADCAST_IDS + 1).count()
    if not n_edited:
        return _messages(e).select(columns)
    # Ids beyond the bound are joined by a shuffle.
    side = F.broadcast(edited) if n_edited <= BROADCAST_IDS else edited
    same = F.col("conv_id").eqNullSafe(F.col("edited"))
    # An edit or regeneration drops the later messages that were started before it.
    before = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    cuts = _messages(e.join(side, same, "left_semi")).withColumn("last_cut", F.max("cut").over(before))
    alive = cuts.where(F.col("last_cut").isNull() | F.coalesce(F.col("seq") > F.col("last_cut"), F.lit(False)))
    plain = _messages(e.join(side, same, "left_anti"))
    return plain.select(columns).unionByName(alive.select(columns))


def escaped(column):
    return F.regexp_replace(column, r"([\\#<])", r"\\$1")


def escaped_role(column):
    """A head ends at its first colon before a line feed, so a role's colons and line feeds are escaped as well."""
    return F.regexp_replace(column, r"([\\#<:\n])", r"\\$1")


def unescaped(column):
    return F.regexp_replace(column, r"(?s)\\(.)", r"$1")


def render(messages: DataFrame) -> DataFrame:
    """Pieces (conv_id, message, piece, loss_start, loss_chars) in code points of the piece; pieces concatenate to the
    conversation's document in order of ``message``."""
    head = F.concat(F.lit(HEAD), escaped_role(F.col("role")), F.lit(":\n"))
    body = escaped(F.col("text"))
    loss = F.col("role") == LOSS_ROLE
    return messages.select(
        "conv_id",
        "message",
        F.concat(head, body, F.lit(TAIL)).alias("piece"),
        F.when(loss, F.char_length(head)).otherwise(F.lit(0)).alias("loss_start"),
        F.when(loss, F.char_length(body)).otherwise(F.lit(0)).alias("loss_chars"),
    )


def parse(pieces: DataFrame) -> DataFrame:
    """Read rendered pieces back: (conv_id, message, role, text, loss, formatted_chars).

    The head ends at the first unescaped colon and line feed; a piece ends at the closing control string.
    """
    inner = F.expr(f"substring(piece, {len(HEAD)} + 1, char_length(piece) - {len(HEAD) + len(TAIL)})")
    parts = pieces.withColumn("inner", inner).withColumn("colon", F.expr("locate(':\\n', inner)"))
    return parts.select(
        "conv_id",
        "message",
        unescaped(F.expr("substring(inner, 1, colon - 1)")).alias("role"),
        unescaped(F.expr("substring(inner, colon + 2)")).alias("text"),
        unescaped(F.expr("substring(piece, loss_start + 1, loss_chars)")).alias("loss"),
        F.char_length("piece").alias("formatted_chars"),
    )


_DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _stream_digests(batches):
    """Rows sorted by conversation and message -> one row per conversation; only the digests' state is held."""
    now, started = None, False
    turns = loss = None
    counts = [0, 0, 0]

    def closed():
        return [now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]]

    for batch in batches:
        out = []
        ids, roles, texts, losses, chars = (batch.column(i) for i in range(5))
        for i in range(batch.num_rows):
            conv = ids[i].as_py()
            if not started or conv != now:
                if started:
                    out.append(closed())
                now, started, turns, loss, counts = conv, True, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            taught = losses[i].as_py()
            turns.update(f"{roles[i].as_py()}\n{texts[i].as_py()}\n".encode())
            loss.update(taught.encode())
            counts = [counts[0] + 1, counts[1] + len(taught), counts[2] + chars[i].as_py()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DIGEST_SCHEMA, strict=True)], schema=_DIGEST_SCHEMA)
    if started:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(closed(), _DIGEST_SCHEMA, strict=True)], schema=_DIGEST_SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from rendered pieces: turns, digests of the turns and of the text under the loss
    mask, and lengths in code points."""
    read = parse(pieces).repartition("conv_id").sortWithinPartitions("conv_id", "message")
    return read.select("conv_id", "role", "text", "loss", "formatted_chars").mapInArrow(_stream_digests, _DIGEST_DDL)


def format_turns(turns: DataFrame) -> DataFrame:
    """Pieces of finished turns (conv_id, turn, role, text), by way of their event log."""
    return render(fold(events_of_turns(turns)))
