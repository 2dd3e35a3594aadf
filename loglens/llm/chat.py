"""Chat formatting by event sourcing.

A conversation is a log of events (conv_id, seq, kind, message, role, text), numbered throughout the conversation: `start`
opens a message, `delta` adds to its text, `edit` replaces the text, `regenerate` empties it for the deltas that follow,
`delete` takes the message out. An event may come after later messages have begun. Every event names its message, so the
log of a conversation is folded message by message, each in the order of seq; messages stand in the order of their number.

Rendering marks each turn. Control strings inside texts are broken up by a backslash behind their first character, so none
is left in the output for a tokenizer to see, and the output can be read back exactly: the formatted conversation, one
segment behind the other, is parsed by its marks alone.

Folding and rendering are expressions per message, spread over all tasks. Only reading back goes through a conversation in
order, sorted by Spark, and holds one turn at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens.llm.common import stored, table

DELTA_CHARS = 256
#: An event's number: that of its message, or of a later one, above LOCAL_BITS bits for its place among that one's events.
LOCAL_BITS = 24
# Control strings that texts may imitate. The first two are this template's own.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>"]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """A backslash before every backslash, and behind the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def message_events(rows: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """rows (conv_id, turn, role, text, ...) -> an event log that would have made them.

    Each row becomes a message, numbered in the order of turn, role and the text's digest; repeated rows are repeated
    messages. NULL role and text are empty. Texts come in deltas of at most delta_chars characters. Of every second message
    (by a hash) the text was not right at first: an assistant's was cut short and regenerated, another's was replaced by
    an edit after the next message had begun.
    """
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.sha2("text", 256))
    own = own.withColumn("message", F.row_number().over(order).cast("long"))
    revised = F.pmod(F.xxhash64("conv_id", "message", "role"), F.lit(2)) == 0
    assistant = F.col("role") == LOSS_ROLE
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    start = F.array(event("start", F.lit("")))
    deltas = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0)), lambda p: event("delta", p))
    draft = event("delta", F.concat(F.left("text", F.lit(delta_chars // 2)), F.lit(" ... ")))
    drafted = F.when(assistant, F.concat(start, F.array(draft, event("regenerate", F.lit(None).cast("string"))), deltas))
    drafted = drafted.otherwise(F.concat(start, F.array(draft)))
    log = own.select("conv_id", "message", "role", F.posexplode(F.when(revised, drafted).otherwise(F.concat(start, deltas))).alias("k", "e"))
    at = lambda message, k: (F.shiftleft(message, LOCAL_BITS) + k).alias("seq")
    log = log.select("conv_id", at(F.col("message"), F.col("k")), "e.kind", "message", "role", "e.text")
    late = at(F.col("message") + 1, F.lit(1 << (LOCAL_BITS - 1)))
    edits = own.where(revised & ~assistant).select("conv_id", late, F.lit("edit").alias("kind"), "message", "role", "text")
    return log.unionByName(edits)


def fold(events: DataFrame) -> DataFrame:
    """events (conv_id, seq, kind, message, role, text) -> (conv_id, message, role, text), a row per message that is left.

    Events of a message count in the order of seq, then kind and text. NULL texts are empty; the role is that of the last
    event that has one. A message without an event but delta is opened by it; unknown kinds change nothing. The text is that
    of the last start, edit or regeneration and of the deltas behind it, put together once, in time linear in the log.
    """
    log = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role"))).alias("log"))

    def last(log: Column, *kinds: str) -> Column:
        """The place of the last event of these kinds, from 1; 0 if there is none."""
        return F.coalesce(F.array_max(F.transform(log, lambda e, i: F.when(e["kind"].isin(*kinds), i + 1))), F.lit(0))

    def state(log: Column) -> Column:
        reset = last(log, "start", "edit", "regenerate")
        head = F.when(F.get(log, reset - 1)["kind"] == "edit", F.get(log, reset - 1)["text"]).otherwise("")
        deltas = F.filter(F.slice(log, reset + 1, F.size(log)), lambda e: e["kind"] == "delta")
        text = F.concat(head, F.array_join(F.transform(deltas, lambda e: e["text"]), ""))
        roles = F.filter(F.transform(log, lambda e: e["role"]), lambda r: r.isNotNull())
        gone = last(log, "delete") > last(log, "start", "edit", "regenerate", "delta")
        return F.struct(text.alias("text"), F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), gone.alias("gone"))

    folded = log.select("conv_id", "message", F.get(F.transform(F.array("log"), state), F.lit(0)).alias("s"))
    return folded.where(~F.col("s.gone")).select("conv_id", "message", F.col("s.role").alias("role"), F.col("s.text").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) -> (conv_id, message, segment, loss_start, loss_stop): the formatted turn, and where
    the loss mask stands in it (code points, end exclusive; NULL outside assistant turns)."""
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))
    text, head = escaped(F.col("text")), F.concat(F.lit(OPEN), role, F.lit("\n"))
    trained = F.col("role") == LOSS_ROLE
    return messages.select("conv_id", "message", F.concat(head, text, F.lit(CLOSE)).alias("segment"), F.when(trained, F.length(head)).alias("loss_start"), F.when(trained, F.length(head) + F.length(text)).alias("loss_stop"))


def assembled(segments: DataFrame) -> DataFrame:
    """(conv_id, formatted): one string a conversation, for conversations that fit a row."""
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message", "segment"))), lambda x: x["segment"]), "").alias("formatted"))


class Reader:
    """Turns of a formatted conversation, from pieces of it cut anywhere."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn that ends in this piece; ValueError where a turn doesn't begin with its mark."""
        text, at = self.rest + piece, 0
        while (end := text.find(CLOSE, at)) >= 0:
            if not text.startswith(OPEN, at):
                raise ValueError("a turn must begin with its mark")
            role, _, said = text[at + len(OPEN) : end].partition("\n")
            yield unescaped(role, newline=True), unescaped(said)
            at = end + len(CLOSE)
        self.rest = text[at:]


def unescaped(text: str, newline: bool = False) -> str:
    """What escaped() was given; newline: an escaped n is a line end."""
    return re.sub(r"(?s)\\(.)", lambda m: "\n" if newline and m[1] == "n" else m[1], text)


class _Digest:
    """The figures of one conversation, its segments coming in order."""

    def __init__(self) -> None:
        self.reader, self.turns, self.loss = Reader(), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, segment: str, start: int | None, stop: int | None) -> None:
        for role, text in self.reader.feed(segment):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        self.chars += len(segment)
        if start is not None:
            masked = unescaped(segment[start:stop])
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)

    def row(self) -> tuple:
        if self.reader.rest:
            raise ValueError("a conversation ends inside a turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    now, own = None, None
    for batch in batches:
        done = []
        for conv, segment, start, stop in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if own is None or conv != now:
                if own is not None:
                    done.append((now, *own.row()))
                now, own = conv, _Digest()
            own.add(segment, start, stop)
        if done:
            yield out(done)
    if own is not None:
        yield out([(now, *own.row())])


def digests(segments: DataFrame) -> DataFrame:
    """render()'s output -> per conversation its number of turns, the digests of all turns (read back from the formatted
    text) and of the text under the loss mask, and the length of the formatted text. A NULL conv_id is a conversation."""
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "message").select("conv_id", "segment", "loss_start", "loss_stop")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digests() of conversations, formatted from their event logs. NULL roles and texts are empty; rows that share conv_id
    and turn, repeated ones too, are turns of their own; without rows only conversation -7 is left; other columns are not
    read."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string"))
    formatted = stored(render(fold(message_events(rows))), "chat")
    return digests(formatted)


def _escaped_sql(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP9_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum({len(OPEN)} + length(replace({_escaped_sql('role')}, chr(10), '\\n')) + 1 + length({_escaped_sql('text')}) + {len(CLOSE)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
