"""Chat formatting from event logs, in DataFrame functions only.

An event is ``conv_id, seq, message_id, kind, role, text``. Logs are partitioned by conversation and message,
sorted by sequence, and folded: ``delta`` appends to the message, ``edit`` replaces what it holds so far,
``regenerate`` empties it for the deltas that follow, ``delete`` drops the message unless later events fill
it again. Only the events after a message's last reset are gathered. Messages stand in the order of their
first event. The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``; ``&`` and ``<|`` inside
roles and texts (and new lines inside roles) are escaped, so the output can be read back exactly.

Defined results: null texts and roles are empty; a null kind is a delta; rows with the same conversation,
sequence and message are ordered by kind, role and text; repeated rows count as often as they stand there;
rows without a conversation form one conversation with a null id; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&nl;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&nl;"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, seq, message_id, role, text`` (seq: of the first event)."""
    e = events.select("conv_id", F.col("seq").cast("long").alias("seq"), F.col("message_id").cast("string").alias("message_id"),
                      F.lower(F.coalesce("kind", F.lit("delta"))).alias("kind"),
                      F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = Window.partitionBy("conv_id", "message_id").orderBy("seq", "kind", "role", "text")
    whole = Window.partitionBy("conv_id", "message_id")
    e = (e.withColumn("_n", F.row_number().over(one))
         .withColumn("_reset", F.max(F.when(F.col("kind").isin("edit", "regenerate", "delete"), F.col("_n"))).over(whole)))
    live = F.col("_reset").isNull() | (F.col("_n") >= F.col("_reset"))
    text = F.when(F.col("kind").isin("regenerate", "delete"), "").otherwise(F.col("text"))
    out = e.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("seq"),
        F.min(F.when(F.col("_n") == 1, F.col("role"))).alias("role"),
        F.array_sort(F.collect_list(F.when(live, F.struct("_n", text.alias("t"))))).alias("parts"),
        F.max_by("kind", "_n").alias("last"))
    return out.where("last <> 'delete'").select("conv_id", "seq", "message_id", "role",
                                                F.array_join(F.transform("parts", lambda x: x["t"]), "").alias("text"))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: the string of each conversation and the code point spans
    (start, length) of the escaped texts under the loss mask."""
    turn = F.struct("seq", "message_id", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"),
                    (F.col("role") == trained_role).alias("trained"))
    conv = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"))
    shown = F.transform("turns", lambda x: F.concat(head(x), x["text"], F.lit(END + "\n")))
    sizes = F.transform("turns", lambda x: F.struct((F.length(x["role"]) + (len(START) + 1)).alias("head"),
                                                    F.length(x["text"]).alias("body"), x["trained"].alias("trained")))
    conv = conv.select("conv_id", F.array_join(shown, "").alias("formatted"), sizes.alias("sizes"))
    tail = len(END) + 1
    # one fold keeps the running place; only trained turns are added to the list
    spans = F.aggregate(
        "sizes", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["head"] + x["body"] + tail).alias("at"),
            F.when(x["trained"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["head"]).alias("start"), x["body"].alias("length")))))
            .otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return conv.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_back(formatted: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Turns of the rendered string (role and unescaped text), in order, with their loss flag."""
    body = F.split("formatted", r"<\|im_end\|>\n", -1)
    segs = F.transform(F.slice(body, F.lit(1), F.size(body) - 1), lambda x: F.substr(x, F.lit(len(START) + 1)))
    turns = F.transform(segs, lambda x: F.struct(
        unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2)).alias("text")))
    return formatted.select("conv_id", "formatted", "loss_spans", turns.alias("turns"))


def under_mask() -> Column:
    """The unescaped texts that stand in ``formatted`` at ``loss_spans``, joined. Cut out of pieces of the string that hold
    about sqrt(n) spans each, as every cut counts code points from the start of what it cuts."""
    return F.expr("""if(size(loss_spans) = 0, '', array_join(flatten(transform(
        sequence(0, (size(loss_spans) - 1) div cast(ceil(sqrt(size(loss_spans))) as int)), k -> transform(
          transform(array(slice(loss_spans, cast(k * ceil(sqrt(size(loss_spans))) as int) + 1, cast(ceil(sqrt(size(loss_spans))) as int))),
            p -> named_struct('p', p, 'at', p[0].start, 'piece',
              substring(formatted, p[0].start + 1, element_at(p, -1).start + element_at(p, -1).length - p[0].start))),
          c -> transform(c.p, x -> replace(replace(substring(c.piece, x.start - c.at + 1, x.length), '&lt;|', '<|'), '&amp;', '&')))[0])), ''))""")


def format_log(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Fold, render and read back in one plan."""
    return read_back(render(fold_events(events), trained_role), trained_role)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The event log behind finished conversations: each row streams half of its text, is regenerated, and then streams
    whole in two deltas. Rows with the same turn are messages of their own, by role and text."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = rows.withColumn("_k", F.row_number().over(order))
    half = (F.length("text") / 2).cast("int")
    ev = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("delta").alias("kind"), F.substr("text", F.lit(1), half).alias("text")),
        F.struct(F.lit(1).alias("step"), F.lit("regenerate").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit(2).alias("step"), F.lit("delta").alias("kind"), F.substr("text", F.lit(1), half).alias("text")),
        F.struct(F.lit(3).alias("step"), F.lit("delta").alias("kind"), F.substr("text", half + 1).alias("text")))
    return (rows.withColumn("e", F.explode(ev))
            .select("conv_id", (F.col("turn") * 8 + F.col("e.step")).alias("seq"),
                    F.concat_ws(":", F.lpad(F.col("turn").cast("string"), 20, "0"), F.lpad(F.col("_k").cast("string"), 20, "0")).alias("message_id"),
                    F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text")))
