"""Chat formatting by prefix-target expansion; DataFrame functions only.

Template: a turn is ``<s>ROLE\nTEXT</s>``, an example is the turns in order with nothing between.
Inside roles and texts the characters that could form a control string are written with an escape
(backslash ``\0``, ``<`` ``\1``, ``[`` ``\2``, and in roles the line feed ``\3``), so ``<s>``,
``</s>``, ``[INST]`` or ``<|...|>`` in a text never look like markup and come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The template.
OPEN, CLOSE = "<s>", "</s>"
ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "\\3")]


def escaped(value: Column, escapes: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in escapes:
        value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def unescaped(value: Column, escapes: list[tuple[str, str]] = ESCAPES) -> Column:
    # Every backslash is followed by its code, so codes can be read in any order, the backslash last.
    for plain, code in reversed(escapes):
        value = F.replace(value, F.lit(code), F.lit(plain))
    return value


def prefix_examples(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Training examples ``conv, example, n_turns, formatted, loss_start, loss_chars, whole``.

    Each assistant turn becomes an example: all earlier turns as context, the reply as the only
    trainable span (``loss_chars`` code points from ``loss_start``, counted from 0, in the escaped
    text). Turns after the last assistant turn give one more example with nothing trainable, so no
    turn is lost; ``whole`` marks the example that holds the whole conversation.

    NULL texts and roles count as empty; turns with equal numbers are ordered by role, then text;
    NULL turns come first; rows with NULL ``conv`` form one conversation; an empty table gives an
    empty result; other columns are ignored. The examples of a conversation stay in the task that
    holds its turns: a conversation is one training sequence and has to fit in memory. The prefix
    of every example is cut from the one formatted string of its conversation.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    pieces = grouped.select(
        "conv",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == "assistant").alias("reply"),
                F.concat(F.lit(OPEN), escaped(t["role"], ROLE_ESCAPES), F.lit("\n")).alias("head"),
                escaped(t["text"]).alias("body"),
            ),
        ).alias("p"),
    )
    # Running lengths: where each turn ends in the formatted conversation.
    zero = F.lit(0).cast("long")
    spans = pieces.select(
        "conv",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("all"),
        F.aggregate(
            "p",
            F.struct(zero.alias("end"), F.array().cast("array<struct<stop:bigint,body:bigint,reply:boolean>>").alias("s")),
            lambda acc, x: _append(acc, x),
        )["s"].alias("spans"),
    )
    n = F.size("spans")
    chosen = F.filter(
        F.transform("spans", lambda s, i: F.struct(i.alias("i"), s["stop"].alias("stop"), s["body"].alias("body"), s["reply"].alias("reply"))),
        lambda s: s["reply"] | (s["i"] == n - 1),
    )
    flat = spans.select("conv", "all", n.alias("n"), F.posexplode(chosen).alias("example", "s"))
    trainable = F.when(F.col("s.reply"), F.col("s.body")).otherwise(zero)
    return flat.select(
        F.col("conv").alias(conv),
        "example",
        (F.col("s.i") + 1).cast("long").alias("n_turns"),
        F.substring("all", F.lit(1), F.col("s.stop").cast("int")).alias("formatted"),
        (F.col("s.stop") - len(CLOSE) - trainable).alias("loss_start"),
        trainable.alias("loss_chars"),
        (F.col("s.i") == F.col("n") - 1).alias("whole"),
    )


def _append(acc: Column, x: Column) -> Column:
    body = F.char_length(x["body"]).cast("long")
    stop = acc["end"] + F.char_length(x["head"]) + body + len(CLOSE)
    span = F.struct(stop.alias("stop"), body.alias("body"), x["reply"].alias("reply"))
    return F.struct(stop.alias("end"), F.concat(acc["s"], F.array(span)).alias("s"))


def read_back(formatted: Column) -> Column:
    """Turns ``array<struct<role, text>>`` of a formatted example."""
    parts = F.filter(F.split(formatted, OPEN), lambda p: F.char_length(p) > 0)

    def turn(p: Column) -> Column:
        inner = F.substring(p, F.lit(1), F.char_length(p) - len(CLOSE))
        role = F.substring_index(inner, "\n", 1)
        return F.struct(
            unescaped(role, ROLE_ESCAPES).alias("role"),
            unescaped(F.substring(inner, F.char_length(role) + 2, F.char_length(inner))).alias("text"),
        )

    return F.transform(parts, turn)


def digests(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation, computed from the formatted examples alone.

    Examples keep the partitioning of their conversation, so nothing is shuffled again. Only the
    example that is the whole conversation brings its text along; the others bring their masked
    reply.
    """
    masked = F.substring("formatted", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    seen = examples.select(
        conv,
        F.char_length("formatted").cast("long").alias("chars"),
        F.struct("example", unescaped(masked).alias("text")).alias("loss"),
        F.when(F.col("whole"), F.col("formatted")).alias("whole"),
    )
    grouped = seen.groupBy(conv).agg(
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"),
        F.max("whole").alias("whole"),
    )
    turns = grouped.withColumn("turns", read_back(F.col("whole")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '[', ''), chr(10), ''))
      + length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) + 8) OVER w AS stop
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(stop) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
