"""Relational chat formatting: turns to one training string with a loss mask, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import let
from tidewater.session import load

#: The template. Texts and roles hold neither < nor > once they are escaped.
OPEN, OPENED, NEXT, CLOSE = "<turn ", ">", "<next>", "</turn>"
#: Code points of a block in which a place of the mask is found.
BLOCK = 512
#: Escapes: each backslash of an escaped text begins one of these.
BACKSLASH, LESS, MORE = "\\s", "\\l", "\\g"


def escape(text: Column) -> Column:
    """`text` without < and >, reversibly."""
    out = F.replace(text, F.lit("\\"), F.lit(BACKSLASH))
    return F.replace(F.replace(out, F.lit("<"), F.lit(LESS)), F.lit(">"), F.lit(MORE))


def unescape(text: Column) -> Column:
    """Undoes `escape`."""
    out = F.replace(F.replace(text, F.lit(LESS), F.lit("<")), F.lit(MORE), F.lit(">"))
    return F.replace(out, F.lit(BACKSLASH), F.lit("\\"))


def running_sums(numbers: Column) -> Column:
    """The sums of an array's first 1, 2, ... numbers.

    Sums of 8, 64, 512, ... neighbours, each of 8 of the round before, so an array of n takes n log n steps;
    to append to an array in an aggregate would copy it each time, n * n steps. Nine rounds are enough: a row
    of 2 GB holds fewer than 8^9 numbers. Rounds that an array is too short for leave it as it is.
    """

    def wider(sums: Column, step: int) -> Column:
        def add(s: Column):
            return lambda x, i: x + sum((F.coalesce(F.get(s, i - F.lit(k * step)), F.lit(0)) for k in range(2, 8)), F.coalesce(F.get(s, i - F.lit(step)), F.lit(0)))

        return let(sums, lambda s: F.when(F.size(s) > step, F.transform(s, add(s))).otherwise(s))

    for power in range(9):
        numbers = wider(numbers, 8**power)
    return numbers


def format_conversations(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: `formatted`, and `loss_mask`, an array of (start, length) in code points.

    Turns are sorted by turn, then role and text, nulls first; null roles and texts are empty. Adjacent
    turns of one role share a block whose texts <next> parts, so that `parse` finds each turn again. The
    mask covers the texts of `learn_from`, not the marks. Repeated rows are turns of their own; a null
    conv_id is a conversation. Other columns are ignored. A conversation is one row of the result, so
    its turns have to meet in one task; that is the only gathering, and it holds no more than that row.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def starts(sorted_turns: Column) -> Column:
        # Places at which the role differs from that of the turn before.
        places = F.sequence(F.lit(0), F.size(sorted_turns) - 1)
        return F.filter(places, lambda i: (i == 0) | (F.get(sorted_turns, i)["role"] != F.get(sorted_turns, i - 1)["role"]))

    def block(sorted_turns: Column, begins: Column):
        def make(begin: Column, i: Column) -> Column:
            end = F.coalesce(F.get(begins, i + 1), F.size(sorted_turns))
            role = F.get(sorted_turns, begin)["role"]
            texts = F.transform(F.slice(sorted_turns, begin + 1, end - begin), lambda t: escape(t["text"]))
            return F.struct(
                F.concat(F.lit(OPEN), escape(role), F.lit(OPENED)).alias("head"),
                texts.alias("texts"),
                (role == learn_from).alias("learnt"),
            )

        return make

    blocks = gathered.select(
        "conv_id",
        let(F.col("turns"), lambda ts: let(starts(ts), lambda begins: F.transform(begins, block(ts, begins)))).alias("blocks"),
    )
    # Pieces in reading order: marks, and texts with a flag that they count for the loss.
    pieces_of = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda text, i: F.array(
                            F.struct(F.when(i == 0, b["head"]).otherwise(F.lit(NEXT)).alias("piece"), F.lit(False).alias("learnt")),
                            F.struct(text.alias("piece"), b["learnt"].alias("learnt")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(CLOSE).alias("piece"), F.lit(False).alias("learnt"))),
            ),
        )
    )
    placed = let(
        F.col("pieces"),
        lambda ps: let(
            running_sums(F.transform(ps, lambda p: F.char_length(p["piece"]))),
            lambda ends: F.transform(
                ps,
                lambda p, i: F.struct((F.get(ends, i) - F.char_length(p["piece"])).alias("start"), F.char_length(p["piece"]).alias("length"), p["learnt"].alias("learnt")),
            ),
        ),
    )
    mask = F.transform(F.filter(placed, lambda p: p["learnt"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return blocks.select("conv_id", pieces_of.alias("pieces")).select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        mask.alias("loss_mask"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: array of (role, text)."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: let(
                F.split(b, OPENED, 2),
                lambda parts: F.transform(
                    F.split(parts[1], NEXT),
                    lambda text: F.struct(unescape(F.substr(parts[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(text).alias("text")),
                ),
            ),
        )
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, with nothing between. The text is cut into blocks once, so that a place
    is found within its block and not from the start of the text."""

    def piece(blocks: Column):
        def read(m: Column) -> Column:
            first, last = F.floor(m["start"] / BLOCK).cast("int"), F.floor((m["start"] + m["length"] - 1) / BLOCK).cast("int")
            around = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
            return unescape(F.substr(around, (m["start"] % BLOCK + 1).cast("int"), m["length"]))

        return read

    return let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: F.array_join(F.transform(mask, piece(blocks)), ""))


#: The query's own conversation, which tries the control strings.
PROBE = "\\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted; the digests are of what is read back."""
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = format_conversations(turns).select(
        "conv_id",
        parse(F.col("formatted")).alias("turns"),
        masked_text(F.col("formatted"), F.col("loss_mask")).alias("learnt"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listing, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP7_SQL = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS role_before FROM raw
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
n AS (
  SELECT *,
    length(text) + length(text) - length(translate(text, '\<>', '')) AS text_len,
    length(role) + length(role) - length(translate(role, '\<>', '')) AS role_len,
    rn = 1 OR role <> role_before AS opens
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(text_len + CASE WHEN opens THEN 14 + role_len ELSE 6 END)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
