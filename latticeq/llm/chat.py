"""Chat formatting by a finite-state machine over roles and a declarative template.

A conversation's rows, ordered by turn, run through the machine. Its moves say where a role leads from a state and
whether the text that it brings is learned; where no move leads on, the state stays, the first such turn is noted, and
the template's rule for stray turns says whether the text is learned. Each turn becomes three segments (opening mark,
text, closing mark), each with its loss flag; the segments' texts joined are the training text. Control strings inside texts are broken up by an escape mark, which
:func:`read_back` takes out again, so the formatted text alone gives the conversation back.

DataFrame functions only. Defined cases: null roles and texts are empty; turns with equal numbers stand in the
order of role and text, null numbers first; a null conversation id is a conversation; no rows give no rows; an
invalid order is reported in ``violation`` and formatted all the same; other columns are not looked at. A conversation
becomes one row, so its turns meet in one task, however many there are: that is what the format asks for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESC = "␛"
#: An opening character before the rest of a control string, of the usual templates; see :func:`escape`.
CONTROL = r"<(?=\||/?s>|/?<?/?SYS>)|\[(?=/?INST\]|/?TOOL_|/?AVAILABLE_TOOLS\])"


@dataclass(frozen=True)
class Template:
    """Marks of a turn and the machine: ``(state, role) -> (state, learned)``; ``stray`` are roles learned in any place."""

    turn_open: str = "<|im_start|>"
    role_close: str = "\n"
    turn_close: str = "<|im_end|>\n"
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    stray: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], tuple[str, bool]] = field(
        default_factory=lambda: {
            ("start", "system"): ("system", False),
            ("start", "user"): ("user", False),
            ("system", "user"): ("user", False),
            ("user", "assistant"): ("assistant", True),
            ("assistant", "user"): ("user", False),
            ("assistant", "tool"): ("tool", False),
            ("tool", "assistant"): ("assistant", True),
            ("tool", "tool"): ("tool", False),
        }
    )


def escape(text: Column) -> Column:
    """Break up control strings; the escape mark itself is marked too, so the change can be taken back."""
    return F.regexp_replace(F.replace(text, F.lit(ESC), F.lit(ESC + "0")), CONTROL, "$0" + ESC + "1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC + "1"), F.lit("")), F.lit(ESC + "0"), F.lit(ESC))


def escape_role(role: Column) -> Column:
    """Roles stand in one line: line ends are escaped as well."""
    return F.replace(escape(role), F.lit("\n"), F.lit(ESC + "2"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESC + "2"), F.lit("\n")))


def _regex(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()<>*+-=!?^$|" else c for c in text)


def format_conversations(rows: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, n_turns, segments, state, violation, valid``; ``segments`` is an array of (text, loss).

    ``violation`` is the position of the first turn that may not follow (null: none), ``valid`` that there is none
    and the machine stopped in a final state.
    """
    turn = F.struct(
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    moves = F.create_map(*(x for (state, role), (to, learned) in template.moves.items() for x in (F.lit(f"{state}\n{role}"), F.struct(F.lit(to).alias("to"), F.lit("1" if learned else "0").alias("flag")))))
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("violation"), F.lit("").alias("flags"))

    def step(s: Column, t: Column) -> Column:
        move = F.try_element_at(moves, F.concat(s["state"], F.lit("\n"), t["role"]))
        stray = F.when(t["role"].isin(*template.stray), "1").otherwise("0")
        return F.struct(
            F.coalesce(move["to"], s["state"]).alias("state"),
            (s["at"] + 1).alias("at"),
            F.when(s["violation"].isNotNull() | move.isNotNull(), s["violation"]).otherwise(s["at"]).alias("violation"),
            F.concat(s["flags"], F.coalesce(move["flag"], stray)).alias("flags"),
        )

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(t: Column, i: Column) -> Column:
        return F.array(
            piece(F.concat(F.lit(template.turn_open), escape_role(t["role"]), F.lit(template.role_close)), F.lit(False)),
            piece(escape(t["text"]), F.substring("run.flags", i + 1, F.lit(1)) == "1"),
            piece(F.lit(template.turn_close), F.lit(False)),
        )

    talks = rows.groupBy(F.col(f"`{id_col}`").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return (
        talks.withColumn("run", F.aggregate("turns", begin, step))
        .select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.flatten(F.transform("turns", segments)).alias("segments"), "run.state", "run.violation")
        .withColumn("valid", F.col("violation").isNull() & F.col("state").isin(*template.final))
    )


def formatted(segments: Column) -> Column:
    """The training text: all segments joined."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_back(text: Column, template: Template = Template()) -> Column:
    """Turns (role, text) of a formatted text."""
    parts = F.split(text, _regex(template.turn_close), -1)
    head = len(template.turn_open)

    def turn(part: Column) -> Column:
        body = F.substring(part, head + 1, 2147483647)
        role = F.substring_index(body, template.role_close, 1)
        return F.struct(unescape_role(role).alias("role"), unescape(body.substr(F.length(role) + F.lit(len(template.role_close) + 1), F.length(body))).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 3: all conversations, and conversation -1, whose texts hold control strings."""
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digest(format_conversations(rows.unionByName(own)))


def digest(talks: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted text and from the loss mask."""
    read = talks.withColumn("formatted", formatted(F.col("segments"))).withColumn("turns", read_back(F.col("formatted"))).withColumn("learned", loss_text(F.col("segments")))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
    length(role) + length(text) + length('<|im_start|>') + 1 + length('<|im_end|>') + 1
      + 2 * len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]|</?<?/?SYS>|\[/?TOOL_|\[/?AVAILABLE_TOOLS\]'))
      + length(text) - length(replace(text, chr(9243), '')) AS chars
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  arg_max(role, k) = 'assistant' AND bool_and(CASE
    WHEN prev IS NULL THEN role IN ('system', 'user')
    WHEN prev = 'system' THEN role = 'user'
    WHEN prev = 'user' THEN role = 'assistant'
    WHEN prev = 'assistant' THEN role IN ('user', 'tool')
    WHEN prev = 'tool' THEN role IN ('assistant', 'tool')
    ELSE false END) AS valid
FROM sized GROUP BY conv_id
"""
