"""Chat formatting of typed content parts, with column functions only.

A message is (conversation, turn, role, parts): an array of structs of type, text, ref, width, height,
seconds and pages. A visitor turns each part into a segment of the formatted text: text with its
control strings escaped, or the placeholder of an attachment. Attachments are kept in the order of
their placeholders, each with its reference and the tokens that its placeholder expands to.

A turn is ``<s>role``, a line end, its segments and ``</s>`` with a line end. Escaping puts one more
backslash behind the first character of whatever would read as a control string: ``</s>`` becomes
``<\\/s>``, and ``<\\/s>`` becomes ``<\\\\/s>``. So it can be undone, and other text stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, other strings that texts must not hold, placeholders, and the sizes by which
    these expand. Control strings start with ``<`` or ``[`` and hold neither behind their start."""

    start: str = "<s>"
    end: str = "</s>"
    reserved: tuple[str, ...] = ("[INST]", "[/INST]")
    image: str = "[IMG]"
    audio: str = "[AUDIO]"
    document: str = "[DOC]"
    other: str = "[FILE]"
    learned: tuple[str, ...] = ("assistant",)
    patch: int = 16
    frames: float = 12.5
    page: int = 256

    def __post_init__(self):
        for mark in self.controls:
            if not re.fullmatch(r"[<\[][^<\[\\]+", mark):
                raise ValueError(f"{mark!r} can't be escaped")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.end, *self.reserved, self.image, self.audio, self.document, self.other)

    def _pattern(self, slashes: str) -> str:
        by_first = {c: "|".join(re.escape(m[1:]).replace("/", "\\/") for m in self.controls if m[0] == c) for c in "<["}
        tails = "|".join(f"(?<=[{re.escape(c)}]){slashes}(?=\\\\*(?:{tail}))" for c, tail in by_first.items() if tail)
        return tails

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(""), "\\\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern("\\\\"), "")


def _text(part: Column) -> Column:
    return F.coalesce(part["text"], F.lit(""))


def _segment(text: Column, loss: Column, attachment: Column | None = None) -> Column:
    none = F.lit(None).cast("struct<kind:string,ref:string,tokens:bigint>")
    return F.struct(text.alias("text"), loss.alias("loss"), (none if attachment is None else attachment).alias("attachment"))


def _attached(kind: Column, part: Column, tokens: Column) -> Column:
    count = F.coalesce(F.greatest(F.ceil(tokens), F.lit(0)), F.lit(0)).cast("long")
    return F.struct(kind.alias("kind"), part["ref"].alias("ref"), count.alias("tokens"))


def visitor(template: Template) -> dict[str, Callable[[Column, Column], Column]]:
    """What becomes of a part of each type: (part, whether its turn is learned) to a segment."""

    def placeholder(kind: str, mark: str, tokens: Callable[[Column], Column]):
        return lambda part, learned: _segment(F.lit(mark), F.lit(False), _attached(F.lit(kind), part, tokens(part)))

    return {
        "text": lambda part, learned: _segment(template.escape(_text(part)), learned),
        "image": placeholder("image", template.image, lambda p: F.ceil(p["width"] / template.patch) * F.ceil(p["height"] / template.patch)),
        "audio": placeholder("audio", template.audio, lambda p: p["seconds"] * template.frames),
        "document": placeholder("document", template.document, lambda p: p["pages"] * template.page),
    }


def visit(part: Column, learned: Column, template: Template) -> Column:
    """The segment of a part. A type without a visitor is an attachment of that kind with 0 tokens."""
    out = _segment(F.lit(template.other), F.lit(False), _attached(part["type"], part, F.lit(0)))
    for kind, make in visitor(template).items():
        out = F.when(part["type"] == kind, make(part, learned)).otherwise(out)
    return out


def _one_line(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\0")), F.lit("\n"), F.lit("\\1"))


def _as_given(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\1"), F.lit("\n")), F.lit("\\0"), F.lit("\\"))


def format_chats(messages: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, formatted, segments, attachments, expanded_tokens) of messages (conv_id, turn,
    role, parts); other columns are left aside.

    segments (text, loss) give ``formatted`` when joined; those with loss are the loss mask: the texts of
    learned roles. attachments (number from 0, turn, kind, ref, tokens) follow their placeholders, and
    expanded_tokens is the sum of their tokens. Rows come by turn, null ones first; rows of one turn in
    the order of role and parts, and rows that repeat each other stay. A null role is an empty one; null
    parts, or none, are an empty text, and so is a null text; a null part, or one of another type, is an
    attachment without tokens; missing sizes count 0. Rows without a conv_id are one conversation. No
    rows give no rows. A conversation is one row, so its own text has to fit in one (2 GB); its rows are
    formatted before they meet.
    """
    template = template or Template()
    role = F.coalesce(F.col("role"), F.lit(""))
    learned = role.isin(*template.learned)
    parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    off = F.lit(False)
    head = _segment(F.concat(F.lit(template.start), template.escape(_one_line(role)), F.lit("\n")), off)
    tail = _segment(F.lit(template.end + "\n"), off)
    body = F.transform(parts, lambda p: visit(p, learned, template))
    turn = messages.select("conv_id", F.struct("turn", role.alias("role"), parts.alias("parts"), F.concat(F.array(head), body, F.array(tail)).alias("segments")).alias("row"))
    turns = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    marked = F.flatten(F.transform("turns", lambda t: F.transform(t["segments"], lambda s: F.struct(s["text"].alias("text"), s["loss"].alias("loss"), t["turn"].alias("turn"), s["attachment"].alias("attachment")))))
    flat = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), marked.alias("all"))
    held = F.transform(F.filter("all", lambda s: s["attachment"].isNotNull()), lambda s, i: F.struct(i.alias("number"), s["turn"].alias("turn"), s["attachment"]["kind"].alias("kind"), s["attachment"]["ref"].alias("ref"), s["attachment"]["tokens"].alias("tokens")))
    return flat.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("all", lambda s: s["text"]), "").alias("formatted"),
        F.transform("all", lambda s: F.struct(s["text"].alias("text"), s["loss"].alias("loss"))).alias("segments"),
        held.alias("attachments"),
        F.aggregate("all", F.lit(0).cast("long"), lambda n, s: n + F.coalesce(s["attachment"]["tokens"], F.lit(0))).alias("expanded_tokens"),
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """array of (role, text) of a formatted conversation, as they were given; a turn's texts are joined
    and placeholders stay where they stood."""
    template = template or Template()
    turns = F.split(formatted, re.escape(template.end).replace("/", "\\/") + "\n")
    turns = F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0)))

    def read(turn: Column) -> Column:
        inner = F.substring(turn, F.lit(len(template.start) + 1), F.length(turn))
        to = F.locate("\n", inner)
        given = _as_given(template.unescape(F.substring(inner, F.lit(1), to - 1)))
        return F.struct(given.alias("role"), template.unescape(F.substring(inner, to + 1, F.length(inner))).alias("text"))

    return F.transform(turns, read)


def learned_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, as it was given."""
    template = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


def text_parts(text: Column) -> Column:
    """A plain text as one part."""
    fields = {"type": F.lit("text"), "text": text}
    names = [f.split(":") for f in PART[7:-1].split(",")]
    return F.array(F.struct(*(fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names)))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 of two rows of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = format_chats(rows.unionByName(probe).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = made.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.array_join(turns, "").alias("turns"), learned_text(F.col("segments")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


#: Written apart: texts are escaped by one pattern with the backslashes in a group of their own.
OP11_SQL = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*(s|/s)>|\[\\*(INST|/INST|IMG|AUDIO|DOC|FILE)\]')) AS text_chars,
  length(role) + len(regexp_extract_all(role, '[\\\n]')) + len(regexp_extract_all(replace(replace(role, '\', '\0'), chr(10), '\1'), '<\\*(s|/s)>|\[\\*(INST|/INST|IMG|AUDIO|DOC|FILE)\]')) AS role_chars FROM m)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(role_chars + text_chars + 3 + 1 + 4 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
