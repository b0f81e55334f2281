"""Chat formatting: conversations rendered by a compiled template, and read back from the output.

Control strings inside roles and texts are broken by a backslash after their first character;
backslashes are doubled. No control string is left in an escaped text, and none can arise where a
text meets a mark, since a control string's first character occurs in it nowhere else. unguard()
takes the backslashes out again.

Rows are sorted by conversation and turn and rendered one at a time: a conversation of any length
needs memory for two of its turns, not for all.

Defined cases: null role or text is empty; turns that tie (or are null, which come first) go by role,
then text; repeated rows are turns of their own; a null conv_id is one conversation; an empty table
has no conversations; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.llm.common import in_arrow, to_batch
from peptrail.llm.template import Piece, compile_template, show

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN]")
TEMPLATE = (
    "{% for message in messages %}"
    "<s>{{ message.role | guard }}[TURN]"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | guard }}{% endgeneration %}"
    "{% elif message.role == 'user' %}[INST]{{ message.text | guard }}[/INST]"
    "{% else %}{{ message.text | guard }}{% endif %}"
    "</s>"
    "{% endfor %}"
)
_turn = re.compile(r"<s>(.*?)\[TURN\](.*?)</s>", re.S)


def guard(x: object) -> str:
    """The text with its control strings broken; unguard() is its inverse."""
    text = show(x).replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unguard(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def renderer(template: str = TEMPLATE):
    return compile_template(template, {"guard": guard})


class Reader:
    """Reads turns back from rendered pieces, fed in order; keeps no more than an unfinished turn."""

    def __init__(self) -> None:
        self.rest: list[str] = []
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def feed(self, piece: Piece) -> None:
        text, generated = piece
        self.chars += len(text)
        if generated:
            plain = unguard(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.rest.append(text)
        if "</s>" in text:
            whole = "".join(self.rest)
            end = 0
            for m in _turn.finditer(whole):
                if m.start() != end:
                    raise ValueError("text between turns")
                role, body, end = unguard(m[1]), m[2], m.end()
                if body.startswith("[INST]") and body.endswith("[/INST]"):
                    body = body[6:-7]
                self.turns.update(f"{role}\n{unguard(body)}\n".encode("utf-8", "surrogatepass"))
                self.n_turns += 1
            self.rest = [whole[end:]]

    def digest(self) -> tuple[int, str, int, str, int]:
        if "".join(self.rest):
            raise ValueError("an unfinished turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest(messages: Iterable[dict], render=None) -> tuple[int, str, int, str, int]:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of one conversation, read back from its rendering."""
    reader = Reader()
    for piece in (render or renderer())(messages=messages):
        reader.feed(piece)
    return reader.digest()


def conversations(batches) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversations of sorted Arrow batches, each an iterator that must be used up before the next."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3))))
    row = next(rows, None)

    def turns(key):
        nonlocal row
        while row is not None and row[0] == key:
            yield {"role": row[1] or "", "text": row[2] or ""}
            row = next(rows, None)

    while row is not None:
        yield row[0], turns(row[0])


def sort_turns(table: DataFrame) -> DataFrame:
    parts = table.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")


def format_conversations(table: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Per conversation its rendering as pieces: conv_id, piece (from 0), text, generated. Joined in order they are the formatted conversation."""
    kind = table.schema["conv_id"].dataType.simpleString()

    def run(batches):
        target, buffer, weight, render = schema(), [], 0, renderer(template)
        for key, turns in conversations(batches):
            for i, (text, generated) in enumerate(render(messages=turns)):
                buffer.append((key, i, text, generated))
                weight += len(text) + 64
                if weight > 8 << 20:
                    yield to_batch(buffer, target)
                    buffer, weight = [], 0
        if buffer:
            yield to_batch(buffer, target)

    out = table.sparkSession.createDataFrame([], f"conv_id {kind}, piece long, text string, generated boolean").schema

    def schema():
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(out)

    return in_arrow(sort_turns(table), run, out)


def digests(table: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = table.schema["conv_id"].dataType.simpleString()
    out = table.sparkSession.createDataFrame([], f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target, buffer, render = to_arrow_schema(out), [], renderer(template)
        for key, turns in conversations(batches):
            buffer.append((key, *digest(turns, render)))
            if len(buffer) >= 4096:
                yield to_batch(buffer, target)
                buffer = []
        if buffer:
            yield to_batch(buffer, target)

    return in_arrow(sort_turns(table), run, out)
