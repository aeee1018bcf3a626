"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn, ``### Role:`` and a text closed by
``</turn>``, and the rendering is read again by a deterministic parser.  Where
the turns that come back differ from the source, the text that conflicts is
escaped, one level more each time, until they are identical.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = " </turn>\n"
HEAD = re.compile(r"### ([^\n]*?): ")
# In an escaped text a backslash stands before each control string and each backslash before one.
CONTROL = re.compile(r"\\*(?:### |</turn>)")
ESCAPED = re.compile(r"(\\*)(### |</turn>)")


def escape(text: str) -> str:
    """Doubles the backslashes before a control string and puts one more there."""
    return CONTROL.sub(lambda m: _slashed(m[0]), text)


def _slashed(found: str) -> str:
    bare = found.lstrip("\\")
    return "\\" * (2 * (len(found) - len(bare)) + 1) + bare


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" * ((len(m[1]) - 1) // 2) + m[2] if m[1] else m[0], text)


def title(role: str) -> str:
    """A role as the template shows it; an odd role is quoted as hexadecimal code points."""
    if re.fullmatch(r"[a-z][a-z_]*", role):
        return role.capitalize()
    return "=" + role.encode("utf-8", "surrogatepass").hex()


def untitle(shown: str) -> str:
    if shown.startswith("="):
        return bytes.fromhex(shown[1:]).decode("utf-8", "surrogatepass")
    return shown.lower()


def render_turn(role: str, body: str) -> str:
    return f"### {title(role)}: {body}{END}"


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendering: role, unescaped text, and where the escaped text begins and ends.

    Raises ValueError where the rendering isn't a sequence of turns.
    """
    turns, at = [], 0
    while at < len(text):
        head = HEAD.match(text, at)
        if not head:
            raise ValueError(f"no turn at {at}")
        # escaped texts never hold the end mark, since a backslash stands before its second character
        stop = text.find(END, head.end())
        if stop < 0:
            raise ValueError(f"a turn at {at} has no end")
        turns.append((untitle(head[1]), unescape(text[head.end():stop]), head.end(), stop))
        at = stop + len(END)
    return turns


def format_turn(role: str, text: str, tries: int = 4) -> tuple[str, int]:
    """The rendered turn and 1 if it had to be escaped; parsing it gives the turn back."""
    body, level = text, 0
    while True:
        out = render_turn(role, body)
        # a text that looks escaped must not be unescaped to something else
        try:
            back = parse(out)
        except ValueError:
            back = []
        if len(back) == 1 and back[0][:2] == (role, text):
            return out, int(level > 0)
        if level >= tries:
            raise ValueError("the turn can't be rendered so that it reads back")
        level += 1
        body = escape(body)


def digest(turns) -> str:
    sha = hashlib.sha256()
    for role, text in turns:
        sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
    return sha.hexdigest()


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """Each turn rendered and read back by itself, spread over all tasks: ``conv_id, turn, role, shown, escaped``.

    Null texts and roles are empty.  Nothing of a conversation is gathered here.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def render(frames):
        for f in frames:
            done = [format_turn(r, t) for r, t in zip(f["role"], f["text"])]
            yield pd.DataFrame({"conv_id": f["conv_id"], "turn": f["turn"], "role": f["role"],
                                "shown": [d[0] for d in done], "escaped": [d[1] for d in done]})

    return rows.mapInPandas(render, "conv_id long, turn long, role string, shown string, escaped int")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, n_turns, escaped_turns``.

    Rows go by ``turn`` (null first), ties by role and rendering; rows that repeat a
    turn are turns of their own.  Every turn was read back by itself, and a
    rendering is the turns' renderings in a row, so it parses to the source.
    A conversation is one value of the result, so it is gathered as one.
    """
    shown = format_turns(turns, conv_col, turn_col, role_col, text_col)
    part = F.struct("turn", "role", "shown", "escaped")
    lists = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return lists.select(
        "conv_id", F.array_join(F.transform("parts", lambda p: p["shown"]), "").alias("formatted"),
        F.size("parts").cast("long").alias("n_turns"),
        F.aggregate("parts", F.lit(0), lambda a, p: a + p["escaped"]).alias("escaped_turns"))


READ_BACK = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")


def read_back(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """What the renderings hold: turns, their digest, and the text under the loss mask.

    The mask is the spans of the loss role's texts in the rendering; their
    contents are unescaped before they are counted and digested.
    """
    def read(frames):
        for f in frames:
            out = []
            for conv, text in zip(f["conv_id"], f["formatted"]):
                turns = parse(text)
                spans = [(a, b) for role, _, a, b in turns if role == loss_role]
                loss = [unescape(text[a:b]) for a, b in spans]
                sha = hashlib.sha256()
                for x in loss:
                    sha.update(x.encode("utf-8", "surrogatepass"))
                out.append((conv, len(turns), digest((r, t) for r, t, _, _ in turns), sum(map(len, loss)),
                            sha.hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                             "formatted_chars"])

    return formatted.select("conv_id", "formatted").mapInPandas(read, READ_BACK)
