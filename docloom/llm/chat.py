"""Chat formatting: render turns with control strings escaped, reparse the text by a fixed grammar, compare the turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
_CONTROLS = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>"
CONFLICT = rf"(<|\[)(\\*)({_CONTROLS})"
ESCAPED = rf"(<|\[)\\(\\*)({_CONTROLS})"
#: Role, what stands before its text, what after; other roles are written out.
MARKS = (("user", "[INST] ", " [/INST]"), ("system", "<<SYS>>", "<</SYS>>"), ("assistant", "<s>", "</s>"))
ROLE, ROLE_END, END = "<<ROLE>>", "<</ROLE>>", "</s>"
TURN = r"(?s)\[INST\] .*? \[/INST\]|<<SYS>>.*?<</SYS>>|<<ROLE>>.*?<</ROLE>>.*?</s>|<s>.*?</s>"


def escape(text: Column) -> Column:
    """Put one more backslash after the first character of each control string (with or without some there)."""
    return F.regexp_replace(text, CONFLICT, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    """Take one backslash back from each escaped control string."""
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render_turn(role: Column, text: Column) -> Column:
    """A turn between its marks."""
    out = None
    for name, before, after in MARKS:
        value = F.concat(F.lit(before), text, F.lit(after))
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out.otherwise(F.concat(F.lit(ROLE), escape(role), F.lit(ROLE_END), text, F.lit(END)))


def parse_turn(turn: Column) -> Column:
    """Role and (unescaped) text of one turn's string, and how many characters stand before and after its text."""
    out = None
    for name, before, after in MARKS:
        text = F.substring(turn, len(before) + 1, F.length(turn) - len(before) - len(after))
        value = _turn(F.lit(name), text, F.lit(len(before)), F.lit(len(after)))
        out = F.when(turn.startswith(before), value) if out is None else out.when(turn.startswith(before), value)
    head = F.locate(ROLE_END, turn) - 1
    role = F.substring(turn, len(ROLE) + 1, head - len(ROLE))
    before = head + len(ROLE_END)
    text = F.substring(turn, before + 1, F.length(turn) - before - len(END))
    return out.otherwise(_turn(unescape(role), text, before, F.lit(len(END))))


def _turn(role: Column, text: Column, before: Column, after: Column) -> Column:
    return F.struct(role.alias("role"), unescape(text).alias("text"), before.alias("before"), after.alias("after"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role, text (unescaped), before and after."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), parse_turn)


def render(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Append rendered: each turn's string, with every control string in its text escaped; it has to parse back.

    Turn by turn, so even one conversation that holds most rows is spread over all tasks.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))

    def same(rendered: Column) -> Column:
        found = F.regexp_extract_all(rendered, F.lit(TURN), F.lit(0))
        back = parse_turn(F.get(found, F.lit(0)))
        return F.coalesce((F.size(found) == 1) & (F.get(found, F.lit(0)) == rendered) & (back["role"] == r) & (back["text"] == t), F.lit(False))

    out = turns.withColumn("rendered", render_turn(r, escape(t)))
    wrong = F.raise_error(F.concat(F.lit("a turn does not come back from its text: "), F.col("rendered"))).cast("string")
    return out.withColumn("rendered", F.when(same(F.col("rendered")), F.col("rendered")).otherwise(wrong))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, and turns and loss spans read back from the formatted text.

    Turns go by number; of equal numbers by role, then text; a null number is last. A null text or role is empty, a
    null conversation id is a conversation. loss is an array of start and end (code points, end exclusive) of the
    assistant texts as they stand in the formatted text. The reparsed turns are compared with the source; the job
    fails if any differs. A conversation's text is one value, so a task holds one whole conversation.
    """
    rows = render(turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t")), "r", "t")
    item = F.struct(F.col("n").isNull().alias("none"), "n", F.col("r").alias("role"), F.col("t").alias("text"), "rendered")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("source"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("source", lambda s: s["rendered"]), ""))
    whole = whole.withColumn("found", F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0)))
    whole = whole.withColumn("turns", F.transform("found", parse_turn))
    bare = lambda a: F.transform(a, lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text")))
    good = (bare("turns") == bare("source")) & (F.array_join("found", "") == F.col("formatted"))
    checked = F.when(good, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not come back from its text")).cast("string"))
    whole = whole.select("conv_id", checked.alias("formatted"), "turns", "found")

    kind = "struct<at:int,out:array<struct<start:int,end:int>>>"

    def add(have: Column, x: Column) -> Column:
        end = have["at"] + x["size"]
        span = F.array(F.struct((have["at"] + x["before"]).alias("start"), (end - x["after"]).alias("end")))
        return F.struct(end.alias("at"), F.when(x["role"] == "assistant", F.concat(have["out"], span)).otherwise(have["out"]).alias("out")).cast(kind)

    sized = F.zip_with("found", "turns", lambda f, t: F.struct(F.length(f).alias("size"), t["role"].alias("role"), t["before"].alias("before"), t["after"].alias("after")))
    loss = F.aggregate(sized, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")).cast(kind), add, lambda have: have["out"])
    return whole.select("conv_id", "formatted", bare("turns").alias("turns"), loss.alias("loss"))
