"""Chat formatting: records of any known layout become canonical turns, and
turns become marked text with a loss mask. DataFrame functions only.

A record's layout is told by its fingerprint, a hash of the paths of its
nested fields that aren't null, in code point order (`messages`, `messages[]`,
`messages[].role`). A layout is a declaration: the paths it needs, those it may
have, and where turns come from. One lookup of the fingerprint selects it.

A turn is written `### role: text</turn>\\n`. Within roles and texts a
backslash is doubled, one is put into `</turn>` behind `<` and behind each `#`
that two more follow (in roles also between `: `), so that no control string
can occur there; a reader drops each backslash and keeps what follows it.

Defined results: a null role or text is empty; a null message in a list is no
turn. A record whose fingerprint is unknown keeps its row with a null layout
and no turns. Columns that no layout names are ignored. Rows of one conversation
are ordered by turn (null last), then role and text; repeated rows are turns of
their own; a row without conv_id is a conversation of its own. A conversation
is gathered whole in one task, as its text is one value; nothing else is.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
HEAD, SEP, END = "### ", ": ", "</turn>\n"


@dataclass(frozen=True)
class Say:
    """One turn of a fixed role; the texts found at the paths are joined by a
    blank line. No turn if none is there."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each struct in the list at path, or for the one struct."""

    path: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()  # role as written, canonical role


@dataclass(frozen=True)
class Layout:
    name: str
    turns: tuple[Say | Each, ...]
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()

    def fingerprints(self) -> list[str]:
        """Of every set of paths that this layout allows."""
        sets = (self.needs + extra for n in range(len(self.may) + 1) for extra in combinations(self.may, n))
        return [path_hash(s) for s in sets]

    def roots(self) -> set[str]:
        return {p.split(".")[0].removesuffix("[]") for p in self.needs + self.may}


def path_hash(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


SPOKEN = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("message row", (Each("message", "role", "text"),), ("message",), ("message.role", "message.text")),
    Layout("messages", (Each("messages", "role", "content", SPOKEN),), ("messages",), ("messages[]", "messages[].role", "messages[].content")),
    Layout("from and value", (Each("conversations", "from", "value", SPOKEN),), ("conversations",), ("conversations[]", "conversations[].from", "conversations[].value")),
    Layout("instruction", (Say("system", ("system",)), Say("user", ("instruction", "input")), Say("assistant", ("output",))), ("instruction",), ("input", "output", "system")),
    Layout("prompt and completion", (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("completion",))), ("prompt",), ("completion", "system")),
    Layout("prompt and response", (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("response",))), ("prompt", "response"), ("system",)),
    Layout("question and answer", (Say("user", ("question",)), Say("assistant", ("answer",))), ("question",), ("answer",)),
    Layout("nested prompt", (Say("user", ("prompt.text",)), Say("assistant", ("completion.text",))), ("prompt", "prompt.text"), ("completion", "completion.text")),
)


def _present(kind: T.DataType, path: str) -> list:
    """(path, test of a value of this type for the path being there)."""
    field = lambda test, name: lambda c: test(c.getField(name))
    some = lambda test: lambda c: F.coalesce(F.exists(c, test), F.lit(False))
    out = [(path, lambda c: c.isNotNull())]
    if isinstance(kind, T.StructType):
        out += [(p, field(t, f.name)) for f in kind.fields for p, t in _present(f.dataType, f"{path}.{f.name}")]
    elif isinstance(kind, T.ArrayType):
        out += [(p, some(t)) for p, t in _present(kind.elementType, f"{path}[]")]
    return out


def _root(name: str) -> Column:
    return F.col(f"`{name}`")


def field_paths(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The paths of a record's fields that aren't null, of the columns that any
    layout names. Fields no layout names count: they make another layout."""
    roots = set().union(*(x.roots() for x in layouts))
    found = [(p, t(_root(f.name))) for f in records.schema.fields if f.name in roots for p, t in _present(f.dataType, f.name)]
    return F.array_compact(F.array(*[F.when(there, F.lit(p)) for p, there in sorted(found, key=lambda x: x[0])])).cast("array<string>")


def fingerprint(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def _kind(schema: T.StructType, path: str) -> T.DataType | None:
    kind = schema
    for name in path.split("."):
        kind = next((f.dataType for f in kind.fields if f.name == name), None) if isinstance(kind, T.StructType) else None
    return kind


def _at(path: str) -> Column:
    root, *rest = path.split(".")
    c = _root(root)
    for name in rest:
        c = c.getField(name)
    return c


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _message(t: Each, has: set[str]):
    """The canonical turn of a struct with fields `has`."""

    def one(m):
        get = lambda name: m.getField(name).cast("string") if name in has else F.lit(None).cast("string")
        role = get(t.role)
        for written, meant in t.names:
            role = F.when(get(t.role) == written, F.lit(meant)).otherwise(role)
        return _turn(role, get(t.text))

    return one


def _turns(schema: T.StructType, layout: Layout) -> Column:
    none = F.array().cast(TURNS)
    parts = []
    for t in layout.turns:
        if isinstance(t, Say):
            texts = [_at(p).cast("string") for p in t.paths if _kind(schema, p) is not None]
            if texts:
                found = F.array_compact(F.array(*texts))
                parts.append(F.when(F.size(found) > 0, F.array(_turn(F.lit(t.role), F.array_join(found, "\n\n")))).otherwise(none))
            continue
        kind = _kind(schema, t.path)
        item = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(item, T.StructType):
            continue
        messages = _at(t.path) if isinstance(kind, T.ArrayType) else F.array(_at(t.path))
        parts.append(F.transform(F.filter(messages, lambda m: m.isNotNull()), _message(t, set(item.fieldNames()))))
    return F.concat(none, *parts).cast(TURNS)


def canonical_turns(records: DataFrame, keep: list[str], layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The columns of `keep`, `fingerprint`, `layout` (null: unknown) and
    `turns`, an array of role and text."""
    roots = set().union(*(y.roots() for y in layouts)) & set(records.columns)
    kept = [f"_keep{i}" for i in range(len(keep))]
    x = records.select(*[_root(c).alias(k) for c, k in zip(keep, kept, strict=True)], *[_root(c) for c in sorted(roots)])
    x = x.withColumn("_print", fingerprint(field_paths(x, layouts)))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for y in layouts:
        if {p.split(".")[0].removesuffix("[]") for p in y.needs} <= roots:
            here = F.col("_print").isin(y.fingerprints())
            layout, turns = F.when(here, F.lit(y.name)).otherwise(layout), F.when(here, _turns(x.schema, y)).otherwise(turns)
    return x.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], F.col("_print").alias("fingerprint"), layout.alias("layout"), turns.alias("turns"))


def gathered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows with turns of a conversation each put together: conv_id, turns."""
    own = F.when(_root(conv).isNull(), F.monotonically_increasing_id())
    place = F.struct(_root(turn).isNull().alias("last"), _root(turn).alias("turn"), F.col("turns").alias("turns"))
    x = turns.select(_root(conv).alias("conv_id"), own.alias("_own"), place.alias("_place"))
    x = x.groupBy("conv_id", "_own").agg(F.sort_array(F.collect_list("_place")).alias("_all"))
    return x.select("conv_id", F.flatten(F.transform("_all", lambda p: p.turns)).alias("turns"))


def escape(text: Column, role: bool = False) -> Column:
    x = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(x, F.lit(END.strip()), F.lit("<\\" + END.strip()[1:]))
    x = F.regexp_replace(x, "#(?=##)", "#\\\\")
    return F.replace(x, F.lit(SEP), F.lit(":\\ ")) if role else x


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(conversations: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conversations with `segments`, pieces of the formatted text, each with
    whether the loss counts it, and `formatted`, all pieces in a row. The loss
    counts the texts of roles in `learn`, without headers and end marks."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.transform(
        "turns",
        lambda t: F.array(
            piece(F.concat(F.lit(HEAD), escape(t.role, True), F.lit(SEP)), F.lit(False)),
            piece(escape(t.text), t.role.isin(*learn)),
            piece(F.lit(END), F.lit(False)),
        ),
    )
    x = conversations.withColumn("segments", F.flatten(segments))
    return x.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(text, END), lambda p: p != "")  # no piece of a turn is empty: the one behind the last mark is

    def turn(p):
        head = F.substring_index(p, SEP, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(HEAD) + 1))).alias("role"), unescape(F.substr(p, F.length(head) + len(SEP) + 1)).alias("text"))

    return F.transform(pieces, turn)


def read_learned(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id and digests of what a reader finds in segments and formatted."""
    x = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("_turns"), read_learned(F.col("segments")).alias("_learned"))
    all_turns = F.array_join(F.transform("_turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return x.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2("_learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def formatted_conversations(rows: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Chats of rows by turn (conv_id, turn, role, text), and of records with a
    conv_id and any layout: conv_id, turns, segments, formatted."""
    message = F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    found = canonical_turns(rows.select("conv_id", "turn", message.alias("message")), ["conv_id", "turn"])
    if records is not None:
        more = canonical_turns(records, ["conv_id"]).withColumn("turn", F.lit(None).cast(rows.schema["turn"].dataType))
        found = found.unionByName(more)
    return formatted(gathered(found))
