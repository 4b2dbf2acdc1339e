"""Chat formatting (native): many layouts to one canonical list of turns, then text.

The layout of a table is recognised by its schema fingerprint: the nested field
paths are hashed, and the hash selects a declarative mapping (which paths hold
the conversation, the order, the role and the text of a turn). A table of JSON
strings is recognised row by row: the paths of each record are listed and hashed
with SQL functions, and the hash selects the mapping of that row.

The template marks turns with ``<|turn|>role<|text|>text<|end|>``. Inside roles
and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so no text can hold
a marker, and one left-to-right pass (a backslash is dropped, the character
after it stays) gives the text back.

A conversation becomes one string, so its turns meet in one row. Offsets of the
loss mask come from a running sum over the turns.

Defined results: null roles and texts are empty; a null conversation id is one
conversation; turns that repeat a turn number all stay, ordered by role and
text; a table of no known layout raises, a JSON record of none gives no turns;
extra columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


@dataclass(frozen=True)
class Layout:
    """A mapping from field paths to turns. ``paths``: the fields that a table of
    this layout has. ``rows``: (order, role, text) columns, one row a turn.
    ``items``: an array path with the role and text fields inside. ``fields``: a
    fixed list of (role, path) turns, empty ones left out but for the last;
    ``joined`` appends the text of a second path to a first by a newline."""

    name: str
    paths: tuple[str, ...]
    rows: tuple[str, str, str] | None = None
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    joined: tuple[str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    """Hash of the sorted nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


LAYOUTS = (
    Layout("turn rows", ("turn", "role", "text"), rows=("turn", "role", "text")),
    Layout("messages", ("messages", "messages[].role", "messages[].content"), items=("messages", "role", "content")),
    Layout(
        "from/value", ("conversations", "conversations[].from", "conversations[].value"),
        items=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant")),
    ),
    Layout("prompt", ("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question", ("question", "answer"), fields=(("user", "question"), ("assistant", "answer"))),
    Layout(
        "instruction", ("instruction", "input", "output"),
        fields=(("user", "instruction"), ("assistant", "output")), joined=("instruction", "input"),
    ),
    Layout(
        "system prompt", ("system", "prompt", "response"),
        fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
)


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested paths of a schema: ``a``, ``a.b`` in structs, ``a[].b`` in arrays of structs."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    if not isinstance(schema, T.StructType):
        return []
    out = []
    for f in schema.fields:
        path = f"{at}.{f.name}" if at else f.name
        out += [path, *field_paths(f.dataType, path)]
    return out


def layout_of(df: DataFrame, ignore: tuple[str, ...] = (), layouts=LAYOUTS) -> Layout:
    """The mapping that the fingerprint of ``df`` selects; ``ignore`` names
    columns (the conversation id, extra ones) that do not count. A table with
    more fields than any mapping knows gets the one that covers most of them."""
    paths = field_paths(T.StructType([f for f in df.schema.fields if f.name not in ignore]))
    mark = fingerprint(paths)
    for x in layouts:
        if x.fingerprint == mark:
            return x
    covered = [x for x in layouts if set(x.paths) <= set(paths)]
    most = max((len(x.paths) for x in covered), default=0)
    covered = [x for x in covered if len(x.paths) == most]
    if len(covered) != 1:
        raise ValueError(f"{'no' if not covered else 'more than one'} mapping for the fields {sorted(paths)}")
    return covered[0]


def _text(column):
    return F.coalesce(column.cast("string"), F.lit(""))


def _role(column, layout: Layout):
    role = _text(column)
    for theirs, ours in layout.roles:
        role = F.when(role == theirs, F.lit(ours)).otherwise(role)
    return role


def _fixed_turns(values: dict, layout: Layout):
    """Array of turns from separate fields (columns by path)."""
    turns = []
    for i, (role, path) in enumerate(layout.fields):
        text = _text(values[path])
        if layout.joined and path == layout.joined[0]:
            more = _text(values[layout.joined[1]])
            text = F.when(more == "", text).otherwise(F.concat(text, F.lit("\n"), more))
        turns.append(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text")))
    last = len(layout.fields) - 1
    return F.filter(F.array(*turns), lambda t: (t["text"] != "") | (t["turn"] == last))


def _item_turns(items, role: str, text: str, layout: Layout):
    """Array of turns from an array of structs."""
    return F.transform(
        items,
        lambda x, i: F.struct(
            i.cast("long").alias("turn"), _role(x[role], layout).alias("role"), _text(x[text]).alias("text")
        ),
    )


def to_turns(df: DataFrame, conv_id: str = "conv_id", ignore: tuple[str, ...] = (), layouts=LAYOUTS) -> DataFrame:
    """Rows (conv_id, turn, role, text) from a table of any known layout."""
    layout = layout_of(df, (conv_id, *ignore), layouts)
    key = F.col(f"`{conv_id}`").alias("conv_id")
    if layout.rows:
        turn, role, text = (F.col(c) for c in layout.rows)
        return df.select(key, turn.cast("long").alias("turn"), _role(role, layout).alias("role"), _text(text).alias("text"))
    if layout.items:
        array, role, text = layout.items
        rows = df.select(key, F.explode(_item_turns(F.col(array), role, text, layout)).alias("_turn"))
        return rows.select("conv_id", "_turn.turn", "_turn.role", "_turn.text")
    values = {path: F.col(path) for path in layout.paths}
    rows = df.select(key, F.explode(_fixed_turns(values, layout)).alias("_turn"))
    return rows.select("conv_id", "_turn.turn", "_turn.role", "_turn.text")


def json_paths(record):
    """The field paths of a JSON object as a sorted array: its keys, and for keys
    that hold an array of objects the keys of the first one, as ``key[].inner``."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))

    def inner(k):
        path = F.concat(F.lit("$['"), k, F.lit("'][0]"))
        first = F.call_function("get_json_object", record, path)
        return F.transform(
            F.coalesce(F.json_object_keys(first), F.array().cast("array<string>")), lambda x: F.concat(k, F.lit("[]."), x)
        )

    return F.array_sort(F.concat(keys, F.flatten(F.transform(keys, inner))))


def json_to_turns(df: DataFrame, record: str = "record", conv_id: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """Rows (conv_id, turn, role, text) from JSON records of mixed layouts. Each
    row's fingerprint selects its mapping (with fields that no mapping knows: the
    one that covers most of the others); records of no known layout (or not JSON)
    give no turns."""
    r, paths = F.col(f"`{record}`"), json_paths(F.col(f"`{record}`"))
    mark = F.sha2(F.array_join(paths, "\n"), 256)
    exact = mark.isin([x.fingerprint for x in layouts])
    turns = F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    for layout in sorted(layouts, key=lambda x: len(x.paths)):  # the largest is asked first
        if layout.items:
            array, role, text = layout.items
            items = F.from_json(F.get_json_object(r, f"$.{array}"), f"array<struct<`{role}`:string,`{text}`:string>>")
            found = _item_turns(items, role, text, layout)
        elif layout.fields:
            found = _fixed_turns({p: F.get_json_object(r, f"$.{p}") for p in layout.paths}, layout)
        else:
            continue
        covered = F.size(F.array_except(F.array(*[F.lit(p) for p in layout.paths]), paths)) == 0
        turns = F.when((mark == layout.fingerprint) | (~exact & covered), found).otherwise(turns)
    return (
        df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.explode(turns).alias("_turn"))
        .select("conv_id", "_turn.turn", "_turn.role", "_turn.text")
    )


def escape(column):
    return F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(column):
    return F.regexp_replace(column, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, ``formatted`` and ``loss_spans`` (start and
    length in code points, the escaped texts of ``loss_role`` turns)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = (
        turns.withColumn("_n", F.row_number().over(order))
        .withColumn("_head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
        .withColumn("_body", escape(F.col("text")))
        .withColumn("_chars", (F.length("_head") + F.length("_body") + len(END)).cast("long"))
        .withColumn("_before", F.sum("_chars").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    )
    span = F.when(
        F.col("role") == loss_role,
        F.struct(
            (F.coalesce("_before", F.lit(0)) + F.length("_head")).cast("long").alias("start"),
            F.length("_body").cast("long").alias("length"),
        ),
    )
    one = F.struct("_n", F.concat("_head", "_body", F.lit(END)).alias("piece"), span.alias("span"))
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("_t"))
    return packed.select(
        "conv_id",
        F.array_join(F.transform("_t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("_t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted):
    """The turns (array of role and text) of a formatted conversation."""
    parts = F.split(formatted, r"<\|turn\|>")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part):
        halves = F.split(part, r"<\|text\|>")
        body = halves[1]
        return F.struct(
            unescape(halves[0]).alias("role"),
            unescape(F.substr(body, F.lit(1), F.length(body) - len(END))).alias("text"),
        )

    return F.transform(parts, turn)


def loss_text(formatted, loss_spans):
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(
            loss_spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
        ),
        "",
    )


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its mask hold, read back from them alone."""
    turns = read_back(F.col("formatted"))
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    return formatted.select("conv_id", "formatted", turns.alias("_turns"), loss.alias("_loss")).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(
                F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
            ).cast("binary"),
            256,
        ).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB SQL for the digest of ``conversations`` and conversation -7.
ORACLE_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(8 + 8 + 7 + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
           + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
