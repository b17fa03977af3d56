"""Chat formatting by schema fingerprints: field paths select a mapping, mappings give turns, turns become one string.

Records come in many layouts (rows of turns, message lists, prompt and answer, instruction and output). The nested field
paths that a record has are hashed; the hash selects one of the declared layouts, each of which is a plain description of
where roles and texts stand. Everything here is DataFrame functions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# What the template writes around roles and texts.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Strings that this or other chat templates give a meaning; none may stand in a formatted text by chance.
CONTROLS = (START, SEPARATOR, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Breaks control strings inside texts; doubled where a text has it itself.
ESCAPE = "\\"
#: The role whose texts are learned.
LEARNED = "assistant"
# Names that data sets give the usual roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record stand.

    ``turns`` lists (role, path) for records with a fixed number of turns; ``items`` is the path of a list of messages with
    the field names ``role`` and ``text``; ``row`` says that a record is itself one turn. ``optional`` paths may be missing;
    ``renames`` says that roles have the names of ``ROLE_NAMES``.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    row: bool = False
    optional: tuple[str, ...] = ()
    renames: bool = False

    @property
    def paths(self) -> tuple[str, ...]:
        """The field paths that the mapping reads."""
        if self.items:
            return f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"
        return (self.role, self.text) if self.row else tuple(path for _, path in self.turns)

    @property
    def required(self) -> frozenset[str]:
        return frozenset(self.paths) - frozenset(self.optional)


#: The declared layouts; of several that fit, the one with the most required paths counts, then the first.
LAYOUTS = (
    Layout("turn rows", row=True, role="role", text="text"),
    Layout("content rows", row=True, role="role", text="content"),
    Layout("messages", items="messages", role="role", text="content"),
    Layout("message texts", items="messages", role="role", text="text"),
    Layout("shared conversations", items="conversations", role="from", text="value", renames=True),
    Layout("instruction", turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
           optional=("system", "input")),
    Layout("prompt and completion", turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question and answer", turns=(("user", "question"), ("assistant", "answer"))),
)


def vocabulary(layouts: tuple[Layout, ...] = LAYOUTS) -> list[str]:
    """Every field path that some layout reads, in order."""
    return sorted({path for layout in layouts for path in layout.paths})


def choose(paths: frozenset[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout for a set of field paths: all its required paths are there, the most of them, the first of equals."""
    fitting = [x for x in layouts if x.required <= paths]
    return max(fitting, key=lambda x: len(x.required), default=None)


def schema_paths(schema: StructType, before: str = "") -> set[str]:
    """Nested field paths of a schema; ``[]`` stands for the elements of a list."""
    found = set()
    for field in schema:
        kind, path = field.dataType, before + field.name
        while isinstance(kind, ArrayType):
            kind, path = kind.elementType, path + "[]"
        found |= schema_paths(kind, path + ".") if isinstance(kind, StructType) else {path}
    return found


def fingerprint(paths: frozenset[str], layouts: tuple[Layout, ...] = LAYOUTS) -> str:
    """The hash of the known ones among the field paths."""
    return hashlib.sha256("\n".join(sorted(paths & set(vocabulary(layouts)))).encode()).hexdigest()


def mappings(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """The layout of each fingerprint that a layout declares: its required paths with any of its optional ones."""
    found: dict[str, Layout] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for spare in combinations(layout.optional, n):
                found.setdefault(fingerprint(layout.required | set(spare), layouts), layout)
    return found


def select(paths: frozenset[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout that the fingerprint selects; ``choose`` decides for fingerprints of paths that mix layouts."""
    return mappings(layouts).get(fingerprint(paths, layouts)) or choose(paths, layouts)


def _turn(position, role: Column, text: Column, renames: bool = False) -> Column:
    name = F.coalesce(role.cast("string"), F.lit(""))
    if renames:
        lowered = F.lower(name)
        name = reduce(lambda c, x: c.when(lowered == x[0], x[1]), ROLE_NAMES.items(), F.when(F.lit(False), "")).otherwise(name)
    return F.struct(F.lit(position).cast("long").alias("position"), name.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def table_turns(table: DataFrame, id_col: str, order_col: str | None = None, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, position, role, text): the turns of a typed table in any declared layout, found by its schema's field paths.

    In row layouts ``order_col`` gives the position of a turn; elsewhere positions are those in the record. Null roles and texts
    become empty; null ids and positions stay; lists that are null or empty give no turns; a missing or null optional field gives
    no turn. Columns that no layout names, and those that the chosen one doesn't read, are left alone. A table that fits no
    layout is a ValueError that names its paths. An empty table gives an empty result.
    """
    paths = frozenset(schema_paths(table.schema))
    layout = select(paths, layouts)
    if layout is None:
        raise ValueError(f"no layout fits the field paths {sorted(paths)}")
    conv = F.col(f"`{id_col}`").alias("conv_id")
    if layout.row:
        position = F.col(f"`{order_col}`") if order_col else F.lit(0)
        turn = _turn(position, F.col(layout.role), F.col(layout.text))
        return table.select(conv, turn.alias("t")).select("conv_id", "t.*")
    if layout.items:
        turns = F.transform(F.col(layout.items), lambda m, i: F.when(m.isNotNull(), _turn(i, m[layout.role], m[layout.text], layout.renames)))
    else:
        present = [(k, role, F.col(path).cast("string"), path in layout.optional) for k, (role, path) in enumerate(layout.turns) if path in paths]
        turns = F.array(*[F.when(F.lit(not spare) | text.isNotNull(), _turn(k, F.lit(role), text)) for k, role, text, spare in present])
    return table.select(conv, F.explode(F.filter(turns, lambda t: t.isNotNull())).alias("t")).select("conv_id", "t.*")


def fingerprints(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The records with ``_paths`` (their known field paths, sorted) and ``_fingerprint`` (hash of these).

    A record is a JSON string or a VARIANT. What isn't JSON has no paths.
    """
    kind = records.schema[record_col].dataType.simpleString()
    record = F.col(record_col) if kind == "variant" else F.try_parse_json(record_col)

    def there(value: Column, path: str) -> Column:
        return F.try_variant_get(value, f"$.{path}", "variant").isNotNull()

    def has(path: str) -> Column:
        if "[]." not in path:
            return there(F.col("_record"), path)
        outer, inner = path.split("[].")
        return F.exists(F.try_variant_get("_record", f"$.{outer}", "array<variant>"), lambda m: there(m, inner))

    present = F.array(*[F.when(has(path), path) for path in vocabulary(layouts)])
    known = records.withColumn("_record", record).withColumn("_paths", F.array_compact(present))
    return known.withColumn("_fingerprint", F.sha2(F.concat_ws("\n", "_paths"), 256))


def record_turns(records: DataFrame, id_col: str, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, position, role, text): turns of JSON (or VARIANT) records whose layouts differ from row to row.

    The fingerprints that occur (at most one per set of known paths, whatever the number of records) are looked up once; each
    selects a mapping for its records. A record that fits no layout, is null or is no JSON, and one without turns, gives one row
    with null position, role and text, so that nothing is lost in silence; ``layout`` is null where none fits. Null roles and
    texts become empty, null ids stay, repeated rows give their turns each; an empty table gives an empty result.
    """
    marked = fingerprints(records.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{record_col}`").alias("record")), "record", layouts)
    seen = marked.groupBy("_fingerprint", "_paths").agg(F.count("*").alias("n")).collect()
    by_layout: dict[Layout, list[str]] = {}
    for row in seen:
        if layout := select(frozenset(row["_paths"]), layouts):
            by_layout.setdefault(layout, []).append(row["_fingerprint"])
    kind = "array<struct<position:bigint,role:string,text:string>>"
    turns, name = F.lit(None).cast(kind), F.lit(None).cast("string")
    for layout, prints in by_layout.items():
        chosen = F.col("_fingerprint").isin(prints)
        turns = F.when(chosen, _mapped(layout).cast(kind)).otherwise(turns)
        name = F.when(chosen, layout.name).otherwise(name)
    return marked.select("conv_id", name.alias("layout"), F.explode_outer(turns).alias("t")).select("conv_id", "layout", "t.*")


def _mapped(layout: Layout) -> Column:
    """The turns of a VARIANT record in one layout."""
    def get(value, path: str) -> Column:
        return F.try_variant_get(value, f"$.{path}", "string")

    if layout.items:
        items = F.try_variant_get("_record", f"$.{layout.items}", "array<variant>")
        found = F.transform(items, lambda m, i: F.when(m.isNotNull(), _turn(i, get(m, layout.role), get(m, layout.text), layout.renames)))
        return F.filter(found, lambda t: t.isNotNull())
    if layout.row:
        return F.array(_turn(0, get("_record", layout.role), get("_record", layout.text)))
    texts = [(k, role, get("_record", path), path in layout.optional) for k, (role, path) in enumerate(layout.turns)]
    found = F.array(*[F.when(F.lit(not spare) | text.isNotNull(), _turn(k, F.lit(role), text)) for k, role, text, spare in texts])
    return F.filter(found, lambda t: t.isNotNull())


def _pattern(strings: tuple[str, ...]) -> str:
    """A pattern for the strings in two groups: the first character, the rest."""
    quoted = ["".join("\\" + c if not c.isalnum() else c for c in s[1:]) for s in strings]
    firsts = sorted({s[0] for s in strings})
    return "|".join(f"(?<=\\{c})(?=(?:{'|'.join(q for s, q in zip(strings, quoted) if s[0] == c)}))" for c in firsts)


def escape(text: Column) -> Column:
    """The text with every control string broken after its first character, reversibly."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, _pattern(CONTROLS), ESCAPE * 2)


def unescape(text: Column) -> Column:
    """The text as it was before ``escape``."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """One row per conversation: its keys, ``formatted`` and ``loss`` (one entry per turn: start and end of the code points to learn, or null).

    ``turns`` has position, role and text. Turns are in order of position (null first), ties by role, then text. A turn is
    START role SEPARATOR text END; control strings inside roles and texts are broken by ``escape``. Null roles and texts count as
    empty; a null key is a conversation of its own; repeated rows are turns of their own; texts may be as long as Spark's strings;
    an empty table gives an empty result. One shuffle by conversation, whose string is one value, and so meets in one task.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "position", role.alias("role"), text.alias("text"))
    order = Window.partitionBy(*names).orderBy(F.asc_nulls_first("position"), "role", "text")
    body = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEPARATOR), escape(F.col("text")), F.lit(END))
    placed = (
        rows.withColumn("turn", F.row_number().over(order) - 1)
        .withColumn("part", body).withColumn("size", F.length(escape(F.col("text"))).cast("long"))
        .withColumn("end", F.sum(F.length("part").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END))
    )
    each = F.struct("turn", "part", (F.col("end") - F.col("size")).alias("start"), "end", (F.col("role") == LEARNED).alias("learned"))
    whole = placed.groupBy(*names).agg(F.sort_array(F.collect_list(each)).alias("turns"))
    learned = F.transform("turns", lambda t: F.when(t["learned"], F.struct(t["start"].alias("start"), t["end"].alias("end"))))
    formatted = F.array_join(F.transform("turns", lambda t: t["part"]), "")
    return whole.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], formatted.alias("formatted"), learned.alias("loss"))


def _parts(formatted: Column) -> Column:
    """The turns of a formatted string, without their ends."""
    return F.split(formatted, "".join("\\" + c if not c.isalnum() else c for c in END))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted string holds: list of (role, text), unescaped."""
    parts = F.filter(_parts(formatted), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEPARATOR, 1)).alias("role"),
        unescape(F.substring_index(p, SEPARATOR, -1)).alias("text"),
    ))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order. A span ends where its turn does, so each looks at its turn alone."""
    def under(part: Column, span: Column) -> Column:
        size = (span["end"] - span["start"]).cast("int")
        return F.when(span.isNotNull(), unescape(F.substr(part, F.length(part) - size + 1, size)))

    return F.array_compact(F.zip_with(_parts(formatted), loss, under))
