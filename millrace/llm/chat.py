"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

Records come as JSON in any layout that :data:`LAYOUTS` declares. The nested field paths of a record, as far as
some layout names them, are hashed; the hash selects the layout's mapping. Everything runs as built-in functions
(VARIANT, higher-order functions), without Python on the executors. Records that VARIANT can't hold (over 128 MB, or
with a string of over 20 million characters) are read as maps of their fields instead. Rows of a table
have the paths of their fields that aren't null, which are hashed in the same way; they are mapped one by one and only
put together at the end, without any JSON; what bounds a conversation then is the
2 GB that Spark allows a value, beyond which it fails.

Defined results: a record that is null, no JSON, or of no known layout gets ``layout`` null, no turns and an empty
text. Null texts and roles are empty; a role or text that is no string is its JSON. Roles of the layout ``turns`` stay
as they are, other layouts' names for them become the canonical ones. Turns that tie in their number keep role and text order; repeated turns stay.
Fields that no layout names, and further columns of the input, are ignored and never clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
#: Bytes from which a record may hold more than VARIANT's parser takes, and how such records are read.
LARGE, WIDE = 20_000_000, {"maxStringLen": str(2**31 - 1)}
FIELDS = "map<string,string>"


@dataclass(frozen=True)
class Layout:
    """How records with just these known paths become turns.

    ``parts`` lists, in order, scalar fields with their role as ``(path, role)``. ``rows`` names an array of objects
    with its role, text and, if it has one, order field; it follows the parts. ``joined`` holds parts that are
    appended to the one before them, after an empty line, unless they are empty. ``renames`` says whether roles get
    their canonical names.
    """

    name: str
    parts: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str, str | None] | None = None
    joined: tuple[str, ...] = ()
    renames: bool = True

    @property
    def paths(self) -> frozenset[str]:
        found = {p for p, _ in self.parts} | set(self.joined)
        if self.rows:
            found |= {f"{self.rows[0]}[].{x}" for x in self.rows[1:] if x}
        return frozenset(found)

    @property
    def fingerprint(self) -> str:
        return hashlib.md5("\n".join(sorted(self.paths)).encode()).hexdigest()


LAYOUTS = (
    Layout("turns", rows=("turns", "role", "text", "turn"), renames=False),
    Layout("messages", rows=("messages", "role", "content", None)),
    Layout("system_messages", parts=(("system", "system"),), rows=("messages", "role", "content", None)),
    Layout("conversations", rows=("conversations", "from", "value", None)),
    Layout("system_conversations", parts=(("system", "system"),), rows=("conversations", "from", "value", None)),
    Layout("instruction", parts=(("instruction", "user"), ("output", "assistant"))),
    Layout("instruction_input", parts=(("instruction", "user"), ("output", "assistant")), joined=("input",)),
    Layout("prompt_completion", parts=(("prompt", "user"), ("completion", "assistant"))),
    Layout("prompt_response", parts=(("prompt", "user"), ("response", "assistant"))),
    Layout("system_prompt", parts=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Layout("question_answer", parts=(("question", "user"), ("answer", "assistant"))),
)
#: Names that other layouts give to the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The sorted nested paths of a VARIANT record that some layout names."""
    known = sorted({p for x in layouts for p in x.paths})
    found = []
    for path in known:
        if "[]." in path:
            array, name = path.split("[].")
            # the field belongs to an element of the array itself, not to what lies deeper
            elements = F.try_variant_get(record, f"$.{array}", "array<variant>")
            found.append(F.when(F.exists(elements, lambda x: F.try_variant_get(x, f"$.{name}", "variant").isNotNull()), F.lit(path)))
        else:
            found.append(F.when(F.variant_get(record, f"$.{path}", "variant").isNotNull(), F.lit(path)))
    return F.array_compact(F.array(*found))


def _hashed(paths: Column) -> Column:
    return F.md5(F.array_join(paths, "\n").cast("binary"))


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    return _hashed(field_paths(record, layouts))


def _objects(fields: Column, array: str) -> Column:
    return F.from_json(fields[array], f"array<{FIELDS}>", WIDE)


def large_field_paths(fields: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """As :func:`field_paths`, of a map of a record's fields."""
    found = []
    for path in sorted({p for x in layouts for p in x.paths}):
        if "[]." in path:
            array, name = path.split("[].")
            found.append(F.when(F.array_contains(F.flatten(F.transform(F.array_compact(_objects(fields, array)), F.map_keys)), name), F.lit(path)))
        else:
            found.append(F.when(F.map_contains_key(fields, path), F.lit(path)))
    return F.array_compact(F.array(*found))


def _turn(role: Column, text: Column, renames: bool = True) -> Column:
    role = F.coalesce(role, F.lit(""))
    for name, canonical in ROLES.items() if renames else ():
        role = F.when(role == name, F.lit(canonical)).otherwise(role)
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(record: Column, layout: Layout, large: bool = False) -> Column:
    """Turns of a VARIANT record, or if ``large`` of a map of its fields."""
    out = F.array().cast(TURNS)
    get = lambda path: F.coalesce(record[path] if large else F.variant_get(record, f"$.{path}", "string"), F.lit(""))
    for i, (path, role) in enumerate(layout.parts):
        text = get(path)
        if i == 0:
            for more in layout.joined:
                text = F.concat(text, F.when(get(more) != "", F.concat(F.lit("\n\n"), get(more))).otherwise(""))
        out = F.concat(out, F.array(_turn(F.lit(role), text)))
    if layout.rows:
        array, role, text, order = layout.rows
        fields = ([f"{order}:bigint"] if order else []) + [f"`{role}`:string", f"`{text}`:string"]
        if large:
            number = lambda x: [x[order].try_cast("decimal(38,6)").cast("long").alias(order)] if order else []
            rows = F.transform(_objects(record, array), lambda x: F.struct(*number(x), x[role].alias(role), x[text].alias(text)))
        else:
            rows = F.variant_get(record, f"$.{array}", f"array<struct<{','.join(fields)}>>")
        rows = F.array_sort(rows) if order else rows
        out = F.concat(out, F.coalesce(F.transform(rows, lambda x: _turn(x[role], x[text], layout.renames)), F.array().cast(TURNS)))
    return out


def canonical(record: Column, layouts: tuple[Layout, ...] = LAYOUTS, found: Column | None = None, large: bool = False) -> Column:
    """Turns of a VARIANT record (if ``large``, of a map of its fields) as its fingerprint's layout maps them; null if no layout has it."""
    if found is None:
        found = _hashed(large_field_paths(record, layouts)) if large else fingerprint(record, layouts)
    out = F.lit(None).cast(TURNS)
    for layout in layouts:
        out = F.when(found == layout.fingerprint, _mapped(record, layout, large)).otherwise(out)
    return out


def escaped(text: Column) -> Column:
    """Text without control strings: ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _role_escaped(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def _role_unescaped(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def formatted(turns: Column) -> Column:
    """The template: each turn as start mark, role, line end, text, end mark, line end."""
    one = lambda t: F.concat(F.lit(START), _role_escaped(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def loss_mask(turns: Column) -> Column:
    """Per turn the characters to skip from its start mark on, then those that carry loss: an assistant's text."""
    return F.transform(
        turns,
        lambda t: F.struct(
            (F.length(_role_escaped(t["role"])) + len(START) + 1).alias("skip"),
            F.when(t["role"] == "assistant", F.length(escaped(t["text"]))).otherwise(0).alias("take"),
        ),
    )


def format_chats(df: DataFrame, payload: str, keys: list[str], layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Format one record a row. Returns the keys, ``layout``, ``fingerprint``, ``turns``, ``formatted``, ``loss_mask``."""
    df = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(payload).alias("payload"), F.try_parse_json(F.col(payload)).alias("record"))
    too_large = F.col("record").isNull() & (F.octet_length("payload") > LARGE)
    df = df.withColumn("fields", F.when(too_large, F.from_json("payload", FIELDS, WIDE))).drop("payload")
    is_large = F.col("fields").isNotNull()
    df = df.withColumn("fingerprint", F.when(is_large, _hashed(large_field_paths(F.col("fields"), layouts))).otherwise(fingerprint(F.col("record"), layouts)))
    name = F.lit(None).cast("string")
    for layout in layouts:
        name = F.when(F.col("fingerprint") == layout.fingerprint, F.lit(layout.name)).otherwise(name)
    turns = F.when(is_large, canonical(F.col("fields"), layouts, F.col("fingerprint"), large=True)).otherwise(canonical(F.col("record"), layouts, F.col("fingerprint")))
    turns = F.coalesce(turns, F.array().cast(TURNS))
    df = df.select("*", name.alias("layout"), turns.alias("turns"))
    return df.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "layout", "fingerprint", "turns",
        formatted(F.col("turns")).alias("formatted"), loss_mask(F.col("turns")).alias("loss_mask"),
    )


def row_layouts(columns: list[str], layouts: tuple[Layout, ...] = LAYOUTS) -> list[tuple[Layout, list[str]]]:
    """Layouts that rows with these columns may have, and the columns that each reads: an array's fields, or its parts."""
    out = []
    for x in layouts:
        own = [c for c in x.rows[1:] if c] if x.rows else [p for p, _ in x.parts] + list(x.joined)
        if not (x.rows and x.parts) and set(own) <= set(columns):
            out.append((x, own))
    return out


def row_fingerprints(possible: list[tuple[Layout, list[str]]]) -> dict[str, Layout]:
    """The layout for each fingerprint of a row's fields.

    A row's fields are those that aren't null. All fields of a layout name it, and so do some of them if no other
    layout that the table's columns allow has them too; the whole schema decides for a table of one layout.
    """
    found: dict[frozenset, list[Layout]] = {}
    for layout, own in possible:
        for n in range(len(own) + 1):
            for some in combinations(sorted(own), n):
                found.setdefault(frozenset(some), []).append(layout)
    whole = {frozenset(own): layout for layout, own in possible}
    chosen = {some: whole.get(some) or (held[0] if len(held) == 1 else None) for some, held in found.items()}
    return {hashlib.md5("\n".join(sorted(some)).encode()).hexdigest(): layout for some, layout in chosen.items() if layout}


def format_rows(df: DataFrame, key: str, layouts: tuple[Layout, ...] = LAYOUTS, order: str | None = None) -> DataFrame:
    """As :func:`format_chats`, from rows that are turns, or prompts with their answers, in one or several layouts.

    The fields that a row has are hashed, and the fingerprint selects the mapping that makes its turns; a row whose
    fingerprint no layout has is left out. Each row is mapped by itself; a conversation's turns are put in order last:
    by their layout's order field, or else by the column ``order``. ``layout`` and ``fingerprint`` name all layouts
    that a conversation's rows have, joined by ``+``.
    """
    possible = row_layouts(df.columns, layouts)
    fields = sorted({c for _, own in possible for c in own})
    names = row_fingerprints(possible)
    rows = df.select(F.col(key).alias("key"), *([F.col(order).cast("long").alias("at")] if order else []), *[F.col(c).alias(f"f_{c}") for c in fields])
    found = _hashed(F.array_compact(F.array(*[F.when(F.col(f"f_{c}").isNotNull(), F.lit(c)) for c in fields]).cast("array<string>")))
    rows = rows.withColumn("found", found)
    text = lambda c: F.coalesce(F.col(f"f_{c}").cast("string"), F.lit(""))
    item = lambda own, said, renames: F.struct(own.alias("own"), said.alias("text"), _turn(own, said, renames)["role"].alias("role"))
    one = F.lit(None).cast("struct<at:bigint,items:array<struct<own:string,text:string,role:string>>,layout:string,fingerprint:string>")
    for layout, _ in possible:
        at = F.col("at") if order else F.lit(None).cast("long")
        if layout.rows:
            _, role, said, own = layout.rows
            at = F.col(f"f_{own}").cast("long") if own else at
            items = F.array(item(text(role), text(said), layout.renames))
        else:
            parts = [(text(p), F.lit(role)) for p, role in layout.parts]
            for more in layout.joined:
                parts[0] = (F.concat(parts[0][0], F.when(text(more) != "", F.concat(F.lit("\n\n"), text(more))).otherwise("")), parts[0][1])
            items = F.array(*[item(role, said, layout.renames) for said, role in parts])
        of_layout = [h for h, x in names.items() if x is layout]
        one = F.when(F.col("found").isin(*of_layout), F.struct(at.alias("at"), items.alias("items"), F.lit(layout.name).alias("layout"), F.lit(layout.fingerprint).alias("fingerprint"))).otherwise(one)
    grouped = rows.select("key", one.alias("one")).groupBy("key").agg(F.array_sort(F.collect_list("one")).alias("all"))
    turns = F.transform(F.flatten(F.transform("all", lambda x: x["items"])), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    said = lambda name: F.array_join(F.array_sort(F.array_distinct(F.transform("all", lambda x: x[name]))), "+")
    grouped = grouped.select("key", said("layout").alias("layout"), said("fingerprint").alias("fingerprint"), turns.alias("turns"))
    some = F.size("turns") > 0
    return grouped.select(
        F.col("key").alias(key), F.when(some, F.col("layout")).alias("layout"), F.when(some, F.col("fingerprint")).alias("fingerprint"), "turns",
        formatted(F.col("turns")).alias("formatted"), loss_mask(F.col("turns")).alias("loss_mask"),
    )


def parsed(text: Column) -> Column:
    """Turns back from a formatted text."""
    parts = F.filter(F.split(text, r"<\|im_start\|>"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            _role_unescaped(F.substring_index(x, "\n", 1)).alias("role"),
            unescaped(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - len(END) - 2)).alias("text"),
        ),
    )


def under_mask(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    parts = F.filter(F.split(text, r"<\|im_start\|>"), lambda x: x != "")
    return F.array_join(F.zip_with(parts, mask, lambda x, m: unescaped(F.substr(x, m["skip"] - len(START) + 1, m["take"]))), "")


def conversation_records(rows: DataFrame) -> DataFrame:
    """One JSON record a conversation, in the layout ``turns``, from rows (conv_id, turn, role, text).

    A conversation is one record, so its rows meet in one place by definition.
    """
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    grouped = rows.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.collect_list("one").alias("turns"))
    keep_nulls = {"ignoreNullFields": "false"}
    return grouped.select("conv_id", F.to_json(F.struct("turns"), keep_nulls).alias("payload"))


def digests(chats: DataFrame, key: str) -> DataFrame:
    """What reading the formatted texts back gives, as counts and digests."""
    chats = chats.select(key, "formatted", parsed(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
