"""Chat formatting with DataFrame functions only: layouts told apart by schema fingerprints, one template for all.

A layout is recognised by a fingerprint, the hash of the nested field paths it has among those that any mapping
reads. Where further columns bear such names, the fingerprint is that of the largest layout all of whose paths are there,
the first declared of several as large; so other columns never matter. The mapping of that fingerprint, a declaration of
where roles and texts are, turns each record into canonical turns. Records in JSON are fingerprinted row by row, typed tables by their schema.

The template writes <s> and for each turn [role] , the text and </s>. Inside roles and texts every character that
can begin or end a mark is written as a backslash and a letter, so no control string of this or a like template can
stand in a text, and reading back is exact.

Defined results: null text or role is empty; a null turn sorts first and equal turns sort by role and text; repeated
rows are repeated turns; an unknown layout gives no turns; an empty table gives no rows. A conversation is one output
value and so is built in one task; nothing else about a key is gathered.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Layouts by the paths they have: alternatives for one field stand in separate entries.
LAYOUTS: dict[str, tuple[str, ...]] = {
    "rows": ("conv_id", "turn", "role", "text"),
    "messages": ("messages[].role", "messages[].content"),
    "conversations": ("conversations[].from", "conversations[].value"),
    "instruction": ("instruction", "output"),
    "instruction_input": ("instruction", "input", "output"),
    "prompt_completion": ("prompt", "completion"),
    "prompt_response": ("prompt", "response"),
    "system_prompt_response": ("system", "prompt", "response"),
}
KNOWN = sorted({p for paths in LAYOUTS.values() for p in paths})
#: Other names of the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    """Hash of the known paths in order."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


MAPPINGS = {fingerprint(paths): name for name, paths in LAYOUTS.items()}
#: Layouts from the least to the one that goes before all others.
RANKED = sorted(LAYOUTS, key=lambda name: (len(LAYOUTS[name]), -list(LAYOUTS).index(name)))


def recognised(paths: list[str]) -> str | None:
    """The layout of a record with these paths."""
    held = [name for name in RANKED if set(LAYOUTS[name]) <= set(paths)]
    return MAPPINGS.get(fingerprint(paths)) or (MAPPINGS[fingerprint(LAYOUTS[held[-1]])] if held else None)


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested paths of the leaves of a schema; [] stands for the elements of an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


def _turn(n: int, role: str, text: Column) -> Column:
    return F.struct(F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), text.cast("string").alias("text"))


def _listed(items: Column, role: str, text: str) -> Column:
    said = lambda x: F.coalesce(x[role].cast("string"), F.lit(""))
    named = lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in ROLES.items() for y in kv]), said(x)), said(x))
    return F.transform(items, lambda x, i: F.struct(i.cast("long").alias("turn"), named(x).alias("role"), x[text].cast("string").alias("text")))


def _present(*turns: Column) -> Column:
    return F.filter(F.array(*turns), lambda t: t["text"].isNotNull())


def _turns(layout: str, c) -> Column:
    """The declared mapping of a layout; c gives the column of a top-level field."""
    return {
        "messages": lambda: _listed(c("messages"), "role", "content"),
        "conversations": lambda: _listed(c("conversations"), "from", "value"),
        "instruction": lambda: _present(_turn(0, "user", c("instruction")), _turn(1, "assistant", c("output"))),
        "instruction_input": lambda: _present(
            _turn(0, "user", F.concat(c("instruction"), F.when(F.length(c("input")) > 0, F.concat(F.lit("\n\n"), c("input"))).otherwise(""))),
            _turn(1, "assistant", c("output")),
        ),
        "prompt_completion": lambda: _present(_turn(0, "user", c("prompt")), _turn(1, "assistant", c("completion"))),
        "prompt_response": lambda: _present(_turn(0, "user", c("prompt")), _turn(1, "assistant", c("response"))),
        "system_prompt_response": lambda: _present(_turn(0, "system", c("system")), _turn(1, "user", c("prompt")), _turn(2, "assistant", c("response"))),
    }[layout]()


def canonical_turns(records: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a typed table, by the mapping that its schema's fingerprint selects."""
    paths = field_paths(records.schema)
    layout = recognised(paths)
    if layout is None:
        raise ValueError(f"no mapping for the paths {paths}")
    if layout == "rows":
        return records.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return records.select(F.col(id_col).alias("conv_id"), F.inline(_turns(layout, lambda x: F.col(x))))


_JSON = "struct<messages:array<struct<role:string,content:string>>,conversations:array<struct<`from`:string,value:string>>,instruction:string,input:string,output:string,prompt:string,completion:string,response:string,system:string>"


def canonical_json_turns(records: DataFrame, *, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """(conv_id, turn, role, text, layout) of JSON records of mixed layouts; each row's own fingerprint picks its mapping."""
    seen = records.select(F.col(id_col).alias("conv_id"), F.from_json(F.col(json_col), _JSON).alias("r"))

    def has(path: str) -> Column:
        top, _, leaf = path.partition("[].")
        column = F.col(f"r.{top}")
        return F.exists(column, lambda x: x[leaf].isNotNull()) if leaf else column.isNotNull()

    readable = [p for p in KNOWN if p not in LAYOUTS["rows"]]
    paths = F.filter(F.array(*[F.when(has(p), F.lit(p)) for p in readable]), lambda p: p.isNotNull())
    named = {h: name for h, name in MAPPINGS.items() if name != "rows"}
    own, largest = F.sha2(F.array_join("paths", "\n"), 256), F.lit(None).cast("string")
    for name in RANKED:
        held = F.size(F.array_except(F.array(*map(F.lit, LAYOUTS[name])), "paths")) == 0
        largest = F.when(held, F.lit(fingerprint(LAYOUTS[name]))).otherwise(largest)
    marked = seen.withColumn("paths", paths).withColumn("fingerprint", F.when(own.isin(list(named)), own).otherwise(largest))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    for h, name in named.items():
        layout = F.when(F.col("fingerprint") == h, F.lit(name)).otherwise(layout)
        turns = F.when(F.col("fingerprint") == h, _turns(name, lambda x: F.col(f"r.{x}"))).otherwise(turns)
    return marked.select("conv_id", layout.alias("layout"), turns.alias("turns")).select("conv_id", "layout", F.inline("turns")).select("conv_id", "turn", "role", "text", "layout")


#: The template's marks, and how characters that take part in marks are written inside roles and texts.
BEGIN, END = "<s>", "</s>"
ESCAPES = {"\\": "\\b", "<": "\\l", "[": "\\i", "]": "\\j"}


def escape(c: Column) -> Column:
    for plain, code in ESCAPES.items():
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES.items()):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_chat(turns: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """Per conversation: formatted text and its loss mask, runs of (chars, loss) that cover the text in order."""
    role, text = escape(F.coalesce(F.col("role"), F.lit(""))), escape(F.coalesce(F.col("text"), F.lit("")))
    ready = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("plain"), F.concat(F.lit("["), role, F.lit("] ")).alias("head"), text.alias("text")).alias("t"))
    listed = ready.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    said = F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")
    run = lambda n, loss: F.struct(n.cast("int").alias("chars"), loss.alias("loss"))
    mask = F.flatten(F.transform("ts", lambda t: F.array(run(F.length(t["head"]), F.lit(False)), run(F.length(t["text"]), t["role"] == loss_role), run(F.lit(len(END)), F.lit(False)))))
    return listed.select("conv_id", F.concat(F.lit(BEGIN), said).alias("formatted"), F.concat(F.array(run(F.lit(len(BEGIN)), F.lit(False))), mask).alias("loss_mask"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """Canonical turns read back from formatted text: (conv_id, formatted, turns of role, text and loss)."""
    parts = F.slice(F.split(F.substr("formatted", F.lit(len(BEGIN) + 1)), END), F.lit(1), F.expr("cast((size(loss_mask) - 1) div 3 as int)"))
    turn = F.transform(
        "parts",
        lambda p, i: F.struct(
            unescape(F.substr(p, F.lit(2), F.instr(p, F.lit("] ")) - 2)).alias("role"),
            unescape(F.substr(p, F.instr(p, F.lit("] ")) + 2)).alias("text"),
            F.element_at("loss_mask", 3 * i + 3)["loss"].alias("loss"),
        ),
    )
    return formatted.select("conv_id", "formatted", "loss_mask", parts.alias("parts")).select("conv_id", "formatted", turn.alias("turns"))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, what reading its formatted text back gives."""
    read = read_chat(formatted)
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
