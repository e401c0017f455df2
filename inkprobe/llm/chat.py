"""Chat formatting with schema fingerprints. DataFrame operations only.

Records of any known layout become canonical turns: an array of (role, text). A layout is recognised by the hash of its
nested field paths: ``messages[].role`` and so on, sorted, array elements marked, scalar types left out. Of a record those
paths count that some mapping knows, so further fields don't hide its layout; an empty list has the fields of its layouts.
A fingerprint selects a mapping, which is data: the paths of a turn list with the names of its role and text fields, the
paths of single fields with the role that each speaks in, or the fields of a row that is one turn. Every record takes this way,
JSON and rows of tables alike.

Formatting. A turn is written ``### role: text</turn>`` and a line end, where in role and text a backslash, ``<`` and ``#``
are written ``\\b``, ``\\l`` and ``\\h``, and in a role ``:`` is ``\\c``. So no text can hold a mark, and reading a formatted
conversation gives back exactly what went in. The loss mask lists the spans (code points) of assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

END = "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"
#: Layouts: name, and how its turns are found. ``list``: path, role field, text field. ``fields``: (path, role) in order.
LAYOUTS = (
    {"name": "messages", "list": ("messages", "role", "content")},
    {"name": "turns", "list": ("turns", "role", "text")},
    {"name": "from_value", "list": ("conversations", "from", "value")},
    {"name": "prompt_response", "fields": (("prompt", "user"), ("response", "assistant"))},
    {"name": "prompt_completion", "fields": (("prompt", "user"), ("completion", "assistant"))},
    {"name": "question_answer", "fields": (("question", "user"), ("answer", "assistant"))},
    {"name": "instruction_output", "fields": (("instruction", "user"), ("output", "assistant"))},
    {"name": "instruction_input_output", "fields": (("instruction", "user"), ("input", "user"), ("output", "assistant"))},
    {"name": "data_prompt", "fields": (("data.prompt", "user"), ("data.response", "assistant"))},
)
#: The layout of a table of one row per turn.
TURN_ROWS = {"name": "turn_rows", "row": ("turn", "role", "text")}
#: Names that layouts give to the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_paths(layout: dict) -> list[str]:
    """The nested field paths of a layout, sorted."""
    if "list" in layout:
        at, role, text = layout["list"]
        return sorted([f"{at}[].{role}", f"{at}[].{text}"])
    if "row" in layout:
        return sorted(layout["row"])
    return sorted(p for p, _ in layout["fields"])


def fingerprint_of(paths: Column) -> Column:
    return F.xxhash64(paths)


def layout_fingerprint(layout: dict) -> Column:
    return fingerprint_of(F.lit("\n".join(layout_paths(layout))))


def _has(record: Column, path: str) -> Column:
    """Whether a parsed record has a field, null or not."""
    at, _, field = path.partition("[].")
    if not field:
        return F.try_variant_get(record, f"$.{at}", "variant").isNotNull()
    rows = F.try_variant_get(record, f"$.{at}", "array<variant>")
    return rows.isNotNull() & ((F.size(rows) == 0) | F.exists(rows, lambda r: F.try_variant_get(r, f"$.{field}", "variant").isNotNull()))


def record_fingerprint(record: Column, layouts=LAYOUTS) -> Column:
    """The fingerprint of a parsed record (variant), from those of its paths that the layouts know."""
    known = sorted({p for layout in layouts for p in layout_paths(layout)})
    return F.when(record.isNotNull(), fingerprint_of(F.concat_ws("\n", *[F.when(_has(record, p), p) for p in known])))


def _canonical_role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), role), role)


def record_turns(record: Column, layout: dict) -> Column:
    """The canonical turns of a parsed record of one layout. Null and missing texts are empty; empty ``input`` fields are
    no turn of their own, and neighbours of one role are separate turns."""
    if "list" in layout:
        at, role, text = layout["list"]
        rows = F.try_variant_get(record, f"$.{at}", f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(rows, lambda r: F.struct(_canonical_role(r[role]).alias("role"), F.coalesce(r[text], F.lit("")).alias("text")))
    each = []
    for path, role in layout["fields"]:
        text = F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit(""))
        each.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    turns = F.array(*each)
    return F.filter(turns, lambda t: t["text"] != "") if any(p == "input" for p, _ in layout["fields"]) else turns


def record_turns_by_layout(rows: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """``rows`` (__record, a variant) with ``layout`` (its name; null where none fits) and ``turns``."""
    rows = rows.withColumn("__print", record_fingerprint(F.col("__record"), layouts))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        ours = F.col("__print") == layout_fingerprint(layout)
        name = F.when(ours, F.lit(layout["name"])).otherwise(name)
        turns = F.when(ours, record_turns(F.col("__record"), layout).cast(TURNS)).otherwise(turns)
    return rows.withColumn("layout", name).withColumn("turns", turns).drop("__record", "__print")


def json_turns(df: DataFrame, json_col: str, layouts=LAYOUTS) -> DataFrame:
    """``df`` with ``layout`` (its name; null where no layout fits or the text is no record) and ``turns``. Null and missing
    texts of a record are empty; rows that repeat stay as they are; an empty table gives an empty one."""
    return record_turns_by_layout(df.withColumn("__record", F.try_parse_json(json_col)), layouts)


def table_turns(df: DataFrame, id_col: str, layouts=LAYOUTS) -> DataFrame:
    """(id, turns) of a table whose columns make a known layout besides its id; unknown columns are ignored.

    Rows that each are one turn are gathered by id, in order of turn, null turns first, ties in order of role and text; their
    roles are canonical as they stand. A conversation is one record, so its turns meet in one row. Of other layouts each row
    is a conversation."""
    others = [c for c in df.columns if c != id_col]
    if set(TURN_ROWS["row"]) <= set(others):
        record = F.to_variant_object(F.struct(*TURN_ROWS["row"]))
        rows = df.select(F.col(id_col).alias("id"), record.alias("__record")).withColumn("__print", record_fingerprint(F.col("__record"), (*layouts, TURN_ROWS)))
        turn, role, text = (F.try_variant_get("__record", f"$.{c}", kind) for c, kind in zip(TURN_ROWS["row"], ("long", "string", "string")))
        row = F.struct(turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        ours = F.col("__print") == layout_fingerprint(TURN_ROWS)
        gathered = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.when(ours, row))).alias("rows"))
        return gathered.select("id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))
    known = {p.split(".")[0].removesuffix("[]") for layout in layouts for p in layout_paths(layout)}
    fields = [c for c in others if c in known]
    if not fields:
        raise ValueError(f"no layout has any of the columns {others}")
    rows = df.select(F.col(id_col).alias("id"), F.to_variant_object(F.struct(*fields)).alias("__record"))
    return record_turns_by_layout(rows, layouts).select("id", "turns")


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), *([(":", "\\c")] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, role: bool = False) -> Column:
    for plain, code in (*([(":", "\\c")] if role else []), ("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(df: DataFrame) -> DataFrame:
    """(id, turns) to (id, formatted, loss): loss is an array of (start, end) in code points of ``formatted``."""
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit("### "), escaped(t["role"], role=True), F.lit(": ")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        spans = F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + len(END)).cast("long").alias("at"), spans.cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    made = df.select("id", pieces.alias("p"))
    text = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return made.select("id", text.alias("formatted"), F.aggregate("p", start, step)["spans"].alias("loss"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted conversation."""
    parts = F.filter(F.split(text, END), lambda s: s != "")

    def turn(s):
        head = F.substring_index(s, ": ", 1)
        return F.struct(unescaped(F.right(head, F.length(head) - 4), role=True).alias("role"), unescaped(F.right(s, F.length(s) - F.length(head) - 2)).alias("text"))

    return F.transform(parts, turn)


def masked_texts(text: Column, loss: Column) -> Column:
    """The unescaped texts under a loss mask, in order."""
    return F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table_turns(table(spark, sf_dir, "conversations"), "conv_id")
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("id"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    both = rows.unionByName(json_turns(extra, "record").select("id", "turns"))
    out = formatted(both)
    back = out.select("id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_texts(F.col("formatted"), F.col("loss")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return back.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(role) + length(text)
         + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) + length(text) - length(replace(text, '#', ''))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
