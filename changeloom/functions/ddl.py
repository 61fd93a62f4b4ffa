"""Statements in the log: what kind they are, which table, and what they do to its columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The statement grammar that the schema history follows.
NAME = r"[`\"]?(\w+)[`\"]?"
TYPE = r"(\w+(?:\s*\(\s*\d+(?:\s*,\s*\d+)*\s*\))?(?:\s+UNSIGNED)?(?:\s+ZEROFILL)?)"
ADD = rf"ADD\s+(?:COLUMN\s+)?{NAME}\s+{TYPE}"
DROP = rf"DROP\s+(?:COLUMN\s+)?{NAME}"
MODIFY = rf"MODIFY\s+(?:COLUMN\s+)?{NAME}\s+{TYPE}"
CHANGE = rf"CHANGE\s+(?:COLUMN\s+)?{NAME}\s+{NAME}\s+{TYPE}"
RENAME = r"RENAME\s+TABLE\s+(?:IF\s+EXISTS\s+)?[`\"]?([\w.]+)[`\"]?\s+TO\s+[`\"]?([\w.]+)[`\"]?"
AFTER = rf"AFTER\s+{NAME}"
FIRST = r"\bFIRST\b"
TABLE_OF = (
    r"ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?([`\"\w.]+)",
    r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([`\"\w.]+)",
    r"DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?([`\"\w.]+)",
    r"RENAME\s+TABLE\s+(?:IF\s+EXISTS\s+)?([`\"\w.]+)",
    r"TRUNCATE\s+(?:TABLE\s+)?([`\"\w.]+)",
)
FIRST_WITHIN = 50  # characters after an ADD in which FIRST counts


def statement_kind(query: Column, in_transaction: Column) -> Column:
    """tx_begin, tx_commit (null outside of a transaction: nothing happens) or schema (all else, ROLLBACK too)."""
    q = F.upper(F.trim(query))
    return F.when(q.startswith("BEGIN"), "tx_begin").when(q.startswith("COMMIT"), F.when(in_transaction, "tx_commit")).otherwise("schema")


def table_of(ddl: Column) -> Column:
    """The table that a statement names, without database and quotes; null if none is found."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(ddl, f"(?i){p}", 1), F.lit("")) for p in TABLE_OF])
    return F.replace(F.replace(F.substring_index(found, ".", -1), F.lit("`")), F.lit('"'))


#: What a statement does to its table as a whole.
DROPS, RENAMES, KEEPS, CREATES, ALTERS, COUNTS = "drop", "rename", "keep", "create", "alter", "count"

COLUMNS = "array<struct<name:string,data_type:string,is_primary_key:boolean,is_nullable:boolean>>"
CLAUSES = "array<struct<rule:string,name:string,other:string,data_type:string,first:boolean,after:string>>"
#: A table's columns at some time; without ``known`` there are none to speak of: it was dropped, or never seen.
STATE = f"struct<known:boolean,columns:{COLUMNS},primary_key:array<string>,version:int>"


def action(ddl: Column) -> Column:
    """The statement's action, told by words anywhere in its text, the first that is found."""
    has = lambda words: F.upper(ddl).contains(words)
    return F.when(has("DROP TABLE"), DROPS).when(has("RENAME TABLE"), F.when(ddl.rlike(f"(?i){RENAME}"), RENAMES).otherwise(KEEPS)).when(has("ALTER TABLE"), F.when(has("CREATE TABLE"), "create or alter").otherwise(ALTERS)).when(has("CREATE TABLE"), CREATES).otherwise(COUNTS)


def _all(ddl: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(ddl, F.lit(f"(?is){pattern}"), F.lit(group))


def clauses(ddl: Column) -> Column:
    """The clauses of an ALTER in the order of the rules: drops, type changes, renames, additions, whatever their order in the text."""
    rest = "(?=(.*))"  # what follows a clause, without taking it

    def made(rule: str, pattern: str, **fields: int | Column) -> Column:
        parts = {k: _all(ddl, pattern, g) for k, g in fields.items()}
        names = list(parts)
        whole = F.arrays_zip(*[v.alias(k) for k, v in parts.items()])
        value = lambda x, k, kind="string": (x[k] if k in names else F.lit(None).cast(kind)).alias(k)
        near = lambda x: F.concat(x["text"], F.substring(x["rest"], 1, FIRST_WITHIN))
        added = lambda x: [near(x).rlike(f"(?i){FIRST}").alias("first"), F.nullif(F.regexp_extract(x["rest"], f"(?i){AFTER}", 1), F.lit("")).alias("after")]
        return F.transform(whole, lambda x: F.struct(F.lit(rule).alias("rule"), value(x, "name"), value(x, "other"), value(x, "data_type"), *(added(x) if "rest" in names else [F.lit(False).alias("first"), F.lit(None).cast("string").alias("after")])))

    return F.concat(
        made("drop", DROP, name=1),
        made("modify", MODIFY, name=1, data_type=2),
        made("change", CHANGE, name=1, other=2, data_type=3),
        made("add", ADD + rest, text=0, name=1, data_type=2, rest=3),
    ).cast(CLAUSES)


def _state(known: Column, columns: Column, key: Column, version: Column) -> Column:
    return F.struct(known.alias("known"), columns.alias("columns"), key.alias("primary_key"), version.cast("int").alias("version"))


def _column(name: Column, data_type: Column, in_key: Column, nullable: Column) -> Column:
    return F.struct(name.alias("name"), data_type.alias("data_type"), in_key.alias("is_primary_key"), nullable.alias("is_nullable"))


def unknown() -> Column:
    return _state(F.lit(False), F.array().cast(COLUMNS), F.array().cast("array<string>"), F.lit(0)).cast(STATE)


def _dropped(now: Column, c: Column) -> tuple[Column, Column]:
    return F.filter(now["columns"], lambda x: x["name"] != c["name"]), F.array_remove(now["primary_key"], c["name"])


def _modified(now: Column, c: Column) -> tuple[Column, Column]:
    return F.transform(now["columns"], lambda x: F.when(x["name"] == c["name"], _column(x["name"], c["data_type"], x["is_primary_key"], x["is_nullable"])).otherwise(x)), now["primary_key"]


def _changed(now: Column, c: Column) -> tuple[Column, Column]:
    columns = F.transform(now["columns"], lambda x: F.when(x["name"] == c["name"], _column(c["other"], c["data_type"], x["is_primary_key"], x["is_nullable"])).otherwise(x))
    return columns, F.transform(now["primary_key"], lambda k: F.when(k == c["name"], c["other"]).otherwise(k))


def _added(now: Column, c: Column) -> tuple[Column, Column]:
    names = F.transform(now["columns"], lambda x: x["name"])
    size = F.size(names)
    place = F.coalesce(F.nullif(F.array_position(names, c["after"]).cast("int"), F.lit(0)), size)  # after a column that isn't there: at the end
    at = F.when(c["first"], 0).otherwise(place)  # FIRST counts also where it is the added column's own name
    grown = F.concat(F.slice(now["columns"], F.lit(1), at), F.array(_column(c["name"], c["data_type"], F.lit(False), F.lit(True))), F.slice(now["columns"], at + 1, size))
    return F.when(F.array_contains(names, c["name"]), now["columns"]).otherwise(grown), now["primary_key"]


#: How each clause changes columns and key.
RULES: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {"drop": _dropped, "modify": _modified, "change": _changed, "add": _added}


def _altered(now: Column, script: Column) -> Column:
    def one(state: Column, c: Column) -> Column:
        columns, key = state["columns"], state["primary_key"]
        for rule, apply in RULES.items():
            new, renamed = apply(state, c)
            columns, key = F.when(c["rule"] == rule, new).otherwise(columns), F.when(c["rule"] == rule, renamed).otherwise(key)
        return F.struct(columns.cast(COLUMNS).alias("columns"), key.alias("primary_key"))

    start = F.struct(now["columns"].alias("columns"), now["primary_key"].alias("primary_key"))
    return F.aggregate(script, start, one)


def after(now: Column, does: Column, script: Column) -> Column:
    """The state after a statement, from the one before."""
    later = now["version"] + 1
    counted = _state(F.lit(True), now["columns"], now["primary_key"], later)
    new = F.aggregate(F.array(_altered(now, script)), counted, lambda _, x: _state(F.lit(True), x["columns"], x["primary_key"], later))
    known = F.when(does == KEEPS, now).when(does.isin(ALTERS, "create or alter"), new).otherwise(counted)
    placeholder = _state(F.lit(True), F.array().cast(COLUMNS), F.array().cast("array<string>"), F.lit(1))
    return F.when(does == DROPS, unknown()).when(now["known"], known).when(does.isin(CREATES, "create or alter"), placeholder).otherwise(unknown()).cast(STATE)
