"""Row and set rules of a contract, as DataFrame operators.

Null semantics follow the declarations: a CHECK that is null passes, UNIQUE treats nulls as distinct, MATCH SIMPLE
passes a key with any null, a view's check option fails on null.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A named row rule; ``bad`` is true on rows that break it (null counts as kept)."""

    name: str
    bad: Column

    def broken(self) -> Column:
        return F.coalesce(self.bad, F.lit(False))


def not_null(*columns: str) -> list[Rule]:
    return [Rule(f"not_null:{c}", F.col(c).isNull()) for c in columns]


def check(name: str, expression: str | Column) -> Rule:
    held = F.expr(expression) if isinstance(expression, str) else expression
    return Rule(name, ~held)


def enum(column: str, labels: Sequence[str]) -> Rule:
    return Rule(f"enum:{column}", ~F.col(column).isin(list(labels)))


def enum_ordinal(column: Column, labels: Sequence[str]) -> Column:
    """1-based place of the label; null for null, 0 for a stranger. Sorts and compares as the enum does."""
    return F.array_position(F.array(*map(F.lit, labels)), column)


def domain(column: str, base: str, pattern: str | None = None, nullable: bool = True, checks: Iterable[str] = ()) -> list[Rule]:
    """Rules of a domain: the value casts to the base type, matches the pattern anywhere (null passes), and passes the
    checks, which are written over ``value``."""
    value = F.col(column)
    rules = [Rule(f"domain_type:{column}", value.isNotNull() & value.try_cast(base).isNull())]
    if not nullable:
        rules.append(Rule(f"domain_null:{column}", value.isNull()))
    if pattern is not None:
        rules.append(Rule(f"domain_pattern:{column}", ~value.rlike(pattern)))
    for i, text in enumerate(checks):
        held = F.expr(f"transform(array(try_cast({column} AS {base})), value -> ({text}))[0]")
        rules.append(Rule(f"domain_check{i}:{column}", ~held))
    return rules


def failed(rules: Sequence[Rule]) -> Column:
    """The names of the rules that a row breaks, in order."""
    return F.array_compact(F.array(*(F.when(r.broken(), F.lit(r.name)) for r in rules)))


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break a rule, one per broken rule, with ``rule``. One scan; also on streams."""
    return df.withColumn("rule", F.explode(failed(rules)))


def quarantined(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): ``bad`` carries the array ``failed``."""
    marked = df.withColumn("failed", failed(rules))
    return marked.filter(F.size("failed") == 0).drop("failed"), marked.filter(F.size("failed") > 0)


def rule_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, n) for every rule, from one aggregate over one scan."""
    counted = df.agg(*(F.count_if(r.broken()).alias(f"r{i}") for i, r in enumerate(rules)))
    pairs = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("n")) for i, r in enumerate(rules)))
    return counted.select(F.explode(pairs).alias("_r")).select("_r.*")


def check_unique(df: DataFrame, columns: Sequence[str | Column], where: str | Column | None = None) -> DataFrame:
    """Keys that occur more than once, with n; rows with a null in the key are never duplicates. Expressions and a
    predicate make it a partial or expression index."""
    rows = df if where is None else df.filter(where)
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    keyed = rows.select(*named)
    for c in keyed.columns:
        keyed = keyed.filter(F.col(c).isNotNull())
    return keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_primary_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows with a null in the key, duplicated keys, and surplus rows of those."""
    null = F.lit(False)
    for c in columns:
        null = null | F.col(c).isNull()
    grouped = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_null", null)
    return grouped.agg(
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).alias("null_rows"),
        F.count_if(~F.col("_null") & (F.col("_n") > 1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(~F.col("_null"), F.col("_n") - 1)), F.lit(0)).alias("surplus_rows"),
    )


def check_foreign_key(child: DataFrame, columns: Sequence[str], parent: DataFrame, keys: Sequence[str], match: str = "SIMPLE") -> DataFrame:
    """Child rows without a parent. SIMPLE passes a key with any null; FULL passes it only if all are null."""
    match = match.upper()
    if match not in ("SIMPLE", "FULL"):
        raise ValueError(f"MATCH {match} is not defined")
    some = all_ = None
    for c in columns:
        own = F.col(c).isNull()
        some = own if some is None else some | own
        all_ = own if all_ is None else all_ & own
    there = parent.select(*(F.col(k).alias(f"_p_{k}") for k in keys)).distinct()
    on = [child[c] == there[f"_p_{k}"] for c, k in zip(columns, keys, strict=True)]
    missing = child.filter(~some).join(there, on, "left_anti")
    return missing if match == "SIMPLE" else missing.unionByName(child.filter(some & ~all_))


def propagate_parent_change(
    child: DataFrame,
    column: str,
    deleted: DataFrame,
    updated: DataFrame | None,
    key: str,
    on_delete: str = "NO ACTION",
    on_update: str = "NO ACTION",
    default: Column | None = None,
    nullable: bool = True,
) -> DataFrame:
    """The child after its parents' keys were ``deleted`` (key) or ``updated`` (key, new_key), with ``outcome``: kept,
    deleted, updated or violation. Rows of outcome deleted stay in the report; filter them to apply it."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    joined = child.join(gone, child[column] == gone["_gone"], "left")
    if updated is not None:
        moved = updated.select(F.col(key).alias("_old"), F.col("new_key").alias("_new"))
        joined = joined.join(moved, joined[column] == moved["_old"], "left")
    else:
        joined = joined.withColumn("_old", F.lit(None)).withColumn("_new", F.lit(None))
    fallback = F.lit(None) if default is None else default

    def action(kind: str, cascade_value: Column, cascade_outcome: str) -> tuple[Column, Column]:
        kind = kind.upper()
        own = F.col(column)
        if kind in ("NO ACTION", "RESTRICT"):
            return own, F.lit("violation")
        if kind == "CASCADE":
            return cascade_value, F.lit(cascade_outcome)
        value = F.lit(None) if kind == "SET NULL" else fallback
        ok = F.lit("updated") if nullable else F.when(value.isNull(), "violation").otherwise("updated")
        return value, ok

    removed, replaced = F.col("_gone").isNotNull(), F.col("_old").isNotNull()
    dv, do = action(on_delete, F.col(column), "deleted")
    uv, uo = action(on_update, F.col("_new"), "updated")
    kind = child.schema[column].dataType
    value = F.when(removed, dv.cast(kind)).when(replaced, uv.cast(kind)).otherwise(F.col(column))
    outcome = F.when(removed, do).when(replaced, uo).otherwise("kept")
    return joined.select(
        *(value.alias(c) if c == column else F.col(c) for c in child.columns), outcome.alias("outcome")
    )


@dataclass(frozen=True)
class Reference:
    """A child table that references the table above it: ``column`` holds that table's key, ``key`` is its own."""

    name: str
    child: DataFrame
    column: str
    key: str
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    default: Column | None = None
    nullable: bool = True


def propagate_chain(deleted: DataFrame, updated: DataFrame | None, key: str, references: Sequence[Reference]) -> dict[str, DataFrame]:
    """The report of ``propagate_parent_change`` for each table of a chain. Rows that a table loses are deleted keys
    for the table below it, and where the referencing column is itself the key, moved rows are updated keys."""
    reports: dict[str, DataFrame] = {}
    for r in references:
        own = r.child.withColumn("_before", F.col(r.key))
        report = propagate_parent_change(own, r.column, deleted, updated, key, r.on_delete, r.on_update, r.default, r.nullable)
        deleted = report.filter("outcome = 'deleted'").select(F.col("_before").alias(r.key))
        updated = None
        if r.column == r.key:
            moved = report.filter(f"outcome = 'updated' AND {r.key} IS NOT NULL")
            updated = moved.select(F.col("_before").alias(r.key), F.col(r.key).alias("new_key"))
        key = r.key
        reports[r.name] = report.drop("_before")
    return reports


def contract_report(
    df: DataFrame,
    rules: Sequence[Rule] = (),
    unique: Mapping[str, Sequence[str]] | None = None,
    primary: Sequence[str] | None = None,
    foreign: Mapping[str, tuple[Sequence[str], DataFrame, Sequence[str], str]] | None = None,
) -> DataFrame:
    """(rule, n) for every rule of a table's contract: rows that break it. Row rules come from one scan; ``unique``,
    ``primary`` and ``foreign`` (columns, parent, keys, match) add their rows."""
    parts = [rule_counts(df, rules)] if rules else []

    def total(name: str, counted: DataFrame, n: Column) -> None:
        parts.append(counted.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).select(F.lit(name).alias("rule"), "n"))

    for name, columns in (unique or {}).items():
        total(name, check_unique(df, columns), F.col("n"))
    if primary is not None:
        null = F.lit(False)
        for c in primary:
            null = null | F.col(c).isNull()
        grouped = df.groupBy(*primary).agg(F.count(F.lit(1)).alias("_n"))
        total("primary_key", grouped.filter(null | (F.col("_n") > 1)), F.col("_n"))
    for name, (columns, parent, keys, match) in (foreign or {}).items():
        total(name, check_foreign_key(df, columns, parent, keys, match), F.lit(1))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cast_audit(df: DataFrame, column: str, kind: str, function: Column | None = None) -> DataFrame:
    """``df`` with ``cast_value`` and ``cast_failed``: the source has a value and the result is null."""
    value = F.col(column).try_cast(kind) if function is None else function
    return df.withColumn("cast_value", value).withColumn("cast_failed", F.col(column).isNotNull() & value.isNull())


#: What each target charset can hold.
CHARSETS = {"LATIN1": r"[^\x{00}-\x{FF}]", "ASCII": r"[^\x{00}-\x{7F}]"}


def encodable(column: Column, charset: str) -> Column:
    """Whether every character exists in the charset; null for null."""
    if charset == "UTF8":
        return column.isNotNull() | F.lit(None).cast("boolean")
    return ~column.rlike(CHARSETS[charset])


# Document contracts -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """Rules of one value of a JSON document: its kind, then those that hold for values of that kind. ``fields`` are
    the rules of an object, ``items`` those of every item of an array."""

    kind: str = "string"
    required: bool = False
    enum: tuple = ()
    pattern: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_items: int | None = None
    unique_items: bool = False
    fields: DocumentContract | None = None
    items: Field | None = None


@dataclass(frozen=True)
class DocumentContract:
    """``fields`` by key; ``closed`` allows no other keys; ``key_pattern`` holds for all keys; ``one_of`` lists groups
    of keys of which exactly one is present; ``not_together`` pairs that exclude each other; ``if_then`` pairs
    (key, needed key)."""

    fields: Mapping[str, Field]
    closed: bool = False
    key_pattern: str | None = None
    one_of: tuple[tuple[str, ...], ...] = ()
    not_together: tuple[tuple[str, str], ...] = ()
    if_then: tuple[tuple[str, str], ...] = field(default=())


# How Spark names the types of the values of each kind of JSON value.
JSON_KINDS = {
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)",
    "boolean": r"^BOOLEAN$",
    "string": r"^STRING$",
    "array": r"^ARRAY",
    "object": r"^OBJECT",
}


def document_violations(df: DataFrame, keys: Sequence[str], column: str, contract: DocumentContract) -> DataFrame:
    """(keys, path, rule) for every rule that a JSON document breaks. Each text is parsed once, to a variant; types are
    those of its values, so that a quoted number is a string. Paths go through nested objects by dots; a rule that an
    item of an array breaks is reported once, under ``path[]``. A text that is no JSON object breaks ``type`` at the
    root only."""
    parsed = df.select(*keys, F.try_parse_json(F.col(column)).alias("_v"))
    broken = F.when(_kind(F.col("_v")).rlike(JSON_KINDS["object"]), _object_rules(F.col("_v"), contract, ""))
    malformed = F.array(F.struct(F.lit("").alias("path"), F.lit("type").alias("rule")))
    found = parsed.select(*keys, F.explode(F.coalesce(broken, malformed)).alias("_f"))
    return found.select(*keys, "_f.*")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _held(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _object_rules(value: Column, contract: DocumentContract, at: str) -> Column:
    """The array of (path, rule) that an object breaks."""
    return _held(value.try_cast("map<string,variant>"), lambda own: _map_rules(own, contract, at))


def _map_rules(own: Column, contract: DocumentContract, at: str) -> Column:
    names = F.map_keys(own)
    has = lambda k: F.array_contains(names, k)
    inside = lambda k: f"{at}.{k}" if at else k
    found: list[Column] = []

    def rule(path: str, name: str, bad: Column) -> None:
        found.append(_broken(path, name, bad))

    deeper = []
    for key, rules in contract.fields.items():
        if rules.required:
            rule(inside(key), "required", ~has(key))
        deeper.append(F.when(has(key), _held(own[key], _rules_of(rules, inside(key)))))
    if contract.closed:
        rule(at, "closed", F.exists(names, lambda k: ~k.isin(list(contract.fields))))
    if contract.key_pattern is not None:
        rule(at, "key_pattern", F.exists(names, lambda k: ~k.rlike(contract.key_pattern)))
    for group in contract.one_of:
        present = sum((has(k).cast("int") for k in group), F.lit(0))
        rule("|".join(map(inside, group)), "one_of", present != 1)
    for a, b in contract.not_together:
        rule(f"{inside(a)}&{inside(b)}", "not", has(a) & has(b))
    for a, b in contract.if_then:
        rule(f"{inside(a)}->{inside(b)}", "if_then", has(a) & ~has(b))
    none = F.array().cast("array<struct<path:string,rule:string>>")
    return F.concat(F.array_compact(F.array(*found)) if found else none, *(F.coalesce(d, none) for d in deeper))


def _rules_of(own: Field, path: str):
    return lambda value: _value_rules(value, own, path)


def _broken(path: str, name: str, bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(name).alias("rule")))


def _value_rules(value: Column, own: Field, path: str) -> Column:
    """The array of (path, rule) that a value breaks. A value of another kind breaks ``type`` and nothing else."""
    kind = _kind(value)
    right = kind.rlike(JSON_KINDS[own.kind])
    number, text = value.try_cast("double"), value.try_cast("string")
    if own.kind == "integer":
        # Exact where 38 digits do; beyond them a double has no fraction.
        exact = value.try_cast("decimal(38,18)")
        right = right | (kind.rlike(JSON_KINDS["number"]) & F.coalesce(exact % 1 == 0, number % 1 == 0))
    found = []

    def rule(name: str, bad: Column) -> None:
        found.append(_broken(path, name, right & bad))

    if own.enum:
        is_text = [x for x in own.enum if isinstance(x, str)]
        rule("enum", ~(text.isin(is_text) if is_text else number.isin([float(x) for x in own.enum])))
    if own.pattern is not None:
        rule("pattern", ~text.rlike(own.pattern))
    if own.minimum is not None:
        rule("minimum", number < own.minimum)
    if own.maximum is not None:
        rule("maximum", number > own.maximum)
    if own.min_length is not None:
        rule("min_length", F.length(text) < own.min_length)
    if own.max_length is not None:
        rule("max_length", F.length(text) > own.max_length)
    if own.min_items is not None or own.unique_items:
        items = value.try_cast("array<variant>")
        if own.min_items is not None:
            rule("min_items", F.size(items) < own.min_items)
        if own.unique_items:
            shown = F.transform(items, lambda v: F.to_json(v))
            rule("unique_items", F.size(F.array_distinct(shown)) < F.size(shown))
    none = F.array().cast("array<struct<path:string,rule:string>>")
    out = [F.array_compact(F.array(*found)) if found else none, F.when(~right, F.array(_broken(path, "type", ~right)))]
    if own.fields is not None:
        out.append(F.when(right, _object_rules(value, own.fields, path)))
    if own.items is not None:
        each = F.flatten(F.transform(value.try_cast("array<variant>"), _rules_of(own.items, f"{path}[]")))
        out.append(F.when(right, F.array_distinct(each)))
    return F.concat(out[0], *(F.coalesce(x, none) for x in out[1:]))
