"""Rule language → Spark ``Column`` expressions.

A rule pack (YAML or dict) names target columns, their defaults, ordered rule sets per target,
and ``flow_outcome_rules``. Every rule compiles to a boolean predicate against ``df.schema``;
each target becomes one ``CASE`` expression (no row loop, no shuffle): the whole tagging is a
projection, so it streams and scales with the input like any other ``select``.

Semantics kept from the reference (see SURVEY §8):
* ``equals`` / ``in`` compare per type: numbers (and booleans) numerically, text with text; a
  string never equals a number. Null never matches; the negations (``not_equals``,
  ``not_in``, ``not_regex``, ``not_cidr``) do match null.
* unknown column / unknown operator / missing field or operator → that condition is false.
* ``conditions`` = AND (empty → true), ``conditions_any`` = OR (empty → false), both → AND of
  the two, neither → match all.
* within a target, the first matching ``stop_processing`` rule wins, else the last matching
  rule; a stop rule without output locks the value reached so far.
* outcome rules: first match wins, default ``Analyzed``; a malformed rule that is reached
  yields ``engine_error``.
"""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.net import in_cidr

log = logging.getLogger(__name__)

RESERVED_KEYS = {"target_column_map", "default_values"}
OUTCOME_KEY = "flow_outcome_rules"
OUTCOME_COLUMN = "flow_outcome"
OUTCOME_DEFAULT = "Analyzed"
OUTCOME_ERROR = "engine_error"

OPERATORS = {"equals", "not_equals", "in", "not_in", "regex", "not_regex", "cidr", "not_cidr",
             "gt", "lt", "gte", "lte", "exists", "not_exists", "starts_with", "ends_with"}

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class RuleFileError(ValueError):
    """Rule pack cannot be read or has the wrong structure."""


class MalformedRule(Exception):
    """A rule whose condition list cannot be evaluated."""


@dataclass
class RulePack:
    target_column_map: dict[str, str]
    default_values: dict[str, Any]
    rule_sets: dict[str, list[dict]]
    outcome_rules: list[dict] = field(default_factory=list)


# ---------------------------------------------------------------------------------------------
# loading and validation (driver side, tiny)


def parse_pack(config: Any) -> RulePack:
    """The pack of a mapping: rule sets are lists of mappings, and ``target_column_map`` names their columns."""
    if not isinstance(config, Mapping):
        raise RuleFileError(f"a rule pack is a mapping, not {type(config).__name__}")
    sets = {k: v for k, v in config.items() if k not in RESERVED_KEYS}
    for name, rules in sets.items():
        wrong = [] if isinstance(rules, list) else [name]
        wrong += [f"{name}[{i}]" for i, r in enumerate(rules) if not isinstance(r, Mapping)] if isinstance(rules, list) else []
        if wrong:
            raise RuleFileError(f"rule sets are lists of mappings; {', '.join(wrong)} is not")
    targets = dict(config.get("target_column_map") or {})
    if not targets:
        raise RuleFileError("the pack names no target columns (target_column_map)")
    return RulePack(targets, dict(config.get("default_values") or {}), {name: sets.get(name, []) for name in targets},
                    list(sets.get(OUTCOME_KEY) or []))


def load_rules(source: str | os.PathLike | Mapping) -> RulePack:
    """Rule pack from a dict, a YAML file path, or YAML text."""
    if isinstance(source, Mapping):
        return parse_pack(source)
    text = os.fspath(source)
    is_path = "\n" not in text and (text.endswith((".yaml", ".yml")) or os.path.exists(text))
    try:
        if is_path:
            with open(text, encoding="utf-8") as fh:
                text = fh.read()
        return parse_pack(yaml.safe_load(text))
    except OSError as e:
        raise RuleFileError(f"rule pack can't be opened: {e}") from e
    except yaml.YAMLError as e:
        raise RuleFileError(f"rule pack is no YAML: {e}") from e


def default_rules_path() -> str:
    return os.path.join(os.path.dirname(__file__), "default.yaml")


def default_rules() -> RulePack:
    return load_rules(default_rules_path())


# ---------------------------------------------------------------------------------------------
# conditions


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, _NUMERIC):
        return "num"
    if isinstance(dt, T.StringType):
        return "str"
    return "other"


def _is_float(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def _present(c: Column, dt: T.DataType) -> Column:
    """Not missing — pandas counts NaN as missing, Spark does not."""
    return (c.isNotNull() & ~F.isnan(c)) if _is_float(dt) else c.isNotNull()


def _as_text(c: Column, dt: T.DataType) -> Column:
    """Column rendered the way Python's ``str()`` renders the value (null stays null)."""
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if _is_float(dt):
        return F.when(~F.isnan(c), c.cast("string"))
    if isinstance(dt, T.ArrayType):
        return F.array_join(c.cast("array<string>"), ",")
    return c.cast("string")


def _equals(c: Column, dt: T.DataType, value: Any) -> Column | None:
    """Typed equality; ``None`` when the comparison can never hold (type mismatch)."""
    k = _kind(dt)
    if value is None or isinstance(value, (list, dict)):
        return None
    if isinstance(value, bool):
        if k == "bool":
            return c == F.lit(value)
        if k == "num":
            return c == F.lit(int(value))
        return None
    if isinstance(value, (int, float)):
        if k == "num":
            return c == F.lit(value)
        if k == "bool":
            return c.cast("int") == F.lit(value)
        return None
    if isinstance(value, str):
        return c == F.lit(value) if k == "str" else None
    return None


def _isin(c: Column, dt: T.DataType, values: Any) -> Column | None:
    if not isinstance(values, (list, tuple, set)):
        raise TypeError("'in' needs a list")
    parts = [e for e in (_equals(c, dt, v) for v in values) if e is not None]
    if not parts:
        return None
    k = _kind(dt)
    lits = [v for v in values if v is not None and not isinstance(v, (list, dict))]
    if k == "str":
        return c.isin([v for v in lits if isinstance(v, str)])
    if k == "num":
        return c.isin([int(v) if isinstance(v, bool) else v for v in lits if isinstance(v, (int, float))])
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _numeric(c: Column, dt: T.DataType) -> Column:
    """Numeric view for gt/lt/gte/lte; NaN reads as missing (Spark orders NaN above every value,
    pandas compares it false)."""
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("double")
    n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def _regex(pattern: Any) -> str:
    # Java's regex engine understands the inline (?i) flag directly.
    return str(pattern)


def compile_condition(df: DataFrame, cond: Any, warn: set | None = None) -> Column:
    """One condition → boolean Column (never null)."""
    if not isinstance(cond, dict):
        raise MalformedRule(f"condition is not a mapping: {cond!r}")
    fld, op, value = cond.get("field"), cond.get("operator"), cond.get("value")
    false = F.lit(False)
    if not fld or not op:
        return false
    if fld not in df.columns:
        return false
    if op not in OPERATORS:
        if warn is not None and op not in warn:
            warn.add(op)
            log.warning("Unsupported operator %r: condition treated as false", op)
        return false
    c = F.col(fld)
    dt = df.schema[fld].dataType
    try:
        if op == "equals":
            e = _equals(c, dt, value)
            return false if e is None else F.coalesce(e, false)
        if op == "not_equals":
            e = _equals(c, dt, value)
            return F.lit(True) if e is None else F.coalesce(~e, F.lit(True))
        if op == "in":
            e = _isin(c, dt, value)
            return false if e is None else F.coalesce(e, false)
        if op == "not_in":
            e = _isin(c, dt, value)
            return F.lit(True) if e is None else ~F.coalesce(e, false)
        if op in ("regex", "not_regex"):
            m = F.coalesce(_as_text(c, dt).rlike(_regex(value)), false)
            return m if op == "regex" else ~m
        if op in ("cidr", "not_cidr"):
            m = F.coalesce(in_cidr(_as_text(c, dt), value), false)
            return m if op == "cidr" else ~m
        if op in ("gt", "lt", "gte", "lte"):
            if isinstance(value, bool):
                value = int(value)
            if not isinstance(value, (int, float)):
                return false
            n = _numeric(c, dt)
            cmp = {"gt": n > value, "lt": n < value, "gte": n >= value, "lte": n <= value}[op]
            return F.coalesce(cmp, false)
        if op == "exists":
            return _present(c, dt)
        if op == "not_exists":
            return ~_present(c, dt)
        if op == "starts_with":
            return F.coalesce(_as_text(c, dt).startswith(str(value)), false)
        if op == "ends_with":
            return F.coalesce(_as_text(c, dt).endswith(str(value)), false)
    except TypeError:
        return false
    return false


def _condition_list(df: DataFrame, conds: Any, logic: str, warn: set) -> Column:
    if not conds:
        return F.lit(logic == "AND")
    if not isinstance(conds, (list, tuple)):
        raise MalformedRule(f"conditions must be a list, got {type(conds).__name__}")
    parts = [compile_condition(df, c, warn) for c in conds]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if logic == "AND" else (out | p)
    return out


def compile_rule(df: DataFrame, rule: Mapping, warn: set | None = None) -> Column:
    """Rule → boolean Column. Raises ``MalformedRule`` for an unusable condition list."""
    warn = set() if warn is None else warn
    c_and, c_or = rule.get("conditions"), rule.get("conditions_any")
    if c_and is None and c_or is None:
        return F.lit(True)
    if c_and is not None and c_or is not None:
        return _condition_list(df, c_and, "AND", warn) & _condition_list(df, c_or, "OR", warn)
    if c_and is not None:
        return _condition_list(df, c_and, "AND", warn)
    return _condition_list(df, c_or, "OR", warn)


# ---------------------------------------------------------------------------------------------
# outputs

_PLACEHOLDER = re.compile(r"\{(.*?)\}")


def _literal(value: Any) -> Column:
    return F.lit(value)


def compile_output(df: DataFrame, rule: Mapping) -> Column | None:
    """Value written by a matching rule, or ``None`` when the rule writes nothing."""
    if rule.get("output_value") is not None:
        return _literal(rule["output_value"])
    fmt = rule.get("output_value_format")
    if fmt is None:
        return None
    fmt = str(fmt)
    names = set(_PLACEHOLDER.findall(fmt))
    if not names or not all(n in df.columns for n in names):
        return F.lit(fmt)
    pieces: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(fmt):
        if m.start() > pos:
            pieces.append(F.lit(fmt[pos:m.start()]))
        name = m.group(1)
        pieces.append(F.coalesce(_as_text(F.col(name), df.schema[name].dataType), F.lit("")))
        pos = m.end()
    if pos < len(fmt):
        pieces.append(F.lit(fmt[pos:]))
    return F.concat(*pieces)


def _target_type(default: Any, rules: list[dict]) -> T.DataType:
    vals = [default] + [r.get("output_value") for r in rules]
    has_fmt = any(r.get("output_value") is None and r.get("output_value_format") is not None for r in rules)
    vals = [v for v in vals if v is not None]
    if not has_fmt and vals and all(isinstance(v, bool) for v in vals):
        return T.BooleanType()
    if not has_fmt and vals and all(isinstance(v, int) and not isinstance(v, bool) for v in vals):
        return T.LongType()
    if not has_fmt and vals and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in vals):
        return T.DoubleType()
    return T.StringType()


def _typed(c: Column, value_hint: Any, dt: T.DataType) -> Column:
    if isinstance(dt, T.StringType) and isinstance(value_hint, bool):
        return F.lit(str(value_hint))
    return c.cast(dt)


def _references(rule: Mapping, name: str) -> bool:
    for key in ("conditions", "conditions_any"):
        conds = rule.get(key)
        if isinstance(conds, (list, tuple)):
            if any(isinstance(c, dict) and c.get("field") == name for c in conds):
                return True
    fmt = rule.get("output_value_format")
    return rule.get("output_value") is None and fmt is not None and name in _PLACEHOLDER.findall(str(fmt))


def _compile_target_closed(df: DataFrame, target: str, rules: list[dict], dt: T.DataType,
                           default: Column, warn: set) -> Column:
    """First matching stop rule wins, else last matching rule, else default."""
    compiled = []
    for r in rules:
        out = compile_output(df, r)
        compiled.append((compile_rule(df, r, warn),
                         None if out is None else _typed(out, r.get("output_value"), dt),
                         r.get("stop_processing") is True))

    def last_before(k: int) -> Column:
        expr = None
        for m, out, _ in reversed(compiled[:k + 1]):
            if out is None:
                continue
            expr = F.when(m, out) if expr is None else expr.when(m, out)
        return default if expr is None else expr.otherwise(default)

    expr = None
    for i, (m, out, stop) in enumerate(compiled):
        if not stop:
            continue
        val = out if out is not None else last_before(i)
        expr = F.when(m, val) if expr is None else expr.when(m, val)
    tail = last_before(len(compiled) - 1)
    return tail if expr is None else expr.otherwise(tail)


def tag(df: DataFrame, rules: RulePack | Mapping | str, outcome: bool = True) -> DataFrame:
    """Apply a rule pack: add each target column and ``flow_outcome``. One projection per
    target group (groups may read the targets of earlier groups)."""
    pack = rules if isinstance(rules, RulePack) else load_rules(rules)
    warn: set = set()
    init = {}
    types = {}
    for key, target in pack.target_column_map.items():
        dflt = pack.default_values.get(target)
        dt = _target_type(dflt, pack.rule_sets.get(key, []))
        types[target] = dt
        init[target] = F.lit(None).cast(dt) if dflt is None else _typed(F.lit(dflt), dflt, dt)
    df = df.withColumns(init)
    for key, target in pack.target_column_map.items():
        rules_ = pack.rule_sets.get(key, [])
        dt = types[target]
        try:
            if any(_references(r, target) for r in rules_):
                # The rule reads its own target: evaluate rule by rule against the value so far.
                for r in rules_:
                    m = compile_rule(df, r, warn)
                    out = compile_output(df, r)
                    if out is None and r.get("stop_processing") is not True:
                        continue
                    lock = f"__lock_{target}"
                    if lock not in df.columns:
                        df = df.withColumn(lock, F.lit(False))
                    eff = m & ~F.col(lock)
                    if out is not None:
                        df = df.withColumn(target, F.when(eff, _typed(out, r.get("output_value"), dt))
                                           .otherwise(F.col(target)))
                    if r.get("stop_processing") is True:
                        df = df.withColumn(lock, F.col(lock) | eff)
                if f"__lock_{target}" in df.columns:
                    df = df.drop(f"__lock_{target}")
            else:
                df = df.withColumn(target, _compile_target_closed(df, target, rules_, dt, F.col(target), warn))
        except MalformedRule as e:
            raise RuleFileError(f"rule set '{key}': {e}") from e
    dflt = pack.default_values.get(OUTCOME_COLUMN, OUTCOME_DEFAULT)
    expr = None
    for r in (pack.outcome_rules if outcome else []):
        try:
            m = compile_rule(df, r, warn)
            val = F.lit(r.get("value", "")).cast("string")
        except MalformedRule:
            m, val = F.lit(True), F.lit(OUTCOME_ERROR)
        expr = F.when(m, val) if expr is None else expr.when(m, val)
    base = F.lit(dflt).cast("string")
    return df.withColumn(OUTCOME_COLUMN, base if expr is None else expr.otherwise(base))


def rule_mask(df: DataFrame, rule: Mapping) -> Column:
    """Boolean Column for a single rule (for filters: ``df.where(rule_mask(df, rule))``)."""
    return compile_rule(df, rule, set())


__all__ = ["RuleFileError", "RulePack", "load_rules", "parse_pack", "default_rules",
           "default_rules_path", "compile_condition", "compile_rule", "compile_output", "tag",
           "rule_mask"]
