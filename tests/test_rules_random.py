"""Randomised differential test: the Column compiler vs a direct per-row evaluation of the rule
semantics (typed equality, null handling, negations, numeric coercion, stop/last ordering,
stop-without-output locking, format strings)."""

import random
import re

from netflow_spark.rules import tag

SCHEMA = "frame_number long, s string, n long, b boolean, t string"
OPS = ["equals", "not_equals", "in", "not_in", "regex", "not_regex", "gt", "lt", "gte", "lte",
       "exists", "not_exists", "starts_with", "ends_with", "bogus"]


def text(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "True" if v else "False"
    return str(v)


def kind(field):
    return {"s": "str", "t": "str", "n": "num", "b": "bool"}[field]


def eq(cell, value, k):
    """True/False, or None when the comparison cannot hold (type mismatch or missing)."""
    if value is None or isinstance(value, list):
        return None
    if isinstance(value, bool):
        if k == "bool":
            return cell == value
        return cell == int(value) if k == "num" else None
    if isinstance(value, (int, float)):
        if k == "num":
            return cell == value
        return int(cell) == value if k == "bool" else None
    return cell == value if k == "str" else None


def cond_ok(row, c):
    f, op, v = c.get("field"), c.get("operator"), c.get("value")
    if not f or not op or f not in row or op not in OPS[:-1]:
        return False
    cell, k = row[f], kind(f)
    if op in ("equals", "not_equals"):
        r = None if cell is None else eq(cell, v, k)
        if op == "equals":
            return bool(r)
        return True if r is None else not r
    if op in ("in", "not_in"):
        hits = [eq(cell, x, k) for x in v] if cell is not None else []
        r = any(h for h in hits if h is not None)
        return r if op == "in" else not r
    if op in ("regex", "not_regex"):
        r = cell is not None and re.search(v, text(cell)) is not None
        return r if op == "regex" else not r
    if op in ("gt", "lt", "gte", "lte"):
        if cell is None or not isinstance(v, (int, float)):
            return False
        try:
            x = float(int(cell)) if isinstance(cell, bool) else float(cell)
        except ValueError:
            return False
        return {"gt": x > v, "lt": x < v, "gte": x >= v, "lte": x <= v}[op]
    if op == "exists":
        return cell is not None
    if op == "not_exists":
        return cell is None
    if op in ("starts_with", "ends_with"):
        if cell is None:
            return False
        return text(cell).startswith(str(v)) if op == "starts_with" else text(cell).endswith(str(v))
    return False


def rule_ok(row, r):
    a, o = r.get("conditions"), r.get("conditions_any")
    if a is None and o is None:
        return True
    ra = all(cond_ok(row, c) for c in a) if a is not None else True
    ro = any(cond_ok(row, c) for c in o) if o is not None else False
    if a is not None and o is not None:
        return ra and ro
    return ra if a is not None else ro


def output(row, r):
    if r.get("output_value") is not None:
        return r["output_value"]
    fmt = r.get("output_value_format")
    if fmt is None:
        return None
    names = set(re.findall(r"\{(.*?)\}", fmt))
    if not names or not all(n in row for n in names):
        return fmt
    return fmt.format_map({k: (text(v) if v is not None else "") for k, v in row.items()})


def evaluate(row, rules, default):
    value, locked = default, False
    for r in rules:
        if locked or not rule_ok(row, r):
            continue
        out = output(row, r)
        if out is not None:
            value = out
        if r.get("stop_processing") is True:
            locked = True
    return value


def random_value(rnd, field):
    k = kind(field)
    if k == "str":
        return rnd.choice(["alpha", "beta", "Alpha2", "42", "3.5", "", "gamma-1"])
    if k == "num":
        return rnd.choice([0, 1, 7, 42, 100, -3])
    return rnd.choice([True, False])


def random_cond(rnd):
    f = rnd.choice(["s", "n", "b", "t", "missing"])
    op = rnd.choice(OPS)
    fk = f if f != "missing" else "s"
    if op in ("in", "not_in"):
        v = [random_value(rnd, rnd.choice(["s", "n", "b"])) for _ in range(rnd.randint(1, 3))]
    elif op in ("regex", "not_regex"):
        v = rnd.choice(["^a", "(?i)ALPHA", "[0-9]", "a$", "e"])
    elif op in ("gt", "lt", "gte", "lte"):
        v = rnd.choice([0, 5, 42.5, 100, "7"])
    elif op in ("starts_with", "ends_with"):
        v = rnd.choice(["a", "Tr", "4", "e", "1"])
    else:
        v = random_value(rnd, rnd.choice([fk, "s", "n", "b"]))
    return {"field": f, "operator": op, "value": v}


def random_rule(rnd, i):
    r = {"name": f"r{i}", "stop_processing": rnd.random() < 0.3}
    shape = rnd.random()
    if shape < 0.5:
        r["conditions"] = [random_cond(rnd) for _ in range(rnd.randint(0, 2))]
    elif shape < 0.8:
        r["conditions_any"] = [random_cond(rnd) for _ in range(rnd.randint(0, 2))]
    elif shape < 0.95:
        r["conditions"] = [random_cond(rnd)]
        r["conditions_any"] = [random_cond(rnd), random_cond(rnd)]
    o = rnd.random()
    if o < 0.6:
        r["output_value"] = f"OUT{i}"
    elif o < 0.9:
        r["output_value_format"] = rnd.choice(["v={s}/{n}", "{b}-{t}", "x{nope}", "plain{s}"])
    return r


def test_random_rule_packs_match_direct_evaluation(spark):
    rnd = random.Random(2024)
    rows = []
    for i in range(1, 121):
        rows.append({"frame_number": i, "s": rnd.choice([None, "alpha", "beta", "Alpha2", "42", "3.5", ""]),
                     "n": rnd.choice([None, 0, 1, 7, 42, 100, -3]), "b": rnd.choice([None, True, False]),
                     "t": rnd.choice([None, "True", "7", "gamma-1", "e"])})
    df = spark.createDataFrame([(r["frame_number"], r["s"], r["n"], r["b"], r["t"]) for r in rows], SCHEMA).cache()
    for k in range(25):
        rules = [random_rule(rnd, i) for i in range(rnd.randint(1, 6))]
        pack = {"target_column_map": {"g": "result"}, "default_values": {"result": "D"}, "g": rules}
        got = {r.frame_number: r.result for r in tag(df, pack).select("frame_number", "result").collect()}
        for row in rows:
            data = {c: row[c] for c in ("s", "n", "b", "t")}
            exp = evaluate(data, rules, "D")
            assert got[row["frame_number"]] == exp, (k, row, rules)


def evaluate_outcome(row, rules, default):
    for r in rules:
        conds = r.get("conditions")
        if isinstance(conds, str) and conds:
            return "engine_error"
        if rule_ok(row, r):
            return r.get("value", "")
    return default


def test_random_outcome_rules_match_direct_evaluation(spark):
    rnd = random.Random(77)
    rows = [{"frame_number": i, "s": rnd.choice([None, "alpha", "beta", "42"]), "n": rnd.choice([None, 0, 7, 42]),
             "b": rnd.choice([None, True, False]), "t": rnd.choice([None, "True", "e"])} for i in range(1, 81)]
    df = spark.createDataFrame([(r["frame_number"], r["s"], r["n"], r["b"], r["t"]) for r in rows], SCHEMA).cache()
    for k in range(15):
        outcome = []
        for i in range(rnd.randint(1, 4)):
            if rnd.random() < 0.15:
                outcome.append({"name": f"bad{i}", "value": "BAD", "conditions": "oops"})
            else:
                r = random_rule(rnd, i)
                outcome.append({"name": r["name"], "value": f"V{i}",
                                **{kk: v for kk, v in r.items() if kk in ("conditions", "conditions_any")}})
        pack = {"target_column_map": {"g": "dummy"}, "default_values": {"dummy": "", "flow_outcome": "Analyzed"},
                "g": [], "flow_outcome_rules": outcome}
        got = {r.frame_number: r.flow_outcome for r in tag(df, pack).select("frame_number", "flow_outcome").collect()}
        for row in rows:
            exp = evaluate_outcome({c: row[c] for c in ("s", "n", "b", "t")}, outcome, "Analyzed")
            assert got[row["frame_number"]] == exp, (k, row, outcome)
