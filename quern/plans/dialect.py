"""From the engine's SQL to Spark's: a rewrite of tokens for what Spark has no word for or reads otherwise.

Null order in every ORDER BY, DISTINCT ON, op ANY / ALL (subquery), FETCH FIRST, OFFSET before LIMIT, GLOB, XOR, <=> for
vectors, JSON arrows, paths over references, set operations from left to right, parameters, quoted names, and functions
that mean something else here. Division and remainder by zero are null. Whether a division is one of integers depends on
the types of its operands: these are read off the plan that Spark has analysed, and the division becomes DIV there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quern.functions import scalar as S
from quern.sources.tables import TABLES

TOKEN = re.compile(r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<parameter>\$\d+|(?<!:):[A-Za-z_]\w*)|(?P<text>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<word>[A-Za-z_]\w*)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<op><=>|<>|!=|<=|>=|\|\||->>|->|<<|>>|::|.)""", re.DOTALL | re.VERBOSE)

#: Names that stand for another function in Spark.
NAMES = {
    "STDDEV": "stddev_pop", "VARIANCE": "var_pop", "STRPOS": "instr", "GROUP_CONCAT": "listagg", "STRING_AGG": "listagg", "STARTS_WITH": "startswith", "ENDS_WITH": "endswith",
    "RANDOM": "rand", "CHAR_LENGTH": "char_length", "VEC_DIMS": "size",
}
WHITE = "r'^" + S.WHITE + "'", "r'" + S.WHITE + "$'"
SQUARES = "aggregate ( zip_with ( {0} , {1} , ( x , y ) -> CAST ( x - y AS DOUBLE ) * CAST ( x - y AS DOUBLE ) ) , 0D , ( s , x ) -> s + x )"
PRODUCT = "aggregate ( zip_with ( %s , %s , ( x , y ) -> CAST ( x AS DOUBLE ) * CAST ( y AS DOUBLE ) ) , 0D , ( s , x ) -> s + x )"
DOT, NORM = PRODUCT % ("{0}", "{1}"), lambda v: "sqrt ( " + PRODUCT % (v, v) + " )"
VARIANT = "schema_of_variant ( try_parse_json ( {0} ) )"
#: Functions by name and number of arguments, in words of Spark; {0} and so on are the arguments.
CALLS = {
    ("SQRT", 1): "CASE WHEN {0} >= 0 THEN sqrt ( {0} ) END",
    ("LN", 1): "CASE WHEN {0} > 0 THEN ln ( {0} ) END",
    ("LOG", 1): "CASE WHEN {0} > 0 THEN log10 ( {0} ) END",
    ("LOG10", 1): "CASE WHEN {0} > 0 THEN log10 ( {0} ) END",
    ("LOG2", 1): "CASE WHEN {0} > 0 THEN log2 ( {0} ) END",
    ("LOG", 2): "CASE WHEN {0} > 0 AND {0} <> 1 AND {1} > 0 THEN ln ( {1} ) / ln ( {0} ) END",
    ("SIGN", 1): "CAST ( signum ( {0} ) AS BIGINT )",
    ("FLOOR", 1): "CAST ( floor ( {0} ) AS DOUBLE )",
    ("CEIL", 1): "CAST ( ceil ( {0} ) AS DOUBLE )",
    ("CEILING", 1): "CAST ( ceil ( {0} ) AS DOUBLE )",
    ("MOD", 2): "{0} % {1}",
    ("SUBSTRING", 2): "CASE WHEN {1} IS NOT NULL THEN substring ( {0} , CAST ( greatest ( {1} , 1 ) AS INT ) ) END",
    ("SUBSTRING", 3): "CASE WHEN {1} IS NOT NULL AND {2} IS NOT NULL THEN substring ( {0} , CAST ( greatest ( {1} , 1 ) AS INT ) , CAST ( greatest ( {2} , 0 ) AS INT ) ) END",
    ("LTRIM", 1): "regexp_replace ( {0} , " + WHITE[0] + " , '' )",
    ("RTRIM", 1): "regexp_replace ( {0} , " + WHITE[1] + " , '' )",
    ("TRIM", 1): "regexp_replace ( regexp_replace ( {0} , " + WHITE[0] + " , '' ) , " + WHITE[1] + " , '' )",
    ("CHAR", 1): "CASE WHEN {0} BETWEEN 1 AND 1114111 AND NOT {0} BETWEEN 55296 AND 57343 THEN decode ( unhex ( lpad ( hex ( CAST ( {0} AS BIGINT ) ) , 8 , '0' ) ) , 'UTF-32' ) END",
    ("FROM_HEX", 1): "unhex ( {0} )",
    ("IIF", 3): "CASE WHEN {0} IS NULL OR lower ( CAST ( {0} AS STRING ) ) IN ( '' , '0' , '0.0' , 'false' , 'no' ) THEN {2} ELSE {1} END",
    ("IFNULL", 2): "coalesce ( {0} , {1} )",
    ("TYPEOF", 1): "coalesce ( try_element_at ( map ( 'bigint' , 'INTEGER' , 'int' , 'INTEGER' , 'double' , 'FLOAT' , 'string' , 'TEXT' , 'boolean' , 'BOOLEAN' , 'date' , 'DATE' , 'time(6)' , 'TIME' , 'timestamp' , 'TIMESTAMPTZ' , 'timestamp_ntz' , 'TIMESTAMP' , 'binary' , 'BLOB' , 'variant' , 'JSON' , 'void' , 'NULL' ) , typeof ( {0} ) ) , upper ( typeof ( {0} ) ) )",
    ("DATEDIFF", 2): "timestampdiff ( DAY , {1} , {0} )",
    ("DATE_DIFF", 2): "timestampdiff ( DAY , {1} , {0} )",
    ("CIVIL_TO_TIMESTAMPTZ", 2): "to_utc_timestamp ( {0} , {1} )",
    ("TIMESTAMPTZ_TO_CIVIL", 2): "CAST ( from_utc_timestamp ( {0} , {1} ) AS TIMESTAMP_NTZ )",
    ("JSON_TYPE", 1): "CASE WHEN " + VARIANT + " LIKE 'OBJECT%' THEN 'object' WHEN " + VARIANT + " LIKE 'ARRAY%' THEN 'array' WHEN " + VARIANT + " = 'STRING' THEN 'string' WHEN " + VARIANT + " = 'BOOLEAN' THEN 'boolean' WHEN " + VARIANT + " = 'VOID' THEN 'null' WHEN " + VARIANT + " IS NOT NULL THEN 'number' END",
    ("JSON_KEYS", 1): "to_json ( array_sort ( json_object_keys ( {0} ) ) )",
    ("VEC_DISTANCE_L2", 2): "sqrt ( " + SQUARES + " )",
    ("VEC_DISTANCE_IP", 2): "- " + DOT,
    ("VEC_DISTANCE_COSINE", 2): "1 - " + DOT + " / ( " + NORM("{0}") + " * " + NORM("{1}") + " )",
    ("VEC_NORM", 1): NORM("{0}"),
}
CALLS[("SUBSTR", 2)], CALLS[("SUBSTR", 3)], CALLS[("JSON_TYPEOF", 1)], CALLS[("CHR", 1)] = CALLS[("SUBSTRING", 2)], CALLS[("SUBSTRING", 3)], CALLS[("JSON_TYPE", 1)], CALLS[("CHAR", 1)]
#: Parts of a date that Spark counts otherwise.
PARTS = {"DOW": "( dayofweek ( {0} ) - 1 )", "ISODOW": "( weekday ( {0} ) + 1 )"}
BOUNDS = {("<", "ANY"): "max", ("<=", "ANY"): "max", (">", "ANY"): "min", (">=", "ANY"): "min", ("<", "ALL"): "min", ("<=", "ALL"): "min", (">", "ALL"): "max", (">=", "ALL"): "max"}
ENDS_ORDER = {"LIMIT", "OFFSET", "FETCH", "ROWS", "RANGE", "UNION", "INTERSECT", "EXCEPT", "WINDOW", ";"}
ENDS_OPERAND = {"AND", "OR", "XOR", "NOT", "WHERE", "ON", "HAVING", "SELECT", "WHEN", "THEN", "ELSE", "END", "CASE", "GROUP", "ORDER", "LIMIT", "UNION", "AS", "BY", "FROM", "QUALIFY", ",", "(", ")", ";"}


def tokens(sql: str) -> list[str]:
    """Words and signs without white space and comments; names in double quotes become names in backticks."""
    out = []
    for m in TOKEN.finditer(sql):
        if m.lastgroup == "quoted":
            out.append("`" + m[0][1:-1].replace('""', '"').replace("`", "``") + "`")
        elif m[0].startswith("$") and m.lastgroup == "parameter":
            out.append(":p" + m[0][1:])
        elif m.lastgroup != "space":
            out.append(m[0])
    return out


def up(t: str) -> str:
    return t.upper() if t[0].isalpha() else t


def closing(ts: list[str], i: int) -> int:
    """Where the bracket that opens at i closes."""
    depth = 0
    for j in range(i, len(ts)):
        depth += {"(": 1, ")": -1}.get(ts[j], 0)
        if not depth:
            return j
    raise ValueError("a bracket stays open")


def rewrite(ts: list[str], tables: dict = TABLES) -> list[str]:
    """Brackets first, from the inside out; then what spans a level."""
    out, i = [], 0
    while i < len(ts):
        if ts[i] == "(":
            j = closing(ts, i)
            out += ["(", *rewrite(ts[i + 1 : j], tables), ")"]
            i = j + 1
        else:
            out.append(ts[i])
            i += 1
    for step in (refused, in_order, navigated, distinct_on, limits, quantified, arrows, names, globs, distances, exclusive, by_zero, null_order):
        out = step(out, tables) if step is navigated else step(out)
    return out


def refused(ts: list[str]) -> list[str]:
    """What Spark takes and the engine does not."""
    for word in ("QUALIFY", "LATERAL"):
        if find(ts, word) >= 0:
            raise ValueError(f"{word} is not known")
    at = find(ts, "GROUP", "BY")
    if at >= 0:
        stop = next((k for k, t in top(ts) if k > at and up(t) in ("HAVING", "WINDOW", "ORDER", "LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT", "EXCEPT")), len(ts))
        keys = [key for key, _ in split_keys(ts[at + 2 : stop])]
        if len(keys) > 1 and any(key and up(key[0]) in ("ROLLUP", "CUBE", "GROUPING") for key in keys):
            raise ValueError("ROLLUP, CUBE and GROUPING SETS stand alone in GROUP BY")
    return ts


def in_order(ts: list[str]) -> list[str]:
    """Set operations from left to right: what stands before an INTERSECT is bracketed, as Spark would bind it closer."""
    ops = [i for i, t in top(ts) if up(t) in ("UNION", "INTERSECT", "EXCEPT")]
    if len(ops) < 2 or not any(up(ts[i]) == "INTERSECT" for i in ops[1:]):
        return ts
    start = find(ts, "SELECT") if up(ts[0]) == "WITH" else 0
    stop = next((k for k, t in top(ts) if k > ops[-1] and up(t) in ("ORDER", "LIMIT", "OFFSET", "FETCH")), len(ts))
    made = ts[start : ops[0]]
    for i, j in zip(ops, [*ops[1:], stop]):
        made = ["SELECT", "*", "FROM", "(", *made, ")", *ts[i:j]] if i != ops[0] else [*made, *ts[i:j]]
    return [*ts[:start], *made, *ts[stop:]]


def chains(ts: list[str]):
    """(from, to, names) of dotted names outside subqueries of this level."""
    i = 0
    while i < len(ts):
        if ts[i] == "(" and i + 1 < len(ts) and up(ts[i + 1]) in ("SELECT", "WITH"):
            i = closing(ts, i) + 1
            continue
        j = i
        while ts[j][0].isalpha() and j + 2 < len(ts) and ts[j + 1] == "." and ts[j + 2][0].isalpha():
            j += 2
        if j > i:
            yield i, j + 1, ts[i : j + 1 : 2]
        i = j + 1


def navigated(ts: list[str], tables: dict) -> list[str]:
    """Paths such as o.o_custkey.c_nationkey.n_name: one LEFT JOIN for every distinct beginning, shared by all paths."""
    at = find(ts, "FROM")
    if at < 0 or find(ts, "SELECT") < 0:
        return ts
    stop = next((k for k, t in top(ts) if k > at and up(t) in ("WHERE", "GROUP", "HAVING", "WINDOW", "ORDER", "LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT", "EXCEPT")), len(ts))
    sources = {}
    for k in range(at, stop):
        if (k == at or up(ts[k]) == "JOIN" or ts[k] == ",") and k + 1 < stop and ts[k + 1].lower() in tables:
            alias = ts[k + 3] if k + 3 < stop and up(ts[k + 2]) == "AS" else ts[k + 2] if k + 2 < stop and ts[k + 2][0].isalpha() and up(ts[k + 2]) not in ("JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "ON", "USING") else ts[k + 1]
            sources[alias.lower()] = ts[k + 1].lower()
    joins: dict[tuple[str, ...], tuple[str, list[str]]] = {}
    out, last = [], 0
    for a, b, names_ in chains(ts):
        low = [n.lower() for n in names_]
        if low[0] not in sources:  # the root may go unnamed
            root = next((s for s, t in sources.items() if low[0] in tables[t].references), None)
            if root is None:
                continue
            low = [root, *low]
        if len(low) < 3:
            continue
        table, alias = sources[low[0]], low[0]
        for k in range(1, len(low) - 1):
            if low[k] not in tables[table].references:
                raise ValueError(f"{table}.{low[k]} is no reference")
            target, key = tables[table].references[low[k]]
            path = tuple(low[: k + 1])
            new = "quern_" + "_".join(path)
            joins.setdefault(path, (new, ["LEFT", "JOIN", target, "AS", new, "ON", alias, ".", low[k], "=", new, ".", key]))
            table, alias = target, new
        out += [*ts[last:a], alias, ".", low[-1]]
        last = b
    if not joins:
        return ts
    out += ts[last:]
    stop = next((k for k, t in top(out) if k > find(out, "FROM") and up(t) in ("WHERE", "GROUP", "HAVING", "WINDOW", "ORDER", "LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT", "EXCEPT")), len(out))
    return [*out[:stop], *[t for _, j in joins.values() for t in j], *out[stop:]]


def primary_start(ts: list[str], i: int) -> int:
    """Where the name, call or bracket that ends before i begins."""
    j = i - 1
    if ts[j] in (")", "]"):
        depth = 0
        while True:
            depth += {")": 1, "]": 1, "(": -1, "[": -1}.get(ts[j], 0)
            if not depth:
                break
            j -= 1
        if j and ts[j - 1][0].isalpha() and up(ts[j - 1]) not in ENDS_OPERAND:
            j -= 1
    while j > 1 and ts[j - 1] == ".":
        j -= 2
    return j


def primary_stop(ts: list[str], i: int) -> int:
    """Past the signed name, number, call or bracket that begins at i."""
    j = i
    while ts[j] in ("-", "+", "~"):
        j += 1
    if up(ts[j]) == "CASE":
        depth = 0
        while True:
            depth += {"CASE": 1, "END": -1}.get(up(ts[j]), 0)
            j += 1
            if not depth:
                return j
    if ts[j] != "(":
        j += 1
    while j < len(ts) and (ts[j] in ("(", ".") or ts[j - 1] == "."):
        j = closing(ts, j) + 1 if ts[j] == "(" else j + 1
    return j


def arrows(ts: list[str]) -> list[str]:
    """j -> 'key' is JSON, j ->> 'key' is text; a number counts array elements from 0."""
    for i, t in enumerate(ts):
        if t in ("->", "->>") and (ts[i + 1][0] in "'0123456789"):
            at = primary_start(ts, i)
            step = f"[{ts[i + 1]}]" if ts[i + 1][0] != "'" else "." + ts[i + 1][1:-1]
            value = ts[at:i]
            new = ["get_json_object", "(", *value, ",", f"'${step}'", ")"] if t == "->>" else ["to_json", "(", "variant_get", "(", "try_parse_json", "(", *value, ")", ",", f"'${step}'", ",", "'variant'", ")", ")"]
            return arrows([*ts[:at], *new, *ts[i + 2 :]])
    return ts


def by_zero(ts: list[str]) -> list[str]:
    """a / b and a % b with b null where it is 0."""
    out, i = [], 0
    while i < len(ts):
        out.append(ts[i])
        if ts[i] in ("/", "%") and ts[i + 1 : i + 2] != ["nullif"]:
            stop = primary_stop(ts, i + 1)
            out += ["nullif", "(", *by_zero(ts[i + 1 : stop]), ",", "0", ")"]
            i = stop
        else:
            i += 1
    return out


def top(ts: list[str]):
    """(position, token) outside all brackets of this level."""
    depth = 0
    for i, t in enumerate(ts):
        if t == ")":
            depth -= 1
        if not depth:
            yield i, t
        if t == "(":
            depth += 1


def find(ts: list[str], *words: str, start: int = 0) -> int:
    for i, _ in top(ts):
        if i >= start and [up(t) for t in ts[i : i + len(words)]] == list(words):
            return i
    return -1


def distinct_on(ts: list[str]) -> list[str]:
    i = find(ts, "SELECT", "DISTINCT", "ON")
    if i < 0 or ts[i + 3 : i + 4] != ["("]:
        return ts
    j = closing(ts, i + 3)
    keys = ts[i + 4 : j]
    cut = find(ts, "ORDER", "BY", start=j)
    stop = next((k for k, t in top(ts) if k > max(cut, j) and up(t) in ("LIMIT", "OFFSET", "FETCH")), len(ts))
    order = ts[cut + 2 : stop] if cut >= 0 else keys
    source = find(ts, "FROM", start=j)
    body = ts[source : cut if cut >= 0 else stop]
    sort_keys = split_keys(order)
    hidden = [t for n, (key, _) in enumerate(sort_keys) for t in (",", *key, "AS", f"quern_k{n}")]
    ranked = ["SELECT", *ts[j + 1 : source], *hidden, ",", "row_number", "(", ")", "OVER", "(", "PARTITION", "BY", *keys, "ORDER", "BY", *null_order(["ORDER", "BY", *order])[2:], ")", "AS", "quern_rank", *body]
    drop = [t for n in range(len(sort_keys)) for t in (",", f"quern_k{n}")]
    outer = [t for n, (_, way) in enumerate(sort_keys) for t in (*([","] if n else []), f"quern_k{n}", *way)]
    return [*ts[:i], "SELECT", "*", "EXCEPT", "(", "quern_rank", *drop, ")", "FROM", "(", *ranked, ")", "WHERE", "quern_rank", "=", "1", *(["ORDER", "BY", *outer] if cut >= 0 else []), *ts[stop:]]


def split_keys(order: list[str]) -> list[tuple[list[str], list[str]]]:
    """The keys of an ORDER BY, each with its direction."""
    cuts = [-1, *(i for i, t in top(order) if t == ","), len(order)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        key, way = order[a + 1 : b], []
        while key and up(key[-1]) in ("ASC", "DESC", "NULLS", "FIRST", "LAST"):
            way.insert(0, key.pop())
        out.append((key, way))
    return out


def limits(ts: list[str]) -> list[str]:
    """FETCH FIRST n ROWS ONLY and OFFSET n ROWS, in the order LIMIT, OFFSET."""
    fetch = find(ts, "FETCH")
    if fetch >= 0 and up(ts[fetch + 1]) in ("FIRST", "NEXT"):
        stop = next(k for k in range(fetch, len(ts)) if up(ts[k]) == "ONLY")
        n = [t for t in ts[fetch + 2 : stop] if up(t) not in ("ROW", "ROWS")] or ["1"]
        ts = [*ts[:fetch], "LIMIT", *n, *ts[stop + 1 :]]
    offset = find(ts, "OFFSET")
    if offset >= 0:
        limit = find(ts, "LIMIT")
        stop = limit if limit > offset else len(ts)
        n = [t for t in ts[offset + 1 : stop] if up(t) not in ("ROW", "ROWS", ";")]
        ts = [*ts[:offset], *ts[stop:], "OFFSET", *n] if limit > offset else [*ts[:offset], "OFFSET", *n]
    return ts


def operand_start(ts: list[str], i: int) -> int:
    """Where the operand that ends before i begins."""
    depth, j = 0, i
    while j > 0:
        t = ts[j - 1]
        depth += {")": 1, "(": -1}.get(t, 0)
        if depth < 0 or (not depth and up(t) in ENDS_OPERAND and t != "("):
            break
        j -= 1
    return j


def quantified(ts: list[str]) -> list[str]:
    for i, t in list(top(ts)):
        kind = {"SOME": "ANY"}.get(up(t), up(t))
        if kind in ("ANY", "ALL") and i and ts[i + 1 : i + 2] == ["("] and ts[i - 1] in ("=", "<>", "!=", "<", "<=", ">", ">=") and up(ts[i + 2]) in ("SELECT", "WITH"):
            j, op = closing(ts, i + 1), ts[i - 1]
            inner = ts[i + 2 : j]
            if (op, kind) == ("=", "ANY"):
                new = [*ts[: i - 1], "IN", "(", *inner, ")"]
            elif op in ("<>", "!=") and kind == "ALL":
                new = [*ts[: i - 1], "NOT", "IN", "(", *inner, ")"]
            elif op in ("=", "<>", "!="):  # = ALL: least and most are the value; <> ANY: one of them is not
                at = operand_start(ts, i - 1)
                value, of = ts[at : i - 1], ["FROM", "(", *inner, ")", "AS", "quern", "(", "c", ")"]
                ends = [["(", "SELECT", *f"{f} ( c )".split(), *of, ")"] for f in ("min", "max")]
                if kind == "ANY":
                    test = ["(", *value, "<>", *ends[0], "OR", *value, "<>", *ends[1], ")"]
                else:
                    known = ["(", "SELECT", *"CASE WHEN count ( * ) = count ( c ) THEN true END".split(), *of, ")"]
                    test = ["(", "NOT", "EXISTS", "(", *inner, ")", "OR", "(", *value, "=", *ends[0], "AND", *value, "=", *ends[1], "AND", *known, ")", ")"]
                new = [*ts[:at], *test]
            elif (op, kind) in BOUNDS:
                at = operand_start(ts, i - 1)
                low = f"{BOUNDS[op, kind]} ( c )"
                bound = low if kind == "ANY" else f"CASE WHEN count ( * ) = count ( c ) THEN {low} END"
                test = [*ts[at : i - 1], op, "(", "SELECT", *bound.split(), "FROM", "(", *inner, ")", "AS", "quern", "(", "c", ")", ")"]
                new = [*ts[:at], *(test if kind == "ANY" else ["coalesce", "(", *test, ",", "NOT", "EXISTS", "(", *inner, ")", ")"])]
            return quantified([*new, *ts[j + 1 :]])
    return ts


def split_arguments(ts: list[str]) -> list[list[str]]:
    cuts = [-1, *(i for i, t in top(ts) if t == ","), len(ts)]
    return [ts[a + 1 : b] for a, b in zip(cuts, cuts[1:])] if ts else []


def filled(template: str, args: list[list[str]]) -> list[str]:
    """The template's words, which blanks part outside of texts, with the arguments in brackets."""
    words = re.findall(r"r'[^']*'|'[^']*'|\S+", template)
    return ["(", *[t for w in words for t in (["(", *args[int(w[1:-1])], ")"] if re.fullmatch(r"\{\d\}", w) else [w])], ")"]


def called(name: str, inner: list[str]) -> list[str] | None:
    """A call in words of Spark, or None where the name may stay."""
    args = split_arguments(inner)
    if name in ("GREATEST", "LEAST") and args:
        unknown = [t for a in args for t in ("OR", "(", *a, ")", "IS", "NULL")][1:]
        return ["CASE", "WHEN", "NOT", "(", *unknown, ")", "THEN", name.lower(), "(", *inner, ")", "END"]
    if name == "EXTRACT" and len(inner) > 2 and up(inner[1]) == "FROM" and up(inner[0]) in PARTS:
        return filled(PARTS[up(inner[0])], [inner[2:]])
    if name in ("FIRST", "LAST") and len(args) >= 1:
        at = find(inner, "ORDER", "BY")
        if at < 0:
            return [f"{name.lower()}", "(", *inner, ",", "true", ")"] if len(args) == 1 else None
        ((key, way), *more) = split_keys(inner[at + 2 :])
        if more:
            raise ValueError(f"{name} takes one key")
        least = (name == "FIRST") != any(up(w) == "DESC" for w in way)
        return filled(("min_by" if least else "max_by") + " ( {0} , CASE WHEN {0} IS NOT NULL THEN struct ( {1} IS NULL , {1} ) END )", [inner[:at], key])
    if name == "TIME_TRUNC" and len(args) == 2 and args[0][0].startswith("'"):
        at = "unix_micros ( CAST ( {1} AS TIMESTAMP ) )"
        return filled(f"timestamp_micros ( {at} - pmod ( {at} , {S.micros(args[0][0][1:-1])} ) )", args)
    if name == "TO_CHAR" and len(args) == 2 and args[1][0].startswith("'"):
        pattern, upper = S.char_pattern(args[1][0][1:-1])
        made = ["date_format", "(", *args[0], ",", "'" + pattern.replace("'", "\\'") + "'", ")"]
        return ["upper", "(", *made, ")"] if upper else made
    if name in ("JSON_EXTRACT", "JSON_ARRAY_LENGTH") and len(args) == 2 and args[1][0].startswith("'"):
        found = ["get_json_object", "(", *args[0], ",", "'" + S.json_path(args[1][0][1:-1]) + "'", ")"]
        return found if name == "JSON_EXTRACT" else ["json_array_length", "(", *found, ")"]
    if name == "GENERATE_SERIES" and len(args) in (2, 3):
        step = args[2] if len(args) == 3 else None
        ends = filled("sequence ( {0} , {1} , {2} )" if step else "sequence ( {0} , {1} )", args)
        return ["explode", "(", *ends, ")"]
    template = CALLS.get((name, len(args)))
    if template is None or any(up(t) in ("FROM", "BOTH", "LEADING", "TRAILING") for _, t in top(inner)):
        return None
    return filled(template, args)


def names(ts: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(ts):
        if ts[i] == "(":  # rewritten before
            stop = closing(ts, i)
            out += ts[i : stop + 1]
            i = stop + 1
            continue
        if i + 1 >= len(ts) or ts[i + 1] != "(" or not ts[i][0].isalpha() or (i and ts[i - 1] == "."):
            out.append(ts[i])
            i += 1
            continue
        name, stop = ts[i].upper(), closing(ts, i + 1)
        inner = ts[i + 2 : stop]
        made = called(name, inner)
        if name == "GENERATE_SERIES" and made and i and up(ts[i - 1]) in ("FROM", "JOIN", ","):
            made = ["(", "SELECT", *made, "AS", "value", ")"]
        if made is None and name == "CONCAT":
            made = ["concat_ws", "(", "''", *([","] if inner else []), *inner, ")"]
        elif made is None and name in ("STRING_AGG", "GROUP_CONCAT") and len(split_arguments(inner)) == 1:
            made = ["listagg", "(", *inner, ",", "','", ")"]
        out += made if made is not None else [NAMES.get(name, ts[i]), "(", *inner, ")"]
        i = stop + 1
    return out


def globs(ts: list[str]) -> list[str]:
    from quern.functions.scalar import glob_regex

    out = list(ts)
    for i, t in enumerate(ts[:-1]):
        if up(t) == "GLOB":
            if not ts[i + 1].startswith("'"):
                raise ValueError("GLOB takes a literal pattern")
            out[i], out[i + 1] = "RLIKE", "r'" + glob_regex(ts[i + 1][1:-1].replace("''", "'")) + "'"
    return out


def distances(ts: list[str]) -> list[str]:
    """a <=> b is the distance of two vectors."""
    i = find(ts, "<=>")
    if i < 0:
        return ts
    at = operand_start(ts, i)
    stop = next((k for k, t in top(ts) if k > i and (up(t) in ENDS_OPERAND - {"("} or t in "<>=+-" or up(t) in ("ASC", "DESC"))), len(ts))
    a, b = " ".join(ts[at:i]), " ".join(ts[i + 1 : stop])
    gap = f"zip_with ( {a} , {b} , ( x , y ) -> power ( x - y , 2 ) )"
    return distances([*ts[:at], *f"sqrt ( aggregate ( {gap} , 0D , ( s , x ) -> s + x ) )".split(), *ts[stop:]])


def exclusive(ts: list[str]) -> list[str]:
    """a XOR b on conditions: the two differ. XOR binds closer than AND and OR here as its operands are bracketed."""
    i = find(ts, "XOR")
    if i < 0:
        return ts
    at = operand_start(ts, i)
    stop = next((k for k, t in top(ts) if k > i and up(t) in ENDS_OPERAND - {"(", "NOT", "CASE"}), len(ts))
    return exclusive([*ts[:at], "(", "(", *ts[at:i], ")", "<>", "(", *ts[i + 1 : stop], ")", ")", *ts[stop:]])


def null_order(ts: list[str]) -> list[str]:
    """NULLS LAST where a key rises and NULLS FIRST where it falls, unless it says otherwise."""
    out, i = [], 0
    while i < len(ts):
        if up(ts[i]) != "ORDER" or i + 1 >= len(ts) or up(ts[i + 1]) != "BY":
            out.append(ts[i])
            i += 1
            continue
        out += ts[i : i + 2]
        i += 2
        key, depth = [], 0

        def done(key=key):
            if key and not any(up(t) == "NULLS" for t in key):
                key += ["NULLS", "FIRST" if up(key[-1]) == "DESC" else "LAST"]
            out.extend(key)
            key.clear()

        while i < len(ts):
            t = ts[i]
            depth += {"(": 1, ")": -1}.get(t, 0)
            if depth < 0 or (not depth and up(t) in ENDS_ORDER):
                break
            if not depth and t == ",":
                done()
                out.append(",")
            else:
                key.append(t)
            i += 1
        done()
    return out


def translate(sql: str) -> str:
    return " ".join(rewrite(tokens(sql.strip().rstrip(";"))))


INTEGRAL = ("LongType", "IntegerType", "ShortType", "ByteType")


def divisions(plan, found: set[tuple[int, int]]) -> None:
    """From and to, in the text, of the divisions of integers in an analysed plan, subqueries included."""

    def integral(e) -> bool:
        if e.getClass().getSimpleName() == "Cast" and not e.getTagValue(e.USER_SPECIFIED_CAST()).isDefined():
            e = e.child()  # what Spark widened by itself
        return e.dataType().getClass().getSimpleName().rstrip("$") in INTEGRAL

    def walk(e) -> None:
        if e.getClass().getSimpleName() == "Divide" and integral(e.left()) and integral(e.right()):
            origin = e.origin()
            if origin.startIndex().isDefined() and origin.stopIndex().isDefined():
                found.add((origin.startIndex().get(), origin.stopIndex().get()))
        if hasattr(e, "plan") and "Subquery" in e.getClass().getSimpleName() or e.getClass().getSimpleName() in ("Exists", "ListQuery", "LateralSubquery"):
            divisions(e.plan(), found)
        children = e.children()
        for k in range(children.size()):
            walk(children.apply(k))

    expressions, below, inside = plan.expressions(), plan.children(), plan.innerChildren()
    for k in range(expressions.size()):
        walk(expressions.apply(k))
    for k in range(below.size()):
        divisions(below.apply(k), found)
    for k in range(inside.size()):
        if hasattr(inside.apply(k), "expressions"):
            divisions(inside.apply(k), found)


def whole_divisions(text: str, spans: set[tuple[int, int]]) -> str:
    """The last stroke outside brackets of every span becomes DIV."""
    strokes = set()
    for a, b in spans:
        depth, last = 0, None
        for m in TOKEN.finditer(text, a, b + 1):
            depth += {"(": 1, ")": -1}.get(m[0], 0)
            if m[0] == "/" and not depth:
                last = m.start()
        if last is not None:
            strokes.add(last)
    for at in sorted(strokes, reverse=True):
        text = text[:at] + "DIV" + text[at + 1 :]
    return text


def run(spark: SparkSession, sql: str, parameters: list | dict | None = None) -> DataFrame:
    """The query's result. Parameters are a list for ? and $1, $2 .., or a dictionary for :name."""
    return run_tokens(spark, tokens(sql.strip().rstrip(";")), parameters)


def run_tokens(spark: SparkSession, ts: list[str], parameters: list | dict | None = None, tables: dict = TABLES) -> DataFrame:
    """As run, for a query in tokens; paths go over the references of the tables given."""
    text = " ".join(rewrite(ts, tables))
    args = parameters
    if isinstance(parameters, list) and ":p1" in text.split():
        args = {f"p{i}": v for i, v in enumerate(parameters, 1)}
    while True:
        df = spark.sql(text, args=args) if args else spark.sql(text)
        if "/" not in text.split():
            return df
        spans: set[tuple[int, int]] = set()
        divisions(df._jdf.queryExecution().analyzed(), spans)
        new = whole_divisions(text, spans)
        if new == text:
            return df
        text = new
