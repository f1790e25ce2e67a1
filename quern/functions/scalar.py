"""Scalar functions whose rules differ from Spark's own, as Column expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\u0085   -     　]+"


# order: null is the largest value
def asc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


# arithmetic
def int_div(a: Column, b: Column) -> Column:
    """INTEGER / INTEGER: toward zero; by zero it is null."""
    safe = F.when(b != 0, b)
    whole = lambda x: x.cast("decimal(20,0)")  # noqa: E731  exact, where doubles are not
    return F.try_divide(whole(a - F.try_mod(a, safe)), whole(safe)).cast("bigint")


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def rem(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def xor(a: Column, b: Column) -> Column:
    return a != b


def absolute(x: Column) -> Column:
    """Of the least integer there is no absolute value: null."""
    return F.when(x == -(2**63), None).otherwise(F.abs(x))


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def truncate(x: Column, digits: int = 0) -> Column:
    scaled = x.cast("double") * F.lit(float(10**digits))
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("double") / F.lit(float(10**digits))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def log(x: Column, base: Column | None = None) -> Column:
    """LOG(x) is to base 10, LOG(base, x) to any; outside their domain they are null."""
    if base is None:
        return F.when(x > 0, F.log10(x))
    return F.when((x > 0) & (base > 0) & (base != 1), F.ln(x) / F.ln(base))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def sign(x: Column) -> Column:
    return F.signum(x).cast("bigint")


# conditional: null in, null out
def _any_null(columns: tuple[Column, ...]) -> Column:
    found = columns[0].isNull()
    for c in columns[1:]:
        found = found | c.isNull()
    return found


def greatest(*columns: Column) -> Column:
    return F.when(~_any_null(columns), F.greatest(*columns))


def least(*columns: Column) -> Column:
    return F.when(~_any_null(columns), F.least(*columns))


def truth(c: Column, kind: str) -> Column:
    """What IIF and CAST take as true: numbers other than 0; texts other than '', 0, false and no."""
    if kind == "boolean":
        return c
    if kind == "string":
        return ~F.lower(c).isin("", "0", "false", "no")
    return c != 0


def iif(c: Column, kind: str, yes: Column, no: Column) -> Column:
    return F.when(truth(c, kind), yes).otherwise(no)


# text
def concat(*columns: Column) -> Column:
    """CONCAT() skips nulls, unlike ||."""
    return F.concat_ws("", *columns)


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """A start below 1 is 1 and takes nothing off the length; a negative length gives ''."""
    n = F.greatest(length, F.lit(0)) if length is not None else F.length(s)
    made = F.substring(s, F.greatest(start, F.lit(1)).cast("int"), n.cast("int"))
    return made if length is None else F.when(length.isNotNull() & start.isNotNull(), made)


def trim(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "^" + WHITE, ""), WHITE + "$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, "^" + WHITE, "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, WHITE + "$", "")


def replace(s: Column, old: str, new: str) -> Column:
    """An empty text to replace lies between all characters."""
    if old:
        return F.replace(s, F.lit(old), F.lit(new))
    return F.concat(F.lit(new), F.regexp_replace(s, "(?s)(.)", "$1" + new.replace("\\", "\\\\").replace("$", "\\$")))


def split_part(s: Column, delimiter: str, n: int) -> Column:
    if n <= 0:
        raise ValueError("split_part counts from 1")
    return F.split_part(s, F.lit(delimiter), F.lit(n))


def locate(sub: str, s: Column, start: int = 1) -> Column:
    return F.locate(sub, s, max(start, 1))


def char(code: Column) -> Column:
    """The character of a Unicode scalar value; null for others."""
    sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32"))


def from_hex(s: Column) -> Column:
    return F.when(s.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(s)).when(s.isNotNull(), F.raise_error(F.lit("not hexadecimal")).cast("binary"))


def glob_regex(pattern: str) -> str:
    special = set(".\\+^$()[]{}|")
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in pattern) + "$"


def glob(s: Column, pattern: str) -> Column:
    """* is any text, ? any character; case counts."""
    return s.rlike(glob_regex(pattern))


def collate(s: Column, name: str) -> Column:
    """A transform of the text that then compares byte by byte."""
    kind = name.upper()
    if kind == "BINARY":
        return s
    if kind == "NOCASE":
        return F.lower(s)
    if kind == "NOACCENT":
        return F.translate(s, "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC")
    if kind == "NUMERIC":
        return F.regexp_replace(s, r"(?<!\d)0*(\d+)", "$1")
    raise ValueError(f"no collation {name}")


# conversion
def float_text(x: Column) -> Column:
    """CAST(FLOAT AS TEXT), function form: six decimals."""
    return F.format_string("%.6f", x)


# dates
def dow(ts: Column) -> Column:
    return F.dayofweek(ts) - 1


def isodow(ts: Column) -> Column:
    return F.weekday(ts) + 1


def millisecond(ts: Column) -> Column:
    return F.floor(F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000)) / 1000).cast("bigint")


def microsecond(ts: Column) -> Column:
    return F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))


def datediff(a: Column, b: Column) -> Column:
    """Whole periods of 24 hours from b to a, toward zero."""
    return F.timestamp_diff("DAY", b, a)


UNITS = {"ns": 0.001, "us": 1, "ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


def micros(duration: str) -> int:
    """Microseconds of a duration such as 1h30m."""
    import re

    parts = re.findall(r"(\d+)(ns|us|ms|s|m|h)", duration)
    if not parts or "".join(n + u for n, u in parts) != duration:
        raise ValueError(f"not a duration: {duration}")
    total = sum(int(n) * UNITS[u] for n, u in parts)
    if total < 1:
        raise ValueError("timestamps go down to microseconds")
    return int(total)


def time_trunc(duration: str, ts: Column) -> Column:
    n = micros(duration)
    at = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at, F.lit(n)))


def date_add(ts: Column, n: int, unit: str = "day") -> Column:
    """Months and years clamp to the month's end and drop what is below a second."""
    unit = unit.lower().rstrip("s")
    if unit in ("month", "year", "quarter"):
        months = n * {"month": 1, "quarter": 3, "year": 12}[unit]
        return F.timestamp_add("MONTH", F.lit(months), F.date_trunc("second", ts))
    return F.timestamp_add(unit.upper(), F.lit(n), ts)


#: Parts of a TO_CHAR pattern, the longer first, and what they are for date_format.
CHAR_PARTS = (
    ("YYYY", "yyyy"), ("MONTH", "MMMM"), ("Month", "MMMM"), ("Mon", "MMM"), ("HH24", "HH"), ("HH12", "hh"), ("DAY", "EEEE"), ("Day", "EEEE"),
    ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("Dy", "EEE"), ("HH", "HH"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("AM", "a"), ("PM", "a"), ("TZ", "zzz"),
)


def char_pattern(pattern: str) -> tuple[str, bool]:
    """A TO_CHAR pattern for date_format, and whether the result is to be in upper case."""
    out, i = "", 0
    while i < len(pattern):
        hit = next(((a, b) for a, b in CHAR_PARTS if pattern.startswith(a, i)), None)
        if hit:
            out += hit[1]
            i += len(hit[0])
        else:
            out += f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i] if pattern[i] != "'" else "''"
            i += 1
    return out, "MONTH" in pattern or "DAY" in pattern


def to_char(ts: Column, pattern: str) -> Column:
    out, upper = char_pattern(pattern)
    made = F.date_format(ts, out)
    return F.upper(made) if upper else made


# JSON text
def json_path(path: str) -> str:
    return path if path.startswith("$") else "$." + path


def json_extract(j: Column, path: str) -> Column:
    return F.get_json_object(j, json_path(path))


def json_valid(j: Column) -> Column:
    """1 or 0. The parser stops after the first value; a value that is also sound inside brackets and inside braces stands alone."""
    listed, held = F.concat(F.lit("["), j, F.lit("]")), F.concat(F.lit('{"v":'), j, F.lit("}"))
    sound = F.try_parse_json(listed).isNotNull() & F.try_parse_json(held).isNotNull() & (F.json_array_length(listed) == 1)
    return F.when(j.isNotNull(), sound.cast("bigint"))


def json_keys(j: Column) -> Column:
    return F.to_json(F.array_sort(F.json_object_keys(j)))


def json_type(j: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(j))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


def json_object(*pairs: tuple[str, Column]) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(pairs)]), {"ignoreNullFields": "false"})


def json_array(*values: Column) -> Column:
    """Values of any types: each is encoded on its own."""
    encoded = [F.coalesce(F.regexp_replace(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", "$1"), F.lit("null")) for v in values]
    return F.concat(F.lit("["), F.concat_ws(",", *encoded), F.lit("]"))


# vectors
def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors differ in size")).cast("double"))


def l2_distance(a: Column, b: Column) -> Column:
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return same_size(a, b, F.sqrt(gap))


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    return same_size(a, b, 1 - F.try_divide(_dot(a, b), norm(a) * norm(b)))


def inner_distance(a: Column, b: Column) -> Column:
    return same_size(a, b, -_dot(a, b))


def vector_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ", "), F.lit("]"))
