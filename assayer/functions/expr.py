"""Column predicates and conversions shared by all operators.

The rules are those of untyped text data: a cell is missing when it is null or
blank, and it is numeric when its text reads as a finite number.  Native Spark
types take the short way, so typed Parquet columns never go through a regex.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
BOOLEAN_WORDS = ("true", "false", "yes", "no")
IDENTIFIER_NAMES = (
    "id", "order_id", "customer_id", "product_id", "seller_id", "user_id",
    "employee_id", "customer_number", "account_id", "transaction_id", "invoice_id",
)
# numbers stand between Unicode white space; digits may be grouped by single underscores
NUMBER_PATTERN = (r"(?U)^[\s\x1c-\x1f]*[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)"
                  r"([eE][+-]?[0-9]+(_[0-9]+)*)?[\s\x1c-\x1f]*$")
INTEGER_PATTERN = r"(?U)^[\s\x1c-\x1f]*[+-]?[0-9]+(_[0-9]+)*[\s\x1c-\x1f]*$"
SPECIAL_FLOAT_PATTERN = r"(?iU)^[\s\x1c-\x1f]*[+-]?(nan|inf|infinity)[\s\x1c-\x1f]*$"
# date-time patterns, each with the shape of text it can match
DATETIME_FORMATS = (
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-M-d H:m:s.SSSSSS", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
)
TYPE_ALIASES = {
    "int": "integer", "int32": "integer", "int64": "integer", "bigint": "integer",
    "float32": "float", "float64": "float", "double": "float",
    "varchar": "string", "text": "string", "str": "string",
    "bool": "boolean",
    "datetime64": "datetime", "timestamp": "datetime",
}
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
# --- end of fixed values ----------------------------------------------------

# Unicode white space plus the four ASCII separators that text trimming removes.
_SPACE = r"[\s\x1c-\x1f]"
_NON_SPACE = r"(?U)[^\s\x1c-\x1f]"


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def ident(name: str) -> str:
    """Quoted SQL identifier, safe for dots and spaces in headers."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> Column:
    return F.col(ident(name))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def as_text(df: DataFrame, name: str) -> Column:
    c = quoted(name)
    return F.to_json(c) if is_nested(data_type(df, name)) else c.cast("string")


# Per-column rules are built as SQL text: a wide table then costs one call per
# aggregate instead of a tree of calls per cell rule.

def missing_sql(df: DataFrame, name: str) -> str:
    c = ident(name)
    if isinstance(data_type(df, name), (T.StringType, T.CharType, T.VarcharType)):
        return f"({c} is null or not rlike({c}, {literal(_NON_SPACE)}))"
    return f"({c} is null)"


def missing(df: DataFrame, name: str) -> Column:
    """Null, or text without any visible character.  Never null itself."""
    return F.expr(missing_sql(df, name))


def numeric_sql(c: str, dtype: T.DataType) -> str:
    if isinstance(dtype, (T.IntegralType, T.DecimalType, T.BooleanType)):
        return f"cast({c} as double)"
    if isinstance(dtype, T.FractionalType):
        finite = f"{c} between -1.7976931348623157E308D and 1.7976931348623157E308D"
        return f"case when {finite} then cast({c} as double) end"
    if isinstance(dtype, T.StringType):
        # what is no number fails at its first visible character; what is one is short, and the
        # cast itself knows neither the white space of other scripts nor underscores
        d = f"try_cast(regexp_replace({c}, {literal('(?U)[_' + chr(92) + 's' + chr(92) + 'x1c-' + chr(92) + 'x1f]')}, '') as double)"
        return (f"case when rlike({c}, {literal(NUMBER_PATTERN)}) "
                f"then case when abs({d}) < double('Infinity') then {d} end end")
    return "cast(null as double)"


def numeric(df: DataFrame, name: str) -> Column:
    """Finite double value of the cell, else null."""
    return F.expr(numeric_sql(ident(name), data_type(df, name)))


def may_be_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType, T.StringType))


def stripped_sql(c: str) -> str:
    return f"regexp_replace({c}, {literal(f'(?U)^{_SPACE}+|{_SPACE}+$')}, '')"


def boolean_sql(c: str) -> str:
    words = ", ".join(literal(w) for w in BOOLEAN_WORDS)
    return f"lower({stripped_sql(c)}) in ({words})"


def integer_sql(c: str) -> str:
    return f"rlike({c}, {literal(INTEGER_PATTERN)})"


def float_sql(c: str) -> str:
    return f"(rlike({c}, {literal(NUMBER_PATTERN)}) or rlike({c}, {literal(SPECIAL_FLOAT_PATTERN)}))"


def parse_datetime_sql(c: str) -> str:
    """Timestamp by the six accepted patterns; the shape test keeps other text
    away from the parser."""
    t = stripped_sql(c)
    return "coalesce(" + ", ".join(
        f"case when rlike({t}, {literal(shape)}) then try_to_timestamp({t}, '{fmt}') end"
        for fmt, shape in DATETIME_FORMATS) + ")"


def datetime_sql(c: str) -> str:
    # most text is no date at all and is settled by its first visible characters
    return f"(rlike({c}, {literal('(?U)^' + _SPACE + '*[0-9]{1,4}[-/]')}) and {parse_datetime_sql(c)} is not null)"


def logical_type_of(dtype: T.DataType) -> str | None:
    """Logical type of a native Spark type; None means "look at the text"."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.NumericType):
        return "float"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return None
    return "string"


def normalized_type(c: Column) -> Column:
    key = F.lower(stripped(c))
    pairs = [F.lit(x) for kv in TYPE_ALIASES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


# --- identifier rules, decided on column names ------------------------------

def _bare(name: str) -> str:
    return name.strip().lower()


def schema_identifier(name: str) -> bool:
    n = _bare(name)
    return n in IDENTIFIER_NAMES or n.endswith("_id")


def forest_identifier(name: str) -> bool:
    n = name.lower().strip()
    return (n in ("id", "key", "uuid") or n.startswith("id_")
            or n.endswith(("_id", "_key", "_uuid")))


def outlier_identifier(name: str) -> bool:
    n = name.lower().strip()
    return forest_identifier(name) or n in ("code", "zip") or n.endswith(("_code", "_zip"))


def recovery_identifier(name: str) -> bool:
    n = name.lower()
    return "id" in n or "key" in n


IDENTIFIER_RULES = {
    "schema": schema_identifier,
    "outlier": outlier_identifier,
    "forest": forest_identifier,
    "recovery": recovery_identifier,
    "none": lambda name: False,
}


def measured_columns(df: DataFrame, rule: str = "outlier",
                     extra_identifiers: Iterable[str] = ()) -> list[str]:
    """Columns that can hold numbers and are not identifiers under ``rule``."""
    extra = set(extra_identifiers)
    return [f.name for f in df.schema.fields
            if may_be_numeric(f.dataType) and f.name not in extra
            and not IDENTIFIER_RULES[rule](f.name)]


# --- reshaping ---------------------------------------------------------------

def ordinals(df: DataFrame) -> dict[str, int]:
    return {name: i for i, name in enumerate(df.columns)}


def row_id(keys: Sequence[str]) -> Column:
    r"""The key as text, one text a key: ``|`` and ``\`` inside a value are escaped, null is ``\N``."""
    def part(k: str) -> Column:
        text = F.replace(quoted(k).cast("string"), F.lit("\\"), F.lit("\\\\"))
        return F.coalesce(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\\N"))

    return F.concat_ws("|", *[part(k) for k in keys])


def numbers_of(df: DataFrame, columns: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """Only the named columns, parsed to double, beside the kept ones.

    Text goes through a one-element ``inline``: without that step the optimizer
    would merge the parsing into every aggregate that reads the column.
    """
    kept = df.select(*keep).columns if keep else []
    if not any(isinstance(data_type(df, c), T.StringType) for c in columns):
        return df.select(*keep, *[numeric(df, c).alias(c) for c in columns])
    parsed = df.select(*keep, *[quoted(c).alias(f"_n{i}") for i, c in enumerate(columns)])
    fields = ", ".join(f"{numeric_sql(f'_n{i}', data_type(df, c))} as {ident(c)}"
                       for i, c in enumerate(columns))
    return parsed.select(*[quoted(k) for k in kept], F.expr(f"inline(array(struct({fields})))"))


def long_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """(keep..., column, ordinal, value) with one row per non-null number.

    Only the named columns are read, and parsing happens once, below ``inline``.
    """
    pos = ordinals(df)
    kept = df.select(*keep).columns if keep else []
    parsed = numbers_of(df, columns, keep)
    cells = ", ".join(f"struct({literal(c)} as column, {pos[c]} as ordinal, {ident(c)} as value)"
                      for c in columns)
    return (parsed.select(*[quoted(k) for k in kept], F.expr(f"inline(array({cells}))"))
            .where("value is not null"))


def ladder(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose bound is <= value, bounds given in falling order."""
    out = None
    for bound, label in steps:
        out = F.when(value >= bound, label) if out is None else out.when(value >= bound, label)
    return out.otherwise(otherwise)


def severity_rank(c: Column) -> Column:
    out = None
    for name, rank in SEVERITY_RANK.items():
        out = F.when(c == name, rank) if out is None else out.when(c == name, rank)
    return out.otherwise(0)


def num(c: Column, digits: int) -> Column:
    """Fixed-point text of a number.

    Four digits more are rounded off first: the last bits of a sum depend on the
    order of its terms and must not decide the text.
    """
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", F.round(c.cast("double"), digits + 4), F.lit(pattern))


BUCKETS_PER_OCTAVE = 128


def bucket_sql(value: str) -> str:
    """Bucket number of a double, rising with the value: 128 buckets per power of two.

    A rule on the value alone: no sketch, no cut points, the same in every task
    and after every retry.  A column that spans 20 powers of two has about 2,600
    buckets, and a double can never have more than 540,000.
    """
    size = f"(bigint(floor(log2(abs({value})) * {BUCKETS_PER_OCTAVE})) + 200000)"
    return f"case when {value} = 0 then 0L when {value} > 0 then {size} else -{size} end"
