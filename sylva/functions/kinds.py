"""Type inspection of VARIANT columns, with the strict split of absent (SQL NULL) and null (variant null)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type bits and their names.
T_any = (1 << 31) - 1
T_noval = 1 << 30
T_boolean = 1 << 29
T_decimal = 1 << 28
T_integer = 1 << 27
T_number = 1 << 26
T_string = 1 << 25
T_function = 1 << 24
T_symbol = 1 << 23
T_null = 1 << 22
T_list = 1 << 14
T_map = 1 << 13
T_instance = 1 << 12
T_scalar = 1 << 7
T_node = 1 << 6
NAMES = {T_noval: "nil", T_boolean: "boolean", T_decimal: "decimal", T_integer: "integer", T_number: "number", T_string: "string", T_function: "function", T_symbol: "symbol", T_null: "null", T_list: "list", T_map: "map", T_instance: "instance", T_scalar: "scalar", T_node: "node"}

INTEGER, DECIMAL, STRING, BOOLEAN = (b | T_scalar for b in (T_integer | T_number, T_decimal | T_number, T_string, T_boolean))
NULL, MAP, LIST = T_null | T_scalar, T_map | T_node, T_list | T_node


def schema(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_absent(v: Column) -> Column:
    return v.isNull()


def is_missing(v: Column) -> Column:
    """Absent or null."""
    return v.isNull() | F.is_variant_null(v)


def present(v: Column) -> Column:
    """v with null read as absent."""
    return F.when(~F.is_variant_null(v), v)


def ismap(v: Column) -> Column:
    return F.coalesce(schema(v).startswith("OBJECT"), F.lit(False))


def islist(v: Column) -> Column:
    return F.coalesce(schema(v).startswith("ARRAY"), F.lit(False))


def isnode(v: Column) -> Column:
    return ismap(v) | islist(v)


def is_number(v: Column) -> Column:
    s = schema(v)
    return F.coalesce(s.startswith("DECIMAL") | s.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), F.lit(False))


def is_string(v: Column) -> Column:
    """Strings, and column types without a JSON counterpart, which read as their text."""
    return F.coalesce(schema(v).isin("STRING", "DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "BINARY"), F.lit(False))


def is_boolean(v: Column) -> Column:
    return F.coalesce(schema(v) == "BOOLEAN", F.lit(False))


def number(v: Column) -> Column:
    """The number as double; NULL for other kinds."""
    return F.when(is_number(v), F.try_variant_get(v, "$", "double"))


def string(v: Column) -> Column:
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


def boolean(v: Column) -> Column:
    return F.when(is_boolean(v), F.try_variant_get(v, "$", "boolean"))


def as_list(v: Column) -> Column:
    """array<variant>; NULL for other kinds."""
    return F.when(islist(v), F.try_variant_get(v, "$", "array<variant>"))


def as_map(v: Column) -> Column:
    """map<string,variant>; NULL for other kinds."""
    return F.when(ismap(v), F.try_variant_get(v, "$", "map<string,variant>"))


def typify(v: Column) -> Column:
    n = F.try_variant_get(v, "$", "double")
    whole = F.when((n % 1 == 0), INTEGER).otherwise(DECIMAL)
    return F.when(v.isNull() | F.isnan(n), T_noval).when(F.is_variant_null(v), NULL).when(ismap(v), MAP).when(islist(v), LIST).when(is_string(v), STRING).when(is_boolean(v), BOOLEAN).when(is_number(v), whole).otherwise(T_any).cast("int")


def typename(bits: Column) -> Column:
    """Name of the highest set bit."""
    out = reduce(lambda w, b: w.when((bits >= b) & (bits < 2 * b), NAMES[b]), sorted(NAMES, reverse=True)[1:], F.when((bits >= T_noval) & (bits < T_any), NAMES[T_noval]))
    return out.otherwise("any")


def iskey(v: Column) -> Column:
    return F.coalesce((is_string(v) & (F.try_variant_get(v, "$", "string") != "")) | is_number(v), F.lit(False))


def isempty(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("null")).isin("null", '""', "[]", "{}")


def size(v: Column) -> Column:
    return F.coalesce(F.when(islist(v), F.size(as_list(v))).when(ismap(v), F.size(as_map(v))).when(is_string(v), F.length(string(v))).when(is_number(v), F.floor(number(v))).when(is_boolean(v), boolean(v).cast("int")), F.lit(0)).cast("int")


def strkey(v: Column) -> Column:
    """Text of a key: strings as they are, numbers floored, else empty."""
    return F.coalesce(string(v), F.when(is_number(v), F.floor(number(v)).cast("string")), F.lit(""))


def number_text(n: Column) -> Column:
    """Text of a double as JSON has it: whole numbers without a fraction."""
    return F.when((n % 1 == 0) & (F.abs(n) < 1e18), n.cast("long").cast("string")).otherwise(n.cast("string"))


def text(v: Column) -> Column:
    """Human text: strings as they are, nodes as compact JSON, absent as NULL."""
    return F.coalesce(string(v), F.when(is_number(v), number_text(number(v))), F.to_json(v))


def stringify(v: Column, maxlen: int | None = None) -> Column:
    whole = F.when(schema(v) == "BIGINT", F.to_json(v))  # all digits, also beyond those of a double
    out = F.coalesce(string(v), whole, F.regexp_replace(text(v), '"', ""), F.lit(""))
    if maxlen is None:
        return out
    return F.when(F.length(out) > maxlen, F.concat(F.substring(out, 1, max(0, maxlen - 3)), F.lit("..."[:maxlen]))).otherwise(out)


def jsonify(v: Column) -> Column:
    """Compact JSON; absent is null. Keys come sorted, as VARIANT keeps them."""
    return F.coalesce(F.to_json(v), F.lit("null"))


def pretty(v: Column, indent: int = 2) -> Column:
    """JSON over several lines, keys sorted; absent is null."""
    text, pad = jsonify(v), " " * indent
    # outside of strings: marks open, close or separate; a scan that carries (depth, inside a string, after a backslash, text)
    start = F.struct(F.lit(0).alias("d"), F.lit(False).alias("q"), F.lit(False).alias("b"), F.lit("").alias("p"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        line = lambda d: F.concat(F.lit("\n"), F.repeat(F.lit(pad), d))
        opens, closes = c.isin("{", "["), c.isin("}", "]")
        empty = a["p"].isin("{", "[") & closes
        own = F.when(a["q"], c).when(opens, F.when(a["p"].isin("{", "["), F.concat(line(a["d"]), c)).otherwise(c)).when(closes, F.when(empty, c).otherwise(F.concat(line(a["d"] - 1), c))).when(c == ",", F.concat(c, line(a["d"]))).when(c == ":", ": ").otherwise(F.when(a["p"].isin("{", "["), F.concat(line(a["d"]), c)).otherwise(c))
        quote = (c == '"') & ~a["b"]
        return F.struct((a["d"] + F.when(a["q"], 0).when(opens, 1).when(closes, -1).otherwise(0)).alias("d"), F.when(quote, ~a["q"]).otherwise(a["q"]).alias("q"), (a["q"] & ~a["b"] & (c == "\\")).alias("b"), F.when(a["q"] | quote, F.lit("")).otherwise(c).alias("p"), F.array_append(a["out"], own).alias("out"))

    return F.array_join(F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda a: a["out"]), "")
