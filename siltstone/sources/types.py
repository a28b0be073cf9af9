"""Column type strings of the remote dialect as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Types without arguments. Unsigned ones widen to the next signed type. Fixed values of the type mapping.
PLAIN = {
    "Bool": T.BooleanType(),
    "Int8": T.ShortType(),
    "UInt8": T.ShortType(),
    "Int16": T.ShortType(),
    "UInt16": T.IntegerType(),
    "Int32": T.IntegerType(),
    "UInt32": T.LongType(),
    "Int64": T.LongType(),
    "UInt64": T.LongType(),
    "Float32": T.FloatType(),
    "Float64": T.DoubleType(),
    "String": T.StringType(),
    "Date": T.DateType(),
    "Date32": T.DateType(),
    "DateTime": T.TimestampType(),
    "DateTime64": T.TimestampType(),
    "UUID": T.StringType(),
    "IPv4": T.StringType(),
    "IPv6": T.StringType(),
    "JSON": T.StringType(),
    "Object": T.StringType(),
}
DECIMALS = {"Decimal32": 9, "Decimal64": 18, "Decimal128": 38, "Decimal256": 76}


def arguments(text: str) -> list[str]:
    """The parts of ``text`` between commas outside brackets and quotes."""
    out, depth, quoted, start = [], 0, False, 0
    for k, c in enumerate(text):
        if c == "'" and (k == 0 or text[k - 1] != "\\"):
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(text[start:k].strip())
                start = k + 1
    return [*out, text[start:].strip()] if text.strip() else out


def _named(text: str, number: int) -> tuple[str, str]:
    """(name, type) of a tuple's element, whose name may be missing."""
    name, space, kind = text.partition(" ")
    return (name.strip('`"'), kind.strip()) if space and "(" not in name and "," not in name else (f"_{number}", text)


def parse(text: str) -> tuple[T.DataType, bool]:
    """The Spark type of a type string, and whether it is nullable."""
    text = text.strip()
    name, bracket, rest = text.partition("(")
    name = name.strip()
    args = arguments(rest[:-1]) if bracket and rest.endswith(")") else []
    if bracket and not rest.endswith(")"):
        raise ValueError(f"unbalanced type {text!r}")
    if name == "Nullable":
        kind, nullable = parse(args[0])
        if nullable:
            raise ValueError("nested Nullable is not supported")
        return kind, True
    if name == "LowCardinality":
        return parse(args[0])
    if name == "Array":
        kind, nullable = parse(args[0])
        return T.ArrayType(kind, nullable), False
    if name == "Map":
        raise ValueError(f"could not map type {text!r}")
    if name == "FixedString":
        return T.VarcharType(int(args[0])), False
    if name in ("Enum8", "Enum16"):
        return T.StringType(), False
    if name == "Decimal":
        if len(args) != 2:
            raise ValueError(f"{text!r}: Decimal needs precision and scale")
        precision, scale = map(int, args)
        if precision > 38:
            raise ValueError(f"{text!r}: at most 38 digits are supported")
        return T.DecimalType(precision, scale), False
    if name in DECIMALS:
        if DECIMALS[name] > 38:
            raise ValueError(f"{text!r}: at most 38 digits are supported")
        return T.DecimalType(DECIMALS[name], int(args[0])), False
    if name == "Tuple":
        fields = [_named(a, k) for k, a in enumerate(args, 1)]
        return T.StructType([T.StructField(n, *parse(t)) for n, t in fields]), False
    if name == "Nested":
        fields = [_named(a, k) for k, a in enumerate(args, 1)]
        return T.ArrayType(T.StructType([T.StructField(n, *parse(t)) for n, t in fields])), False
    if name == "SimpleAggregateFunction":
        return parse(args[1])
    if name == "AggregateFunction":
        return (parse(args[1]) if len(args) > 1 else (T.LongType(), False))
    if name in PLAIN:
        return PLAIN[name], False
    raise ValueError(f"could not map type {text!r}")


def aggregate_of(text: str) -> str | None:
    """The function of a type that holds aggregate states, with its parameters cut off."""
    name, _, rest = text.strip().partition("(")
    if name in ("AggregateFunction", "SimpleAggregateFunction"):
        return arguments(rest[:-1])[0].partition("(")[0]
    return None


def schema(columns: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, *parse(t)) for n, t in columns.items()])
