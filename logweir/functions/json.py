"""JSON events and attributes, on VARIANT."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.text import REDACTED
from logweir.functions.times import ntz, parse_rfc3339
from logweir.schema import LOG_COLUMNS, OPTIONAL_COLUMNS

# An attribute is secret when its lower-cased key contains one.
SENSITIVE_KEYS = [
    "password",
    "secret",
    "token",
    "api_key",
    "apikey",
    "authorization",
    "ssn",
]

STRING_FIELDS = [c for c in LOG_COLUMNS if c not in ("timestamp", "attributes")]
_OBJECT = "map<string,variant>"


def evaluated_once(df: DataFrame, **values: Column) -> DataFrame:
    """Add costly columns that are not computed again for every later use.

    A filter moves below a projection and takes copies of its expressions along;
    it does not move below a generator. Separate steps also keep the generated
    methods small enough for the JVM to compile.
    """
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select("*", F.inline(F.array(row)))


def object_map(value: Column) -> Column:
    """Top-level members of a VARIANT object, NULL when it is not an object."""
    return value.try_cast(_OBJECT)


def _fold(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("\u017f"), F.lit("s")))


def fold_keys(members: Column) -> Column:
    """Lower-case the keys; U+017F is the one other letter that folds to ASCII s."""
    keys = F.array_join(F.map_keys(members), "\n")
    folded = F.transform_keys(members, lambda k, _: _fold(k))
    return F.when(keys == _fold(keys), members).otherwise(folded)


def _with_members(lines: DataFrame, value: str) -> DataFrame:
    """Add `_members`, fold_keys() of the members of a text that is one JSON value and nothing
    else, and `_root`, the VARIANT of such a value where it is no object; else both are NULL.

    The parser stops after the first complete value, so trailing garbage would
    pass. Wrapped as a two-element array that ends in the text's own hash, the
    text parses to exactly those two elements only if it is one JSON value. They are
    counted, as asking for a third one that is not there raises an exception inside
    Spark for every good line.

    The members are taken from the array itself: an object taken out of it first would be
    built anew, member by member, and then again. A lambda keeps its whole generator from
    being compiled, so the keys are told in a step before, and only odd ones are folded in
    a step of its own.
    """
    kept = lines.columns
    seal = F.xxhash64(value)
    text = F.concat(F.lit("["), value, F.lit(","), seal, F.lit("]"))
    sealed = evaluated_once(lines, _sealed=F.try_parse_json(text))
    wrapped = F.col("_sealed")
    # What is no whole number is NULL in the array.
    numbers = evaluated_once(sealed, _numbers=wrapped.try_cast("array<bigint>"))
    whole = (F.size("_numbers") == 2) & (F.get("_numbers", 1) == seal)
    checked = evaluated_once(numbers, _whole=whole)
    mapped = evaluated_once(checked, _plain=F.when(F.col("_whole"), F.try_variant_get(wrapped, "$[0]", _OBJECT)))
    # Nothing but capitals and letters beyond ASCII can fold.
    keys = F.array_join(F.map_keys("_plain"), "\n")
    other = F.col("_whole") & F.col("_plain").isNull()
    told = evaluated_once(
        mapped,
        _odd=keys.rlike("[A-Z\\x{80}-\\x{10ffff}]"),
        _root=F.when(other, F.variant_get(wrapped, "$[0]", "variant")),
    )
    folded = F.transform_keys("_plain", lambda k, _: _fold(k))
    members = F.when(F.col("_odd"), folded).otherwise(F.col("_plain"))
    return told.select(*kept, "_root", members.alias("_members"))


def kind(value: Column) -> Column:
    """Type of a VARIANT; absent and JSON null are both VOID."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _absent(value: Column) -> Column:
    """Whether kind() is VOID, without the text of a whole type."""
    return value.isNull() | F.is_variant_null(value)


def _is_text(value: Column) -> Column:
    return _absent(value) | (F.schema_of_variant(value) == "STRING")


def _text(value: Column) -> Column:
    return F.coalesce(value.try_cast("string"), F.lit(""))


def _time_text(value: Column) -> Column:
    return F.when(_is_text(value), value.try_cast("string"))


def _event_time(value: Column) -> Column:
    return parse_rfc3339(_time_text(value))


def _bad_time(value: Column, time: Column) -> Column:
    return time.isNull() & ~_absent(value)


def _known_time(time: Column) -> Column:
    """The zero time counts as missing."""
    return F.when(time != ntz(datetime(1, 1, 1)), time)


def split_members(mapped: DataFrame) -> DataFrame:
    """Split `_members` into columns `_<field>`, and add the parsed time as `_time`.
    `_object` tells whether there is an object at all."""
    members = F.col("_members")
    split = evaluated_once(
        mapped, _object=members.isNotNull(), **{f"_{c}": members[c] for c in LOG_COLUMNS}
    ).drop("_members")
    return _with_time(split)


def _with_time(split: DataFrame) -> DataFrame:
    """Add `_time`, the time in `_timestamp`; its text is taken once."""
    told = evaluated_once(split, _written=_time_text(F.col("_timestamp")))
    return evaluated_once(told, _time=parse_rfc3339(F.col("_written"))).drop("_written")


def event_error(root: Column) -> Column:
    """Why a value, split by split_members(), is not a log event; `root` is the value
    where it is no object.

    NULL when it is one. JSON null is an event without any field.
    """
    attributes = F.col("_attributes")
    not_object = object_map(attributes).isNull() & ~_absent(attributes)
    error = F.when(~F.col("_object") & root.isNull(), F.lit("unmarshal: invalid JSON")).when(
        ~F.col("_object") & ~F.is_variant_null(root), F.lit("unmarshal: not an object")
    )
    for name in STRING_FIELDS:
        error = error.when(~_is_text(F.col(f"_{name}")), F.lit(f"unmarshal: {name} is not a string"))
    return error.when(
        _bad_time(F.col("_timestamp"), F.col("_time")), F.lit("unmarshal: timestamp is not RFC 3339")
    ).when(not_object, F.lit("unmarshal: attributes is not an object"))


def is_malformed(root: Column, members: Column) -> Column:
    """event_error() as a flag on a value and its members, for use inside arrays."""
    mistyped = F.map_filter(members, lambda k, v: k.isin(STRING_FIELDS) & ~_is_text(v))
    timestamp, attributes = members["timestamp"], members["attributes"]
    return (
        F.coalesce(members.isNull() & ~F.is_variant_null(root), F.lit(False))
        | (F.coalesce(F.size(mistyped), F.lit(0)) > 0)
        | _bad_time(timestamp, _event_time(timestamp))
        | (object_map(attributes).isNull() & ~_absent(attributes))
    )


def event_fields() -> list[Column]:
    """The ten event columns after split_members(). Absent text is empty, absent
    time is NULL, attributes stay VARIANT."""
    special = {
        "timestamp": _known_time(F.col("_time")),
        "attributes": F.when(~_absent(F.col("_attributes")), F.col("_attributes")),
    }
    return [special.get(c, _text(F.col(f"_{c}"))).alias(c) for c in LOG_COLUMNS]


def decode_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Strictly decode JSON lines.

    Adds the event columns and `decode_error`, which is NULL for good lines; the
    raw line stays in `value` and other columns pass through. A type error in
    any field fails the whole event.
    """
    checked, kept = _checked(lines, value)
    return checked.select(*kept, *event_fields(), "decode_error")


def decode_and_route(lines: DataFrame, value: str = "value") -> DataFrame:
    """decode_events() and with_routing() of the lines in one pass."""
    checked, kept = _checked(lines, value)
    return checked.select(*kept, *event_fields(), "decode_error", *_routing(F.col("_object")))


def _checked(lines: DataFrame, value: str) -> tuple[DataFrame, list[str]]:
    kept = [c for c in lines.columns if c not in LOG_COLUMNS]
    parsed = split_members(_with_members(lines.select(*kept), value))
    return evaluated_once(parsed, decode_error=event_error(F.col("_root"))), kept


def with_routing(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add service and time of raw lines, both NULL when either cannot be read.

    Nothing else of the event is looked at.
    """
    kept = lines.columns
    mapped = _with_members(lines, value)
    members = F.col("_members")
    split = evaluated_once(mapped, _service=members["service"], _timestamp=members["timestamp"])
    return _with_time(split).select(*kept, *_routing(members.isNotNull()))


def _routing(is_object: Column) -> list[Column]:
    """Service and time of a split event, both NULL when either cannot be read."""
    readable = is_object & _is_text(F.col("_service")) & ~_bad_time(F.col("_timestamp"), F.col("_time"))
    return [
        F.when(readable, _text(F.col("_service"))).alias("_service"),
        F.when(readable, _known_time(F.col("_time"))).alias("_time"),
    ]


def attributes_variant(attributes: Column) -> Column:
    """Attributes from text: a JSON object, or a JSON string that holds one."""
    parsed = F.try_parse_json(attributes)
    inner = F.try_parse_json(F.try_variant_get(parsed, "$", "string"))
    is_string = F.schema_of_variant(parsed) == "STRING"
    return F.when(is_string, inner).otherwise(parsed)


def as_variant(df: DataFrame, name: str = "attributes") -> Column:
    """Attributes of a frame as VARIANT, whether they are stored parsed or as text."""
    column = F.col(name)
    return column if df.schema[name].dataType.typeName() == "variant" else F.try_parse_json(column)


def redact_attributes(attributes: Column) -> Column:
    """Replace the value of every secret top-level key, whatever its type."""
    secret = F.parse_json(F.lit(f'"{REDACTED}"'))

    def clean(key: Column, value: Column) -> Column:
        name = F.lower(key)
        hit = F.lit(False)
        for word in SENSITIVE_KEYS:
            hit = hit | F.contains(name, F.lit(word))
        return F.when(hit, secret).otherwise(value)

    return F.transform_values(object_map(attributes), clean)


def attributes_text(attributes: Column) -> Column:
    """JSON text of attributes with sorted keys; absent attributes are `null`."""
    return F.coalesce(F.to_json(attributes), F.lit("null"))


def redacted_text(attributes: Column) -> Column:
    """attributes_text() of redacted attributes.

    Members are looked at one by one only where the text, which holds every key,
    contains one of the words at all.
    """
    text = F.to_json(attributes)
    suspicious = F.lower(text).rlike("|".join(SENSITIVE_KEYS))
    redacted = F.to_json(redact_attributes(attributes))
    return F.coalesce(F.when(suspicious, redacted).otherwise(text), F.lit("null"))


def upsert_attributes(attributes: Column, values: dict[str, str]) -> Column:
    """Set text attributes, replacing those that exist."""
    members = F.coalesce(object_map(attributes), F.expr(f"CAST(map() AS {_OBJECT})"))
    added = F.create_map(
        *[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("variant"))]
    )
    return F.map_concat(F.map_filter(members, lambda k, _: ~k.isin(list(values))), added)


def event_json(df: DataFrame) -> Column:
    """JSON text of an event; optional fields are left out when empty."""
    fields = []
    for name in LOG_COLUMNS:
        column = F.col(name)
        if name == "timestamp":
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        elif name == "attributes":
            column = as_variant(df)
        elif name in OPTIONAL_COLUMNS:
            column = F.nullif(column, F.lit(""))
        fields.append(column.alias(name))
    return F.to_json(F.struct(*fields))
