"""Versioned schemas: registration with compatibility checks, and validation of events against them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a type may become in a later version.
PROMOTIONS = {
    "int": ("int", "long", "float", "double"),
    "long": ("long", "float", "double"),
    "float": ("float", "double"),
    "double": ("double",),
    "string": ("string", "bytes"),
    "bytes": ("bytes",),
}

SIMPLE = {"int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "boolean": T.BooleanType()}


def promotable(old, new) -> bool:
    """Whether values of a type can be read as the other. Unions with null go by their other type; records and arrays
    by what they hold."""
    old, new = (next((t for t in x if t != "null"), "null") if isinstance(x, list) else x for x in (old, new))
    if isinstance(old, dict) and isinstance(new, dict) and old.get("type") == new.get("type"):
        if old["type"] == "record":
            return compatible(old, new, "BACKWARD")
        return all(promotable(old[k], new[k]) for k in ("items", "values") if k in old and k in new)
    if isinstance(old, dict) or isinstance(new, dict):
        return old == new
    return new == old or new in PROMOTIONS.get(old, ())


def _optional(f: dict) -> bool:
    return f.get("default") is not None or bool(f.get("nullable", False))


def compatible(old: dict, new: dict, mode: str) -> bool:
    """BACKWARD: every old field is kept with a promotable type or was optional. FORWARD: every new field existed with
    a promotable type or is optional. FULL: both."""
    if mode == "FULL":
        return compatible(old, new, "BACKWARD") and compatible(old, new, "FORWARD")
    before, after = ({f["name"]: f for f in s.get("fields", [])} for s in (old, new))
    source, other = (before, after) if mode == "BACKWARD" else (after, before)
    for name, f in source.items():
        if name in other:
            if not promotable(before[name]["type"], after[name]["type"]):
                return False
        elif not _optional(f):
            return False
    return True


@dataclass
class Registry:
    """Subjects with their versions, counted from 1."""

    subjects: dict[str, list[dict]] = field(default_factory=dict)

    def register(self, subject: str, schema: dict, compatibility: str = "BACKWARD") -> int:
        versions = self.subjects.setdefault(subject, [])
        if versions and not compatible(versions[-1]["schema"], schema, compatibility):
            raise ValueError(f"{subject}: not {compatibility} compatible with version {len(versions)}")
        versions.append({"schema": schema, "compatibility": compatibility})
        return len(versions)

    def version(self, subject: str) -> int:
        return len(self.subjects[subject])

    def schema(self, subject: str, version: int | None = None) -> dict:
        versions = self.subjects[subject]
        if version is not None and not 1 <= version <= len(versions):
            raise KeyError(f"{subject} has no version {version}")
        return versions[(version or len(versions)) - 1]["schema"]


def spark_type(kind) -> T.DataType:
    """A registry type as Spark's."""
    if isinstance(kind, list):
        return spark_type(next(t for t in kind if t != "null"))
    if isinstance(kind, dict):
        if kind["type"] == "record":
            return T.StructType([T.StructField(f["name"], spark_type(f["type"]), isinstance(f["type"], list) or f["name"] not in kind.get("required", ())) for f in kind["fields"]])
        if kind["type"] == "array":
            return T.ArrayType(spark_type(kind["items"]))
        return T.MapType(T.StringType(), spark_type(kind["values"])) if kind["type"] == "map" else spark_type(kind["type"])
    return SIMPLE[kind]


def _fits(found: Column, kind) -> Column:
    """Whether the schema of a JSON value is of a registry type."""
    nullable = isinstance(kind, list) and "null" in kind
    base = next((t for t in kind if t != "null"), "null") if isinstance(kind, list) else kind
    name = base["type"] if isinstance(base, dict) else base
    fits = {
        "string": found == "STRING",
        "int": found == "BIGINT",
        "long": found == "BIGINT",
        "float": found.isin("BIGINT", "DOUBLE") | found.startswith("DECIMAL"),
        "double": found.isin("BIGINT", "DOUBLE") | found.startswith("DECIMAL"),
        "boolean": found == "BOOLEAN",
        "bytes": found.isin("BINARY", "STRING"),
        "array": found.startswith("ARRAY"),
        "map": found.startswith("OBJECT"),
        "record": found.startswith("OBJECT"),
    }.get(name, F.lit(True))
    return fits | (F.lit(nullable) & (found == "VOID"))


def _fields(schema: dict, prefix: str = "$") -> list[tuple[str, object, bool]]:
    """(path, type, is required) of each field, those within records after their record."""
    out = []
    for f in schema.get("fields", []):
        path = f"{prefix}.{f['name']}"
        out.append((path, f["type"], f["name"] in schema.get("required", ())))
        if isinstance(f["type"], dict) and f["type"].get("type") == "record":
            out += _fields(f["type"], path)
    return out


def validate_json(df, column: str, schema: dict):
    """Adds errors, an array of messages, to rows whose column holds an event as JSON; empty for a valid one."""
    fields = _fields(schema)
    parsed = df.withColumn("event_", F.try_parse_json(column))
    # Each value is looked up once, in a projection of its own: null where it isn't there.
    parsed = parsed.withColumn("kinds_", F.array(*[F.schema_of_variant(F.try_variant_get("event_", path, "variant")) for path, _, _ in fields]).cast("array<string>"))
    messages = [F.when(F.col("event_").isNull(), F.lit("not JSON"))]
    for i, (path, kind, required) in enumerate(fields):
        found = F.get("kinds_", F.lit(i))
        if required:
            messages.append(F.when(found.isNull(), F.lit(f"missing {path[2:]}")))
        messages.append(F.when(found.isNotNull() & ~_fits(found, kind), F.lit(f"type of {path[2:]}")))
    return parsed.withColumn("errors", F.array_compact(F.array(*messages))).drop("event_", "kinds_")


# The schema of change events.
TRANSACTION = {
    "type": "record",
    "name": "Transaction",
    "fields": [
        {"name": "transaction_id", "type": "string"},
        {"name": "account_id", "type": "string"},
        {"name": "event_time", "type": "string"},
        {"name": "event_type", "type": "string"},
        {"name": "processing_time", "type": ["null", "string"], "default": None},
        {"name": "_dedup_key", "type": ["null", "string"], "default": None},
        {
            "name": "data",
            "type": {
                "type": "record",
                "name": "TransactionData",
                "fields": [
                    {"name": "amount", "type": "double"},
                    {"name": "currency", "type": "string"},
                    {"name": "merchant_id", "type": ["null", "string"], "default": None},
                    {"name": "category", "type": ["null", "string"], "default": None},
                ],
            },
        },
    ],
    "required": ["transaction_id", "account_id", "event_time", "event_type", "data"],
}
