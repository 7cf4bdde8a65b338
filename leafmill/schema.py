"""Target schemas: which fields a record should have, and of what type."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

TYPES = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str = "string"
    description: str = ""
    required: bool = False

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"field {self.name!r}: type {self.type!r} is none of {sorted(TYPES)}")


@dataclass(frozen=True)
class TargetSchema:
    fields: tuple[FieldSpec, ...] = field(default_factory=tuple)

    @staticmethod
    def of(*specs: str) -> "TargetSchema":
        """From 'name', 'name:type' or 'name*:type' (required)."""
        out = []
        for s in specs:
            name, _, kind = s.partition(":")
            out.append(FieldSpec(name.rstrip("*"), kind or "string", required=name.endswith("*")))
        return TargetSchema(tuple(out))

    @staticmethod
    def from_config(block: dict | None) -> "TargetSchema":
        """From the ``schema`` block of a pipeline file; a missing block is an empty schema."""
        if not block:
            return TargetSchema()
        if not isinstance(block, dict) or not isinstance(block.get("fields", []), list):
            raise ValueError("schema must be a mapping with a list of fields")
        return TargetSchema(tuple(FieldSpec(str(f["name"]), f.get("type", "string"), f.get("description", "") or "", bool(f.get("required", False))) for f in block.get("fields", [])))

    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def as_lines(self):
        """A line for each field, for prompts."""
        return "\n".join(f"* {f.name} ({f.type}{', required' if f.required else ''})" + (f": {f.description}" if f.description else "") for f in self.fields)

    def struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, TYPES[f.type]) for f in self.fields])

    def json_schema(self) -> dict:
        """The contract of a structured reply: an object with a list ``records``."""
        props = {}
        for f in self.fields:
            props[f.name] = {"type": f.type} | ({"description": f.description} if f.description else {})
        item = {"type": "object", "properties": props, "required": [f.name for f in self.fields if f.required]}
        records = {"items": item, "type": "array"}
        return {"type": "object", "required": ["records"], "properties": dict(records=records)}
