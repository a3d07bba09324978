"""Import mappings: which column of a file fills which field. Documents are checked before any row is read."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from ..functions.values import IDENTITY_TYPES

BUILT_IN = ("key", "id", "name", "description", "is_active")
ENDS = ("subject", "object")
RESOLVERS = ("key", "id", "attribute")


@dataclass(frozen=True)
class Column:
    column: str
    field: str
    match: bool = False
    by: str = ""
    object_type_id: str = ""


@dataclass(frozen=True)
class Mapping:
    kind: str
    type_id: str
    columns: tuple[Column, ...]


@dataclass(frozen=True)
class Target:
    """The type that a file is imported into: its attributes' data types and, for edges, the allowed pairs of ends."""

    kind: str
    type_id: str
    attributes: dict[str, str]
    pairs: tuple[tuple[str, str], ...] = ()


def check(raw: dict, headers: list[str], targets: dict[tuple[str, str], Target]) -> tuple[Mapping | None, list[dict]]:
    """The mapping, or what is wrong with it as (code, column) documents."""
    problems: list[dict] = []

    def bad(code: str, column: str = "") -> None:
        problems.append({"code": code, "column": column})

    spec = raw.get("target") if isinstance(raw, dict) else None
    target = targets.get((str((spec or {}).get("kind", "")), str((spec or {}).get("type_id", ""))))
    if target is None:
        return None, [{"code": "unknown_target", "column": ""}]
    columns = []
    for c in raw.get("columns") or []:
        if isinstance(c, dict) and c.get("field"):
            columns.append(Column(str(c.get("column", "")), str(c["field"]), bool(c.get("match")), str(c.get("by") or ""), str(c.get("object_type_id") or "")))
    for name, n in Counter(c.column for c in columns).items():
        if n > 1:
            bad("duplicate_column", name)
        if name not in headers:
            bad("unknown_column", name)
    for name, n in Counter(c.field for c in columns).items():
        if n > 1:
            bad("duplicate_field", name)
    legal = {f"attributes.{a}" for a in target.attributes} | ({"id", "is_active", *ENDS} if target.kind == "relationship" else set(BUILT_IN))
    for c in columns:
        if c.field not in legal:
            bad("unknown_field", c.column)
        if c.match and target.attributes.get(c.field.removeprefix("attributes.")) not in IDENTITY_TYPES:
            bad("not_an_identity", c.column)
        if c.field in ENDS and target.kind == "relationship":
            side = {p[ENDS.index(c.field)] for p in target.pairs}
            if c.by.split(":")[0] not in RESOLVERS:
                bad("unknown_resolver", c.column)
            if c.object_type_id and c.object_type_id not in side:
                bad("type_not_allowed", c.column)
            if c.by.startswith("attribute") and not c.object_type_id:
                bad("resolver_needs_a_type", c.column)
    fields = {c.field for c in columns}
    if target.kind == "relationship":
        if not ({"subject", "object"} <= fields or "id" in fields):
            bad("ends_required")
    else:
        if sum(c.match for c in columns) > 1:
            bad("several_matches")
        if not (any(c.match for c in columns) or {"key", "id"} & fields):
            bad("identity_required")
    return (None if problems else Mapping(target.kind, target.type_id, tuple(columns))), problems
