"""Explorer queries: what to hide, filters on attributes, records to include, and a limit. Small documents, no data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

#: Fixed limits of a projection.
DEFAULT_LIMIT, MOST_LIMIT = 300, 1000
#: Filter operator of each data type; a type that is not listed can't be filtered.
OPERATORS = {"text": "contains", "number": "range", "boolean": "in", "date": "range", "datetime": "range", "choice": "in"}


@dataclass(frozen=True)
class Filter:
    type_id: str
    attribute: str
    operator: str
    values: tuple[str, ...] = ()
    text: str = ""
    least: float | str | None = None
    most: float | str | None = None


@dataclass(frozen=True)
class Query:
    hide_objects: tuple[str, ...] = ()
    hide_relationships: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    limit: int = DEFAULT_LIMIT


@dataclass
class Dropped:
    """What a request named that the model does not have."""

    object_types: list[str] = field(default_factory=list)
    relationship_types: list[str] = field(default_factory=list)
    filters: list[dict] = field(default_factory=list)


def clamp_limit(value) -> int:
    try:
        return max(1, min(MOST_LIMIT, int(str(value).strip())))
    except (TypeError, ValueError):
        return DEFAULT_LIMIT


def normal_id(value) -> str:
    return str(value).strip().lower().removeprefix("urn:uuid:").strip("{}")


def distinct(values) -> list:
    return list(dict.fromkeys(values))


def clean_filter(raw: dict, data_types: dict[tuple[str, str], str]) -> Filter | None:
    """The filter, if its attribute exists, the operator fits the data type and there is something to compare."""
    if not isinstance(raw, dict):
        return None
    type_id, attribute = normal_id(raw.get("type_id", "")), str(raw.get("attribute", ""))
    operator = OPERATORS.get(data_types.get((type_id, attribute), ""))
    if operator is None or raw.get("operator") not in (None, operator):
        return None
    if operator == "contains":
        text = str(raw.get("value") or "").strip()
        return Filter(type_id, attribute, operator, text=text) if text else None
    if operator == "in":
        values = raw.get("values", raw.get("value"))
        values = values if isinstance(values, list) else [] if values is None else [values]
        values = tuple(distinct(str(v).casefold() for v in values if str(v).strip()))
        return Filter(type_id, attribute, operator, values=values) if values else None
    bounds: list[float | str | None] = []
    for key in ("min", "max"):
        v = raw.get(key)
        if v is None or str(v).strip() == "":
            bounds.append(None)
        elif data_types[(type_id, attribute)] == "number":
            try:
                bounds.append(float(v))
            except (TypeError, ValueError):
                return None
        else:
            bounds.append(str(v).strip())
    return Filter(type_id, attribute, operator, least=bounds[0], most=bounds[1]) if bounds != [None, None] else None


def from_params(params: dict, object_types: set[str], relationship_types: set[str], data_types: dict[tuple[str, str], str]) -> tuple[Query, Dropped]:
    """A query from request parameters (lists, or JSON text for filters); what is unknown goes to ``Dropped``."""
    dropped = Dropped()

    def known(key: str, ids: set[str], gone: list[str]) -> tuple[str, ...]:
        asked = distinct(normal_id(v) for v in params.get(key) or [])
        gone += [v for v in asked if v not in ids]
        return tuple(v for v in asked if v in ids)

    raw = params.get("filters") or []
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError:
            raw = []
    filters = []
    for item in raw if isinstance(raw, list) else []:
        f = clean_filter(item, data_types)
        (filters if f else dropped.filters).append(f or item)
    return (
        Query(
            known("hide_objects", object_types, dropped.object_types),
            known("hide_relationships", relationship_types, dropped.relationship_types),
            tuple(distinct(normal_id(v) for v in params.get("include") or [])),
            tuple(filters),
            clamp_limit(params.get("limit")),
        ),
        dropped,
    )


def to_state(query: Query) -> dict:
    """The query as a document that ``from_params`` reads back."""
    filters = []
    for f in query.filters:
        item: dict = {"type_id": f.type_id, "attribute": f.attribute, "operator": f.operator}
        if f.operator == "contains":
            item["value"] = f.text
        elif f.operator == "in":
            item["values"] = list(f.values)
        else:
            item |= {k: v for k, v in (("min", f.least), ("max", f.most)) if v is not None}
        filters.append(item)
    return {"hide_objects": list(query.hide_objects), "hide_relationships": list(query.hide_relationships), "include": list(query.include), "filters": filters, "limit": query.limit}


@dataclass(frozen=True)
class Scope:
    """What a publication shows. ``depth`` None: as far as edges lead from the roots."""

    exclude_objects: tuple[str, ...] = ()
    exclude_relationships: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    roots: tuple[str, ...] = ()
    depth: int | None = None


def clean_scope(raw: dict, object_types: set[str], relationship_types: set[str], data_types: dict[tuple[str, str], str]) -> Scope:
    query, _ = from_params({"hide_objects": raw.get("exclude_objects"), "hide_relationships": raw.get("exclude_relationships"), "filters": raw.get("filters")}, object_types, relationship_types, data_types)
    depth = raw.get("depth")
    try:
        depth = None if depth is None else max(0, min(5, int(depth)))
    except (TypeError, ValueError):
        depth = None
    return Scope(query.hide_objects, query.hide_relationships, query.filters, tuple(distinct(normal_id(r) for r in raw.get("roots") or [])), depth)
