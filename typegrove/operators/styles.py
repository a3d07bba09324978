"""Appearance: styles layered from default to model to type, colours by attribute value, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .overlay import merge_maps


#: Style fields and what they hold (fixed values): a colour, a number within bounds, one of some words, or an attribute's key.
OBJECT_STYLE = {
    "shape": ("box", "ellipse", "circle", "database", "diamond", "dot", "square", "triangle", "hexagon", "star"),
    "size": (10, 80),
    "background_source": ("type", "attribute"),
    "background": "color",
    "background_attribute": "key",
    "border_source": ("type", "attribute"),
    "border": "color",
    "border_attribute": "key",
    "border_width": (0, 8),
    "font_colour": "color",
    "font_size": (8, 32),
    "font_weight": ("normal", "bold"),
}
RELATIONSHIP_STYLE = {
    "colour_source": ("type", "attribute"),
    "colour": "color",
    "colour_attribute": "key",
    "width": (0.5, 10),
    "line_style": ("solid", "dashed", "dotted"),
    "arrows": ("none", "to", "from", "both"),
    "label_colour": "color",
    "label_size": (8, 24),
}


def color_of(value: Column) -> Column:
    """#rgb or #rrggbb as #RRGGBB, null if it is neither."""
    text = F.upper(F.btrim(value))
    long = F.when(F.char_length(text) == 4, F.regexp_replace(text, "([0-9A-F])", "$1$1")).otherwise(text)
    return F.when(text.rlike("^#([0-9A-F]{3}|[0-9A-F]{6})$"), long)


def cleaned(styles: DataFrame, fields: dict) -> DataFrame:
    """Styles (type_id, style map) without unknown fields and without values that their field can't hold."""

    def one(name: str, rule) -> Column:
        v = F.element_at("style", F.lit(name))
        if rule == "color":
            kept = color_of(v)
        elif rule == "key":
            kept = F.when(F.btrim(v).rlike("^[-a-zA-Z0-9_]{1,100}$"), F.btrim(v))
        elif isinstance(rule[0], str):
            kept = F.when(v.isin(*rule), v)
        else:
            n = v.try_cast("double")
            kept = F.when(n.between(*rule), F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string")))
        return F.when(kept.isNotNull(), F.struct(F.lit(name).alias("key"), kept.alias("value")))

    return styles.withColumn("style", F.map_from_entries(F.array_compact(F.array(*[one(k, r) for k, r in fields.items()]))))


def layered(types: DataFrame, default: dict[str, str], model: dict[str, str], own: DataFrame) -> DataFrame:
    """(type_id, style): later layers win key by key. own: type_id, style map."""
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")
    base = merge_maps(as_map(default), as_map(model))
    rows = types.select(F.col("id").alias("type_id")).join(own.withColumnRenamed("style", "__own"), "type_id", "left")
    return rows.select("type_id", merge_maps(base, F.coalesce("__own", F.create_map().cast("map<string,string>"))).alias("style"))


def by_value(rows: DataFrame, colors: DataFrame, attribute: str, fallback: str) -> DataFrame:
    """Adds color: that of the attribute's value, else the type's own colour, else ``fallback``. colors: value, color."""
    c = colors.select(F.col("value").alias("__value"), F.col("color").alias("__color"))
    out = rows.withColumn("__at", F.element_at("attributes", F.lit(attribute))).join(c, F.col("__at") == F.col("__value"), "left")
    own = F.col("type_color") if "type_color" in rows.columns else F.lit(None).cast("string")
    return out.withColumn("color", F.coalesce("__color", own, F.lit(fallback))).drop("__at", "__value", "__color")


def pruned(styles: DataFrame, types: DataFrame) -> DataFrame:
    """Styles whose type still exists."""
    return styles.join(types.select(F.col("id").alias("type_id")), "type_id", "left_semi")
