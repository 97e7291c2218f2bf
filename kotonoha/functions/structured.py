"""Definitions as JSON: kinds, images, styles, and rendering of structured content as HTML."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

# Keys of an image definition with their defaults.
IMAGE_TEXTS = ["path", "title", "alt", "description"]
IMAGE_FLAGS = {"pixelated": False, "background": True, "collapsed": False, "collapsible": True}
RENDERINGS = {"pixelated": "pixelated", "crisp-edges": "crispEdges"}
#: Attributes of an image that become styles.
STYLED = {"verticalAlign": "vertical-align", "border": "border", "borderRadius": "border-radius", "imageRendering": "image-rendering"}
DROPPED = {"pixelated", "background"}


def definition_kind(c: Column) -> Column:
    """basic, text, structured-content, image or deinflection; null for anything else."""
    first, kind = F.substring(F.trim(c), 1, 1), F.get_json_object(c, "$.type")
    return F.when(first == '"', "basic").when(first == "[", "deinflection").when((first == "{") & kind.isin("text", "structured-content", "image"), kind)


def image_defaults(c: Column) -> Column:
    """A struct of all keys of an image definition, absent ones with their defaults."""
    schema = "path string, width int, height int, title string, alt string, description string, pixelated boolean, imageRendering string, appearance string, background boolean, collapsed boolean, collapsible boolean"
    p = F.from_json(c, schema)
    texts = [F.coalesce(p[k], F.lit("")).alias(k) if k != "path" else p[k].alias(k) for k in IMAGE_TEXTS]
    flags = [F.coalesce(p[k], F.lit(v)).alias(k) for k, v in IMAGE_FLAGS.items()]
    rendering = F.lit("auto")
    for name, ours in RENDERINGS.items():
        rendering = F.when(p["imageRendering"] == name, ours).otherwise(rendering)
    return F.struct(*texts, F.coalesce(p["width"], F.lit(0)).alias("width"), F.coalesce(p["height"], F.lit(0)).alias("height"), *flags, rendering.alias("imageRendering"), F.when(p["appearance"] == "monochrome", "monochrome").otherwise("auto").alias("appearance"))


def camel_to_param(c: Column) -> Column:
    """``fontSize`` -> ``font-size``."""
    parts = F.transform(F.split(c, ""), lambda x: F.when(x.rlike("^[A-Z]$"), F.concat(F.lit("-"), F.lower(x))).otherwise(x))
    return F.array_join(parts, "")


def style_string(styles: Column) -> Column:
    """A map of styles as `` k:v;`` for each entry in the map's order, on which their meaning may depend."""
    return F.array_join(F.transform(F.map_entries(styles), lambda e: F.concat(F.lit(" "), camel_to_param(e["key"]), F.lit(":"), e["value"], F.lit(";"))), "")


def media_path(dictionary: Column, path: Column, base: str = "") -> Column:
    return F.concat(F.lit(f"{base}/dictionaryMedia/"), dictionary, F.lit("/"), path)


def _shown(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _open_tag(tag: str, attributes: dict, styles: dict | None, media: str) -> str:
    shown = " ".join(f'{k}="{media + v if k == "src" else _shown(v)}"' for k, v in attributes.items())
    css = "".join(f" {re.sub('[A-Z]', lambda m: '-' + m[0].lower(), k)}:{_shown(v)};" for k, v in (styles or {}).items())
    return "<" + " ".join(filter(None, [tag, shown, f'style="{css}"' if css else ""])) + ">"


def image_html(attributes: dict, media: str) -> str:
    """An ``img`` tag, inside ``details`` where it is collapsible; attributes that are styles are left out, as a tag without content has no style."""
    if "path" not in attributes:
        raise ValueError("an image needs a path")
    hidden = {*STYLED, *DROPPED, "path", "collapsible", "collapsed"} | ({"appearance"} if attributes.get("appearance") == "monochrome" else set())
    plain = {k: v for k, v in attributes.items() if k not in hidden}
    image = _open_tag("img", {**plain, "src": attributes["path"]}, None, media)
    if attributes.get("collapsible") is not True:
        return image
    opened = {} if attributes.get("collapsed") else {"open": ""}
    return _open_tag("details", opened, None, media) + "<summary> </summary>" + image + "</details>"


def to_html(node: object, media: str) -> str:
    """Structured content as HTML; an explicit stack, so that depth is no limit."""
    out: list[str] = []
    stack: list[object] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):  # a closing tag
            out.append(x[0])
        elif isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            attributes = {**(x.get("data") or {}), **{k: v for k, v in x.items() if k not in ("tag", "data", "style", "content")}}
            if x["tag"] == "br":
                out.append(_open_tag("br", attributes, None, media))
            elif x["tag"] == "img":
                out.append(image_html(attributes, media))
            else:
                out.append(_open_tag(x["tag"], attributes, x.get("style"), media))
                stack.append((f"</{x['tag']}>",))
                if x.get("content") is not None:
                    stack.append(x["content"])
        else:
            raise ValueError(f"not structured content: {type(x).__name__}")
    return "".join(out)


def definition_html(definition: str | None, dictionary: str | None, base: str = "") -> str | None:
    if definition is None:
        return None
    value, media = json.loads(definition), f"{base}/dictionaryMedia/{dictionary}/"
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return value[0]
    if value.get("type") == "text":
        return value["text"]
    if value.get("type") == "image":
        full = {"width": 0, "height": 0, "title": "", "alt": "", "description": "", **IMAGE_FLAGS, "imageRendering": "auto", "appearance": "auto"}
        return image_html({**full, **{k: v for k, v in value.items() if k != "type"}}, media)
    return to_html(value["content"], media)


@F.pandas_udf(types.StringType())
def structured_html(definition: pd.Series, dictionary: pd.Series) -> pd.Series:
    """Each definition (JSON) of a dictionary as HTML; null for one that is malformed."""

    def shown(d: str | None, x: str | None) -> str | None:
        try:
            html = definition_html(d, x)
        except (ValueError, KeyError, IndexError, TypeError, AttributeError):
            return None
        return html if isinstance(html, str) else None

    return pd.Series([shown(d, x) for d, x in zip(definition, dictionary, strict=True)], dtype=object)
