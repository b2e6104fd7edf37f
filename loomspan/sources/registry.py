"""The registry of sources: a YAML list below `sources:` as a table.

PyYAML reads it where it is installed. Else a reader of the registry's own shape does: items that begin with `- id:`, each with plain or quoted
scalars by key, and comments.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.citations import EVIDENCE_TYPES, RANK

FIELDS = ("id", "title", "kind", "author", "translator", "publisher", "language", "url", "license", "confidence", "notes")
#: What a field is where it isn't given; a title is the id.
DEFAULTS = {"kind": "scholarly_opinion", "language": "ar", "confidence": "unverified"}
SCALAR = re.compile(r"""^\s*(?P<item>-\s+)?(?P<key>[a-z_]+):(?:\s+(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<plain>[^#\s](?:(?! \#).)*?)))?(?:\s+\#.*)?\s*$""")


def plain_items(text: str) -> list[dict[str, str | None]]:
    """The items of a registry without a YAML library."""
    found: list[dict[str, str | None]] = []
    for m in filter(None, map(SCALAR.match, text.splitlines())):
        if m["item"]:
            found.append({})
        if found:
            quoted = m["double"] if m["double"] is not None else m["single"]
            found[-1][m["key"]] = quoted if quoted is not None else None if m["plain"] in ("null", "~") else m["plain"]
    return found


def items(text: str) -> list[dict]:
    try:
        import yaml
    except ImportError:
        return plain_items(text)
    return (yaml.safe_load(text) or {}).get("sources") or []


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """The registered sources, a column for each of FIELDS. A registry is a small file, read whole on the driver through Spark.

    Items without an id are passed over; a field that isn't there takes its default, a title the id. An unknown kind or level is refused."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    rows = []
    for item in items(text):
        if not (item and item.get("id")):
            continue
        full = {"title": item["id"]} | DEFAULTS | item
        for field, allowed in (("kind", EVIDENCE_TYPES), ("confidence", tuple(RANK))):
            if full[field] not in allowed:
                raise ValueError(f"unknown {field} of source {full['id']}: {full[field]}")
        rows.append(tuple(None if full.get(f) is None else str(full[f]) for f in FIELDS))
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in FIELDS))
