"""Functions over text, JSON and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a key=value token, the value bare, quoted, or in brackets.
TOKEN = r"([A-Za-z%_][\w%-]*)\s*=\s*(\"[^\"]*\"|'[^']*'|\([^)]*\)|\[[^\]]*\]|[^\s]+)"


def without_comment(line: Column) -> Column:
    """The line up to an exclamation mark or two slashes."""
    return F.trim(F.regexp_replace(line, r"(!|//).*$", ""))


def tokens(line: Column) -> Column:
    """(key, value) pairs of a line in order; keys in lower case, quotes and brackets gone."""
    keys = F.regexp_extract_all(line, F.lit(TOKEN), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(TOKEN), F.lit(2))
    clean = lambda x: F.regexp_replace(x, r"^[\"'(\[]|[\"')\]]$", "")
    return F.zip_with(keys, values, lambda k, x: F.struct(F.lower(k).alias("key"), clean(x).alias("value")))


def element(line: Column) -> Column:
    """(class, name) of a line that makes an element, in lower case; null for other lines."""
    head = r"(?i)^\s*new\s+\"?([\w]+)\.([^\s\"]+)"
    return F.when(line.rlike(head), F.struct(F.lower(F.regexp_extract(line, head, 1)).alias("class"), F.lower(F.regexp_extract(line, head, 2)).alias("name")))


def array_literals(text: Column, name: str) -> Column:
    """The bodies of all array literals that a script assigns to ``name``."""
    return F.regexp_extract_all(text, F.lit(rf"{name}\s*=\s*\[([^\]]*)\]"), F.lit(1))


def canonical_digest(obj: Column) -> Column:
    """SHA-256 of a struct's JSON; fields must be given in sorted order."""
    return F.sha2(F.to_json(obj), 256)


#: Fixed value: the form of a substation id.
SUBSTATION = r"(?i)^(p\d+[ru])hs(\d+)_([0-9]+)$"


def substation_parts(x: Column) -> Column:
    """(service_area, root_bus, kv) of a substation id; null for other forms."""
    part = lambda i: F.regexp_extract(x, SUBSTATION, i)
    parts = F.struct(F.upper(part(1)).alias("service_area"), F.concat(F.lower(part(1)), F.lit("hs"), part(2)).alias("root_bus"), (part(3).try_cast("double") / 100).alias("kv"))
    return F.when(x.rlike(SUBSTATION), parts)
