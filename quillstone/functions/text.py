"""Lists in one string, and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names in logs and the names that the ground truth has for them.
MODEL_NAMES = {"cheff": "chef", "T-rex": "trex", "parasaurolophus": "para"}


def split_list(value: str) -> list[str]:
    """Parts between commas; quotes keep commas, a backslash keeps the next character; empty parts go."""
    out, part, quoted, escaped = [], "", False, False
    for c in value:
        if escaped:
            part, escaped = part + ("\n" if c == "n" else c), False
        elif c == "\\":
            escaped = True
        elif c in "\"'":
            quoted = not quoted
        elif c == "," and not quoted:
            out.append(part)
            part = ""
        else:
            part += c
    return [p for p in [*out, part] if p]


def model_name(name: Column) -> Column:
    out = name
    for k, v in MODEL_NAMES.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out
