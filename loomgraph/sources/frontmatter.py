"""Entity files: Markdown with a frontmatter of scalars and inline arrays."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("active", "stale", "rejected", "superseded", "pruned")
_INT, _FLOAT = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?")


def split(text: str) -> tuple[str, str] | None:
    """(header, body), or None without an opening and a closing line of dashes; one blank line after the header goes."""
    if not text.startswith("---\n"):
        return None
    lines = text[4:].split("\n")
    for k, line in enumerate(lines):
        if line.rstrip("\r") == "---":
            body = "\n".join(lines[k + 1 :])
            return "\n".join(lines[:k]), body.removeprefix("\n")
    return None


def _items(inner: str) -> list[str]:
    out, word, quote = [], "", ""
    for ch in inner:
        if quote:
            word += ch
            quote = "" if ch == quote and not word.endswith("\\" + ch) else quote
        elif ch in "\"'":
            quote, word = ch, word + ch
        elif ch == ",":
            out.append(word)
            word = ""
        else:
            word += ch
    return [x.strip() for x in [*out, word] if x.strip()]


def scalar(raw: str):
    """null -> "", arrays inline, booleans, whole numbers, floats, quoted and bare strings."""
    raw = raw.strip()
    if raw in ("null", "~", ""):
        return ""
    if raw.startswith("[") and raw.endswith("]"):
        return [str(_plain(x)) for x in _items(raw[1:-1])]
    return _plain(raw)


def _plain(raw: str):
    if raw in ("true", "false"):
        return raw == "true"
    if len(raw) > 1 and raw[0] == raw[-1] == '"':
        return re.sub(r'\\(["\\n])', lambda m: {"n": "\n"}.get(m[1], m[1]), raw[1:-1])
    if len(raw) > 1 and raw[0] == raw[-1] == "'":
        return raw[1:-1]
    if _INT.fullmatch(raw):
        return int(raw)
    if _FLOAT.fullmatch(raw):
        return float(raw)
    return raw


def parse(header: str) -> dict:
    """key: value lines; the first colon splits, other lines are skipped."""
    out = {}
    for line in header.split("\n"):
        key, colon, value = line.partition(":")
        if colon and key.strip() and not line.startswith((" ", "\t", "#")):
            out[key.strip()] = scalar(value)
    return out


def _quote(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _written(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "[" + ", ".join(_quote(str(x)) for x in value) + "]"
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, int):
        return str(value)
    same = scalar(value) if value else ""
    return value if value and same == value and value == value.strip() and not re.search(r"[#\n\"'\[\]]", value) else _quote(value) if value else '""'


def serialise(fields: dict, body: str) -> str:
    """Text that parse() turns back into the same fields: floats keep their point, arrays are quoted."""
    return "---\n" + "".join(f"{k}: {_written(v)}\n" for k, v in fields.items()) + "---\n\n" + body


def _uuid(value) -> bool:
    try:
        uuid.UUID(str(value))
        return True
    except ValueError:
        return False


def _stamp(value) -> bool:
    try:
        return datetime.fromisoformat(str(value).replace("Z", "+00:00")).tzinfo is not None
    except ValueError:
        return False


def problem(fields: dict) -> str | None:
    """Why an entity file is invalid."""
    if not _uuid(fields.get("id", "")):
        return "id is not a UUID"
    if not str(fields.get("title", "")).strip():
        return "title is missing"
    if fields.get("status", "active") not in STATUSES:
        return "status is unknown"
    if not all(_stamp(fields[k]) for k in ("created_at", "updated_at") if k in fields):
        return "time stamp is invalid"
    if not all(_uuid(r) for r in fields.get("references") or []):
        return "reference is not a UUID"
    return None


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, raw in zip(pdf["path"], pdf["content"]):
            text = bytes(raw).decode("utf-8", "replace")
            parts = split(text)
            fields = parse(parts[0]) if parts else {}
            error = problem(fields) if parts else "no frontmatter"
            refs = fields.get("references")
            rows.append((path, str(fields.get("id", "")), str(fields.get("type", "")), str(fields.get("title", "")), str(fields.get("status", "active")), json.dumps(fields, sort_keys=True, ensure_ascii=False), refs if isinstance(refs, list) else [], parts[1] if parts else text, error))
        yield pd.DataFrame(rows, columns=["path", "id", "type", "title", "status", "properties", "references", "content", "error"])


FILES = "path string, id string, type string, title string, status string, properties string, references array<string>, content string, error string"


def read_entities(spark: SparkSession, root: str) -> DataFrame:
    """Entity files below a folder, one row each: parsed, or with an error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    parsed = raw.select("path", "content").mapInPandas(_parse_files, FILES)
    return parsed.withColumn("content_hash", F.sha2("content", 256))


def edges_of(entities: DataFrame) -> DataFrame:
    """references edges declared in frontmatter."""
    return entities.where("error is null").select(F.col("id").alias("source_id"), F.explode("references").alias("target_id"), F.lit("references").alias("edge_type"), F.lit(1.0).alias("weight")).distinct()
