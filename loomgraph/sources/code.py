"""Source trees: scan, language, entities and raw edges per file. Python by its own grammar, other languages by patterns."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.constants import LANGUAGES

LIMIT = 1 << 20  # larger files are skipped for good
ENTITIES = "path string, language string, type string, title string, qualified_name string, line_start int, line_end int, hash string"
EDGES = "path string, source_name string, target_name string, edge_type string"

# Patterns of declarations by language: (type, pattern with the name as group 1).
_DECLARATIONS = {
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)"), ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"), ("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)")],
    "go": [("module", r"^package\s+(\w+)"), ("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("class", r"^type\s+(\w+)\s+(?:struct|interface|=)")],
    "javascript": [("function", r"^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("class", r"^\s*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(\w+)")],
    "bash": [("function", r"^\s*(?:function\s+)?([\w-]+)\s*\(\)\s*\{")],
}
_DECLARATIONS["typescript"] = _DECLARATIONS["tsx"] = [*_DECLARATIONS["javascript"], ("class", r"^\s*(?:export\s+)?(?:interface|enum)\s+(\w+)")]
_IMPORTS = {
    "rust": r"^\s*(?:pub\s+)?use\s+([^;]+);",
    "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$',
    "javascript": r"""(?:from|require\()\s*['"](\.[^'"]+)['"]""",
    "bash": r"^\s*(?:source|\.)\s+(\S+)",
}
_IMPORTS["typescript"] = _IMPORTS["tsx"] = _IMPORTS["javascript"]
_EXTENDS = {"rust": r"^\s*impl(?:<[^>]*>)?\s+(\w+)(?:<[^>]*>)?\s+for\s+(\w+)", "javascript": r"class\s+(\w+)\s+extends\s+([\w.]+)"}
_EXTENDS["typescript"] = _EXTENDS["tsx"] = _EXTENDS["javascript"]
_CALL = re.compile(r"\b([A-Za-z_][\w.:]*)\s*\(")
_KEYWORDS = frozenset("if for while match switch return fn func function catch sizeof in and or not elif else def class lambda with await yield".split())


def resolve_relative(importer: str, target: str, known: set[str] | None = None) -> str:
    """A relative module path against its importer's folder: '.', '..', a folder's index; the extension is tried on known files."""
    parts = importer.split("/")[:-1]
    for step in target.split("/"):
        if step == "..":
            parts = parts[:-1]
        elif step not in (".", ""):
            parts.append(step)
    path = "/".join(parts) + ("/index" if target.endswith("/") else "")
    if re.search(r"\.[a-z]+$", path):
        return path
    options = [f"{path}{tail}" for base in ("", "/index") for tail in (f"{base}.ts", f"{base}.tsx", f"{base}.js", f"{base}.jsx", f"{base}.mjs")]
    return next((o for o in options if known and o in known), f"{path}.ts")


def _digest(text: str) -> str:
    """A hash that white space, blank lines and comments do not change."""
    lines = (re.sub(r"\s*(#|//).*$", "", line).rstrip() for line in text.split("\n"))
    return "v2:" + hashlib.sha256("\n".join(x for x in lines if x).encode()).hexdigest()


def _python(text: str) -> tuple[list, list]:
    tree = ast.parse(text)
    entities, edges = [], []

    def calls(node, owner):
        for inner in ast.walk(node):
            if isinstance(inner, ast.Call):
                edges.append((owner, ast.unparse(inner.func), "calls"))

    def entity(node, kind, name):
        normal = ast.dump(node, include_attributes=False)
        entities.append((kind, node.name, name, node.lineno, node.end_lineno, "v2:" + hashlib.sha256(normal.encode()).hexdigest()))

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            entity(node, "function", node.name)
            calls(node, node.name)
        elif isinstance(node, ast.ClassDef):
            entity(node, "class", node.name)
            edges.extend((node.name, ast.unparse(b), "extends") for b in node.bases)
            for inner in node.body:
                if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    entity(inner, "function", f"{node.name}::{inner.name}")
                    calls(inner, f"{node.name}::{inner.name}")
        elif isinstance(node, ast.Import):
            edges.extend(("", a.name, "imports") for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            edges.extend(("", f"{'.' * node.level}{node.module or ''}.{a.name}".strip("."), "imports") for a in node.names)
    return entities, edges


def _block_end(lines: list[str], start: int) -> int:
    depth = 0
    for k in range(start, len(lines)):
        depth += lines[k].count("{") - lines[k].count("}")
        if depth <= 0 and ("{" in lines[k] or k > start or lines[k].rstrip().endswith(";")):
            return k
    return len(lines) - 1


def _by_pattern(text: str, language: str) -> tuple[list, list]:
    lines, entities, edges, owner, until = text.split("\n"), [], [], "", -1
    impl, impl_until = "", -1
    for k, line in enumerate(lines):
        if language == "rust" and (m := re.match(r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)", line)):
            impl, impl_until = m[1], _block_end(lines, k)
        if m := re.search(_IMPORTS.get(language, r"(?!)"), line):
            edges.append(("", m[1].strip(), "imports"))
        if m := re.search(_EXTENDS.get(language, r"(?!)"), line):
            edges.append((m[2], m[1], "extends") if language == "rust" else (m[1], m[2], "extends"))
        for kind, pattern in _DECLARATIONS.get(language, ()):
            if m := re.match(pattern, line):
                end = _block_end(lines, k) if kind != "module" or "{" in line else k
                name = f"{impl}::{m[1]}" if kind == "function" and k <= impl_until and impl else m[1]
                entities.append((kind, m[1], name, k + 1, end + 1, _digest("\n".join(lines[k : end + 1]))))
                if kind == "function":
                    owner, until = name, end
                break
        if k <= until:
            edges.extend((owner, c, "calls") for c in _CALL.findall(line) if c.split(".")[-1].split("::")[-1] not in _KEYWORDS and c != owner.split("::")[-1])
    return entities, edges


def extract(path: str, text: str) -> tuple[list, list, str | None]:
    """(entities, raw edges, error) of one file; the file itself is always an entity."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1], "")
    whole = ("file", path.rsplit("/", 1)[-1], path, 1, text.count("\n") + 1, _digest(text))
    try:
        entities, edges = _python(text) if language == "python" else _by_pattern(text, language)
    except (SyntaxError, ValueError) as e:
        return [whole], [], f"{type(e).__name__}"
    return [whole, *entities], [(s or path, t, k) for s, t, k in edges], None


def source_files(spark: SparkSession, root: str, deny: str | None = None) -> DataFrame:
    """Files of known languages below a folder, without hidden and denied paths, and with what is too large marked."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = raw.withColumn("name", F.regexp_replace("path", "^[a-z]+:/*", "/")).where(F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1)).isin(*LANGUAGES))
    files = files.where(~F.col("name").rlike(r"/\.[^/]"))
    if deny:
        files = files.where(~F.col("name").rlike(deny))
    return files.select(F.col("name").alias("path"), "content", (F.col("length") > LIMIT).alias("too_large"))


def _entity_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, raw in zip(pdf["path"], pdf["content"]):
            found, _, _ = extract(path, bytes(raw).decode("utf-8", "replace"))
            language = LANGUAGES.get(path.rsplit(".", 1)[-1], "")
            rows += [(path, language, *e) for e in found]
        yield pd.DataFrame(rows, columns=["path", "language", "type", "title", "qualified_name", "line_start", "line_end", "hash"])


def _edge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(path, *e) for path, raw in zip(pdf["path"], pdf["content"]) for e in extract(path, bytes(raw).decode("utf-8", "replace"))[1]]
        yield pd.DataFrame(rows, columns=["path", "source_name", "target_name", "edge_type"])


def code_entities(files: DataFrame) -> DataFrame:
    return files.where("not too_large").select("path", "content").mapInPandas(_entity_rows, ENTITIES)


def raw_edges(files: DataFrame) -> DataFrame:
    return files.where("not too_large").select("path", "content").mapInPandas(_edge_rows, EDGES)
