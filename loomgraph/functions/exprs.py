"""Scalar functions as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.constants import CURATED, DEFAULT, ERROR_WORDS, LANGUAGES, PIPE_SHELLS, RECORD_CATEGORIES, SECRETS, STOPWORDS, TRANSITIONS

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def code_tokens(text: Column) -> Column:
    """tokens() that also breaks camelCase; parts of two characters or more."""
    broken = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\p{Ll}0-9])(\p{Lu})", "$1 $2")
    return F.filter(tokens(broken), lambda t: F.length(t) >= 2)


def content_terms(text: Column) -> Column:
    """code_tokens() of four characters or more, not all digits, not stop words."""
    kept = F.filter(code_tokens(text), lambda t: (F.length(t) >= 4) & ~t.rlike("^[0-9]+$"))
    return F.array_except(kept, F.array(*(F.lit(w) for w in dict.fromkeys(STOPWORDS))))


def search_terms(title: Column) -> Column:
    """Parts of split identifiers, followed by letter and digit parts joined again (http2)."""
    words = F.filter(F.split(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    def split(word: Column) -> Column:
        marked = F.regexp_replace(word, r"(\p{Lu}{2,})(\p{Lu}\p{Ll})", "$1 $2")
        marked = F.regexp_replace(marked, r"(?<=\p{Ll})(?=\p{Lu})|(?<=[0-9])(?=[^0-9 ])|(?<=[^0-9 ])(?=[0-9])", " ")
        return F.filter(F.split(marked, " "), lambda p: p != "")

    parts = F.filter(F.transform(words, split), lambda p: F.size(p) > 1)

    def joined(p: Column) -> Column:
        pairs = F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, i: F.when(x.rlike(r"^\p{L}+$") & F.get(p, i + 1).rlike("^[0-9]+$"), F.concat(x, F.get(p, i + 1))))
        return F.concat(p, F.array_compact(pairs))

    return F.array_join(F.flatten(F.transform(parts, joined)), " ")


def language(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return reduce(lambda c, kv: c.when(ext == kv[0], kv[1]), list(LANGUAGES.items())[1:], F.when(ext == "rs", "rust"))


def is_test_path(path: Column) -> Column:
    """Per-language test-file rule; a null path is no test."""
    ext = F.regexp_extract(path, r"([^/]*)\.([^./]*)$", 2)
    has_ext = path.rlike(r"\.[^./]*$")
    in_tests = path.startswith("tests/") | path.contains("/tests/")
    rust = in_tests | path.endswith("/tests.rs") | (path == "tests.rs") | path.endswith("_tests.rs")
    python = in_tests | path.rlike(r"(^|/)test_[^/]+\.py$") | path.rlike(r"(^|/)[^/]+_test\.py$")
    script = path.contains("/__tests__/") | path.rlike(r"(^|/)[^/]+\.(test|spec)\.[^./]+$")
    shell = path.rlike(r"(^|/)test_[^/]+\.(sh|bash)$") | path.rlike(r"(^|/)[^/]+_test\.(sh|bash)$")
    rule = F.when(ext == "rs", rust).when(ext == "go", path.endswith("_test.go")).when(ext == "py", python)
    rule = rule.when(ext.isin("js", "mjs", "cjs", "jsx", "ts", "tsx"), script).when(ext.isin("sh", "bash"), shell).otherwise(False)
    return F.coalesce(has_ext & rule, F.lit(False))


def secret_kind(text: Column) -> Column:
    """Kind of the first pattern in list order that matches."""
    return reduce(lambda c, p: c.when(text.rlike(p[1]), p[0]), SECRETS[1:], F.when(text.rlike(SECRETS[0][1]), SECRETS[0][0]))


def secret_preview(text: Column) -> Column:
    first = lambda p: F.left(F.regexp_substr(text, F.lit(p)), F.lit(4))
    return reduce(lambda c, p: c.when(text.rlike(p[1]), first(p[1])), SECRETS[1:], F.when(text.rlike(SECRETS[0][1]), first(SECRETS[0][1])))


def redact(text: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p[1], f"[redacted: {p[0]}]"), SECRETS, text)


def looks_like_error(result: Column) -> Column:
    """The last exit code decides; without one, a word of failure in the first 200 characters."""
    code = F.regexp_extract(result, r"(?s).*Exit code:\s*(-?\d+)(?:\s|$)", 1)
    words = F.lower(F.left(result, F.lit(200))).rlike("|".join(ERROR_WORDS))
    return F.when(code != "", code.cast("long") != 0).otherwise(words)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v))


def l2_to_cosine(d: Column) -> Column:
    return 1 - d * d / 2


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors (array of arrays) whose mask is 1, then L2-normalised."""
    n = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    zero = F.transform(vectors[0], lambda _: F.lit(0.0))
    total = F.aggregate(F.arrays_zip(vectors.alias("v"), mask.alias("m")), zero, lambda s, r: F.zip_with(s, r["v"], lambda a, b: a + b * r["m"]))
    mean = F.transform(total, lambda x: x / F.greatest(n, F.lit(1e-9)))
    size = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(mean, lambda x: F.when(size > 0, x / size).otherwise(0.0))


def mock_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic 0/1 vector of the bits of hashes of the text; for tests and offline runs."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.getbit(F.xxhash64(text, F.floor(i / 32)), (i % 32).cast("int")).cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def lines_of(text: Column) -> Column:
    """Distinct trimmed lines of more than three characters."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 3))


def normal_title(title: Column) -> Column:
    """Lower case, other than letters and digits to blanks, collapsed."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def excerpt(text: Column, n: int) -> Column:
    """The first n lines and a note of how many more there are."""
    parts = F.split(text, "\n")
    more = F.size(parts) - n
    return F.when(more > 0, F.concat(F.array_join(F.slice(parts, 1, n), "\n"), F.lit("\n... ("), more.cast("string"), F.lit(" more lines)"))).otherwise(text)


def snippet(text: Column, n: int = 120) -> Column:
    flat = F.replace(F.replace(F.trim(text), F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("'"))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.left(flat, F.lit(n)), F.lit("…")))


def cap_payload(text: Column, limit: int = 4096, marker: str = "\n[...]\n") -> Column:
    half = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half))))


def slugify(title: Column, limit: int = 60) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.left(slug, F.lit(limit)), "-[^-]*$", "")
    return F.when(F.length(slug) <= limit, slug).otherwise(F.regexp_replace(cut, "-+$", ""))


def uuid5(name: Column, namespace_hex: str) -> Column:
    """Version-5 UUID of a name in a namespace given as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def edge_weight(edge_type: Column) -> Column:
    return F.when(edge_type.isin(*CURATED), 1.0).when(edge_type == "auto_references", 0.7).otherwise(0.5)


def volatility(kind: Column, explicit: Column, category: Column) -> Column:
    record = (kind == "observation") | ((kind == "knowledge") & category.isin(*RECORD_CATEGORIES))
    return F.when(explicit.isin("record", "living"), explicit).when(record, "record").otherwise("living")


def may_become(old: Column, new: Column) -> Column:
    """Whether a status may turn into another one."""
    legal = [F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, into in TRANSITIONS.items() for b in into]
    return F.array_contains(F.array(*legal), F.struct(old.alias("old"), new.alias("new")))


def suspicious(content: Column) -> Column:
    """Markers of a rule that deserve a look: URL, pipe-to-shell."""
    shells = "|".join(sorted(PIPE_SHELLS, key=len, reverse=True))
    pipe = content.rlike(rf"(?<!\|)\|(?!\s*\|)\s*({shells})(?![\p{{L}}\p{{N}}_])")
    url = content.contains("http://") | content.contains("https://")
    return F.array_compact(F.array(F.when(url, F.lit("URL")), F.when(pipe, F.lit("pipe-to-shell"))))


def cold_start_score(confidence: Column, accesses: Column, age_days: Column, c=DEFAULT) -> Column:
    recency = F.coalesce(F.pow(F.lit(2.0), -age_days / c.half_life_days), F.lit(0.0))
    return c.score_importance * confidence + c.score_frequency * F.ln(accesses + 1.0) + c.score_recency * recency
