"""Scalar functions as column expressions; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {
    "python": "py pyi", "javascript": "js jsx mjs cjs", "typescript": "ts tsx", "java": "java", "go": "go", "rust": "rs",
    "c": "c h", "cpp": "cc cpp cxx hpp hh", "csharp": "cs", "ruby": "rb", "php": "php", "swift": "swift", "kotlin": "kt kts",
    "scala": "scala sc", "bash": "sh bash", "r": "r", "dart": "dart", "sql": "sql",
}
LANG_GROUPS = {"javascript": "js", "typescript": "js", "c": "c", "cpp": "c", "java": "jvm", "kotlin": "jvm"}


def language_of(path: Column) -> Column:
    """Language by extension, case ignored; null when unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts.split() for x in (e, lang)]
    return F.create_map(*pairs)[ext]


def lang_group(language: Column) -> Column:
    pairs = [F.lit(x) for kv in LANG_GROUPS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[language], language)


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))


def split_identifier(name: Column) -> Column:
    """camelCase and snake_case parts, lower case."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\W]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " +"), lambda x: F.length(x) > 1)


def shingles(tokens: Column, k: int = 3) -> Column:
    """Space-joined windows of ``k`` tokens, repeats kept; empty below ``k`` tokens.

    The windows are zipped from ``k`` shifted slices: ``tokens`` is evaluated a few times
    and never inside a lambda, where it would run once an element.
    """
    n = F.greatest(F.size(tokens) - (k - 1), F.lit(0))
    rows = F.arrays_zip(*[F.slice(tokens, j + 1, n) for j in range(k)])
    return F.transform(rows, lambda x: F.concat_ws(" ", *[x[str(j)] for j in range(k)]))


KEYWORDS = (
    "def class return if else elif for while try except finally import from as with lambda yield function var let const new this "
    "public private protected static void int string bool float double fn func fun struct enum impl trait interface match switch case break continue"
).split()


def normalise_token(token: Column) -> Column:
    """$STR, $NUM, $ID; keywords and signs stay."""
    return (
        F.when(token.rlike("^[\"'`]"), "$STR").when(token.rlike(r"^[0-9]"), "$NUM").when(token.isin(*KEYWORDS), token)
        .when(token.rlike(r"^[A-Za-z_]\w*$"), "$ID").otherwise(token)
    )


def code_tokens(source: Column) -> Column:
    """Quoted strings, numbers, names and signs of a source text."""
    pattern = r"\"[^\"\n]*\"|'[^'\n]*'|[A-Za-z_]\w*|[0-9][\w.]*|[^\s\w]"
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two word arrays; zero when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [-1, 1]; zero for vectors of different or no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    scale = norm(a) * norm(b)
    ok = (F.size(a) == F.size(b)) & (scale > 0)
    return F.when(ok, F.greatest(F.least(dot / scale, F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(0.0))


def stable_id(*parts: Column) -> Column:
    """A content-derived node id, the same on every run."""
    return F.xxhash64(*parts)
