"""Scalar functions on names, source text and import statements, as Columns inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the tokenizers.
STOP_WORDS = [
    "a", "an", "the", "for", "to", "in", "of", "on", "at", "by",
    "is", "it", "or", "and", "as", "if", "do", "so", "no", "up",
    "be", "we", "he", "me", "my", "us", "am",
]
CODE_STOP_WORDS = [
    "return", "self", "cls", "def", "class", "elif", "while", "try", "except", "finally", "with", "import",
    "from", "pass", "break", "continue", "yield", "raise", "lambda", "none", "true", "false", "not",
    "const", "let", "var", "function", "new", "this", "typeof", "instanceof", "void", "null", "undefined", "async",
    "await", "export", "default", "extends", "implements",
    "print", "log", "error", "string", "number", "boolean", "type", "interface", "enum", "dict", "list", "tuple",
    "int", "float", "str", "bool", "any", "object", "get", "set", "has", "can", "key", "val", "value",
    "args", "kwargs", "param", "params", "result", "data",
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c, f) -> Column:
    """f of a variable that holds c: a lambda inside f would work out c itself again for every element."""
    return F.transform(F.array(_col(c)), f)[0]


def split_tokens(c) -> Column:
    """T1: words of an identifier or path; camel case and acronyms split, digits stay attached."""
    s = F.regexp_replace(_col(c), r"(?U)[_\-.\s/\\]+", " ")
    s = F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(s), r"(?U)\s+"), lambda x: x != "")


def short_tokens(c) -> Column:
    """T2: alphanumeric words of two or more characters; acronyms stay whole."""
    s = F.lower(F.regexp_replace(_col(c), "([a-z0-9])([A-Z])", "$1_$2"))
    return F.filter(F.split(s, "[^a-zA-Z0-9]+"), lambda x: F.length(x) >= 2)


def source_tokens(c) -> Column:
    """T3: tokens of identifiers, then words of quoted strings; three or more characters, no stop words; repeats stay."""
    text = F.coalesce(_col(c), F.lit(""))
    # Split all identifiers in one string: nothing that splits them reaches over a space.
    names = split_tokens(F.array_join(F.regexp_extract_all(text, F.lit("([a-zA-Z_][a-zA-Z0-9_]{2,})"), 1), " "))
    quoted = F.regexp_extract_all(text, F.lit("[\"']([^\"']{3,})[\"']"), 1)
    words = F.flatten(F.transform(quoted, lambda q: F.transform(F.regexp_extract_all(q, F.lit("([a-zA-Z]{3,})"), 1), F.lower)))
    return F.filter(F.concat(names, words), lambda x: (F.length(x) >= 3) & ~x.isin(STOP_WORDS + CODE_STOP_WORDS))


def query_tokens(c) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(split_tokens(c), lambda x: ~F.array_contains(stop, x))


def stem_match(a, b) -> Column:
    """Morphological variants share a long prefix. Positives always share four characters (the join key)."""
    a, b = _col(a), _col(b)
    m, w = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    k = F.greatest(F.lit(4), m - 1)
    near = (w - m <= 3) & (F.left(a, k) == F.left(b, k))
    return (m >= 4) & (near | ((m >= 7) & (F.left(a, F.lit(5)) == F.left(b, F.lit(5)))))


def bigrams(c) -> Column:
    """Distinct letter pairs of the lower-cased letters."""
    pairs = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
    some = lambda s: F.when(F.length(s) >= 2, F.array_distinct(pairs(s))).otherwise(F.array().cast("array<string>"))
    return bound(F.regexp_replace(F.lower(_col(c)), "[^a-z]", ""), some)


def jaccard(a, b) -> Column:
    a, b = _col(a), _col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def normalised(c) -> Column:
    """Lower-cased, trimmed, only a-z, 0-9 and spaces."""
    return F.regexp_replace(F.trim(F.lower(_col(c))), "[^a-z0-9 ]", "")


def marked_bigrams(c) -> Column:
    """All character pairs of the normalised text between ^ and $."""
    s = F.concat(F.lit("^"), normalised(c), F.lit("$"))
    return bound(s, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))


def shared_prefix(a, b) -> Column:
    """Number of leading equal components of two arrays."""
    same = F.zip_with(_col(a), _col(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("alive"))
    step = lambda s, x: F.struct((s["n"] + (s["alive"] & x).cast("int")).alias("n"), (s["alive"] & x).alias("alive"))
    return F.aggregate(same, start, step, lambda s: s["n"])


def first_sentence(c) -> Column:
    paragraph = F.split(F.trim(_col(c)), "\n\n")[0]
    flat = F.regexp_replace(paragraph, "[ \t\r\n]+", " ")
    return F.trim(F.substring_index(flat, ". ", 1))


def return_annotated(signature) -> Column:
    """Something is annotated behind the last parenthesis: `-> x` or `: x`."""
    tail = F.regexp_extract(_col(signature), r"([^)]*)$", 1)
    return tail.rlike(r"->\s*\S") | tail.rlike(r"^\s*:\s*[^=\s]")


def import_module(c) -> Column:
    """Module named by an import statement; '' where it is not a project module."""
    s = F.trim(_col(c))
    quoted = F.regexp_extract(s, "from\\s+['\"]([^'\"]+)['\"]", 1)
    required = F.regexp_extract(s, "require\\(\\s*['\"]([^'\"]+)['\"]", 1)
    script = F.when(quoted != "", quoted).otherwise(required)
    cleaned = F.regexp_replace(F.regexp_replace(script, r"^(@/|(\.\.?/)+)", ""), r"\.(tsx?|jsx?)$", "")
    local = script.rlike(r"^[.@]")
    python = F.when(s.rlike(r"^from\s+\."), F.lit("")).otherwise(
        F.coalesce(F.nullif(F.regexp_extract(s, r"^from\s+([\w.]+)\s+import", 1), F.lit("")), F.regexp_extract(s, r"^import\s+([\w.]+)", 1))
    )
    return F.when(script != "", F.when(local, cleaned).otherwise(F.lit(""))).otherwise(python)


def imported_names(c) -> Column:
    """Names that an import statement binds or takes; wildcards give none."""
    s = _col(c)
    braces = F.regexp_extract(s, r"\{([^}]*)\}", 1)
    default = F.regexp_extract(s, r"^import\s+(\w+)\s*(?:,|\s+from\s+['\"])", 1)
    python = F.regexp_extract(s, r"\bimport\s+([^{}'\"]+)$", 1)
    listed = F.when(braces != "", braces).otherwise(python)
    parts = F.flatten(F.transform(F.split(listed, ","), lambda p: F.split(F.trim(p), r"\s+as\s+")))
    names = F.concat(parts, F.array(default))
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x.rlike(r"(?U)^[^\W\d]\w*$")))


def soft_cap(c) -> Column:
    e = _col(c) - 0.85
    return F.when(e <= 0, _col(c)).otherwise(0.85 + 0.15 * e / (0.15 + e))


def sigmoid(c, clip: float = 20.0) -> Column:
    x = F.greatest(F.least(_col(c), F.lit(clip)), F.lit(-clip))
    return 1 / (1 + F.exp(-x))


def saturating(c, k: float) -> Column:
    return F.least(_col(c) / F.lit(float(k)), F.lit(1.0))
