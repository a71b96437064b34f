"""Path predicates and parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names and extensions.
IGNORED = [
    "node_modules", ".git", "__pycache__", ".venv", "venv", ".env", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", "egg-info", ".eggs", ".next", ".nuxt", "coverage", ".coverage", ".nyc_output",
]
TEST_DIRS = ["test", "tests", "spec", "specs", "testing", "__tests__", "load_tests", "__mocks__"]
SCORED_TEST_DIRS = ["test", "tests", "load_tests", "__tests__", "spec", "specs", "__mocks__"]
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}
WEB = ("typescript", "javascript")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parts(c) -> Column:
    return F.split(F.regexp_replace(_col(c), r"\\", "/"), "/")


def is_ignored(c) -> Column:
    return F.arrays_overlap(parts(c), F.array(*[F.lit(x) for x in IGNORED]))


def is_test(c) -> Column:
    return F.arrays_overlap(parts(F.lower(_col(c))), F.array(*[F.lit(x) for x in TEST_DIRS]))


def is_migration(c) -> Column:
    return _col(c).contains("/alembic/versions/") | _col(c).contains("/migrations/")


def language(c) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(names, F.lower(F.regexp_extract(_col(c), r"\.([^./]+)$", 1)))


def family(lang) -> Column:
    return F.when(_col(lang).isin(*WEB), F.lit("web")).otherwise(_col(lang))


def basename(c) -> Column:
    return F.substring_index(_col(c), "/", -1)


def directory(c) -> Column:
    return F.regexp_replace(_col(c), "/?[^/]*$", "")


def suffixes(c, most: int | None = None) -> Column:
    """All path suffixes, the longest first; most: the number of components at most."""
    p = F.filter(parts(c), lambda x: x != "")
    n = F.size(p)
    depth = n if most is None else F.least(n, F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(depth, F.lit(1)), lambda k: F.array_join(F.slice(p, n - k + 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def translate(c, mirror: str, original: str) -> Column:
    """Swap the mirror's prefix for the original one, with forward slashes."""
    s = F.regexp_replace(_col(c), r"\\", "/")
    return F.when(s.startswith(mirror), F.concat(F.lit(original), F.substring(s, len(mirror) + 1, 2**30))).otherwise(s)


def resolve(c, root: str) -> Column:
    return F.when(_col(c).startswith("/"), _col(c)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), _col(c)))
