"""Source trees as tables: files, functions, classes, imports, calls, object literals, manifests."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.functions import paths

PARAM = "array<struct<name:string,type:string,default:string>>"
SYMBOLS = (
    "kind string, name string, class_name string, file string, line int, docstring string, is_async boolean, return_type string, "
    f"params {PARAM}, decorators array<string>, bases array<string>, calls array<string>, source string, error string"
)
RESERVED = {"if", "for", "while", "switch", "catch", "function"}


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, language, source of the tree's source files outside ignored directories, by any file system Spark reads."""
    rows = _seen(spark, root).unionByName(_unseen(spark, root))
    hidden = F.exists(paths.parts("path"), lambda p: p.startswith(".") & (F.length(p) > 1))
    return rows.withColumn("language", paths.language("path")).filter("language is not null").filter(~paths.is_ignored("path") & ~hidden)


def _seen(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{py,pyi,ts,tsx,js,jsx}").load(root)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("content").cast("string").alias("source"))


def _unseen(spark: SparkSession, root: str) -> DataFrame:
    """Files whose names begin with an underscore, which Spark's readers pass over (`__init__.py`). Only their names are
    listed here; executors read them."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    listing = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while listing.hasNext():
        path = listing.next().getPath()
        name = path.getName()
        if name.startswith("_") and name.rpartition(".")[2] in paths.LANGUAGES:
            found.append((path.toString(),))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            texts = []
            for path in pdf["path"]:
                system, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                with system.open_input_stream(inner) as f:
                    texts.append(f.read().decode("utf-8", "replace"))
            yield pd.DataFrame({"path": [re.sub("^file:/*", "/", p) for p in pdf["path"]], "source": texts})

    listed = spark.createDataFrame(found, "path string")
    return listed.mapInPandas(read, "path string, source string")


def languages(tree: DataFrame, least: int = 2) -> DataFrame:
    """Languages with two or more files; JavaScript counts as TypeScript."""
    name = F.when(F.col("language") == "javascript", "typescript").otherwise(F.col("language"))
    return tree.groupBy(name.alias("language")).agg(F.count("*").alias("n_files")).filter(F.col("n_files") >= least)


def _text(node) -> str | None:
    return ast.unparse(node) if node is not None else None


def _called(node) -> list[str]:
    out = []
    for x in ast.walk(node):
        if isinstance(x, ast.Call):
            f = x.func
            out.append(f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None)
    return [x for x in out if x]


def _function(node, owner: str | None, file: str, text: str) -> dict:
    args = node.args
    names = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(names) - len(args.defaults)) + list(args.defaults)
    pairs = [*zip(names, defaults, strict=True), *zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    return {
        "kind": "function" if owner is None else "method", "name": node.name, "class_name": owner, "file": file, "line": node.lineno,
        "docstring": ast.get_docstring(node), "is_async": isinstance(node, ast.AsyncFunctionDef), "return_type": _text(node.returns),
        "params": [{"name": a.arg, "type": _text(a.annotation), "default": _text(d)} for a, d in pairs],
        "decorators": ["@" + ast.unparse(d) for d in node.decorator_list], "bases": None, "calls": _called(node),
        "source": ast.get_source_segment(text, node), "error": None,
    }


def parse_python(file: str, text: str) -> list[dict]:
    """Rows of a module; a file that does not parse gives one row with its error."""
    blank = dict.fromkeys(x.split()[0] for x in re.sub(r"<[^ ]*>", "", SYMBOLS.replace("array<struct<name:string,type:string,default:string>>", "array")).split(", "))
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return [blank | {"kind": "error", "file": file, "error": str(e)}]
    out = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(_function(node, None, file, text))
        elif isinstance(node, ast.ClassDef):
            out.append(blank | {
                "kind": "class", "name": node.name, "file": file, "line": node.lineno, "docstring": ast.get_docstring(node),
                "decorators": ["@" + ast.unparse(d) for d in node.decorator_list], "bases": [ast.unparse(b) for b in node.bases],
                "source": ast.get_source_segment(text, node),
            })
            out += [_function(m, node.name, file, text) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            out.append(blank | {"kind": "import", "file": file, "line": node.lineno, "source": ast.unparse(node)})
    return out


def symbols(tree: DataFrame) -> DataFrame:
    """Parsed Python files; executors parse, nothing is gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [re.match(r"\w+", x)[0] for x in re.sub(r"<.*?>>?", "", SYMBOLS).split(", ")]
        for pdf in batches:
            rows = [r for f, s in zip(pdf["path"], pdf["source"], strict=True) for r in parse_python(f, s)]
            yield pd.DataFrame(rows, columns=names)

    return tree.filter("language = 'python'").select("path", "source").mapInPandas(run, SYMBOLS)


def _skip(text: str, i: int) -> int:
    """Position behind the string or comment that starts at i, or i."""
    c = text[i]
    if c in "'\"`":
        j = i + 1
        while j < len(text) and text[j] != c:
            j += 2 if text[j] == "\\" else 1
        return min(j + 1, len(text))
    if text.startswith("//", i):
        j = text.find("\n", i)
        return len(text) if j < 0 else j
    if text.startswith("/*", i):
        j = text.find("*/", i + 2)
        return len(text) if j < 0 else j + 2
    return i


def matching(text: str, start: int, opening: str = "{", closing: str = "}") -> int:
    """Position of the bracket that closes the one at start, or -1; strings and comments do not count."""
    depth, i = 0, start
    while i < len(text):
        j = _skip(text, i)
        if j > i:
            i = j
            continue
        depth += (text[i] == opening) - (text[i] == closing)
        if depth == 0 and text[i] == closing:
            return i
        i += 1
    return -1


_HEAD = re.compile(r"(?:(?:const|let|var)\s+(\w+)\s*(?::[^={]+)?=\s*|export\s+default\s*)\{")
_METHOD = re.compile(r"(?:async\s+)?(\w+)\s*(?:\([^)]*\)\s*\{|:\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*=>|\w+\s*=>))")


def object_methods(file: str, text: str) -> list[dict]:
    """Methods of object literals that are assigned to a name or exported."""
    out = []
    for head in _HEAD.finditer(text):
        start = head.end() - 1
        end = matching(text, start)
        if end < 0:
            continue
        i = start + 1
        while i < end:
            j = _skip(text, i)
            if j > i:
                i = j
            elif text[i] in "{([":
                close = matching(text, i, text[i], {"{": "}", "(": ")", "[": "]"}[text[i]])
                i = close + 1 if close > 0 else end
            else:
                m = _METHOD.match(text, i) if text[i].isalpha() and not (text[i - 1].isalnum() or text[i - 1] in "_$") else None
                if m and m[1] not in RESERVED and not m[1].startswith("_"):
                    out.append({"name": m[1], "parent": head[1] or "default", "file": file, "line": text.count("\n", 0, i) + 1, "source": text[i : min(end, i + 500)]})
                    i += len(m[1])
                else:
                    i += 1
    return out


def object_literals(tree: DataFrame) -> DataFrame:
    schema = "name string, parent string, file string, line int, source string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for f, s in zip(pdf["path"], pdf["source"], strict=True) for r in object_methods(f, s)]
            yield pd.DataFrame(rows, columns=["name", "parent", "file", "line", "source"])

    return tree.filter("language <> 'python'").select("path", "source").mapInPandas(run, schema)


@F.pandas_udf(StringType())
def script_params(source: pd.Series) -> pd.Series:
    """Text between the first parenthesis outside angle brackets and its counterpart."""

    def one(text):
        depth = 0
        for i, c in enumerate(text or ""):
            if c == "<":
                depth += 1
            elif c == ">" and depth:
                depth -= 1
            elif c == "(" and not depth:
                end = matching(text, i, "(", ")")
                return text[i + 1 : end].strip() if end > 0 else ""
        return ""

    return source.map(one)


def package_json_names(text: str) -> list[str]:
    try:
        spec = json.loads(text)
    except ValueError:
        return []
    return sorted({*spec.get("dependencies", {}), *spec.get("devDependencies", {})})


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_vectors(rows: DataFrame, path: str) -> None:
    """Vector cache, one partition for each (encoder, fingerprint)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("encoder", "fingerprint").parquet(path)
