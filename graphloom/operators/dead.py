"""Unused functions and classes: a chain of anti-joins, the cheap ones first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import paths

# Names and bases that frameworks and runtimes reach by themselves.
ENTRY_POINTS = ["main", "__main__"]
LIFECYCLE = [
    "setUp", "tearDown", "setUpClass", "tearDownClass", "setUpModule", "tearDownModule", "asyncSetUp", "asyncTearDown",
    "constructor", "toString", "valueOf", "toJSON", "dispatch",
    "render", "componentDidMount", "componentDidUpdate", "componentWillUnmount", "shouldComponentUpdate",
    "getDerivedStateFromProps", "getSnapshotBeforeUpdate", "componentDidCatch", "getDerivedStateFromError",
    "ngOnInit", "ngOnDestroy", "ngOnChanges", "ngDoCheck", "ngAfterContentInit", "ngAfterContentChecked", "ngAfterViewInit", "ngAfterViewChecked",
    "created", "mounted", "updated", "destroyed", "unmounted", "beforeCreate", "beforeMount", "beforeUpdate", "beforeDestroy", "beforeUnmount", "setup",
]
FRAMEWORK_DECORATORS = [
    "property", "cached_property", "staticmethod", "classmethod", "abstractmethod", "overload", "override", "deprecated",
    "route", "get", "post", "put", "delete", "patch", "api_view", "action", "websocket", "exception_handler", "middleware",
    "fixture", "parametrize", "mark", "receiver", "on_event", "listener", "handler", "hook", "subscriber", "callback", "lifespan",
    "command", "group", "argument", "option", "tool", "validator", "root_validator", "field_validator", "model_validator",
    "field_serializer", "model_serializer", "computed_field", "depends", "task", "shared_task", "periodic_task", "serializer_method",
    "component", "injectable", "directive", "pipe", "ngmodule", "input", "output", "hostlistener", "hostbinding", "controller",
    "module", "guard", "useguards", "useinterceptors", "entity", "column", "primarygeneratedcolumn", "manytoone", "onetomany",
    "manytomany", "observable", "computed",
]
FRAMEWORK_BASES = [
    "BaseModel", "BaseSettings", "GenericModel", "RootModel", "Base", "DeclarativeBase", "DeclarativeBaseNoMeta", "Model", "View",
    "Serializer", "ModelSerializer", "Form", "ModelForm", "ModelAdmin", "AppConfig", "TestCase", "TransactionTestCase",
    "SimpleTestCase", "LiveServerTestCase", "Command", "BaseCommand", "BaseHTTPMiddleware", "FlaskForm", "Resource", "MethodView",
    "Schema", "Enum", "IntEnum", "StrEnum", "Flag", "IntFlag", "TypedDict", "NamedTuple", "Component", "PureComponent", "Pipe",
    "Directive", "BaseEntity", "Protocol", "ABC",
]
PLAIN_BASES = [
    "object", "type", "Exception", "BaseException", "Warning", "DeprecationWarning", "UserWarning", "FutureWarning", "RuntimeError",
    "ValueError", "TypeError", "KeyError", "AttributeError", "ImportError", "OSError", "IOError", "NotImplementedError", "Generic",
    "TypedDict", "NamedTuple", "Enum", "IntEnum", "StrEnum", "Flag", "IntFlag", "tuple", "list", "dict", "set", "frozenset", "str",
    "bytes", "int", "float", "bool", "complex",
]
ABSTRACT = ["Protocol", "ABC", "ABCMeta"]
HOOK_FILES = r"(_hooks?|_plugins?|_extensions?)\.py$|conftest\.py$"


def never_dead() -> F.Column:
    """What name and file alone decide. A dunder is always reached by the runtime."""
    name, file = F.col("name"), F.col("file")
    top = F.col("class_name").isNull()
    return (
        name.isin(LIFECYCLE) | name.rlike(r"^__\w+__$") | (top & (name.isin(ENTRY_POINTS) | file.endswith("/__main__.py")))
        | (top & file.rlike(HOOK_FILES)) | paths.is_migration("file")
    )


def framework_decorated(decorators: F.Column) -> F.Column:
    """Case-folded comparison of the last dotted part, on both sides, so that decorators written in mixed case count as their
    list entries are meant; `x.connect` counts too."""
    bare = lambda d: F.lower(F.substring_index(F.regexp_replace(F.regexp_replace(d, r"\(.*$", ""), "@", ""), ".", -1))
    return F.exists(decorators, lambda d: bare(d).isin(FRAMEWORK_DECORATORS) | d.rlike(r"\.connect(\(|$)"))


def unused_functions(
    functions: DataFrame, called: DataFrame, imported: DataFrame, mentions: DataFrame, exported: DataFrame, base_methods: DataFrame, include_tests: bool = False
) -> DataFrame:
    """functions: name, class_name, file, seq, decorators; called: name, class_name (surviving callers; class null for any);
    imported: name; mentions: name, file (call-like mentions in source); exported: name; base_methods: class_name, name
    (methods of an ancestor, or name null for ancestors outside the project). Adds re_exported."""
    rows = functions if include_tests else functions.filter(~paths.is_test("file"))
    rows = rows.filter(~never_dead()).filter(~framework_decorated(F.col("decorators")))
    any_call = called.select("name").distinct()
    rows = rows.join(imported.select("name").distinct().join(any_call, "name", "left_semi"), "name", "left_anti")
    plain = rows.filter("class_name is null").join(any_call, "name", "left_anti")
    methods = rows.filter("class_name is not null").join(called.select("name", "class_name").distinct(), ["name", "class_name"], "left_anti")
    rows = plain.unionByName(methods)
    # Mentions in another file: more than one file, or one that is not the function's own.
    seen = mentions.groupBy("name").agg(F.count_distinct("file").alias("n"), F.min("file").alias("only"))
    rows = rows.join(seen, "name", "left").filter((F.col("n").isNull()) | ((F.col("n") == 1) & (F.col("only") == F.col("file")))).drop("n", "only")
    overrides = base_methods.filter("name is not null").select("class_name", "name").distinct()
    outside = base_methods.filter("name is null").select("class_name").distinct()
    rows = rows.join(overrides, ["class_name", "name"], "left_anti").join(outside, "class_name", "left_anti")
    flag = exported.select("name").distinct().withColumn("re_exported", F.lit(True))
    return rows.join(flag, "name", "left").withColumn("re_exported", F.coalesce("re_exported", F.lit(False)))


def unused_classes(classes: DataFrame, imported: DataFrame, called_methods: DataFrame, constructed: DataFrame, include_tests: bool = False) -> DataFrame:
    """classes: name, base, file; called_methods: class_name; constructed: name."""
    rows = classes if include_tests else classes.filter(~paths.is_test("file"))
    last = F.substring_index("base", ".", -1)
    rows = rows.filter(~paths.is_migration("file") & ~F.col("name").rlike("(Error|Exception)$") & ~F.coalesce(last.isin(FRAMEWORK_BASES), F.lit(False)))
    bases = classes.select(last.alias("name")).filter("name is not null").distinct()
    for gone in (imported.select("name"), bases, called_methods.select(F.col("class_name").alias("name")), constructed.select("name")):
        rows = rows.join(gone.distinct(), "name", "left_anti")
    return rows
