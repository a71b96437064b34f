"""Small golden cases: parsing, tokens, edges, callers, imports, dead code, conventions, change feed."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths, text
from graphloom.operators import callers, dead, edges, imports, learning, lookup, search, stats
from graphloom.sources import code
from graphloom.streaming import watch

PY = '''
import os
from utils import helper as h, other

class Base:
    """A base."""
    x = 1

class Child(Base):
    def run(self, n: int = 3, *, deep=False) -> str:
        """Run it."""
        return self.helper(n) + fmt(os.path.join("a"))

    async def helper(self, n):
        pass

@app.route("/x")
def view(request):
    return Child().run()
'''


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr).first()[0]


def test_parse_python():
    rows = {(r["kind"], r["name"]): r for r in code.parse_python("/p/a.py", PY)}
    run = rows["method", "run"]
    assert run["class_name"] == "Child" and run["return_type"] == "str" and run["docstring"] == "Run it."
    assert run["params"][1] == {"name": "n", "type": "int", "default": "3"} and set(run["calls"]) == {"helper", "fmt", "join"}
    assert rows["class", "Child"]["bases"] == ["Base"] and rows["method", "helper"]["is_async"]
    assert rows["function", "view"]["decorators"] == ["@app.route('/x')"]
    assert code.parse_python("/p/b.py", "def (")[0]["error"]


def test_source_tree(spark, tmp_path):
    for name, body in {"pkg/a.py": PY, "pkg/b.py": "x = 1", "web/c.ts": "const api = { go(a) { return '}' }, stop: () => 1, _no() {} }", "node_modules/d.js": "1", ".hid/e.py": "1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    tree = code.files(spark, str(tmp_path))
    assert tree.count() == 3
    assert {r.language: r.n_files for r in code.languages(tree).collect()} == {"python": 2}
    assert {r.name for r in code.object_literals(tree).collect()} == {"go", "stop"}
    assert code.symbols(tree).filter("kind = 'import'").count() == 2
    got = spark.createDataFrame([("function f<T extends (x: y) => z>(a: number, b: (c) => d): void {",)], "s string").select(code.script_params("s")).first()[0]
    assert got == "a: number, b: (c) => d"
    assert code.package_json_names(json.dumps({"dependencies": {"a": 1}, "devDependencies": {"b": 1}})) == ["a", "b"]


@pytest.mark.parametrize("name,tokens", [("getUserData", "get user data"), ("get_user_data", "get user data"), ("HTTPResponse", "http response"), ("src/a-b.py", "src a b py"), ("été_x", "été x")])
def test_split_tokens(spark, name, tokens):
    assert one(spark, text.split_tokens("s"), s=name) == tokens.split()


def test_source_tokens(spark):
    tokens = lambda s: one(spark, text.source_tokens("s"), s=s)
    assert {"process", "transform"} <= set(tokens("def process_data(items): return transform(items)"))
    assert {"text", "event", "stream"} <= set(tokens('content_type="text/event-stream"'))
    assert tokens("x = ab + cd") == [] and tokens("") == [] and tokens("self true none") == []


@pytest.mark.parametrize("a,b,same", [("send", "sending", True), ("store", "storing", True), ("permission", "permitted", True), ("execution", "executor", True), ("log", "logging", False), ("verify", "verification", False)])
def test_stem(spark, a, b, same):
    assert one(spark, text.stem_match("a", "b"), a=a, b=b) is same


def test_names_from_imports(spark):
    names = lambda s: one(spark, text.imported_names("s"), s=s)
    assert set(names("from utils import helper_a, helper_b as hb")) == {"helper_a", "helper_b", "hb"}
    assert set(names("import Main, { A as B, C } from './x'")) == {"Main", "A", "B", "C"} and names("from utils import *") == []


def functions(spark, rows):
    schema = "name string, class_name string, file string, source string, calls array<string>, return_type string, decorators array<string>, seq long"
    return spark.createDataFrame([(n, c, f, s, calls, ret, dec, i) for i, (n, c, f, s, calls, ret, dec) in enumerate(rows)], schema)


def test_edges(spark):
    f = functions(spark, [
        ("get_admin", None, "/a.py", "", [], None, []),
        ("list_users", None, "/a.py", "async def list_users(admin = Depends(get_admin)):\n  tool.run(1)", ["Depends", "run"], None, []),
        ("make", None, "/a.py", "", [], "Executor", []),
        ("run", "Executor", "/e.py", "", [], None, []),
        ("go", "Chat", "/c.py", "self.executor = Executor(config)\nself.executor.run(tools)", ["run"], None, []),
        ("local", None, "/c.py", "def local():\n    e = make()\n    e.run(2)\n    job.delay(1)", ["run"], None, []),
        ("job", None, "/t.py", "", [], None, ["@app.task(bind=True)"]),
    ])
    classes = spark.createDataFrame([("Executor",), ("Chat",)], "name string")
    methods = f.filter("class_name is not null").select("name", "class_name")
    key = lambda df: {(r.callee, r.caller) for r in df.collect()}
    first = {(r.callee, r.caller): (r.receivers, r.has_dot) for r in edges.primary(f).collect()}
    assert first["run", "list_users"] == (["tool"], True) and first["Depends", "list_users"] == ([], False)
    assert key(edges.references(f)) == {("get_admin", "list_users")}
    assert key(edges.typed_calls(f, classes, methods)) == {("run", "local")}
    assert key(edges.field_calls(f, methods)) == {("run", "go")}
    assert key(edges.dispatched(f)) == {("job", "local")}
    files = spark.createDataFrame([("/m.py", "executor = Executor(1)\nother = thing()\n  inner = Chat()")], "path string, source string")
    assert [tuple(r) for r in edges.class_instances(files, classes).collect()] == [("Executor", "executor", "/m.py")]
    web = functions(spark, [("reg", None, "/w.ts", "app.register('name', handle_it); on('other', not_this); const a = [app.first_fn, last_fn]; <Panel/>; x = {key: api.prop_fn}", [], None, [])])
    names = spark.createDataFrame([("handle_it",), ("first_fn",), ("not_this",), ("prop_fn",)], "name string")
    tags = spark.createDataFrame([("Panel",), ("prop_fn",)], "name string")
    assert {c for c, _ in key(edges.framework_references(web, names, tags))} == {"handle_it", "Panel", "first_fn", "prop_fn"}


def test_field_types(spark):
    f = functions(spark, [
        ("__init__", "A", "/a.py", "    self.one = Tool()\n    self.two: Chat = x\n    self.three = await make()\n    self.one: Chat = y", [], None, []),
        ("go", "A", "/a.py", "    self.three = other()\n    self.body.run()", [], None, []),
    ])
    made = spark.createDataFrame([("make", "Exec"), ("other", "Tool")], "name string, type string")
    bodies = spark.createDataFrame([("A", "/a.py", "class A:\n    body: Exec\n    one: Exec = None\n")], "class_name string, file string, source string")
    found = {r["var"]: r.type for r in edges.field_types(f, made, bodies).collect()}
    assert found == {"one": "Chat", "two": "Chat", "three": "Exec", "body": "Exec"}
    assert {r["var"] for r in edges.field_types(f).collect()} == {"one", "two"}


def test_numbered(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 as x").repartition(9)
    got = search.numbered(rows, ["x"], "place").collect()
    assert sorted((r.x, r.place) for r in got) == [(i, i + 1) for i in range(1000)]


def test_callers_of_a_class(spark):
    e = spark.createDataFrame([("refresh", "handler", "/api.py", None, ["db"], True, False), ("refresh", "importer_func", "/consumer.py", None, ["database"], True, False)],
        "callee string, caller string, caller_file string, caller_class string, receivers array<string>, has_dot boolean, trusted boolean")
    m = spark.createDataFrame([("refresh", "Database", "/db.py"), ("refresh", "Router", "/r.py")], "name string, class_name string, file string")
    defs = spark.createDataFrame([("Database", "/db.py")], "class_name string, file string")
    i = spark.createDataFrame([("/consumer.py", "/db.py")], "importer string, target string")
    wanted = spark.createDataFrame([("refresh", "Database")], "callee string, class_name string")
    assert [r.caller for r in callers.class_callers(e, m, defs, i, wanted).collect()] == ["importer_func"]
    assert callers.plain_callers(e, m).count() == 0
    assert one(spark, callers.receiver_token(F.array(F.lit("self.a.b"), F.lit("self"), F.lit("z"))), x=1) == "a"


def test_subclasses(spark):
    rows = [("BaseHandler", None), ("HTTPHandler", "BaseHandler"), ("WebSocketHandler", "web.BaseHandler"), ("APIHandler", "HTTPHandler"), ("A", "B"), ("B", "A")]
    c = spark.createDataFrame(rows, "name string, base string")
    assert callers.subclass_paths(c, "BaseHandler", 3).count() == 3 and callers.subclass_paths(c, "BaseHandler", 1).count() == 2
    assert callers.subclass_paths(c, "APIHandler", 3).count() == 0 and callers.subclass_paths(c, "Nope", 3).count() == 0
    assert callers.subclass_paths(c, "A", 5).count() == 1
    assert {(r.name, r.ancestor) for r in callers.ancestors(c).collect()} >= {("APIHandler", "BaseHandler"), ("A", "A")} - {("A", "A")}


def test_trees_and_dependencies(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "print"), ("c", "a"), ("a", "ext")], "src string, dst string")
    assert {(r.parent, r.node, r.depth) for r in callers.call_tree(e, "a", 3, ["print"]).collect()} == {("a", "b", 1), ("a", "ext", 1), ("b", "c", 2), ("c", "a", 3)}
    project = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    nodes, outside = callers.forward_dependencies(e, project, "a", 2)
    assert {r.node for r in nodes.collect()} == {"b", "c"} and outside.first().externals == 2


def test_import_resolution(spark):
    files = spark.createDataFrame([("/p/main.py", 0), ("/p/utils.py", 1), ("/p/helpers.tsx", 2), ("/p/helpers.py", 3), ("/p/pkg/__init__.py", 4), ("/p/pkg/impl.py", 5), ("/q/utils.py", 6)], "path string, seq long")
    table = imports.suffix_table(files)
    s = spark.createDataFrame([("/p/main.py", 0, "utils"), ("/p/main.py", 1, "helpers"), ("/p/main.py", 2, "nothing")], "importer string, imp int, module string")
    assert {r.imp: r.target for r in imports.resolve(imports.module_candidates(s), table).collect()} == {0: "/p/utils.py", 1: "/p/helpers.py"}
    rel = spark.createDataFrame([("/p/pkg/__init__.py", 0, 1, "impl"), ("/p/pkg/impl.py", 1, 2, "utils")], "importer string, imp int, dots int, rest string")
    assert {r.imp: r.target for r in imports.relative_target(rel, table).collect()} == {0: "/p/pkg/impl.py", 1: "/p/utils.py"}
    si = spark.createDataFrame([("/p/main.py", "/p/pkg/__init__.py", "Service"), ("/p/main.py", "/p/pkg/__init__.py", "impl")], "importer string, target string, name string")
    ex = spark.createDataFrame([("/p/pkg/__init__.py", "Service", "/p/pkg/impl.py", 0)], "init string, name string, source string, prio int")
    assert [tuple(r) for r in imports.through_reexports(si, ex).collect()] == [("/p/main.py", "/p/pkg/impl.py")]
    assert [tuple(r) for r in imports.submodules(si, table).collect()] == [("/p/main.py", "/p/pkg/impl.py")]
    lines = spark.createDataFrame([("requirements", "Flask>=2"), ("requirements", "# x"), ("pyproject", 'deps = ["a-b>=1", "c"]')], "kind string, text string")
    assert {r.name for r in imports.external_packages(lines).collect()} == {"flask", "a_b", "c"}


def test_unused(spark):
    f = functions(spark, [
        ("used", None, "/a.py", "", [], None, []), ("alone", None, "/a.py", "", [], None, []), ("main", None, "/a.py", "", [], None, []),
        ("view", None, "/a.py", "", [], None, ["@router.get('/x')"]), ("__len__", "K", "/a.py", "", [], None, []), ("t", None, "/tests/a.py", "", [], None, []),
        ("over", "K", "/a.py", "", [], None, []), ("plain", "L", "/a.py", "", [], None, []), ("texted", None, "/a.py", "", [], None, []),
    ])
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = dead.unused_functions(f, frame([("used", None)], "name string, class_name string"), frame([], "name string"), frame([("texted", "/b.py"), ("alone", "/a.py")], "name string, file string"),
        frame([("alone",)], "name string"), frame([("K", "over")], "class_name string, name string"))
    assert {(r.name, r.re_exported) for r in out.collect()} == {("alone", True), ("plain", False)}
    c = frame([("A", None, "/a.py"), ("B", "A", "/a.py"), ("MyError", None, "/a.py"), ("M", "BaseModel", "/a.py")], "name string, base string, file string")
    assert [r.name for r in dead.unused_classes(c, frame([], "name string"), frame([], "class_name string"), frame([], "name string")).collect()] == ["B"]


def test_lookup(spark):
    f = functions(spark, [("send", "Bus", "/tests/b.py", "", [], None, []), ("send", "Bus", "/b.py", "", [], None, []), ("send_event", None, "/c.py", "", [], None, [])])
    assert [r.file for r in lookup.by_name(f, "Bus.send").collect()] == ["/b.py", "/tests/b.py"]
    assert lookup.symbol(f, f.filter("false"), "send").first().file == "/tests/b.py"
    assert lookup.truncate({"a": list(range(20_000))}, 100)["_a_total"] == 20_000
    with pytest.raises(ValueError):
        lookup.detail(f, "everything")
    assert one(spark, paths.translate(F.lit("/m/x\\y.py"), "/m", "C:"), x=1) == "C:/x/y.py"


def test_weights_and_vectors(spark):
    assert one(spark, stats.ndcg_at(F.lit(3), 10), x=1) == 0.5 and one(spark, stats.mrr_at(F.lit(11), 10), x=1) == 0.0
    runs = spark.createDataFrame([("a", ["b", "a"], 5.0), ("c", ["x"], 7.0)], "expected string, ranked array<string>, latency double")
    r = stats.retrieval_metrics(runs).first()
    assert (r.ndcg, r.mrr, r.p50, r.n) == (0.315465, 0.25, 6.0, 2)
    low = search.low_confidence(spark.createDataFrame([(0.5,), (0.1,)], "score double"))
    assert low.filter("low_confidence").count() == 2


def test_network_learns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    model = learning.Mlp.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), epochs=40)
    assert ((model(x) > 0.5) == (x[:, 0] + x[:, 1] > 0)).mean() > 0.95
    rows = spark.createDataFrame([(x[i].tolist(),) for i in range(20)], "features array<double>")
    assert np.allclose([r.score for r in learning.predict(rows, model).collect()], model(x[:20]))
    assert learning.weights_table(spark, "m", model).count() == 3


def test_debounce_as_a_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    events = [("10:00:00", "/a.py"), ("10:00:01", "/b.py"), ("10:00:02.5", "/a.py"), ("10:00:09", "/c.py"), ("10:01:00", "/d.py"), ("10:00:01", "/x.txt")]
    (src / "1.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T{t}Z", "type": "modified", "path": p}) for t, p in events))
    stream = watch.debounced(watch.with_watermark(watch.relevant(watch.source(spark, str(src)))))
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.read.parquet(str(out)).collect()) == [1, 3]
    seen = []
    q = watch.refresh(watch.source(spark, str(src)), lambda c: seen.extend(r.path for r in c.collect()), str(tmp_path / "ck2"))
    q.awaitTermination(120)
    assert sorted(seen) == ["/a.py", "/b.py", "/c.py", "/d.py"]
