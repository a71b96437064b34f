"""The query surface over a small tree on disk."""

import pytest

from graphloom.project import Project

TREE = {
    "app/main.py": '''
from app.utils import helper_function, format_output
from app.models import User, Product

def process_data(items):
    """Process all the data items of a batch."""
    return transform(validate(items)), format_output(items)

def validate(items):
    return items

def transform(items) -> list:
    return items

class DataProcessor:
    def run(self):
        return process_data(self.items)

    def run_cached(self):
        return self.run()
''',
    "app/utils.py": '''
def helper_function():
    pass

def format_output(x) -> str:
    return str(x)

def merge_dicts(a, b):
    return merge_dicts(b, a)
''',
    "app/models.py": '''
class User:
    def is_admin(self):
        return True

class Product:
    def add_tag(self, tag):
        return tag

class BaseHandler:
    def handle(self):
        pass

class HTTPHandler(BaseHandler):
    def handle(self):
        pass

class APIHandler(HTTPHandler):
    def handle(self):
        pass

default_user = User()
''',
    "app/__init__.py": "",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, body in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return Project(spark, str(root))


def base(path):
    return path.rsplit("/", 1)[1]


def test_relations(project):
    assert {(base(r.importer), base(r.target)) for r in project.import_edges().collect()} == {("main.py", "utils.py"), ("main.py", "models.py")}
    assert {r.name for r in project.symbol_imports().collect()} == {"helper_function", "format_output", "User", "Product"}
    got = {(r.callee, r.caller) for r in project.caller_edges().collect()}
    assert {("validate", "process_data"), ("process_data", "run"), ("merge_dicts", "merge_dicts")} <= got


def test_structure(project):
    s = project.get_project_skeleton()
    total = s["stats"].filter("language is null").first()
    assert (total.n_files, total.n_functions, total.n_classes) == (4, 6, 6)
    assert s["tree"].count() == 1 and s["hints"].count() == 1
    m = project.get_module_context("app", detail="signatures")
    assert m["files"].count() == 3 and "source" not in m["functions"].columns
    f = project.get_file_context("models.py")
    assert f["importers"].count() == 1 and f["symbols"].filter("kind = 'class'").count() == 5


def test_symbols(project):
    f = project.get_function_context("process_data")
    assert f["matches"].count() == 1 and {r.caller for r in f["callers"].collect()} == {"run"}
    assert {r.callee for r in f["calls"].collect()} == {"transform", "validate", "format_output"}
    c = project.get_class_context("User")
    assert c["usages"].count() == 2 and c["methods"].count() == 1
    assert [(r.node, r.depth) for r in project.get_subclasses("BaseHandler").orderBy("depth").collect()] == [("HTTPHandler", 1), ("APIHandler", 2)]
    g = project.get_call_graph("run_cached", 3, include_builtins=True)
    assert {r.node for r in g["calls"].collect()} == {"run", "process_data", "transform", "validate", "format_output"}
    d = project.get_dependency_graph("process_data")
    assert {r.node for r in d["depends_on"].collect()} == {"transform", "validate", "format_output"} and d["used_by"].count() == 1


def test_unused_and_conventions(project):
    unused = {r.name for r in project.get_unused_symbols().collect()}
    assert {"is_admin", "add_tag"} <= unused and "process_data" not in unused and "validate" not in unused
    assert {r.name for r in project.get_unused_symbols("classes").collect()} == {"DataProcessor", "APIHandler"}
    found = {r.pattern for r in project.get_conventions().collect()}
    assert "classes: PascalCase" in found and any(p.startswith("python: snake_case") for p in found)


def test_search(project):
    rows = project.find_related_code("process data batch", 8).orderBy("place").collect()
    assert rows and rows[0].name == "process_data"
    assert base(project.find_related_files("http handler models").first().path) == "models.py"
    project.refresh()
    assert project.files.count() == 4
