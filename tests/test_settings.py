import pytest
from conftest import dicts

from annalist.operators import settings


def history(make_history, path, before, after):
    return make_history(
        commits=[("c", "A", 5, "msg", 1)], file_versions=[("c", path, before, after)],
    )


def config(make_history, path, before, after):
    rows = dicts(settings.config_changes(history(make_history, path, before, after)))
    return sorted((r["key_path"], r["change_type"], r["old_value"], r["new_value"]) for r in rows)


def deps(make_history, path, before, after):
    rows = dicts(settings.dependency_changes(history(make_history, path, before, after)))
    return sorted((r["package"], r["change_type"], r["old_version"], r["new_version"]) for r in rows)


def added(make_history, path, content):
    return {p: v for p, _, _, v in deps(make_history, path, "", content)}


def test_flatten(make_history):
    got = config(make_history, "x.json", "", '{"a": {"b": {"c": 42}}, "tags": [1, 2, 3], "t": true, "n": null, "f": 1.0, "e": {}}')
    assert got == [
        ("a.b.c", "added", None, "42"), ("f", "added", None, "1.0"), ("n", "added", None, "null"),
        ("t", "added", None, "True"), ("tags", "added", None, "[1, 2, 3]"),
    ]


def test_diff(make_history):
    assert config(make_history, "x.json", '{"a":1,"b":2,"c":3}', '{"a":1,"b":99,"d":4}') == [
        ("b", "modified", "2", "99"), ("c", "deleted", "3", None), ("d", "added", None, "4"),
    ]
    assert config(make_history, "x.json", "42", '{"a": 1}') == [("a", "added", None, "1")]
    assert config(make_history, "x.json", '{"a": 1}', "[1, 2, 3]") == [("a", "deleted", "1", None)]
    assert config(make_history, "x.json", "{broken", "") == []
    assert config(make_history, "x.txt", "", '{"a": 1}') == []


def test_other_formats(make_history):
    assert config(make_history, "x.toml", "", "[a]\nk = 5\n") == [("a.k", "added", None, "5")]
    pytest.importorskip("yaml")
    assert config(make_history, "x.yml", "a:\n  k: 5\n", "a:\n  k: 6\n") == [("a.k", "modified", "5", "6")]


def test_requirements(make_history):
    text = ("# comment\nrequests==2.28.0\nflask>=2.0\nnumpy\n\n-r base.txt\n--index-url https://x\nFlask_Login==0.6\n"
            "urllib3[secure]>=2.0\ngit+https://github.com/u/r.git\nhttps://x/y.whl\npinned==2.0  # why\nrange>=2.0,<3.0\n"
            "also broken\nnumpy>=1\n")
    assert added(make_history, "requirements-dev.txt", text) == {
        "requests": "==2.28.0", "flask": ">=2.0", "numpy": ">=1", "flask-login": "==0.6", "urllib3": ">=2.0",
        "pinned": "==2.0", "range": ">=2.0,<3.0",
    }


def test_package_json(make_history):
    text = '{"dependencies": {"react": "^18.0"}, "devDependencies": {"jest": "29", "react": "^17"}, "peerDependencies": []}'
    assert added(make_history, "web/package.json", text) == {"react": "^17", "jest": "29"}
    assert added(make_history, "package.json", "{broken") == {}


def test_pyproject(make_history):
    text = ('[project]\ndependencies = ["click>=8.0", "Rich", "uvicorn[standard]>=0.2"]\n'
            '[project.optional-dependencies]\ndev = ["pytest ~=7.0"]\n'
            '[tool.poetry.dependencies]\npython = "^3.10"\nDjango = "^4"\ncelery = {version = "5.1", extras = ["x"]}\n'
            'local = {path = "."}\n[tool.poetry.dev-dependencies]\nblack = "22"\n')
    assert added(make_history, "pyproject.toml", text) == {
        "click": ">=8.0", "rich": "*", "uvicorn": ">=0.2", "pytest": "~=7.0", "django": "^4", "celery": "5.1",
        "local": "*", "black": "22",
    }
    assert added(make_history, "pyproject.toml", "[broken") == {}


def test_cargo(make_history):
    text = '[dependencies]\nserde = "1.0"\ntokio = { version = "1", features = ["full"] }\n[build-dependencies]\ncc = "1"\n'
    assert added(make_history, "Cargo.toml", text) == {"serde": "1.0", "tokio": "1", "cc": "1"}


def test_go_mod(make_history):
    text = ("module x\n\ngo 1.20\n\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgithub.com/c/d v0.1 // indirect\n\t// only a comment\n)\n"
            "replace (\n\tgithub.com/q/r v1 => ./r\n)\nrequire github.com/e/f v2.0.0 // x\n")
    assert added(make_history, "go.mod", text) == {
        "github.com/a/b": "v1.2.3", "github.com/c/d": "v0.1", "github.com/e/f": "v2.0.0",
    }


def test_dependency_diff(make_history):
    assert deps(make_history, "requirements.txt", "a==1\nb==1\nd==1\n", "a==2\nc==1\nd==1\n") == [
        ("a", "bumped", "==1", "==2"), ("b", "removed", "==1", None), ("c", "added", None, "==1"),
    ]


def test_a_missing_yaml_reader_is_an_error(make_history, monkeypatch):
    monkeypatch.setattr(settings, "yaml", None)
    read = settings._config_leaves.func
    import pandas as pd

    with pytest.raises(RuntimeError, match="PyYAML"):
        read(pd.Series(["a: 1"]), pd.Series(["x.yaml"]))
    assert read(pd.Series(["", '{"a": 1}', "{broken"]), pd.Series(["x.yaml", "x.json", "y.json"])).tolist() == [[], [{"key": "a", "value": "1"}], []]


def test_sides_are_compared_in_their_row(make_history):
    both = make_history(
        commits=[("c", "A", 5, "msg", 1)],
        file_versions=[("c", "go.mod", "", "require a v1\nrequire (\n b v2\n)\nc v3\n"), ("c", "requirements.txt", "x==1\nx==2", "x==2"),
                       ("c", "package.json", '{"dependencies": {"r": "1"}}', '{"dependencies": {"r": null}}'), ("c", "Cargo.toml", "[dependencies]\ns = '1'", None)],
    )
    rows = dicts(settings.dependency_changes(both))
    assert sorted((r["file_path"], r["package"], r["change_type"], r["new_version"]) for r in rows) == [
        ("Cargo.toml", "s", "removed", None), ("go.mod", "a", "added", "v1"), ("go.mod", "b", "added", "v2"), ("package.json", "r", "bumped", "None"),
    ]
    for changes in (settings.dependency_changes(both), settings.config_changes(both)):
        plan = changes._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Union" not in plan and plan.count("Join") == 1
