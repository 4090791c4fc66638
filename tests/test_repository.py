"""From a scripted git repository to answers, and the renderers."""

from __future__ import annotations

import json
import os
import subprocess

import pytest

from loomgraph.plans import cli, evaluation
from loomgraph.plans.engine import AmbiguousTargetError, Engine, TargetNotFoundError
from loomgraph.render import reports, trees
from loomgraph.sources import config, extract
from loomgraph.sources.store import NoIndexError, Store

RUST = """use std::sync::Mutex;

fn gamma() -> u32 {
    // beta() in a comment
    7
}

fn beta() -> u32 {
    gamma()
}

fn alpha(m: &Mutex<u32>) -> u32 {
    let text = "gamma() in a string";
    let held = m.lock();
    for _ in 0..3 {
        beta();
    }
    gamma()
}
"""
SERVICE = """from store import load


class Service:
    def run(self, key):
        for item in load(key):
            self.handle(item)

    def handle(self, item):
        if item:
            return load(item)
        return None
"""


def commit(root, message):
    env = os.environ | {f"GIT_{w}_{k}": v for w in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "t"), ("EMAIL", "t@example.com"), ("DATE", "2024-01-01T00:00:00Z"))}
    for args in (["add", "-A"], ["commit", "-qm", message]):
        subprocess.run(["git", "-C", str(root), *args], check=True, env=env)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    subprocess.run(["git", "init", "-q", "-b", "main", str(root)], check=True)
    (root / "src").mkdir()
    for n in range(8):
        (root / "a.py").write_text(f"import b\n\n\ndef first():\n    return b.second({n})\n")
        if n < 3:
            (root / "b.py").write_text(f"def second(x):\n    return {n}\n")
        if n == 0:
            (root / "src/lib.rs").write_text(RUST)
            (root / "service.py").write_text(SERVICE)
            (root / "store.py").write_text("def load(key):\n    return [key]\n")
        commit(root, f"c{n}")
    engine = Engine(spark, root)
    engine.index(as_of="2024-01-11")
    return engine


def test_mined_history(engine):
    stats = {r["path"]: (r["churn"], r["age_days"]) for r in engine.file_stats().collect()}
    assert stats == {"a.py": (7, 10), "b.py": (2, 10)}  # the first commit counts for nothing
    assert [(r["partner"], r["support"]) for r in engine.coupled("a.py", support=2).collect()] == [("b.py", 2)]
    assert engine.hotspots(1).first()["path"] == "a.py"


def test_precision_of_sure_edges(engine):
    names = {r["id"]: r["name"] for r in engine.symbols().collect()}
    sure = {(names[r["from_id"]], names[r["to_id"]]) for r in engine.calls().where("confidence >= 0.7").collect()}
    assert {("alpha", "beta"), ("alpha", "gamma"), ("beta", "gamma")} <= sure
    assert sure <= {("alpha", "beta"), ("alpha", "gamma"), ("beta", "gamma"), ("first", "second"), ("run", "load"), ("run", "handle"), ("handle", "load")}


def test_patterns_and_queries(engine):
    alpha = engine.resolve("alpha")
    assert alpha["patterns"] == ["lock", "loop"] and engine.resolve("src/lib.rs:9")["name"] == "beta"
    assert {r["depth"] for r in engine.paths("alpha", 2).collect()} == {0, 1}
    assert engine.callers("load", 1).count() == 3
    assert [r["step"] for r in engine.path_to("first", "second").collect()] == [0, 1]
    assert engine.explain("alpha")["risk"] == "LOW"
    with pytest.raises(TargetNotFoundError):
        engine.resolve("nothing")
    assert {(r["section"], r["kind"]) for r in engine.smells().collect()} <= {("structural", "god_file"), ("semantic", "spawn_in_tight_loop")}
    shown = trees.tree([engine.tree("alpha", 3)])
    assert shown.startswith("alpha\n") and "beta" in shown and "gamma" in shown


def test_command_line(engine, capsys):
    def shown(*args):
        assert cli.main(["--repo", str(engine.root), *args]) == 0
        return capsys.readouterr().out

    assert shown("hotspots").split("\n")[0].endswith("a.py")
    found = json.loads(shown("-o", "json", "--depth", "1", "paths", "first"))
    assert found["query"]["target"] == "first" and found["root"]["children"][0]["name"] == "second" and not found["truncated"]["depth"]
    assert json.loads(shown("-o", "json", "--depth", "1", "paths", "run"))["truncated"]["depth"] is False
    assert "calls" in shown("-o", "mermaid", "paths", "first", "--to", "second")
    assert "path_depth" in shown("paths", "first", "--to", "second", "--analyze")
    assert "risk        LOW" in shown("explain", "alpha") and "a.py" in shown("map") and "a.py" in shown("age") and "b.py" in shown("coupled", "a.py", "--support", "2")
    assert "high_complexity" not in shown("smells")
    assert cli.main(["--repo", str(engine.root), "explain", "nothing"]) == 1


def test_incremental_equals_full(engine):
    before = sorted(map(str, engine.store.read("edges").collect()))
    stats = sorted(map(str, engine.store.read("git_stats").collect()))
    engine.index(as_of="2024-01-11")
    assert sorted(map(str, engine.store.read("edges").collect())) == before
    assert sorted(map(str, engine.store.read("git_stats").collect())) == stats


def test_new_commits_are_added(engine):
    (engine.root / "store.py").write_text("def load(key):\n    return [key, key]\n")
    (engine.root / "a.py").write_text("import b\n\n\ndef first():\n    return b.second(77)\n")
    commit(engine.root, "more")
    engine.index(as_of="2024-01-11")
    tables = ("git_stats", "cochange", "hunks", "symbols", "edges")
    added = {t: sorted(str(sorted(r.asDict().items())) for r in engine.store.read(t).collect()) for t in tables}
    engine.index(full=True, as_of="2024-01-11")
    assert added == {t: sorted(str(sorted(r.asDict().items())) for r in engine.store.read(t).collect()) for t in tables}
    assert {r["path"]: r["churn"] for r in engine.file_stats().collect()} == {"a.py": 8, "b.py": 2, "store.py": 1}


def test_callers_with_coupled_files(engine, capsys):
    assert cli.main(["--repo", str(engine.root), "callers", "first", "--coupled"]) == 0
    assert "changes together with" in capsys.readouterr().out
    assert cli.main(["skill"]) == 0
    assert "explain-pr" in capsys.readouterr().out


def test_packs_from_a_folder(tmp_path):
    (tmp_path / "lisp.toml").write_text("defs = [[\"function\", '\\\\(defun\\s+(\\w+)']]\npatterns = [[\"loop\", '\\\\(loop\\b']]\ncomment = ';[^\\n]*'\n".replace("\\\\", "\\"))
    got = extract.packs_from(tmp_path)
    parsed = got["lisp"]("(defun go (x)\n  (loop x)) ; (defun no ())\n")
    assert [d["name"] for d in parsed.defs] == ["go"] and [p["kind"] for p in parsed.patterns] == ["loop"] and "rust" in got


@pytest.mark.parametrize(("lang", "text", "names", "calls"), [
    ("rust", "impl<T> S<T> {\n    fn a(&self) {\n    }\n}\nfn b() {\n}\n", {("a", "method"), ("b", "function")}, set()),
    ("typescript", "const u = 'http://x'; foo();\n/* 'it */ bar(); // baz()\n", set(), {"foo", "bar"}),
    ("c", "int add(int a);\nint sub(int a) {\n  return add(a);\n}\n", {("add", "function"), ("sub", "function")}, {"add"}),
])
def test_details_of_packs(lang, text, names, calls):
    got = extract.EXTRACTORS[lang](text)
    assert {(d["name"], d["kind"]) for d in got.defs} == names and {c["callee"] for c in got.calls} == calls


def test_evaluation(spark, tmp_path):
    root = tmp_path / "work"
    (root / "src").mkdir(parents=True)
    (root / "src/pay.py").write_text("def charge(x):\n    return x\n")
    (root / "src/shop.py").write_text("from pay import charge\n\n\ndef buy():\n    return charge(1)\n")
    (root / "src/other.py").write_text("def rest():\n    return 0\n" * 40)
    wanted = {"src/pay.py", "src/shop.py"}
    skill, baseline = evaluation.with_index(Engine(spark, root), "charge", wanted), evaluation.without_index(Engine(spark, root), wanted)
    assert (skill["precision"], skill["recall"], skill["missed_callers"]) == (1.0, 1.0, []) and baseline["files_opened_count"] == 3 and baseline["bytes_read"] > skill["bytes_read"]
    evaluation.save(tmp_path, skill, 1)
    evaluation.save(tmp_path, baseline, 1)
    text = evaluation.table(evaluation.latest(tmp_path, "skill"), evaluation.latest(tmp_path, "baseline"))
    assert "PASS" in text and "FAIL" not in text and evaluation.compared(skill, baseline)["skill_passed"]
    for _ in range(2):
        evaluation.update(tmp_path / "doc.md", text)
    assert (tmp_path / "doc.md").read_text().count("Bytes saved") == 1


def test_diff_and_pr(engine):
    (engine.root / "b.py").write_text("def second(x):\n    return 99\n\n\ndef third():\n    return second(1)\n")
    marks = {r["name"]: r["mark"] for r in engine.diff().collect()}
    assert marks == {"second": "~"}
    subprocess.run(["git", "-C", str(engine.root), "checkout", "-qb", "work"], check=True)
    commit(engine.root, "work")
    assert "b.py" in engine.explain_pr("work")["changed"]
    assert "a.py" in reports.pull_request("work", "main", engine.explain_pr("work", support=2))
    assert engine.explain_pr("work", strength=0.5, support=2)["missed"] == [{"partner": "a.py", "strength": 1.0}]


def test_store_and_config(spark, tmp_path):
    with pytest.raises(NoIndexError):
        Store(spark, tmp_path).read("symbols")
    assert config.thresholds(tmp_path).complexity_high == 10
    (tmp_path / "thresholds.toml").write_text("[default]\ncomplexity_high = 4\n")
    (tmp_path / "smells.toml").write_text('[[rules]]\nname = "r"\ndescription = "d"\npatterns = ["lock"]\nseverity = "high"\n')
    assert config.thresholds(tmp_path).complexity_high == 4 and config.custom_rules(tmp_path) == [("r", ["lock"], "high")]
    (tmp_path / "smells.toml").write_text("not toml [")
    assert config.custom_rules(tmp_path) == []


def test_wrong_use_and_no_index(spark, tmp_path, capsys):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert cli.main(["--repo", str(tmp_path), "--weight", "diff", "age"]) == 2
    assert cli.main(["--repo", str(tmp_path), "age"]) == 4


@pytest.mark.parametrize(("lang", "text", "defs", "patterns"), [
    ("go", 'package m\nimport "sync"\nfunc (s *S) Do() {\n  s.mu.Lock()\n  go run()\n}\ntype S struct {\n}\n', {("Do", "method", 3, 6), ("S", "type", 7, 8)}, {"lock", "spawn"}),
    ("java", "class A {\n  void run() {\n    new Thread(r).start();\n  }\n}\n", {("A", "type", 1, 5), ("run", "method", 2, 4)}, {"alloc", "spawn"}),
    ("typescript", "const f = async (x) => {\n  await g(x);\n};\n", {("f", "function", 1, 3)}, {"await"}),
    ("ruby", "class A\n  def go\n    x.each do |y|\n    end\n  end\nend\n", {("A", "type", 1, 6), ("go", "method", 2, 5)}, {"loop"}),
    ("c", "int add(int a) {\n  return malloc(a);\n}\n", {("add", "function", 1, 3)}, {"alloc"}),
    ("bash", "run() {\n  ls\n}\n", {("run", "function", 1, 3)}, set()),
])
def test_packs(lang, text, defs, patterns):
    got = extract.EXTRACTORS[lang](text)
    assert {(d["name"], d["kind"], d["span_start"], d["span_end"]) for d in got.defs} == defs
    assert {p["kind"] for p in got.patterns} == patterns


def test_broken_source_is_skipped(spark):
    df = spark.createDataFrame([("x.py", "python", "def ("), ("y.py", "python", None), ("z.zz", "unknown", "x")], "path string, lang string, text string")
    assert extract.extract_stats(extract.extract(df)).first().asDict() == {"files_processed": 2, "symbols_found": 0, "files_skipped": 1}


def node(name, weight=0.0, *children, **more):
    return trees.Node(name, name, name, "f", weight=weight, children=list(children), **more)


def test_renderers():
    root = node("root", 0.0, node("low", 0.0004), node("big", 0.5, confidence=0.5), node("ext", external=True, confidence=0.0))
    assert trees.folded([root]) == "root;low 1\nroot;big 500\nroot;ext 1\n"
    assert trees.tree([root]) == "root\n   ├─ low  " + " " * 6 + " 0.00\n   ├─ big ┄┄ 0.5  ███    0.50\n   └─ ext (ext)\n"
    assert "▸ (3 more)" in trees.tree([root], collapse=1)
    assert json.loads(trees.to_json("paths", "root", 3, "none", [root], []))["schema"] == 1
    assert trees.mermaid_sequence(root).startswith("```mermaid\nsequenceDiagram\n") and "flowchart TD" in trees.mermaid_flowchart([root])
    assert "digraph" in trees.dot_flowchart([root], fence=False) and "<li" in trees.page("t", [root])
    assert "+lock" in trees.mermaid_class([("a.rs", "lock")]) and '"a.rs"' in trees.dot_class([("a.rs", "lock")])
    partner = [{"partner": "b", "strength": 0.5, "support": 5}]
    assert "0.50 (5 commits)" in trees.mermaid_dependency("a", partner) and "dir=both" in trees.dot_dependency("a", partner)


def test_ambiguity():
    assert AmbiguousTargetError("x", ["a", "b"]).candidates == ["a", "b"]
