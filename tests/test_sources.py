"""Extraction from small projects written for these tests, line rules, history and the change stream."""

import os
import subprocess

import pytest

from depmill.operators import comments, cross_language, security, temporal
from depmill.plans.session import Session
from depmill.sources import extract as ex
from depmill.sources import scan

FILES = {
    "pkg/__init__.py": "from .core import Engine\n",
    "pkg/core.py": "from pkg.util import scale, LIMIT\n\nclass Base:\n    pass\n\nclass Engine(Base):\n    def run(self):\n        self.step()\n        return scale(LIMIT)\n\n    def step(self):\n        pass  # TODO: speed\n",
    "pkg/util.py": "LIMIT = 3\n\ndef scale(x):\n    return x * 2\n",
    "web/app.ts": "import { load } from './lib';\nexport class App {\n  start(): void {\n    load();\n  }\n}\nexport function main() { new App(); }\nfetch(`/api/items/${id}`, { method: 'GET' });\n",
    "web/lib.ts": "export const LOADED = 1;\nexport function load() { return helper(); }\nfunction helper() { return eval('1'); }\n",
    "srv/server.py": "@app.route('/api/items/<item>', methods=['GET'])\ndef items(item):\n    return os.system('python tools/job.py')\n",
    "tools/job.py": "x = 1\n",
    "go/main.go": 'package main\n\nimport "example.com/m/store"\n\ntype App struct {\n}\n\nfunc (a *App) Run() {\n\tstore.Open()\n}\n',
    "store/db.go": "package store\n\nfunc Open() {}\n",
    "c/m.c": '#include "m.h"\n#define MAX 3\nstatic int low(int a) {\n  return a;\n}\nint top(void) {\n  return low(MAX);\n}\n',
    "c/m.h": "int top(void);\n",
    "node_modules/x.js": "var a = 1;\n",
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "add all | first")
    return str(root)


@pytest.fixture(scope="module")
def session(spark, project):
    s = Session(spark)
    s.connect(project)
    return s


def has(session, source, target):
    return session.g.edges.where(f"source = '{source}' and target = '{target}'").count() == 1


def test_scan_skips_and_keeps_underscored(project):
    paths = [p for p, _, _ in scan.list_files(project)]
    assert "pkg/__init__.py" in paths and not any("node_modules" in p for p in paths)
    assert [p for p, _, _ in scan.list_files(project, ("*.ts",)) if p.endswith(".ts")] == []


def test_python_edges(session):
    assert has(session, "pkg/core.py::Engine.run", "pkg/core.py::Engine.step")
    assert has(session, "pkg/core.py::Engine.run", "pkg/util.py::scale")
    assert has(session, "pkg/core.py::Engine", "pkg/core.py::Base")
    assert has(session, "pkg/core.py::__file__", "pkg/util.py::LIMIT")


def test_other_languages(session):
    assert has(session, "web/app.ts::App.start", "web/lib.ts::load")
    assert has(session, "web/lib.ts::load", "web/lib.ts::helper")
    assert has(session, "go/main.go::App.Run", "store/db.go::Open") or has(session, "go/main.go::__file__", "store/db.go::__file__")
    assert has(session, "c/m.c::top", "c/m.c::low")
    exported = {r["name"]: r["exported"] for r in session.g.nodes.where("file_path in ('c/m.c', 'web/lib.ts')").collect()}
    assert exported["top"] and not exported["low"] and exported["load"] and not exported["helper"]


def test_cross_language(session):
    rest = cross_language.rest_edges(session.lines).collect()
    assert [(r["source_file"], r["target_file"], r["confidence"]) for r in rest] == [("web/app.ts", "srv/server.py", "high")]
    scripts = cross_language.script_edges(session.lines, session.files).collect()
    assert [(r["source_file"], r["target_file"]) for r in scripts] == [("srv/server.py", "tools/job.py")]


def test_security(session):
    found = security.findings(session.lines)
    assert {"eval() usage detected", "Python os.system() call"} <= {r["title"] for r in found.collect()}
    told = security.numbered(security.elevated(found, session.g)).collect()
    assert told[0]["id"] == "SEC-001" and security.gate(found, "high")


def test_comments(session):
    assert [(r["type"], r["file_path"], r["text"]) for r in comments.markers(session.lines).collect()] == [("TODO", "pkg/core.py", "speed")]


def test_history_and_snapshots(spark, session, tmp_path):
    commits = scan.commits_of(spark, session.root)
    assert [(r["message"], r["author"]) for r in commits.collect()] == [("add all | first", "t")]
    assert session.snapshots(str(tmp_path / "snaps")).first()["d_total_files"] > 5
    assert session.snapshots(str(tmp_path / "snaps")).count() == 1


def test_weeks_keep_the_calendar_year(spark):
    df = spark.sql("SELECT timestamp '2021-01-03' AS d")
    assert df.select(temporal.week_key(df["d"])).first()[0] == "2021-W53"


def test_json_round_trip(spark, session, tmp_path):
    scan.export_json(session.g, session.root).write.text(str(tmp_path / "g"))
    back = scan.import_json(spark, str(tmp_path / "g"))
    assert (back.nodes.count(), back.edges.count()) == (session.g.nodes.count(), session.g.edges.count())


def test_sarif(session):
    assert '"version":"2.1.0"' in scan.sarif(security.findings(session.lines)).first()[0]


def test_broken_file_is_an_error_row():
    rows = ex.extract("x.py", "def (:\n", "python", lambda p: False, 0)
    assert [r["rec"] for r in rows] == ["error"]


@pytest.mark.parametrize(
    ("path", "text", "names"),
    [("a.csproj", '<PackageReference Include="Json" />', ["Json"]), ("CMakeLists.txt", "project(demo)\nfind_package(Zlib REQUIRED)\n", ["demo", "Zlib"]), ("conanfile.txt", "[requires]\nzlib/1.2\n[options]\nx/1\n", ["zlib"]), ("vcpkg.json", '{"dependencies": ["fmt", {"name": "curl"}]}', ["fmt", "curl"]), ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId></dependency>", ["g:a"]), ("build.gradle", "implementation 'a:b:1'\n", ["a:b:1"])],
)
def test_build_files(path, text, names):
    assert [r["name"] for r in ex.extract(path, text, "build", lambda p: False, 0) if r["rec"] == "sym"] == names


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("rust", "pub struct A;\nimpl A {\n    pub fn go(&self) {}\n}\nfn low() {}\n", {"A": "class", "go": "method", "low": "function"}), ("java", "package p;\npublic class A {\n  private int n;\n  public void go() {\n  }\n}\n", {"A": "class", "go": "method"}),
        ("kotlin", "package p\nclass A {\n  fun go() {}\n}\nfun top() {}\n", {"A": "class", "go": "method", "top": "function"}), ("csharp", "namespace N;\npublic class A\n{\n  public void Go()\n  {\n  }\n}\n", {"A": "class"}),
        ("php", "<?php\nclass A {\n  public function go() {}\n}\nfunction top() {}\n", {"A": "class", "go": "method", "top": "function"}), ("cpp", "namespace n {\nclass A {\n};\n}\nint top(int a) {\n  return a;\n}\n", {"A": "class", "top": "function"}),
        ("javascript", "class A {\n  go() {\n  }\n}\nconst f = (a) => a;\nmodule.exports = { A };\n", {"A": "class", "go": "method", "f": "function"}),
    ],
)
def test_declarations(language, text, want):
    got = {r["name"]: r["kind"] for r in ex.extract("x", text, language, lambda p: False, 0) if r["rec"] == "sym"}
    assert want.items() <= got.items(), got


def test_change_reader(tmp_path):
    from depmill.streaming.watch import ChangeReader

    (tmp_path / "a.py").write_text("x = 1\n")
    os.utime(tmp_path / "a.py", (1, 1))
    reader = ChangeReader(str(tmp_path))
    rows, offset = reader.read(reader.initialOffset())
    assert [(r[0], r[1]) for r in rows] == [("a.py", "add")]
    (tmp_path / "a.py").unlink()
    rows, _ = reader.read(offset)
    assert [(r[0], r[1]) for r in rows] == [("a.py", "unlink")]


def test_windows_over_events(spark):
    from depmill.streaming import watch

    df = spark.sql("SELECT timestamp '2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1L AS user_id UNION ALL SELECT timestamp '2024-01-01 00:20:00', 'a', 1L UNION ALL SELECT timestamp '2024-01-01 03:00:00', 'a', 1L")
    assert sorted(r["n"] for r in watch.activity(df).collect()) == [1, 2]
    assert sorted(r["n"] for r in watch.sessions(df).collect()) == [1, 2]


def test_updates_keep_package_imports_and_later_generations(spark, session, project, tmp_path):
    from depmill.streaming import watch

    batch = spark.createDataFrame([("go/main.go", "change", 1.0, "go", FILES["go/main.go"] + "\nfunc (a *App) Stop() {\n}\n"), ("web/lib.ts", "unlink", 1.0, None, None)], watch.CHANGE)
    files = spark.createDataFrame([(p, lang, 0) for p, lang, _ in scan.list_files(project)], "file_path string, language string, place long")
    after = watch.applied(session.g, batch, files)
    into = lambda g: {r[0] for r in g.ef.where("source_file = 'go/main.go' and target_file = 'store/db.go'").select("target").collect()}
    assert into(after) == into(session.g) != set()
    assert after.nodes.where("name = 'Stop'").count() == 1 and after.nodes.where("file_path = 'web/lib.ts'").count() == 0
    store = str(tmp_path / "store")
    for name in ("start", "3"):
        scan.save_graph(after, f"{store}/{name}")
    assert watch.generation_before(spark, store, 5) == f"{store}/start"  # 3 was not finished
    spark.range(1).write.parquet(f"{store}/3/{watch.COMPLETE}")
    assert watch.generation_before(spark, store, 5) == f"{store}/3" and watch.generation_before(spark, store, 3) == f"{store}/start"


def test_line_rules_look_around(spark):
    from depmill.operators import rules

    texts = ["} catch (e) {", "log(e)", "next()", "const p = resolve(base)", "if (!p.startsWith(base)) throw 1", "path.join(root, req.query.f)", *["x"] * 20, "path.join(root, req.query.f)", "// eval(x)", "eval(x)"]
    lines = spark.createDataFrame([("src/route/a.ts", i + 1, t) for i, t in enumerate(texts)], "file_path string, line_no long, line string")
    found = {(r["title"], r["line"], r["severity"]) for r in security.findings(lines).collect()}
    assert found == {("Fail-open catch block may bypass authentication", 1, "medium"), ("Potential path traversal via path.join", 27, "high"), ("eval() usage detected", 29, "high")}
    assert len(rules.RULES) > 60


def test_path_aliases(tmp_path):
    from depmill.sources import aliases

    (tmp_path / "tsconfig.json").write_text('{ // note\n "compilerOptions": { "baseUrl": "src", /* x */ "paths": { "@/*": ["./*", "other/*"], "exact": ["a//b.ts"], }, }, }')
    known = {"src/ui/button.ts", "src/a/b.ts", "lib/z.ts"}.__contains__
    found = aliases.path_aliases(str(tmp_path))
    assert found == (("@/*", "src/*"), ("exact", "src/a/b.ts"))
    at = lambda spec: ex.resolve_import("src/main.ts", spec, known, (".ts",), found)
    assert [at(x) for x in ("@/ui/button.js", "exact", "/lib/z", "./a/b", "react", "@/none")] == ["src/ui/button.ts", "src/a/b.ts", "lib/z.ts", "src/a/b.ts", None, None]
    assert aliases.plain_json('{"u": "http://x,]", "v": [1,],}') == '{"u": "http://x,]", "v": [1]}'
    rows = ex.extract("src/main.ts", "import { Button } from '@/ui/button';\n", "typescript", known, 0, found)
    assert [r["target"] for r in rows if r["rec"] == "ref"] == ["src/ui/button.ts::Button"]


def test_command_line(spark, project, capsys):
    from depmill.__main__ import main

    assert main(["whatif", project, "move", "pkg/util.py"], spark) == 2 and "--to" in capsys.readouterr().err
    assert main(["whatif", project, "delete", "no/such.py"], spark) == 2
    assert main(["impact", project, "nothing_named_so"], spark) == 2
    assert main(["search", project, "scale"], spark) == 0 and '"name":"scale"' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["whatif", project, "burn", "pkg/util.py"], spark)
    assert main(["security", project, "--target", "web/lib.ts", "--fail-on", "high"], spark) == 1
