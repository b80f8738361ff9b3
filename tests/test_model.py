"""A repository's log and tree as tables, and a model that is learned from them and asked."""

import json

from pyspark.sql import functions as F

from patternmill import model
from patternmill.sources import histories
from tests.test_operators import scopes


def test_log_and_tree(spark, tmp_path):
    log = "\x1eaaa\t100\tann@x\tfix the parser\n\nM\tsrc/a.ts\nA\tsrc/b.ts\n\x1ebbb\t200\tbob@x\tmove\twith tab\nR100\tsrc/b.ts\tlib/b.ts\nD\told.ts\n\x1eccc\t300\tann@x\tempty\n"
    (tmp_path / "log.txt").write_text(log)
    commits = histories.commit_log(spark, str(tmp_path / "log.txt"))
    out = {r.sha: r for r in commits.collect()}
    assert out["aaa"].fix and out["aaa"].files == ["src/a.ts", "src/b.ts"] and out["aaa"].added == ["src/b.ts"] and not out["ccc"].files
    assert out["bbb"].msg == "move\twith tab" and [tuple(e) for e in out["bbb"].events] == [("R", "lib/b.ts", "src/b.ts"), ("D", "old.ts", None)]
    assert [tuple(r) for r in histories.renames(commits).collect()] == [("src/b.ts", "lib/b.ts", 200)]
    assert histories.footprints(commits).count() == 4
    root = tmp_path / "repo"
    for path, text in {"src/a.ts": "x", "node_modules/q/i.js": "y", "package.json": json.dumps({"dependencies": {"left": "1"}, "scripts": {"test": "t", "build": "b"}})}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    files = histories.tree(spark, str(root), content=True)
    assert {r.path: r.size for r in files.collect()} == {"src/a.ts": 1, "package.json": (root / "package.json").stat().st_size}
    assert [tuple(r) for r in histories.package_manifest(files).collect()] == [("package.json", "dependencies", "left", "1")]
    assert {r.key for r in histories.key_paths(files.where("path = 'package.json'")).collect()} == {"test", "build"}


def test_model(spark, tmp_path):
    rows = [(i, "handler", ["src", "src/h"], "true") for i in range(60)] + [(60, "handler", ["src", "src/h"], "false")]
    rows += [(100 + i, "view", ["src", "src/v"], "true" if i % 2 else "false") for i in range(60)]
    touches = [(f"c{i}", i, u, u[0]) for i in range(120) for u in ((f"a{i % 3}", "b0", f"d{i % 40}") if i % 4 == 0 else (f"e{i % 7}", f"f{i % 5}"))]
    messages = [(f"c{i}", i, t) for i in range(120) for t in (["guard", "login"] if i % 4 == 0 else ["page", "style"])]
    cards = [("login.ts", "login", 1.0), ("login.ts", "user", 0.5), ("page.ts", "page", 1.0)]
    edges = [(1, 2, 3), (2, 3, 1), (3, 1, 1), (3, 4, 9)]
    m = model.learn(str(tmp_path / "m"), scopes(spark, rows), spark.createDataFrame(touches, "sha string, ts long, unit string, cls string"), spark.createDataFrame(messages, "sha string, ts long, tok string"), spark.createDataFrame(cards, "card string, tok string, w double"), spark.createDataFrame(edges, "src long, dst long, n long"))
    assert {r.cid for r in m.rules().collect()} == {"r[handler]", "d[src/h]"}
    waive = spark.createDataFrame([(60, "has:guard")], "scope long, pid string")
    assert [(r.scope, r.waived) for r in m.check(waivers=waive).collect()] == [(60, True)] and m.check([1, 2]).count() == 0
    words = spark.createDataFrame([(1, "login"), (1, "guard")], "q long, tok string")
    assert m.where(words).first().card == "login.ts" and m.how(words).first().score == 1.0
    assert {r.tok: (r.cards, r.changes) for r in m.what(words).collect()} == {"login": (1, 30), "guard": (0, 30)}
    assert {r.tok for r in m.what(words).where(F.array_contains("stands_for", "b")).collect()} == {"login", "guard"}
    assert m.explain("has:guard").where("verdict = 'accepted'").count() == 2
    assert {r.name: r.rows for r in m.status().collect()}["deviations"] == 1
    assert {r.layer: r.nodes for r in m.map().collect()} == {0: 1, 1: 3} and m.table("cuts").agg(F.sum("n")).first()[0] == 1
    assert {r.state for r in m.compare(m).collect()} == {"kept"} and m.grouped().first().n == 1
    assert m.obligation("a").count() == 0, "three births are too few"
    assert (m.obligation("d").first().unit, m.obligation("d").first().rule) == ("b0", True)
    assert m.cochange("b0").count() >= 1 and m.places(words).count() >= 1
    assert ("b0", "comes with") in {(r.partner, r.why) for r in m.missing(spark.createDataFrame([("d0",)], "unit string")).collect()}
