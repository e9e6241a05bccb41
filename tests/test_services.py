"""Verdicts, serving, stores, sources and the streaming fold."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sievework import schemas
from sievework.plans import serving, verdict
from sievework.sources import stores
from sievework.sources.ignore import Ignore, enumerate_files, load_ignore
from sievework.sources.workspace import Settings, conventions, detect_monorepo, inside, load_config, load_corpus, recent, tsconfig_aliases
from sievework.streaming import progress
from tests.conftest import rows

F0 = {"workspace": "w", "detector_id": "silent-catch", "severity": "medium", "confidence": 0.7, "layer": 1, "title": "t", "description": "d", "evidence": [{"file": "src/a/x.ts", "line_range": {"start_line": 1, "end_line": 2}, "snippet": "s", "note": None}], "suggestion": None, "fingerprint": "f", "resolved_at": None, "llm_false_positive": None}


def findings(spark, *over):
    return spark.createDataFrame([F0 | o for o in over], schemas.FINDINGS)


def test_verdict_algebra(spark):
    f = findings(
        spark, {"fingerprint": "up"}, {"fingerprint": "bump"}, {"fingerprint": "down"}, {"fingerprint": "soft"}, {"fingerprint": "none"},
        {"fingerprint": "dup+", "detector_id": "duplicate-type", "confidence": 0.5}, {"fingerprint": "dup-", "detector_id": "duplicate-type", "confidence": 0.9},
    )
    v = spark.createDataFrame([("up", True, 0.84, "r"), ("bump", True, 0.99, "r"), ("down", False, 0.6, "r"), ("soft", False, 0.1, "r"), ("soft", True, 0.05, "r"), ("dup+", True, 0.99, "r"), ("dup-", False, 0.5, "r")], schemas.VERDICTS)
    got = {r.fingerprint: (round(r.confidence, 6), r.severity, r.layer, r.llm_false_positive is not None) for r in verdict.apply_verdicts(f, v).collect()}
    assert got == {
        "up": (0.84, "medium", 3, False), "bump": (0.95, "high", 3, False), "down": (0.28, "low", 3, True), "soft": (0.63, "low", 3, False), "none": (0.7, "medium", 1, False),
        "dup+": (0.97, "medium", 3, False), "dup-": (0.35, "low", 1, False),
    }


def test_gate_chunks_and_replies(spark):
    f = findings(spark, {"fingerprint": "a", "detector_id": "mutation"}, {"fingerprint": "b", "severity": "low"}, {"fingerprint": "c", "detector_id": "duplicate-type", "confidence": 1.0}, {"fingerprint": "d", "detector_id": "skip-tests"})
    assert rows(f.filter(verdict.needs_verdict(F.lit(2), F.lit(3))), "fingerprint") == [("a",), ("c",)]
    big = findings(spark, {"evidence": [F0["evidence"][0] | {"snippet": "x" * 900}] * 11})
    assert sorted((r.chunk, len(r.sites)) for r in verdict.chunk_sites(big).collect()) == [(0, 2), (1, 2), (2, 2), (3, 2)]
    got = verdict.merge_chunks(verdict.ask(verdict.chunk_sites(big), lambda fp, p: '```json\n{"positive": true, "confidence": 0.8}\n```')).collect()
    assert [(r.fingerprint, r.positive, r.confidence) for r in got] == [("f", True, 0.8)]
    assert verdict.ask(verdict.chunk_sites(big), lambda fp, p: 1 / 0).count() == 0
    assert verdict.json_from_reply('sure: {"a": "}{", "b": 1} done') == {"a": "}{", "b": 1} and verdict.json_from_reply("no") is None


def test_confirmers_ask_their_own_question(spark):
    asked = spark.sparkContext.accumulator(0)

    def provider(fp, prompt):
        asked.add(1)
        return json.dumps({"positive": True, "confidence": 0.9, "reason": prompt.split("\n")[0]})

    long_ = [F0["evidence"][0] | {"snippet": "x" * 1300}] * 2
    f = findings(spark, {"fingerprint": "m", "detector_id": "mutation"}, {"fingerprint": "big", "detector_id": "mutation", "evidence": long_}, {"fingerprint": "t"}, {"fingerprint": "wide", "evidence": long_}, {"fingerprint": "d", "detector_id": "duplicate-type"})
    got = {r.fingerprint: r.reason for r in verdict.ask(verdict.chunk_sites(f), provider, 2).collect()}
    q = {k: v for k, (_, v) in verdict.QUESTIONS.items()}
    assert got == {"m": q["mutation"], "t": q["triage"], "wide": q["triage"], "d": q["duplicate"]} and asked.value == 5


def test_false_positive_precedence(spark):
    f = findings(spark, *[{"fingerprint": x, "llm_false_positive": {"confidence": 0.9, "reason": "r"} if x in "cd" else None} for x in "abcd"])
    s = lambda *x: spark.createDataFrame([(y,) for y in x], "fingerprint string")
    got = {r.fingerprint: (r.bucket, r.llm_false_positive is None) for r in verdict.split_false_positives(f, s("a", "b"), s("a", "d")).collect()}
    assert got == {"a": ("open", True), "b": ("false-positive", True), "c": ("false-positive", False), "d": ("open", True)}


def test_serving(spark):
    f = findings(spark, {"fingerprint": "a", "severity": "high"}, {"fingerprint": "b", "severity": "low"}, {"fingerprint": "c", "evidence": [F0["evidence"][0] | {"file": "lib/z.ts", "note": '{"entity":"user","column":"email"}'}]})
    assert rows(serving.diff(f.filter("fingerprint != 'a'"), f.filter("fingerprint != 'b'"))) == [("a", "removed"), ("b", "added"), ("c", "persisting")]
    assert rows(serving.top_directories(f)) == [("src/a", 1)]
    assert rows(serving.facets(f, severities=["high", "low"], directory="src/a", text="SRC"), "fingerprint") == [("a",), ("b",)]
    assert ("user.email", 1) in rows(serving.cluster_groups(f), "label", "n")
    assert [(r.fingerprint, r.previous, r.next) for r in serving.queue(f).orderBy("fingerprint").collect()] == [("a", None, "c"), ("b", "c", None), ("c", "a", "b")]
    src = spark.createDataFrame([("p.ts", "1\n2\n3\n4")], "path string, text string")
    assert rows(serving.code_window(src, "p.ts", 3, 1)) == [(2, "2"), (3, "3"), (4, "4")]
    files = spark.createDataFrame([("src/a/x.ts",), ("lib/z.ts",)], "path string")
    sym = spark.createDataFrame([("1", "src/a/x.ts"), ("2", "src/a/x.ts")], "id string, file string")
    tree = {r.path: (r.symbols, r.high, r.low) for r in serving.symbol_tree(files, sym, f).collect()}
    assert tree[""] == (2, 1, 1) and tree["src/a"] == (2, 1, 1) and tree["lib"] == (0, 0, 0)
    again = serving.refresh_finding(f, f.filter("fingerprint = 'a'").withColumn("severity", F.lit("low")), 77)
    assert {r.fingerprint: (r.severity, r.resolved_at) for r in again.collect()} == {"a": ("low", None), "b": ("low", 77), "c": ("medium", 77)}


def test_stores_and_reports(spark, tmp_path):
    one, two = str(tmp_path / "fp"), str(tmp_path / "open")
    s = lambda *x: spark.createDataFrame([(y,) for y in x], "fingerprint string")
    stores.write_set(s("a", "b", "a"), one)
    stores.move(spark, s("b", "c"), two, one)
    assert rows(stores.read_set(spark, one)) == [("a",)] and rows(stores.read_set(spark, two)) == [("b",), ("c",)]
    assert stores.read_set(spark, str(tmp_path / "none")).count() == 0
    f = findings(spark, {"fingerprint": "a", "severity": "high"}, {"fingerprint": "b", "confidence": 0.2})
    assert stores.report_counts(f, 0.5).first().asDict() == {"total": 2, "shown": 1, "hidden": 1, "high": 1, "medium": 0, "low": 0}
    assert stores.markdown_report(f).first().markdown.startswith("### t")
    assert "1 high, 1 medium" in stores.fix_prompt(f).first().prompt
    d = tmp_path / "scans"
    d.mkdir()
    (d / "1.json").write_text(json.dumps({"scan_id": "s1", "started_at": 1, "findings": [{"fingerprint": "a", "severity": "high"}]}))
    (d / "2.json").write_text("{broken")
    (d / "3.json").write_text(json.dumps({"scan_id": "s3", "started_at": 3}))
    h = stores.load_history(spark, str(d))
    assert [r.scan_id for r in h.collect()] == ["s3", "s1"]
    assert [r.high for r in serving.scans(h).collect()] in ([None, 1], [-1, 1], [0, 1])
    stores.persist_scan(h.filter("scan_id = 's1'"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_ignore_rules():
    i = Ignore([("", "*.log\n!keep.log\n/build\ndocs/**/x.md\ntmp/\n# c\n\n"), ("pkg", "local.ts\n")])
    assert [i.ignores(p) for p in ("a.log", "d/keep.log", "build/x", "src/build/x", "docs/a/b/x.md", "tmp/", "a/tmp/f", "tmp", "pkg/d/local.ts", "local.ts", "node_modules/x", "a/.git/")] == [True, False, True, False, True, True, True, False, True, False, True, True]


@pytest.fixture
def repo(tmp_path):
    def put(p, t):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)

    put("package.json", '{"workspaces": ["packages/*", "!packages/skip"]}')
    put("packages/a/package.json", '{"name": "@x/a"}')
    put("packages/a/src/index.ts", "import { b } from '@x/b';\n")
    put("packages/b/package.json", '{"name": "@x/b"}')
    put("packages/b/src/index.ts", "export function b(): void {}\nexport function idle(): void {}\n")
    put("packages/b/.gitignore", "gen/\n")
    put("packages/b/gen/g.ts", "x")
    put("packages/skip/package.json", "{}")
    put("base.json", '{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["*"], "@/core/*": ["core/*"]}}}')
    put("tsconfig.json", '{ // c\n"extends": "./base.json" }')
    put("README.md", "root notes")
    return tmp_path


def test_workspace_loading(spark, repo):
    root = str(repo)
    assert [(w.name, w.package_name) for w in detect_monorepo(root)] == [("a", "@x/a"), ("b", "@x/b")]
    assert tsconfig_aliases(root) == [("@/core/", True, ["src/core/*"]), ("@/", True, ["src/*"]), ("", True, ["src/*"])]
    assert list(enumerate_files(root, load_ignore(root), [".ts"])) == ["packages/a/src/index.ts", "packages/b/src/index.ts"]
    c = load_corpus(spark, root)
    assert rows(c.files, "path") == [("a/package.json",), ("a/src/index.ts",), ("b/package.json",), ("b/src/index.ts",)]
    from sievework.plans.detectors import REGISTRY

    assert [r.title for r in REGISTRY["dead-api"](c).collect()] == ["No other workspace uses idle of b/src/index.ts"]
    only = load_corpus(spark, root, only=["src/index.ts"])
    assert only.files.count() == 2 and load_corpus(spark, root, only=[]).files.count() == 4
    assert conventions(root, "packages/a/src/index.ts") == "root notes"
    assert inside(root, "../x") is None and inside(root, "README.md")
    (repo / "sievework.config.json").write_text('{"workspaces": [{"name": "a", "path": "packages/a"}, {"name": "a", "path": "packages/b"}]}')
    with pytest.raises(ValueError):
        load_config(root)


def test_settings(tmp_path):
    p = str(tmp_path / "s.json")
    assert Settings.load(p).llm_concurrency == 4
    Settings(llm_concurrency=2).save(p)
    assert Settings.load(p).llm_concurrency == 2 and os.path.exists(p)
    assert recent(["a", "b"], "b") == ["b", "a"]


def test_stream_fold_equals_batch(spark, tmp_path):
    ev = [
        {"scan_id": "s", "seq": 1, "state": "running"}, {"scan_id": "s", "seq": 2, "detector_id": "d", "phase": "start"}, {"scan_id": "s", "seq": 4, "latency_ms": 5.0, "race": True},
        {"scan_id": "s", "seq": 3, "detector_id": "d", "phase": "done"}, {"scan_id": "s", "seq": 3, "detector_id": "d", "phase": "done"}, {"scan_id": "s", "seq": 9, "state": "finished"}, {"scan_id": "z", "seq": 1, "state": "queued"},
    ]
    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate((ev[4:], ev[:4])):
        (src / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
    progress.run_fold(spark, str(src), str(tmp_path / "t"), str(tmp_path / "cp"))
    batch = progress.fold(spark.read.schema(progress.EVENTS).json(str(src)).dropDuplicates(["scan_id", "seq"]))
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == rows(batch) == [("s", "finished", "d", ["d"], 1, 1, 9), ("z", "queued", None, [], 0, 0, 1)]
    assert progress.eta_ms(spark.createDataFrame([], "latency_ms double"), 3).first()[0] == 4500


def test_lines_meet_their_innermost_symbols(spark):
    rows_ = [("out", "f", "a.ts", 1, 200, True), ("mid", "g", "a.ts", 60, 130, False), ("in", "h", "a.ts", 100, 130, True), ("same", "i", "a.ts", 100, 130, False), ("b", "j", "b.ts", 5, 5, True), ("bad", "k", "a.ts", 9, 3, True), (None, "n", "a.ts", 1, 2, True)]
    sym = spark.createDataFrame([(i, n, f, (a, b), e) for i, n, f, a, b, e in rows_], "id string, name string, file string, line_range struct<start_line:int,end_line:int>, exported boolean").union(spark.createDataFrame([("out", "f", "a.ts", (1, 200), True)], "id string, name string, file string, line_range struct<start_line:int,end_line:int>, exported boolean"))
    places = spark.createDataFrame([("a.ts", 1), ("a.ts", 64), ("a.ts", 128), ("a.ts", 200), ("a.ts", 201), ("b.ts", 5), (None, 3), ("a.ts", None), ("a.ts", 64)], "file string, line int")
    assert rows(serving.enclosing_symbols(places, sym)) == [("a.ts", 1, "out"), ("a.ts", 128, "in"), ("a.ts", 200, "out"), ("a.ts", 64, "mid"), ("b.ts", 5, "b")]
    src = spark.createDataFrame([("a.ts", "\n".join(str(i) for i in range(1, 203))), ("b.ts", "x")], "path string, text string")
    t = {(r.file, r.line): r for r in serving.triage_context(places, sym, src, conventions="c").collect()}
    assert t["a.ts", 1].enclosing == "f" and t["a.ts", 1].siblings == ["k", "h"] and t["a.ts", 1].window == "\n".join(str(i) for i in range(1, 10)) and t["a.ts", 1].conventions == "c"
    assert t["a.ts", 201].enclosing is None and t["a.ts", 201].siblings == ["f", "k", "h"] and t["b.ts", 5].window == "x"
    f = findings(spark, {"fingerprint": "e", "evidence": [F0["evidence"][0] | {"file": "a.ts", "line_range": {"start_line": 100, "end_line": 101}}]})
    assert rows(serving.evidence_symbols(f, sym)) == [("e", "a.ts", 100, "in"), ("e", "a.ts", 100, "same")]
    assert serving.enclosing_symbols(places.limit(0), sym).count() == 0 and serving.enclosing_symbols(places, sym.limit(0)).count() == 0


def test_scan_lists_and_pages(spark):
    made = lambda i, at, *fps: (i, "w", "done", at, at, [{"fingerprint": f, "detector_id": "d", "severity": sev, "llm_false_positive": None} for f, sev in fps])
    schema = "scan_id string, workspace_root string, state string, started_at long, finished_at long, findings array<struct<fingerprint:string,detector_id:string,severity:string,llm_false_positive:struct<confidence:double,reason:string>>>"
    old = spark.createDataFrame([made("s1", 1, ("a", "high")), made("s2", 2, ("a", "high"), ("b", "low")), made("live", 3, ("z", "low"))], schema)
    live = spark.createDataFrame([made("live", 9, ("a", "high"), ("c", "medium"))], schema)
    mark = lambda *x: spark.createDataFrame([(y,) for y in x], "fingerprint string")
    got = {r.scan_id: (r.high, r.medium, r.low, r.false_positives) for r in serving.scans(old, live, mark("a", "b"), mark("b"), newest=1).collect()}
    assert got == {"live": (0, 1, 0, 1), "s2": (0, 0, 1, 1)}
    assert rows(serving.scan(old, "s2", "w", mark("a")), "fingerprint", "bucket") == [("a", "false-positive"), ("b", "open")]
    assert serving.scan(old, "s2", "other").count() == 0
    f = findings(spark, *[{"fingerprint": x, "title": f"'{t}'", "severity": s, "layer": n} for x, t, s, n in [("a", "one", "medium", 1), ("b", "two", "medium", 3), ("c", "two", "low", 1), ("d", "x", "high", 1)]])
    assert [(r.fingerprint, r.cluster_size, r.page) for r in serving.cluster_queue(f, 2).orderBy("position").collect()] == [("d", 1, 1), ("b", 2, 1), ("a", 1, 2), ("c", 2, 2)]
    assert rows(serving.page(f, 2, 2), "fingerprint") == [("a",), ("c",)] and rows(serving.layer_share(f)) == [("w", 4, 25.0)]


def test_a_set_survives_a_write_that_stopped_between_its_renames(spark, tmp_path):
    import shutil

    s = lambda *x: spark.createDataFrame([(y,) for y in x], "fingerprint string")
    p = str(tmp_path / "fp")
    stores.write_set(s("a"), p)
    stores.write_set(stores.read_set(spark, p).union(s("b")), p)
    assert rows(stores.read_set(spark, p)) == [("a",), ("b",)]
    shutil.move(p, p + ".new")
    assert rows(stores.read_set(spark, p)) == [("a",), ("b",)]
    stores.write_set(stores.read_set(spark, p).union(s("c")), p)
    assert rows(stores.read_set(spark, p)) == [("a",), ("b",), ("c",)]


def test_deep_folders_are_walked_with_every_rule_above_them(spark, tmp_path):
    for p in ("a.ts", "x/b.ts", "x/y/c.ts", "x/y/z/d.ts", "x/y/z/skip/e.ts", "x/y/z/f.log.ts", "gone/g.ts", "node_modules/m/h.ts", ".hidden/i.ts", "x/y/z/tsconfig.json", "x/.env.example"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    (tmp_path / ".gitignore").write_text("gone/\n*.log.ts\n")
    (tmp_path / "x/y/.gitignore").write_text("z/skip\n")
    c = load_corpus(spark, str(tmp_path))
    assert rows(c.sources, "path", "text") == sorted([(p, p) for p in ("a.ts", "x/b.ts", "x/y/c.ts", "x/y/z/d.ts", ".hidden/i.ts", "x/y/z/tsconfig.json", "x/.env.example")], key=str)
    assert rows(load_corpus(spark, str(tmp_path), only=["x/y/c.ts"]).sources, "path") == [("x/y/c.ts",)]
