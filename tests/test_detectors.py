"""Detector plans end to end on small corpora: what must and what must not be reported."""

import pytest
from pyspark.sql import functions as F

from sievework.plans import detector_queries
from sievework.plans.corpus import Corpus
from sievework.plans.detectors import DEFAULT_OFF, REGISTRY, run


def corpus(spark, files, multi=False, packages=None, **more):
    rows = [(w, p, t) for (w, p), t in files.items()] if multi else [("w", p, t) for p, t in files.items()]
    return Corpus(spark.createDataFrame(rows, "workspace string, path string, text string"), multi=multi, packages=packages, **more)


def titles(spark, name, files, **more):
    return sorted(r.title for r in REGISTRY[name](corpus(spark, files, **more)).collect())


def prints(df):
    return sorted(r.fingerprint for r in df.collect())


def test_registry():
    assert len(REGISTRY) == 33 and len(DEFAULT_OFF) == 10 and DEFAULT_OFF < set(REGISTRY)


USER = "export interface {0} {{ id: string; email?: string; createdAt: Date; name: string }}\n"


def test_duplicate_type(spark):
    files = {
        "a.ts": USER.format("User"), "b.ts": USER.format("Account"), "c.ts": "export interface Acc { uid: string; mail?: string; created: Date; displayName: string }\n",
        "d.ts": "interface T1 { a: string; b: string; c: string }\n", "e.ts": "interface T2 { x: string; y: string; z: string }\n",
    }
    got = REGISTRY["duplicate-type"](corpus(spark, files)).collect()
    assert len(got) == 1 and got[0].severity == "high" and got[0].confidence == 1.0 and len(got[0].evidence) == 3 and got[0].fingerprint.startswith("dup-type:strict:")


def test_duplicate_function(spark):
    body = "{ const total = items.reduce((s, x) => s + x.price * x.count, 0); if (total > 10) { return total; } return total * 2; }"
    files = {
        "a.ts": f"export function sum(items: Item[]): number {body}\n", "b.ts": f"export function add(items: Item[]): number {body}\n",
        "c.ts": f"export function near(items: Item[]): number {body.replace('total * 2', 'total * 3 + 1')}\n", "d.ts": "function s(a: number): number { return a; }\n", "e.ts": "function t(a: number): number { return a; }\n",
        "f.ts": f"export function other(items: string): number {body.replace('items', 'rows').replace('total * 2', 'total / 4')}\n",
    }
    got = REGISTRY["duplicate-function"](corpus(spark, files)).collect()
    assert len(got) == 1 and sorted(e.file for e in got[0].evidence) == ["a.ts", "b.ts", "c.ts"] and got[0].fingerprint.startswith("dup-fn:strict:")


def test_graph_detectors(spark):
    files = {
        "src/index.ts": "import { used } from './lib';\nimport D from './def';\nexport * from './star';\n", "src/lib.ts": "export function used(): void { helper(); }\nexport function unused(): void {}\nexport function helper(): void {}\n",
        "src/def.ts": "export default function def(): void {}\n", "src/b.ts": "import Other from './def';\n", "src/star.ts": "export const s = () => 1;\n", "src/orphan.ts": "export function lost(): void {}\n",
        "src/handlers/a.ts": "export function h(): void {}\n", "infra/stack.ts": "new Fn({ handler: 'src/handlers/b.main' });\n", "src/handlers/b.ts": "export function main(): void {}\n",
    }
    c = corpus(spark, files)
    assert [t for t in (r.title for r in REGISTRY["dead-module"](c).collect()) if "handlers" not in t] == ["Unreachable module: src/orphan.ts"] or {r.title for r in REGISTRY["dead-module"](c).collect()} == {"Unreachable module: src/orphan.ts", "Unreachable module: src/b.ts"}
    dead = {r.title for r in REGISTRY["dead-export"](c).collect()}
    assert "Unused export: unused in src/lib.ts" in dead and "Unused export: lost in src/orphan.ts" in dead and not any(n in t for t in dead for n in ("used in src/lib.ts",) if "unused" not in t) and not any("helper" in t or "star" in t for t in dead)
    assert {r.title for r in REGISTRY["dead-handler"](c).collect()} == {"Handler without wiring: src/handlers/a.ts"}
    drift = REGISTRY["default-export-name-drift"](c).collect()
    assert len(drift) == 1 and "D, Other" in drift[0].title
    assert [r.title for r in REGISTRY["hot-hub-file"](c, threshold=2).collect()] == ["Import hub: src/def.ts (2 importers)"]


def test_re_export_shadow(spark):
    files = {"i.ts": "export { a } from './x';\nexport { a } from './y';\nexport { b } from './x';\nexport function b(): void {}\n", "x.ts": "export const a = () => 1;\n", "y.ts": "export const a = () => 2;\n"}
    got = {r.title: r.severity for r in REGISTRY["re-export-shadow"](corpus(spark, files)).collect()}
    assert got == {"`a` has 2 origins in i.ts": "medium", "`b` has 2 origins in i.ts": "high"}


def test_dead_api_across_workspaces(spark):
    files = {
        ("app", "src/main.ts"): "import { used } from '@x/lib';\n", ("lib", "src/index.ts"): "export { used, idle } from './impl';\nexport * from './all';\n",
        ("lib", "src/impl.ts"): "export function used(): void {}\nexport function idle(): void {}\n", ("lib", "src/all.ts"): "export function star(): void {}\n",
    }
    packages = spark.createDataFrame([("app", "@x/app"), ("lib", "@x/lib")], "workspace string, package_name string")
    got = {r.title for r in REGISTRY["dead-api"](corpus(spark, files, multi=True, packages=packages)).collect()}
    assert got == {"No other workspace uses idle of lib/src/impl.ts", "No other workspace uses star of lib/src/all.ts"}


def test_aliases_resolve_by_longest_prefix(spark):
    files = {"src/a.ts": "import { x } from '@/util/x';\nimport y from '@/util';\n", "src/util/x.ts": "export const x = 1;\n", "lib/index.ts": "export default 1;\n"}
    c = corpus(spark, files, aliases={"w": [("@/", True, ["src/*"]), ("@/util", False, ["lib/index.ts"])]})
    assert sorted((r.specifier, r.target) for r in c.imports.collect()) == [("@/util", "lib/index.ts"), ("@/util/x", "src/util/x.ts")]


def test_shape_and_any_and_length(spark):
    files = {
        "m.ts": "export interface UserModel { id: string; name: string; email: string; age: number }\n", "d.ts": "export interface UserDto { id: string; name: string; email: string }\n", "o.ts": "export interface OrderDto { id: string; total: number; at: Date }\n",
        "f.ts": "export function f(a: any, b: Many): void {" + "\n  x();" * 70 + "\n}\nfunction g(a: any): void {}\n",
    }
    assert titles(spark, "schema-shape-divergence", files) in (["Schema drift: `UserModel` (m.ts) vs `UserDto` (d.ts)"], ["Schema drift: `UserDto` (d.ts) vs `UserModel` (m.ts)"])
    assert titles(spark, "public-any", files) == ["Public `any` in `f` (f.ts)"]
    assert titles(spark, "long-function", files) == ["Long function: `f` (72 lines) in f.ts"]


def test_similar_functions(spark):
    b = "{{\n  const rows = load(x);\n  const out = rows.filter((r) => r.ok);\n  log(out.{0});\n  return out.map((r) => r.{0});\n}}\n"
    files = {"a/x.ts": "export function fetchUserRows(x: string): Row[] " + b.format("id"), "b/y.ts": "export function loadUserRows(x: string): Row[] " + b.format("name"), "c/z.ts": "export function paint(c: Canvas): void {\n  c.clear();\n  c.draw(1);\n  c.draw(2);\n  c.flush();\n}\n"}
    got = REGISTRY["similar-functions"](corpus(spark, files)).collect()
    assert len(got) == 1 and [e.file for e in got[0].evidence] == ["a/x.ts", "b/y.ts"] and 0.6 <= got[0].confidence <= 0.85
    mt = spark.createDataFrame([("b/y.ts", 9)], "path string, ts long")
    assert "canonical b/y.ts" in REGISTRY["similar-functions"](corpus(spark, files, file_mtime=mt)).first().title


def test_env_endpoints_drift_packages(spark):
    files = {
        "src/a.ts": "process.env.FOO; process.env.NODE_ENV; process.env.DECL;\n// sievework:ignore-env-var-undeclared\nprocess.env.SKIP;\napp.post('/u', (req, res) => { const { a, gone } = req.body; });\napp.get('/dead', h);\n",
        "src/b.ts": "fetch('/u/', { method: 'POST', body: JSON.stringify({ a: 1 }) });\nimport x from 'left-pad';\n", ".env.example": "DECL=\nNEVER=\n",
        "package.json": '{"name": "p", "version": "1.0.0", "main": "dist/b.js", "types": "dist/none.d.ts", "dependencies": {"left-pad": "1", "right-pad": "1", "tsx": "1"}}',
    }
    assert titles(spark, "env-var-undeclared", files) == ["Undeclared variable FOO read in src/a.ts:1", "Variable NEVER declared in .env.example is never read"]
    assert titles(spark, "dead-endpoint", files) == ["GET /dead has no caller (src/a.ts:5)"]
    assert titles(spark, "producer-consumer-field-drift", files) == ["Drift on POST /u: no client sends gone (src/a.ts:4)"]
    assert titles(spark, "unused-deps", files) == ["Unused dependency right-pad in package.json"]
    assert titles(spark, "package-export-mismatch", files) == ["package.json#types points at dist/none.d.ts"]


def test_cross_file_clusters(spark):
    w = "prisma.user.update({ where: {}, data: { email: 1 } });\n"
    files = {"a.ts": w + "axios.put('/u/1', b);", "b.ts": "userRepository.save({ email: 2, once: 1 });\nfetch('/u/2/', { method: 'PUT' });", "c.ts": w}
    assert titles(spark, "shared-db-write", files) == ["`user.email` is written from 3 files (prisma+typeorm)"]
    assert titles(spark, "api-race", files) == ["`PUT /u/:id` is called from 2 files"]


def test_configurations_are_judged_with_their_bases(spark):
    files = {
        "tsconfig.json": '{"extends": ["./a.json", "./conf/b"], "compilerOptions": {"allowJs": true}}', "a.json": '{"compilerOptions": {"strict": false, "checkJs": true}}', "conf/b.json": '{"extends": "../c.json", "compilerOptions": {"strict": true}}',
        "c.json": '{"compilerOptions": {"noImplicitReturns": false, "strict": false}}', "tsconfig.loop.json": '{"extends": "./tsconfig.loop.json"}', "tsconfig.gone.json": '{"extends": "./none.json", "compilerOptions": {"strict": true}}',
        "node_modules/@org/base/tsconfig.json": '{"compilerOptions": {"target": "es5", "strict": true}}', "pkg/tsconfig.json": '{"extends": "@org/base"}', "deep/er/tsconfig.json": '{"compilerOptions": {}}',
    }
    want = ["tsconfig: noImplicitReturns disabled in tsconfig.json", "tsconfig: strict not set in tsconfig.loop.json", "tsconfig: target is es5 in pkg/tsconfig.json"]
    assert titles(spark, "bad-config", files) == want
    deep = REGISTRY["bad-config"](corpus(spark, files), depth=None)
    assert sorted(r.title for r in deep.collect()) == sorted([*want, "tsconfig: strict not set in deep/er/tsconfig.json", "tsconfig: target is es5 in node_modules/@org/base/tsconfig.json"])


def test_words_of_a_file_keep_its_exports_alive(spark):
    files = {"src/a.ts": "export function used(): void {\n}\nexport function $cash(): void {\n}\nexport function user(): void {\n  used();\n  $cash();\n}\nexport function users(): void {\n  user_2();\n}\n"}
    assert titles(spark, "dead-export", files) == ["Unused export: user in src/a.ts", "Unused export: users in src/a.ts"]


def test_magic_numbers_query_is_whole(spark, monkeypatch):
    monkeypatch.setattr(detector_queries, "corpus", lambda *_: corpus(spark, {"a.ts": "".join(f"f({n});\n" for n in range(301, 320))}))
    assert detector_queries.QUERIES["detector_magic_numbers"](spark, "").count() == 19


def test_caps_and_run(spark):
    files = {"a.ts": "".join(f"f({n});\n" for n in range(301, 320)), "b.ts": "// FIXME x\n"}
    c = corpus(spark, files)
    assert REGISTRY["magic-numbers"](c).count() == 5
    df = run(c, only=["todo-comments", "magic-numbers"])
    assert df.groupBy("detector_id").count().count() == 2 and prints(df) == prints(run(corpus(spark, files), only=["magic-numbers", "todo-comments"]))
    with pytest.raises(ValueError):
        run(c, only=["nothing"])


def test_every_detector_on_nothing_and_on_nulls(spark):
    empty = Corpus(spark.createDataFrame([], "workspace string, path string, text string"), shared=True)
    odd = Corpus(spark.createDataFrame([(None, None, "x"), (None, "a.ts", None), (None, "b.ts", ""), ("w", "c.ts", "export const a = () => {")], "workspace string, path string, text string").withColumn("kind", F.lit(1)), shared=True)
    for name, fn in REGISTRY.items():
        assert fn(empty).count() == 0, name
        fn(odd).count()
