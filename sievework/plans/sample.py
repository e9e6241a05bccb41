"""A bundled corpus in which every detector has something to report, with the reports it must give.

The driver tables hold no handlers, routes, tests or resolvable imports, so each detector also runs over these files,
with the thresholds it has by default; its oracle is the list of expected rows, written out beside the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.plans.corpus import Corpus
from sievework.plans.detectors import REGISTRY
from sievework.session import ship

_BODY = "{ const total = items.reduce((s, x) => s + x.price * x.count, 0); if (total > 10) { return total; } return total * 2; }"
_ROWS = "{{\n  const rows = load(x);\n  const out = rows.filter((r) => r.ok);\n  log(out.{0});\n  return out.map((r) => r.{0});\n}}\n"
_USER = "export interface {0} {{ id: string; email?: string; createdAt: Date; name: string }}\n"

FILES = {
    "src/index.ts": "".join(f"import * as m{i} from './{p}';\n" for i, p in enumerate(("cart", "names", "types/user", "types/account", "types/order", "types/dto", "math/sum", "math/add", "rows/fetch", "rows/load", "api", "client", "state", "flow", "db/a", "db/b", "errors", "long", "deep", "log", "env", "sink", "wide")))
    + "import { total } from './cart';\nimport Format from './format';\nexport * from './barrel';\ntotal([]);\nFormat(1);\n",
    "src/cart.ts": "export function total(items: Item[]): number {\n  return sum(items);\n}\nexport function sum(items: Item[]): number {\n  return items.length;\n}\n",
    "src/shelf.ts": "export function stock(): number {\n  return level();\n}\nexport function level(): number {\n  return 1;\n}\nexport function spare(): void {\n}\n",
    "src/format.ts": "export default function format(n: number): string {\n  return String(n);\n}\n",
    "src/report.ts": "import Pretty from './format';\nimport { stock } from './shelf';\nexport function report(): string {\n  return Pretty(stock());\n}\n",
    "src/barrel.ts": "export { inner } from './inner';\n",
    "src/inner.ts": "export const inner = () => 1;\n",
    "src/names.ts": "export { a } from './x';\nexport { a } from './y';\nexport { b } from './x';\nexport function b(): void {\n}\n",
    "src/x.ts": "export const a = () => 1;\n",
    "src/y.ts": "export const a = () => 2;\n",
    "src/hub.ts": "export const hub = () => 0;\n",
    **{f"src/pages/p{i}.ts": f"import {{ hub }} from '../hub';\nexport const p{i} = () => hub();\n" for i in range(20)},
    "src/handlers/idle.ts": "export function run(): void {\n}\n",
    "src/handlers/busy.ts": "export function main(): void {\n}\n",
    "infra/stack.ts": "new Fn({ handler: 'src/handlers/busy.main' });\n",
    "src/types/user.ts": _USER.format("User"),
    "src/types/account.ts": _USER.format("Account"),
    "src/types/order.ts": "export interface OrderModel { id: string; total: number; placed: Date; note: string }\n",
    "src/types/dto.ts": "export interface OrderDto { id: string; total: number; placed: Date }\n",
    "src/math/sum.ts": f"export function sumUp(items: Item[]): number {_BODY}\n",
    "src/math/add.ts": f"export function addUp(items: Item[]): number {_BODY}\n",
    "src/rows/fetch.ts": "export function fetchUserRows(x: string): Row[] " + _ROWS.format("id"),
    "src/rows/load.ts": "export function loadUserRows(x: string): Row[] " + _ROWS.format("name"),
    "src/api.ts": "app.post('/orders', (req, res) => {\n  const { item, gone } = req.body;\n  res.status(404);\n});\napp.get('/unused', list);\n",
    "src/client.ts": "fetch('/orders/', { method: 'POST', body: JSON.stringify({ item: 1 }) });\naxios.put('/users/1', body);\n",
    "src/state.ts": "export function fill(xs: string[], o: Box): void {\n  xs.push('a');\n  o.size = 1;\n}\nlet count = 0;\nexport function tick(): void {\n  count += 1;\n}\n",
    "src/flow.ts": "let cache: string | null = null;\nexport async function once(): Promise<string> {\n  const c = cache;\n  if (c) return c;\n  const v = await load();\n  cache = v;\n  return v;\n}\n",
    "src/db/a.ts": "prisma.user.update({ where: { id }, data: { email: x } });\nfetch('/users/2/', { method: 'PUT' });\n",
    "src/db/b.ts": "userRepository.save({ email: 2, once: 1 });\n",
    "src/errors.ts": "export function quiet(): void {\n  try { go(); } catch (e) {}\n  try { go(); } catch (e) { // intentional\n  }\n  try { go(); } catch { return; }\n  try { go(); } catch (e) { throw e; }\n}\n",
    "src/long.ts": "".join(f"export const word{i} = 'w{i}';\n" for i in range(450)),
    "src/deep.ts": "export function deep(a: number): void {\n  if (a) {\n    for (;;) {\n      while (a) {\n        if (a) {\n          go();\n        }\n      }\n    }\n  }\n}\n",
    "src/log.ts": "// TODO: trim this\nconsole.log('a');\nconsole.error('b');\n// console.log('c');\nwait(37);\n",
    "src/env.ts": "use(process.env.PORT_NAME);\nuse(process.env.NODE_ENV);\nuse(process.env.DECLARED);\n// sievework:ignore-env-var-undeclared\nuse(process.env.SKIPPED);\n",
    "src/sink.ts": "export function find(req: Request): void {\n  const id = req.params.id;\n  db.query(`select ${id}`);\n  db.query('select 1', [id]);\n  fs.rm('/tmp/' + id);\n}\n",
    "src/wide.ts": "export function wide(a: any, b: Many): void {\n" + "  step();\n" * 70 + "}\n",
    "src/__tests__/cart.test.ts": "it.only('a', () => { expect(1).toBe(1); });\nit('b', () => { run(); });\nxit('c', () => { expect(1).toBe(1); });\n",
    ".env.example": "DECLARED=\nNEVER=\n",
    "tsconfig.base.json": '{ "compilerOptions": { "strict": true } }',
    "tsconfig.json": '{ // comment\n  "extends": "./tsconfig.base.json",\n  "compilerOptions": { "noImplicitAny": false, }\n}\n',
    "tsconfig.loose.json": '{ "compilerOptions": { "target": "ES5" } }',
    "tsconfig.fine.json": '{ "compilerOptions": { "noImplicitAny": true } }',
    "package.json": '{"name": "p", "version": "1.0.0", "main": "dist/index.js", "types": "dist/none.d.ts", "dependencies": {"left-pad": "1", "right-pad": "1", "tsx": "1"}}',
    "src/uses.spec.ts": "import pad from 'left-pad';\nit('pads', () => { expect(pad('a', 2)).toBe(' a'); });\n",
}
#: Two workspaces for what crosses them.
MULTI = {
    ("app", "src/main.ts"): "import { used } from '@x/lib';\nimport { deep } from '@x/lib/deep';\n",
    ("lib", "src/index.ts"): "export { used, idle } from './impl';\nexport * from './all';\n",
    ("lib", "src/impl.ts"): "export function used(): void {\n}\nexport function idle(): void {\n}\n",
    ("lib", "src/all.ts"): "export function star(): void {\n}\n",
    ("lib", "src/deep.ts"): "export function deep(): void {\n}\nexport function shallow(): void {\n}\n",
}
#: Declarations, imports and call sites for the parsers and scanners alone.
PARTS = {
    "p/kinds.ts": "export interface Shape { id: string; readonly tags?: string[] }\nexport type Alias = { a: number; b: string };\nexport class Box extends Base { size: number = 1; grow(n: number): void { this.size += n; } }\n"
    "export default function main(a: string, b?: number): void {\n}\nconst local = async (x: number): Promise<number> => x;\nexport const twice = function (n: number): number { return n * 2; };\n",
    "p/twin.ts": "export interface Form { id: string; readonly tags?: string[] }\nexport interface Renamed { key: string; readonly labels?: string[] }\nexport function double(m: number): number { return m * 2; }\nexport function twofold(n: number): number { return n * 2; }\n",
    "p/uses.ts": "import main, { Shape as S } from './kinds';\nimport * as twin from './twin.js';\nexport { Alias } from './kinds';\nexport * from './twin';\nimport './missing';\nconst later = import('./twin');\nimport pad from 'left-pad';\n",
    "p/calls.ts": "prisma.user.upsert({ where: {}, update: { a: 1 }, create: { b: 1 } });\nAccount.findOneAndUpdate({ q: 1 }, { $set: { email: 3 } });\nknex('users').where({ q: 1 }).update({ name: 5 });\ndb.update(orders).set({ total: 4 });\n"
    "pool.query(\"INSERT INTO public.items (sku, n) VALUES (1, 2)\");\nUser.update({ email: 1 }, { where: { id } });\nitemRepository.save({ sku: 2 });\n",
    "p/http.ts": "fetch('/a/1', { method: 'DELETE' });\naxios({ url: '/b', method: 'post' });\ngot.patch(`/c/${id}`, x);\nrouter.get('/d/:id', h);\nfetch(`/d/${id}`);\naxios.get('/e/');\n",
}
_kept: dict = {}


def sample(spark: SparkSession, which: str = "files") -> Corpus:
    """A bundled corpus; its parsed tables are kept for all queries of a session."""
    key = (spark.sparkContext.applicationId, which)
    if key not in _kept:
        ship(spark)
        rows = [(w, p, t) for (w, p), t in MULTI.items()] if which == "multi" else [("w", p, t) for p, t in (PARTS if which == "parts" else FILES).items()]
        packages = spark.createDataFrame([("app", "@x/app"), ("lib", "@x/lib")], "workspace string, package_name string") if which == "multi" else None
        _kept[key] = Corpus(spark.createDataFrame(rows, "workspace string, path string, text string").coalesce(1), multi=which == "multi", packages=packages, shared=True)
    return _kept[key]


def _run(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return REGISTRY[name](sample(spark, "multi" if name == "dead-api" else "files")).select("severity", F.round("confidence", 3).alias("confidence"), "title", F.size("evidence").alias("sites"))

    run.__doc__ = f"{name} over the bundled corpus, with its default thresholds."
    return run


QUERIES = {f"sample_{n.replace('-', '_')}": _run(n) for n in REGISTRY}


def sample_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of every kind that is parsed."""
    return sample(spark, "parts").symbols.select("file", "name", "kind", "exported", "is_default", F.col("line_range.start_line").alias("first"), F.col("line_range.end_line").alias("last"))


def sample_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of types and parameters of functions, with their types and flags."""
    s = sample(spark, "parts").symbols
    x = F.concat(F.coalesce("type_struct.fields", F.array()), F.coalesce("fn_struct.params", F.array()))
    f = s.select("name", F.posexplode(x).alias("i", "f"))
    return f.select("name", "i", F.col("f.name").alias("field"), F.col("f.type").alias("type"), F.col("f.optional").alias("optional"), F.col("f.readonly").alias("readonly"))


def sample_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of declarations that share a strict, structural or normalized hash."""
    s = sample(spark, "parts").symbols
    h = s.select("name", F.explode(F.create_map(*[x for k in ("strict", "structural", "normalized") for x in (F.lit(k), F.col(f"hash_{k}"))])).alias("hash_kind", "h")).filter("h <> ''")
    a, b = h.select(F.col("name").alias("a"), "hash_kind", "h"), h.select(F.col("name").alias("b"), "hash_kind", "h")
    return a.join(b, ["hash_kind", "h"]).filter("a < b").select("a", "b", "hash_kind")


def sample_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import records and what they resolve to."""
    i = sample(spark, "parts").imports
    return i.select("source", "specifier", "target", "default_import", "namespace_alias", F.array_join("named_imports", ",").alias("named"), "is_re_export", "is_star_re_export")


def sample_sibling_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports across workspaces, resolved by package name."""
    return sample(spark, "multi").imports.select("source", "specifier", "target", "source_workspace", "target_workspace")


def sample_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to databases and over HTTP, routes and client calls."""
    return sample(spark, "parts").fact("db_write", "http_write", "route", "client_call").select("kind", "path", "line", "key")


def sample_text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the texts of the detectors' corpus: environment, manifests, infrastructure, lengths."""
    return sample(spark).fact("env_read", "env_decl", "pkg_target", "pkg_dep", "published", "iac_entry", "todo", "console").select("kind", "path", "line", "key")


QUERIES |= {f.__name__: f for f in (sample_symbols, sample_fields, sample_twins, sample_imports, sample_sibling_imports, sample_facts, sample_text_facts)}


def _values(columns: str, rows: str, **cast: str) -> str:
    """Expected rows, written as tuples of SQL literals, as a query."""
    names = columns.split()
    shown = ", ".join(f"{n}::{cast[n]} AS {n}" if n in cast else n for n in names)
    return f"SELECT {shown} FROM (VALUES {rows}) AS t({', '.join(names)})"


def _expected(rows: str) -> str:
    return _values("severity confidence title sites", rows, confidence="DOUBLE")


#: What each detector must report on the bundled corpora.
ORACLE = {
    "sample_long_function": _expected("('low', 0.98, 'Long function: `wide` (72 lines) in src/wide.ts', 1)"),
    "sample_deep_nesting": _expected("('low', 0.85, 'Deeply nested function: `deep` (depth 4) in src/deep.ts', 1)"),
    "sample_public_any": _expected("('high', 0.97, 'Public `any` in `wide` (src/wide.ts)', 1)"),
    "sample_duplicate_type": _expected("('medium', 1.0, '2 definitions appear equivalent: Account, User', 2)"),
    "sample_duplicate_function": _expected("('medium', 0.97, '2 definitions appear equivalent: addUp, sumUp', 2), ('medium', 0.82, '2 definitions appear equivalent: fetchUserRows, loadUserRows', 2)"),
    "sample_schema_shape_divergence": _expected("('medium', 0.9, 'Schema drift: `OrderModel` (src/types/order.ts) vs `OrderDto` (src/types/dto.ts)', 2)"),
    "sample_similar_functions": _expected("('medium', 0.75, '2 similar functions, canonical src/rows/fetch.ts:fetchUserRows', 2)"),
    "sample_dead_module": _expected("('low', 0.7, 'Unreachable module: src/shelf.ts', 1), ('low', 0.7, 'Unreachable module: src/report.ts', 1)"),
    "sample_dead_export": _expected("('low', 0.65, 'Unused export: spare in src/shelf.ts', 1), ('low', 0.65, 'Unused export: report in src/report.ts', 1)"),
    "sample_dead_api": _expected(
        "('low', 0.7, 'No other workspace uses shallow of lib/src/deep.ts', 1), ('low', 0.7, 'No other workspace uses star of lib/src/all.ts', 1), ('low', 0.7, 'No other workspace uses idle of lib/src/impl.ts', 1)"
    ),
    "sample_hot_hub_file": _expected("('low', 1.0, 'Import hub: src/hub.ts (20 importers)', 1)"),
    "sample_re_export_shadow": _expected("('medium', 0.92, '`a` has 2 origins in src/names.ts', 1), ('high', 0.92, '`b` has 2 origins in src/names.ts', 1)"),
    "sample_default_export_name_drift": _expected("('low', 0.95, 'Default export of src/format.ts goes by Format, Pretty', 1)"),
    "sample_dead_handler": _expected("('low', 0.65, 'Handler without wiring: src/handlers/idle.ts', 1)"),
    "sample_todo_comments": _expected("('low', 1.0, 'TODO comment in src/log.ts:1', 1)"),
    "sample_console_log_prod": _expected("('low', 0.9, 'console.log in src/log.ts:2', 1)"),
    "sample_skip_tests": _expected("('high', 0.97, 'Test isolation: .only(...) in src/__tests__/cart.test.ts:1', 1), ('medium', 0.97, 'Skipped test: x-prefixed skip in src/__tests__/cart.test.ts:3', 1)"),
    "sample_long_file": _expected("('low', 0.99, 'Long file: src/long.ts (450 LOC)', 1)"),
    "sample_silent_catch": _expected("('medium', 0.85, 'Silent catch in src/errors.ts:2', 1), ('medium', 0.85, 'Silent catch in src/errors.ts:5', 1)"),
    "sample_test_without_assertion": _expected("('medium', 0.85, 'Test without assertion: b in src/__tests__/cart.test.ts:2', 1)"),
    "sample_mutable_globals": _expected("('medium', 0.8, 'Reassigned module state: count in src/state.ts:5', 1), ('medium', 0.8, 'Reassigned module state: cache in src/flow.ts:1', 1)"),
    "sample_magic_numbers": _expected("('low', 0.7, 'Magic number 37 in src/log.ts:5', 1)"),
    "sample_bad_config": _expected(
        "('medium', 0.95, 'tsconfig: strict not set in tsconfig.loose.json', 1), ('low', 0.95, 'tsconfig: target is ES5 in tsconfig.loose.json', 1), ('high', 0.95, 'tsconfig: noImplicitAny disabled in tsconfig.json', 1)"
    ),
    "sample_env_var_undeclared": _expected("('medium', 0.9, 'Undeclared variable PORT_NAME read in src/env.ts:1', 1), ('low', 0.85, 'Variable NEVER declared in .env.example is never read', 1)"),
    "sample_dead_endpoint": _expected("('medium', 0.8, 'GET /unused has no caller (src/api.ts:5)', 1)"),
    "sample_producer_consumer_field_drift": _expected("('high', 0.85, 'Drift on POST /orders: no client sends gone (src/api.ts:1)', 1)"),
    "sample_unsanitized_input_to_sink": _expected("('high', 0.7, 'id from req.params.id reaches db.query in src/sink.ts:3', 1), ('high', 0.7, 'id from req.params.id reaches fs.rm in src/sink.ts:5', 1)"),
    "sample_shared_db_write": _expected("('medium', 0.7, '`user.email` is written from 2 files (prisma+typeorm)', 2)"),
    "sample_api_race": _expected("('medium', 0.65, '`PUT /users/:id` is called from 2 files', 2)"),
    "sample_mutation": _expected("('medium', 0.7, 'Parameter xs changed by push', 1), ('medium', 0.7, 'Parameter o changed by =', 1)"),
    "sample_race_condition": _expected("('medium', 0.7, 'Read-modify-write across await on cache', 1)"),
    "sample_unused_deps": _expected("('low', 0.85, 'Unused dependency right-pad in package.json', 1)"),
    "sample_package_export_mismatch": _expected("('high', 0.97, 'package.json#types points at dist/none.d.ts', 1)"),
    "sample_symbols": _values(
        "file name kind exported is_default first last",
        "('p/kinds.ts', 'Shape', 'interface', true, false, 1, 1), ('p/kinds.ts', 'Alias', 'type-alias', true, false, 2, 2), ('p/kinds.ts', 'Box', 'class', true, false, 3, 3), ('p/kinds.ts', 'main', 'function', true, true, 4, 5), "
        "('p/kinds.ts', 'local', 'function', false, NULL, 6, 6), ('p/kinds.ts', 'twice', 'function', true, NULL, 7, 7), ('p/twin.ts', 'Form', 'interface', true, false, 1, 1), ('p/twin.ts', 'Renamed', 'interface', true, false, 2, 2), "
        "('p/twin.ts', 'double', 'function', true, false, 3, 3), ('p/twin.ts', 'twofold', 'function', true, false, 4, 4)",
    ),
    "sample_fields": _values(
        "name i field type optional readonly",
        "('Shape', 0, 'id', 'string', false, false), ('Shape', 1, 'tags', 'string[]', true, true), ('Alias', 0, 'a', 'number', false, false), ('Alias', 1, 'b', 'string', false, false), ('Box', 0, 'size', 'number', false, false), "
        "('Box', 1, '()grow', '(n:number)=>void', false, false), ('main', 0, 'a', 'string', false, false), ('main', 1, 'b', 'number', true, false), ('local', 0, 'x', 'number', false, false), ('twice', 0, 'n', 'number', false, false), "
        "('Form', 0, 'id', 'string', false, false), ('Form', 1, 'tags', 'string[]', true, true), ('Renamed', 0, 'key', 'string', false, false), ('Renamed', 1, 'labels', 'string[]', true, true), ('double', 0, 'm', 'number', false, false), ('twofold', 0, 'n', 'number', false, false)",
    ),
    # strict: equal names and types; normalized: equal up to synonyms; structural: names don't count
    "sample_twins": _values(
        "a b hash_kind",
        "('Form', 'Shape', 'strict'), ('Form', 'Shape', 'normalized'), ('Form', 'Shape', 'structural'), ('Form', 'Renamed', 'structural'), ('Renamed', 'Shape', 'structural'), ('double', 'twofold', 'structural'), ('double', 'twice', 'structural'), ('twice', 'twofold', 'structural'), ('twice', 'twofold', 'strict'), ('twice', 'twofold', 'normalized')",
    ),
    "sample_imports": _values(
        "source specifier target default_import namespace_alias named is_re_export is_star_re_export",
        "('p/uses.ts', './kinds', 'p/kinds.ts', 'main', NULL, 'Shape', false, false), ('p/uses.ts', './twin.js', 'p/twin.ts', NULL, 'twin', '', false, false), ('p/uses.ts', 'left-pad', NULL, 'pad', NULL, '', false, false), ('p/uses.ts', './kinds', 'p/kinds.ts', NULL, NULL, 'Alias', true, false), "
        "('p/uses.ts', './missing', NULL, NULL, NULL, '', false, false), ('p/uses.ts', './twin', 'p/twin.ts', NULL, NULL, '', true, true), ('p/uses.ts', './twin', 'p/twin.ts', NULL, '__dynamic__', '', false, false)",
    ),
    "sample_sibling_imports": _values(
        "source specifier target source_workspace target_workspace",
        "('lib/src/index.ts', './impl', 'lib/src/impl.ts', 'lib', 'lib'), ('lib/src/index.ts', './all', 'lib/src/all.ts', 'lib', 'lib'), ('app/src/main.ts', '@x/lib/deep', 'lib/src/deep.ts', 'app', 'lib'), ('app/src/main.ts', '@x/lib', 'lib/src/index.ts', 'app', 'lib')",
    ),
    "sample_facts": _values(
        "kind path line key",
        "('db_write', 'p/calls.ts', 1, 'user.a'), ('db_write', 'p/calls.ts', 1, 'user.b'), ('db_write', 'p/calls.ts', 2, 'account.email'), ('db_write', 'p/calls.ts', 3, 'users.name'), ('db_write', 'p/calls.ts', 4, 'orders.total'), ('db_write', 'p/calls.ts', 5, 'items.sku'), ('db_write', 'p/calls.ts', 5, 'items.n'), "
        "('db_write', 'p/calls.ts', 6, 'user.email'), ('db_write', 'p/calls.ts', 7, 'item.sku'), ('route', 'p/http.ts', 4, 'get /d'), ('client_call', 'p/http.ts', 1, 'delete /a/1'), ('client_call', 'p/http.ts', 2, 'post /b'), ('client_call', 'p/http.ts', 5, 'get /d'), ('client_call', 'p/http.ts', 6, 'get /e'), "
        "('http_write', 'p/http.ts', 1, 'DELETE /a/:id'), ('http_write', 'p/http.ts', 2, 'POST /b'), ('http_write', 'p/http.ts', 3, 'PATCH /c/:param')",
    ),
    "sample_text_facts": _values(
        "kind path line key",
        "('iac_entry', 'infra/stack.ts', 1, 'src/handlers/busy.main'), ('todo', 'src/log.ts', 1, 'TODO:trim this'), ('console', 'src/log.ts', 2, 'log'), ('env_read', 'src/env.ts', 1, 'PORT_NAME'), ('env_read', 'src/env.ts', 2, 'NODE_ENV'), ('env_read', 'src/env.ts', 3, 'DECLARED'), ('env_read', 'src/env.ts', 5, 'SKIPPED'), "
        "('env_decl', '.env.example', 1, 'DECLARED'), ('env_decl', '.env.example', 2, 'NEVER'), ('pkg_target', 'package.json', 1, 'main::dist/index.js'), ('pkg_target', 'package.json', 1, 'types::dist/none.d.ts'), ('pkg_dep', 'package.json', 1, 'left-pad'), ('pkg_dep', 'package.json', 1, 'right-pad'), ('pkg_dep', 'package.json', 1, 'tsx'), ('published', 'package.json', 1, 'p')",
    ),
}
