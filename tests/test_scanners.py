"""Text scanners and parsers: a positive case and a near miss each."""

import pytest

import sievework.functions.config_rules as cfg
import sievework.functions.flow as flow  # noqa: F401
from sievework.functions import declare
from sievework.functions.lex import Source, mask, nesting_depth
from sievework.functions.scan import SCANNERS, dead_endpoint_key, effective_lines, facts_of, http_path, sql_write

PRAGMA = "// sievework:ignore-"


def keys(kind, text, path="src/a.ts"):
    return [f[3] for f in SCANNERS[kind](path, Source(text))]


def attrs(kind, text, path="src/a.ts"):
    return [f[4] for f in SCANNERS[kind](path, Source(text))]


def test_mask_keeps_length_and_blanks():
    s = "a('x{y'); // b{\n/* c{ */ `t{` x = /[{(]/g;"
    m = mask(s, True)
    assert len(m) == len(s) and m.count("{") == 0 and m.count("\n") == 1


@pytest.mark.parametrize(
    "text, want",
    [("// TODO: x", ["TODO:x"]), ("# fixme later", ["FIXME:later"]), ("const todo = 1", []), ("/** NOTE: y */", ["NOTE:y */"])],
)
def test_todo(text, want):
    assert keys("todo", text) == want
    assert keys("todo", text, "a/node_modules/x.ts") == []


def test_console():
    assert keys("console", "console.log(1)\nconsole.error(2)\n// console.log(3)\n" + PRAGMA + "console-log-prod\nconsole.info(4)") == ["log"]
    assert keys("console", "console.log(1)", "src/a.test.ts") == keys("console", "console.log(1)", "scripts/a.ts") == []


def test_skipped_tests():
    t = "it.only('a', f); describe.skip('b', f); xit('c', f); fit('d', f); it('e', f)"
    assert keys("skipped_test", t, "src/a.test.ts") == [".skip(...)", ".only(...)", "x-prefixed skip", "f-prefixed only"]
    assert keys("skipped_test", t) == []


def test_effective_lines():
    assert effective_lines("a\n\n// b\n/* c\n d */ e\n * f\n/* g */ h\n") == 3


def test_silent_catch():
    assert [a["how"] for a in attrs("catch", "try{}catch(e){}\ntry{}catch{ return null; }\ntry{}catch(e){ console.log(e); }\ntry{}catch(e){ throw e; }\ntry{}catch(e){ // intentional\n }")] == ["empty", "bare-return", "console-only"]


def test_unasserted_tests():
    t = "it('a', () => { run(); }); it('b', () => { expect(1).toBe(1); }); it('c', () => {}); it.skip('d', () => { run(); });"
    assert keys("test_case", t, "a.spec.ts") == ["a"]


def test_mutable_globals():
    assert keys("mutable_global", "let a = 1;\nlet b = 2;\nfunction f() {\n  let c = 1; c = 2;\n  a += 1;\n  o.b = 3;\n}\n") == ["a"]


def test_magic_numbers():
    t = "const LIMIT = 42;\nf(37);\n\nres.status(404);\nif (status === 500) {}\ng(-1, 1024);\nconst t = [\n  3, 7,\n];\nwait(3.5);\nconst o = { port: 3007 };"
    assert keys("number", t) == ["37", "3.5"]
    assert keys("number", "f(37)", "vite.config.ts") == []


def test_env():
    assert keys("env_read", "process.env.FOO; process.env['BAR']; import.meta.env.VITE_X; process.env[name]") == ["FOO", "BAR", "VITE_X"]
    assert keys("env_decl", "FOO=1\nexport BAR=\n# BAZ=2\n", ".env.example") == ["FOO", "BAR"]
    assert keys("env_decl", "FROM x\nENV FOO=1\nARG BAR\nRUN y", "Dockerfile.dev") == ["FOO", "BAR"]
    assert keys("env_decl", "services:\n  a:\n    environment:\n      - FOO=1\n      BAR: 2\n    ports:\n      - BAZ: 1\n", "docker-compose.yml") == ["FOO", "BAR"]


def test_endpoints():
    assert dead_endpoint_key("GET", "/users/:id") == dead_endpoint_key("get", "/users/") == "get /users"
    assert keys("route", "app.get('/a/:id', h); router.post(`/b`, h); other.get('/c', h)") == ["get /a", "post /b"]
    assert keys("client_call", "fetch('/a'); fetch(`/b/${id}`, { method: 'POST' }); axios.delete('/c/'); axios({ url: '/d', method: 'put' })") == ["get /a", "post /b", "delete /c", "put /d"]


def test_field_drift_facts():
    f = list(SCANNERS["route_reads"]("a.ts", Source("app.post('/u', (req, res) => { const { a, b: c } = req.body; use(req.query.page); });")))
    assert [(x[3], x[5]) for x in f] == [("post /u", ["a", "b", "page"])]
    f = list(SCANNERS["client_body"]("a.ts", Source("fetch('/u', { method: 'POST', body: JSON.stringify({ a, x: 1, ...rest }) }); axios.post('/v/', { q: 1 }); axios.get('/w', { z: 1 })")))
    assert [(x[3], x[5]) for x in f] == [("post /u", ["a", "x"]), ("post /v", ["q"])]


def test_http_writes():
    assert http_path("https://h.example/a//12/b/?q=1") == "/a/:id/b"
    t = "axios.patch(`/u/${id}`, b); fetch('/u/7', { method: 'PUT' }); fetch('/u'); fetch('/u', { method: 'GET' }); mine.put('/u'); axios({ url: 'x', method: 'post' }); got.get('/u')"
    assert keys("http_write", t) == ["PATCH /u/:param", "PUT /u/:id", "POST /x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("prisma.user.update({ where: { id }, data: { email: x, name: y } })", ["prisma:user.email", "prisma:user.name"]),
        ("tx.user.upsert({ where: {}, update: { a: 1 }, create: { b: 1 } })", ["prisma:user.a", "prisma:user.b"]),
        ("User.update({ email: 1 }, { where: { id } })", ["sequelize:user.email"]),
        ("User.update({ email: 1 }, { other: 1 })", []),
        ("QueryBuilder.update({ email: 1 }, { where: 1 })", []),
        ("userRepository.save({ email: 2 })", ["typeorm:user.email"]),
        ("getRepository(User).update(id, { email: 3 })", ["typeorm:user.email"]),
        ("Account.findOneAndUpdate({ a: 1 }, { $set: { email: 3 } })", ["mongoose:account.email"]),
        ("this.userModel.updateOne({}, { $inc: { n: 1 }, email: 1 })", ["mongoose:user.email"]),
        ("knex('users').where({ a: 1 }).update({ email: 5 })", ["knex:users.email"]),
        ("db.update(users).set({ email: 4 }).where(1)", ["drizzle:users.email"]),
        ("pool.query(\"UPDATE public.users SET email = $1, n = 2 WHERE id = 2\")", ["raw-sql:users.email", "raw-sql:users.n"]),
        ("pool.query('SELECT 1')", []),
    ],
)
def test_db_writes(text, want):
    assert [f"{f[4]['adapter']}:{f[3]}" for f in SCANNERS["db_write"]("a.ts", Source(text))] == want


def test_sql_write():
    assert sql_write('INSERT INTO "app"."users" (email, "name") VALUES (1, 2)') == ("users", ["email", "name"])
    assert sql_write("delete from users") is None


def test_taint():
    t = "const id = req.params.id; const { q: term } = req.query; const ok = Number(req.body.n);\ndb.query(`select ${id}`); exec('ls ' + term); db.query('select 1', [id]); eval(ok); sql`x ${id}`"
    assert keys("taint", t) == ["db.query:id", "exec:term", "sql`...`:id"]


def test_packages():
    pkg = '{"name": "p", "version": "1.0.0", "main": "dist/index.js", "bin": {"x": "./bin/x.js"}, "exports": {".": {"import": "./dist/a.mjs"}, "./*": "./y/*.js"}, "dependencies": {"a": "1", "b": "workspace:*"}}'
    assert keys("pkg_target", pkg, "package.json") == ["main::dist/index.js", "bin.x::./bin/x.js", "exports...import::./dist/a.mjs"]
    assert keys("pkg_target", pkg.replace('"name"', '"private": true, "name"'), "package.json") == []
    assert keys("pkg_dep", pkg, "package.json") == ["a", "b"]
    assert keys("pkg_dep", "{broken", "package.json") == []


def test_mutations():
    t = "let shared = {};\nfunction f(xs: string[], o: Foo, r: readonly string[]) {\n  xs.push(1);\n  o.a = 1;\n  delete o.b;\n  r.push(2);\n  shared.x = 1;\n  this.y = 1;\n  const l = []; l.push(1);\n  return o;\n}"
    got = [(f[3], f[4]["pattern"], f[4]["escapes"]) for f in SCANNERS["mutation"]("a.ts", Source(t))]
    assert got == [("xs", "array-mutator", "0"), ("o", "property-assignment", "1"), ("o", "delete-property", "1"), ("shared", "shared-state-write", "0")]


RACE = "let total = 0;\nlet cache = null;\n"


@pytest.mark.parametrize(
    "text, want",
    [
        ("class C { async inc() {\n const n = this.n;\n await t();\n this.n = n + 1;\n} }", ["read-modify-write"]),
        ("async function f() {\n const c = cache;\n if (c) return c;\n const v = await load();\n cache = v;\n return v;\n}", ["read-modify-write"]),
        ("async function f(ids) { await Promise.all(ids.map(async (id) => {\n const t = total;\n const x = await get(id);\n total = t + x;\n})); }", ["read-modify-write", "promise-all"]),
        ("async function f() { await Promise.all([(async () => { total = 1; })(), (async () => { total = 2; })()]); }", ["promise-all"]),
        ("async function f() { await Promise.all([(async () => { total = 1; })(), (async () => { cache = 2; })()]); }", []),
        ("async function f(a) {\n const t = total;\n if (a) {\n  await x();\n  return;\n } else {\n  total = 1;\n }\n}", []),
        ("async function f() {\n const t = local;\n await x();\n local = t;\n}", []),
        ("function f() {\n const t = total;\n total = t + 1;\n}", []),
        ("function g(em) {\n let seen = 0;\n em.on('x', async () => {\n  const s = seen;\n  await y();\n  seen = s + 1;\n });\n}", ["read-modify-write"]),
    ],
)
def test_races(text, want):
    assert [f[4]["pattern"] for f in SCANNERS["race"]("a.ts", Source(RACE + text))] == want


def test_strict_order_flag():
    src = Source("let total = 0;\nasync function f() {\n await x();\n total = 1;\n const t = total;\n}")
    f = declare.callables(src)[0]
    assert list(flow.read_await_write(src, f, {"total"})) and not list(flow.read_await_write(src, f, {"total"}, strict_order=True))


def test_symbols_and_hashes():
    t = "export interface User { id: string; email?: string; call(a: number): void; [key: string]: unknown }\nexport type Acc = { userId: string; mail?: string };\ntype U = 'a' | 'b';\nexport default async function go(a: number, b = 2): Promise<void> { return; }\nconst f = (x: string) => x;\nclass K { static s = 1; a: string; m(): void {} }\nfunction over(a: string): void;\n"
    s = {x["name"]: x for x in declare.symbols("a.ts", t)}
    assert set(s) == {"User", "Acc", "U", "go", "f", "K"}
    assert [(f["name"], f["type"], f["optional"]) for f in s["User"]["type_struct"]["fields"]] == [("id", "string", False), ("email", "string", True), ("()call", "(a:number)=>void", False), ("[string]", "unknown", False)]
    assert s["go"]["is_default"] and s["go"]["fn_struct"]["is_async"] and s["go"]["fn_struct"]["params"][1]["optional"]
    assert s["U"]["structure_kind"] == "union" and s["K"]["kind"] == "class" and [f["name"] for f in s["K"]["type_struct"]["fields"]] == ["a", "()m"]
    a = declare.type_hashes([{"name": "user_id", "type": "string", "optional": False}, {"name": "mail", "type": "string | undefined", "optional": False}])
    b = declare.type_hashes([{"name": "uid", "type": "string", "optional": False}, {"name": "email", "type": "string", "optional": False}])
    assert a[0] != b[0] and a[1] == b[1] and a[2] == b[2]


def test_canonical_type():
    assert declare.canonical_type("b | undefined | a") == "a|b"
    assert declare.canonical_type("Map<a | b, c>") == "Map<a|b,c>"
    assert declare.canonical_type("() => a | b") == "()=>a|b"


def test_shingles():
    assert declare.shingles("{ a }") == ["{ _ }"]
    assert declare.shingles(declare.collapse("{ return a + 'x'; // y\n }")) == declare.shingles("{ return b + 'zz'; }")


def test_imports():
    t = "import D, { a as b, type c } from './x';\nimport * as N from 'n';\nimport './side';\nexport { p as q } from './r';\nexport * from './s';\nexport * as M from './t';\nconst l = await import('./u');"
    got = [(i["specifier"], i["default_import"], i["named_imports"], i["namespace_alias"], i["is_re_export"], i["is_star_re_export"], i["re_export_local_names"]) for i in declare.imports("a.ts", t)]
    assert got == [
        ("./x", "D", ["a", "c"], None, False, False, None), ("n", None, [], "N", False, False, None), ("./side", None, [], None, False, False, None),
        ("./r", None, ["p"], None, True, False, ["q"]), ("./s", None, [], None, True, True, []), ("./t", None, [], None, True, True, []), ("./u", None, [], "__dynamic__", False, False, None),
    ]


def test_nesting_depth():
    assert nesting_depth("function f() { if (a) { for (;;) { while (x) { try { } catch (e) { if (y) {} } } } } }") == 5
    assert nesting_depth("function f() { const o = { a: { b: { c: 1 } } }; }") == 0


def test_jsonc_and_rules():
    assert cfg.read_jsonc('{ // c\n "paths": { "@/*": ["src/*"], }, /* d */ "a": "x,}" }') == {"paths": {"@/*": ["src/*"]}, "a": "x,}"}
    assert keys("config", '{"compilerOptions": {"strict": false, "allowJs": true, "target": "es5"}}', "tsconfig.json") == ["strict", "allowJs", "target"]
    assert keys("config", '{"compilerOptions": {"strict": true}}', "tsconfig.json") == []
    assert keys("config", '{"rules": {"eqeqeq": "off", "@typescript-eslint/no-explicit-any": ["off"]}}', ".eslintrc.json") == ["@typescript-eslint/no-explicit-any", "eqeqeq"]
    assert keys("config", '{"linter": {"enabled": false, "rules": {"style": {"noNonNullAssertion": "off"}}}}', "biome.json") == ["noNonNullAssertion", "linter.enabled"]


def test_broken_texts_never_raise():
    for t in ("", "{{{{", "((((", "`${", "catch (", "it('", "function (", "=> {", "class A {", "}" * 50, "\x00", "import {", "export default"):
        list(facts_of("src/a.test.ts", t, SCANNERS))
        list(declare.symbols("a.ts", t))
        list(declare.imports("a.ts", t))


def test_long_annotations_keep_their_functions():
    fields = " ".join(f"field{i}: Array<string>;" for i in range(200))
    texts = [
        f"export const handler: Handler<{{ {fields} }}> = async (e) => {{ return e; }};",
        f"export const handler = async <T extends {{ {fields} }}>(e: T) => {{ return e; }};",
        "export const handler: (a: number, b: Map<string, number>) => void = async (a, b) => {};",
        "export const other = 1 > 0,\n  handler: A<B, C> = async (a) => a;",
    ]
    for t in texts:
        (f,) = [x for x in declare.symbols("a.ts", t) if x["kind"] == "function"]
        assert (f["name"], f["exported"], f["fn_struct"]["is_async"]) == ("handler", True, True) and f["source"].startswith("handler"), t
    (f,) = declare.symbols("a.ts", f"function f<T extends {{ {fields} }}>(x: T) {{ return x; }}")
    assert f["name"] == "f"
    assert not list(declare.symbols("a.ts", "let a: string\nb = () => 1\nexports.c = () => 2"))


def test_token_stream():
    t = Source("a?.b.c(x, [1, 2], (y) => { return /[)]/; }) // (c\nit.each(rows)('t', f); new Function(z); if (q) {} don't").tokens
    calls = {c.parts: (len(c.args), c.new) for c in t.calls()}
    assert calls == {("a", "b", "c"): (3, False), ("it", "each"): (1, False), ("it", "each", "()"): (2, False), ("Function",): (1, True)}
    assert [x for _, x in t.comments] == ["// (c"] and all(t.pair[t.pair[i]] == i for i in range(len(t)) if t.pair[i] >= 0)
    assert Source("").calls == [] and Source("((]").calls == []


def test_scanners_see_structure_not_windows():
    far = "x" * 400
    assert keys("test_case", f"it('{far}', () => {{ run(); }});", "a.test.ts") == [far]
    assert keys("client_call", f"fetch('/a', {{ headers: {{ a: f(1) }}, body: '{far}', method: 'PUT' }});") == ["put /a"]
    assert [f[5] for f in SCANNERS["client_body"]("a.ts", Source("fetch('/u', { method: 'POST', body: JSON.stringify({ a: { b: 1 }, c: [2], ...d }) });"))] == [["a", "c"]]
    assert keys("number", "const TABLE: Record<string, number[]> = {\n  a: [3, 7, 9],\n};\nconst grid = [\n  1.5, 37,\n];\nenum E { A = 77 }\nf(a[41], 5e9, 0x1f);\nif (x >= 43) {}\nuse(51, 2);") == ["7", "9", "51"]
    assert keys("taint", "const id = req.query.id;\nfs.rm('/tmp/' + id);\nexec(`ls ${other}`);\npool.query('a' + f(id), 1);\nquery('x', id);") == ["fs.rm:id", "pool.query:id"]
    assert keys("mutable_global", "  let a = 1;\nif (x) { a = 2; }\nvar b = 1; o.b = 2;\n{ let c = 1; c = 2; }\n") == ["a"]


def test_function_expressions_go_by_their_variable():
    got = {s["name"]: (s["exported"], s["fn_struct"]["is_async"]) for s in declare.symbols("a.ts", "export const twice = function (n: number): number { return n * 2; };\nconst own = async function inner() { return 1; };\nfoo(function () { return 2; });\n")}
    assert got == {"twice": (True, False), "own": (False, True)}
