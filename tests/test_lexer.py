"""Symbols with ranges from texts of each language, and from whole files."""

from __future__ import annotations

import time

import pytest

from weft.sources import files, lexer

TS = """import { n } from './util';
// function nope() {}
/* class Nope {} */
export const envSchema = { PORT: 3000, "a{": `x ${ {a: "}"}.a } }` };
export function makeConfig() { const localValue = 1; const inner = (x) => x; return envSchema; }
export default class Foo<T> extends Bar {
  static async list(a: {x: number}, b = f()): Promise<void> { if (a) { return; } }
  get x() { return /[}/]'/.test("{"); }
  field = () => { const q = 1; };
  constructor(private y: string) { super(); }
}
interface I { foo(): void; a: string }
const a = 1, b = function () { return 2; }, {c} = z;
app.get('/users/:id', async (req, res) => { res.send("}"); });
new Elysia()
  .get("/", () => 1)
  .post('/b', h);
const obj = { meth() { return 1; }, k: 2 };
if (x) { const hidden = 3; }
const str = "function fake() {}";
"""
PY = '''class A:
    """def no(): pass
    class B"""
    x = [
 1,
    ]
    async def m(self,
          a=")"):
        def inner():
            return 1
        # def c(): pass
        return inner

    @property
    def n(self): return 2
def f(): pass
s = "def g():"
'''
GO = "type R interface {\n\tRead(p []byte) error\n}\nfunc (s *S) Do(x int) error { return f(\"}{\") }\nfunc Main[T any](a T) (int, error) {\n\treturn\n}\n// func no() {}\n"
RUST = "pub struct P { x: i32 }\nstruct U;\nfn go<'a>(x: &'a str) -> u8 { let c = '}'; 1 }\nimpl<T: Clone> Shape for P<T> { fn area(&self) -> f64 { 0.0 } }\ntrait Shape { fn area(&self) -> f64; }\nenum E { A { x: i32 } }\nlet s = r#\"fn no() {}\"#;\n"
JAVA = "public class A<T> extends B {\n  private final int x = 1;\n  public A(int x) { this.x = x; }\n  @Override public <R> List<R> m(T t) throws IOException, E { if (x) { return null; } }\n  abstract void q();\n  enum Z { P, Q }\n  record R(int a, int b) { }\n  String s = \"class No {}\";\n}\ninterface K { int z(int a); }\n"
CPP = "#include <x>\n#define M {\nstruct S { int a; };\nenum class Color : int { Red };\nclass Foo : public Bar { public: int get() const { return a; } ~Foo() {} };\nint main(int argc, char** argv) { while (a(b)) {} struct S s; }\nstd::vector<int> ns::Foo::bar(int x) const { return {}; }\nint decl(int x);\n"
WANTED = {
    ("typescript", TS): [("envSchema", "variable", 4, 4), ("makeConfig", "function", 5, 5), ("inner", "function", 5, 5), ("Foo", "class", 6, 11), ("list", "method", 7, 7), ("x", "method", 8, 8), ("constructor", "method", 10, 10),
                         ("I", "interface", 12, 12), ("a", "variable", 13, 13), ("b", "function", 13, 13), ("route_users_:id", "route_handler", 14, 14), ("route_root", "route_handler", 15, 16), ("obj", "variable", 18, 18), ("meth", "method", 18, 18), ("str", "variable", 20, 20)],
    ("python", PY): [("A", "class", 1, 15), ("m", "method", 7, 12), ("inner", "function", 9, 10), ("n", "method", 15, 15), ("f", "function", 16, 16)],
    ("go", GO): [("R", "interface", 1, 3), ("Do", "method", 4, 4), ("Main", "function", 5, 7)],
    ("rust", RUST): [("P", "class", 1, 1), ("U", "class", 2, 2), ("go", "function", 3, 3), ("Shape for P<T>", "class", 4, 4), ("area", "function", 4, 4), ("Shape", "interface", 5, 5), ("E", "class", 6, 6)],
    ("java", JAVA): [("A", "class", 1, 9), ("A", "method", 3, 3), ("m", "method", 4, 4), ("q", "method", 5, 5), ("Z", "class", 6, 6), ("R", "class", 7, 7), ("K", "interface", 10, 10), ("z", "method", 10, 10)],
    ("cpp", CPP): [("S", "class", 3, 3), ("Color", "class", 4, 4), ("Foo", "class", 5, 5), ("get", "function", 5, 5), ("~Foo", "function", 5, 5), ("main", "function", 6, 6), ("ns::Foo::bar", "function", 7, 7)],
    ("prisma", "model A { id Int }\nmodel B {\n  x Int\n  }\nmodel C {\n a A\n}\nmodel D {"): [("A", "db_model", 1, 1), ("B", "db_model", 2, 4), ("C", "db_model", 5, 7), ("D", "db_model", 8, 8)],
}


@pytest.mark.parametrize(("language", "text"), WANTED)
def test_symbols_have_ranges(language, text):
    got = [(s.name, s.kind, text.count("\n", 0, s.start) + 1, text.count("\n", 0, s.end) + 1) for s in lexer.symbols(text, language)]
    assert got == WANTED[language, text]


@pytest.mark.parametrize(("language", "text"), WANTED)
def test_masks_keep_places(language, text):
    code = lexer.masked(text, language)
    assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    for broken in (text[: len(text) // 2], text.replace("}", ""), text.replace("{", ""), text[::-1]):
        found = lexer.symbols(broken, language)
        assert all(0 <= s.start <= s.end <= len(broken) for s in found)


def test_parents_are_the_narrowest_around():
    found = lexer.symbols(PY, "python")
    assert [found[q].name if q >= 0 else None for q in lexer.parents(found)] == [None, "A", "m", "A", None]


def test_imports():
    assert lexer.imports("import a, b as c, d.e\nfrom .x import y\n# import z\ns='''\nimport q\n'''\n", "python") == ["a", "d.e", ".x"]
    assert lexer.imports('import (\n "fmt"\n x "a/b"\n)\nimport "c"\n// import "d"\n', "go") == ["fmt", "a/b", "c"]
    script = "const a = require('x'); export { b } from \"./b\";\nimport './side'; import type { T } from 'types'; // import 'no'\nconst s = \"import 'n2'\";"
    assert lexer.imports(script, "javascript") == ["x", "./b", "./side", "types"]


def test_scan_is_linear():
    took = []
    for n in (400, 1600):
        began = time.process_time()
        lexer.symbols(TS * n, "typescript")
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]


def test_ingest_gives_one_graph(spark):
    rows = [
        ("src/util.ts", "typescript", "export const n = 1;\n"),
        ("src/app.ts", "typescript", "import { n } from './util';\nimport { t } from './tools';\nimport z from 'zod/x';\nexport const x = () => n;\n"),
        ("src/tools/b.ts", "typescript", "export function b() {}\n"),
        ("src/tools/a.ts", "typescript", "export function a() {}\n"),
        ("src/hooks/useSession.ts", "typescript", "export const useSession = () => ({ user: null });\n"),
        ("src/middleware/auth.ts", "typescript", "export function authGuard() { return true; }\n"),
        ("src/services/profile.ts", "typescript", "export class ProfileService { list() { return []; } }\n"),
        ("config.ts", "typescript", "export const appConfig = { databaseUrl: process.env.DATABASE_URL };\nexport function makeConfig() { const localValue = 1; return localValue; }\n"),
        ("app.config.ts", "typescript", "export default defineConfig({ a: 1 })\n"),
        ("prisma/schema.prisma", "prisma", "model Profile {\n  id String @id\n  name String\n}\n"),
        ("empty.py", "python", None),
    ]
    df = spark.createDataFrame([("demo/x", *r) for r in rows], "repo_name string, path string, language string, content string")
    nodes, edges = files.ingest(df)
    got = {(r.label, r.kind) for r in nodes.collect()}
    assert {("useSession", "react_hook"), ("authGuard", "middleware"), ("ProfileService", "service_boundary"), ("appConfig", "config_object"), ("makeConfig", "config_object"), ("Profile", "db_model"), ("app_config", "config_object")} <= got
    assert "localValue" not in {label for label, _ in got} and ("app.ts", "file_surface") in got
    made = {(r.source_id, r.target_id, r.edge_type) for r in edges.collect()}
    uri = "repo://demo/x/"
    assert (f"{uri}src/app.ts", f"{uri}src/util.ts", "DEPENDS_ON_FILE") in made and (f"{uri}src/app.ts", "module:zod", "IMPORTS_MODULE") in made
    assert (f"{uri}src/app.ts", f"{uri}src/tools/a.ts", "DEPENDS_ON_FILE") in made  # a folder stands for its least file
    assert (f"{uri}prisma/schema.prisma", f"{uri}prisma/schema.prisma#Profile:db_model:1", "CONTAINS") in made
    assert ("project:demo_x", f"{uri}config.ts", "CONTAINS") in made
    assert nodes.where("label = 'list'").first()["parent"] == "ProfileService"
