"""Extractors on small sources: kinds, names, spans, edges, and files that are broken or empty."""

import pytest

from spanloom.sources.extract import extract


def kinds(x):
    return {(s.name, s.kind) for s in x.symbols}


def edges(x):
    return {(e.src_name, e.dst_name, e.kind, e.confidence) for e in x.edges}


def test_python():
    src = "import os\nfrom session import create_session\nclass Auth:\n    def login(self):\n        return create_session()\ndef helper():\n    return x.login()\n"
    x = extract("pkg/a.py", src)
    assert x.status == "graph" and kinds(x) == {("<file>", "module"), ("Auth", "class"), ("login", "method"), ("helper", "function")}
    assert {("<file>", "os", "import", "high"), ("<file>", "session", "import", "high"), ("<file>", "create_session", "import", "high"), ("login", "create_session", "call", "low"), ("helper", "login", "call", "low")} == edges(x)
    auth = next(s for s in x.symbols if s.name == "Auth")
    assert (auth.start_line, auth.end_line) == (3, 5) and src[auth.start_byte : auth.end_byte].startswith("class Auth")


def test_python_lines():
    """Only line feeds and carriage returns end a line, as the parser has it."""
    src = "x = 1 # a\u2028b\x0cc\u0085d\x1ce\n\x0c\ndef f():\r\n    return 'é\u2029', g()\r\n\ndef h(): pass\n"
    x = extract("a.py", src)
    spans = {s.name: (s.start_line, s.end_line, src.encode()[s.start_byte : s.end_byte].decode()) for s in x.symbols}
    assert spans["f"] == (3, 4, "def f():\r\n    return 'é\u2029', g()") and spans["h"] == (6, 6, "def h(): pass")


def test_python_broken():
    x = extract("a.py", "import os, sys\nclass A:\n    def f(self):\n        return (\n\ndef g():\n    pass\n")
    assert x.status == "graph" and {("A", "class"), ("f", "method"), ("g", "function")} <= kinds(x)
    assert kinds(extract("a.py", "")) == {("<file>", "module")}


def test_typescript():
    x = extract("a.ts", "import d, { createSession as cs, other } from './session'\nimport * as ns from \"lib\"\nexport interface User { id: string }\ntype Id = string | number;\nexport class AuthService { async login(a: string): Promise<void> { cs(); this.helper?.() } }\nexport const go = async (x: number): Promise<number> => { return other(x) }\nfunction* gen() {}\nlet v = 3\n")
    assert kinds(x) == {("<file>", "module"), ("User", "interface"), ("Id", "type"), ("AuthService", "class"), ("login", "method"), ("go", "function"), ("gen", "function")}
    assert {("<file>", "./session", "import", "high"), ("<file>", "createSession", "import", "high"), ("<file>", "d", "import", "high"), ("<file>", "ns", "import", "high"), ("<file>", "lib", "import", "high")} <= edges(x)
    assert {("login", "cs", "call", "low"), ("go", "other", "call", "low"), ("login", "helper", "call", "low")} == {e for e in edges(x) if e[2] == "call"}


@pytest.mark.parametrize("path, src, name, kind", [
    ("a.tsx", "export function LoginBanner() { return createSession() }", "LoginBanner", "component"),
    ("App.jsx", "export const App = () => <div/>;\n", "App", "component"),
    ("u.js", "export function Helper() { return 1; }\n", "Helper", "function"),
    ("u.mjs", "const f = function () { return `a ${g(1)} b` }", "f", "function"),
    ("u.cjs", "/* function no() {} */ const s = 'function no2(){}'; function helper() { return /[{]/.test(s) }\n", "helper", "function"),
])
def test_script_kinds(path, src, name, kind):
    x = extract(path, src)
    assert x.status == "graph" and (name, kind) in kinds(x) and not any(n.startswith("no") for n, _ in kinds(x))


def test_script_broken():
    assert ("f", "function") in kinds(extract("a.ts", "function f() { if (x { \n"))
    assert kinds(extract("a.ts", "")) == {("<file>", "module")}


def spans(x, src):
    return {(s.name, s.kind): src.encode()[s.start_byte : s.end_byte].decode() for s in x.symbols[1:]}


def calls(x):
    return {(e.src_name, e.dst_name) for e in x.edges if e.kind == "call"}


@pytest.mark.parametrize("src, named, called", [
    # braces in types are no bodies
    ("function ret(): {a: string} { deep() }\nafter()", {("ret", "function"): "function ret(): {a: string} { deep() }"}, {("ret", "deep"), ("<file>", "after")}),
    ("function page<T extends {x: number}>(p: T, q: { h(y: number): void }) { inner(q.h(1)) }", {("page", "function"): ...}, {("page", "inner"), ("page", "h")}),
    ("class C<T extends {a: 1}> extends mixin(Base, {b: 1})<{c: 2}> implements I<{d: 3}>, J {\n m(): {b: number} { return mk() }\n get v(): Map<string, {a: 1}> { return mk2() }\n}", {("C", "class"): ..., ("m", "method"): "m(): {b: number} { return mk() }", ("v", "method"): "get v(): Map<string, {a: 1}> { return mk2() }"}, {("C", "mixin"), ("m", "mk"), ("v", "mk2")}),
    ("const f = (a: {x: 1}): Promise<{y: (z: number) => void}> => { go() }\nconst g = <T,>(a: T): a is T => other(a), h = function* <U>(u: U): Iterable<{u: U}> { yield x() }", {("f", "function"): ..., ("g", "function"): "g = <T,>(a: T): a is T => other(a)", ("h", "function"): ...}, {("f", "go"), ("g", "other"), ("h", "x")}),
    # heads without bodies are no symbols and no calls
    ("interface A extends B<{k: 1}> { f(x: string): void; g<T>(y: T): {z: 1}; new (q: number): A; (c: string): void }\nrun()", {("A", "interface"): ...}, {("<file>", "run")}),
    ("type G = { h(y: number): void } | typeof import('./m').k;\ntype H<T> = T extends (infer U)[] ? { p(u: U): U } : never\nrun()", {("G", "type"): ..., ("H", "type"): ...}, {("<file>", "run")}),
    ("abstract class Q {\n abstract w(a: string): void\n over(a: string): void;\n over(a: any) { w2(a) }\n static { boot() }\n x = calc(1);\n protected abstract get y(): number;\n}", {("Q", "class"): ..., ("over", "method"): "over(a: any) { w2(a) }"}, {("over", "w2"), ("Q", "boot"), ("Q", "calc")}),
    ("declare function z(a: string): void\nnext(1)\nexport declare function y<T>(a: T): {t: T};\nfunction over(a: 1): void\nfunction over(a: any): void { b(a) }", {("over", "function"): "function over(a: any): void { b(a) }"}, {("<file>", "next"), ("over", "b")}),
    ("class D { @dec() m(a = dflt({k: 1})) { return `}${`{${deep('}')}`}` + y() } }", {("D", "class"): ..., ("m", "method"): ...}, {("D", "dec"), ("m", "dflt"), ("m", "deep"), ("m", "y")}),
    ("const o = { a() { one() }, async b<T>(x: T): Promise<{t: T}> { two() }, c: (d: number) => three(d), ...four() }", {("a", "method"): ..., ("b", "method"): ...}, {("a", "one"), ("b", "two"), ("<file>", "three"), ("<file>", "four")}),
    ("function a() { return " + "(" * 60 + "{ k: [ f() ] }" + ")" * 60 + " }\nfunction b() { g() }", {("a", "function"): ..., ("b", "function"): "function b() { g() }"}, {("a", "f"), ("b", "g")}),
])
def test_script_shapes(src, named, called):
    x = extract("a.ts", src)
    got = spans(x, src)
    assert got.keys() == named.keys() and all(named[k] in (..., v) for k, v in got.items())
    assert {(a if a != "o" else "<file>", b) for a, b in calls(x)} == called


def test_elements():
    """Text between tags is no code, what stands in braces is."""
    src = """export function Page<T extends {x: number}>(p: T) {
  const q = p.x < limit(1) && p.x > 2
  return (<div className="a{b" onClick={() => click('}')} {...rest()}>
    it's {x(1)} and "quoted {y(2)}, don't <b>f(3)</b> {/* it's */ ok ? <i>{z(4)}</i> : <Sub.Item a='>' />}
  </div>)
}
const Two = <T,>(a: T) => <>{two(a)} isn't</>
function last() { return done() }
"""
    x = extract("a.tsx", src)
    assert calls(x) == {("Page", n) for n in ("limit", "click", "rest", "x", "y", "z")} | {("Two", "two"), ("last", "done")}
    got = spans(x, src)
    assert got.keys() == {("Page", "component"), ("Two", "component"), ("last", "function")} and got["Two", "component"] == "Two = <T,>(a: T) => <>{two(a)} isn't</>"


def test_yaml_documents():
    """A document that is no proper YAML is read by indentation, and no key goes over a document's mark."""
    src = "a: 1\nb: *nope\n---\nc: 2\nd:\n  e: 3\n...\nf: 4\n"
    x = extract("a.yaml", src)
    assert [(s.name, s.start_line, s.end_line) for s in x.symbols] == [("a", 1, 1), ("b", 2, 2), ("c", 4, 4), ("d", 5, 6), ("d.e", 6, 6), ("f", 8, 8)]


def test_markdown():
    src = "# ADR-003 Queue ##\ntext\n## Context\nx\n## Decision\nuse it\n### more\n## After\nSupersedes ADR-1, see [old](../adr/002-old.md \"t\") and [web](http://x/y)\n"
    x = extract("docs/adr/003.md", src)
    assert x.status == "outline" and ("ADR-003 Queue", "heading") in kinds(x)
    d = next(s for s in x.symbols if s.kind == "decision")
    assert (d.name, d.start_line, d.end_line) == ("ADR-003 Queue", 5, 7)
    assert edges(x) == {("ADR-003 Queue", "ADR-1", "supersedes", "low"), ("ADR-003 Queue", "002-old", "supersedes", "low")}
    plain = extract("adr_7.md", "no heading\n" * 200)
    assert [(s.name, s.start_line, s.end_line) for s in plain.symbols] == [("adr_7", 1, 80)]
    assert not extract("README.md", "# T\nSupersedes ADR-1").edges


def test_css():
    x = extract("a.css", ".auth-panel { color: #fff; --gap: 1 }\n#main { background: url(x.y#z) }")
    assert [s.name for s in x.symbols] == [".auth-panel", "#fff", "#main", "--gap"] and {s.kind for s in x.symbols} == {"selector"}


def test_json():
    src = '{ "scripts": { "test": "vitest", "a": {"b": 1} }, // c\n "name": "app", "name": 2, "items": [{"id": 1}] }'
    x = extract("package.json", src)
    assert [s.name for s in x.symbols] == ["scripts", "scripts.test", "scripts.a", "name", "name", "items"]
    assert all((s.kind, s.signature) == ("heading", "key") for s in x.symbols) and '"test"' in src[x.symbols[0].start_byte : x.symbols[0].end_byte]
    assert [extract("a.json", s).status for s in ("", "{", "[1]", '"x"', "{}")] == ["error", "error", "outline", "outline", "outline"]
    assert extract("a.jsonc", "{}").status == "file"


def test_yaml():
    names = lambda s: [x.name for x in extract("a.YML", s).symbols]
    assert names("services:\n  web:\n    port: 80\n") == ["services", "services.web"]
    assert names("{a: {b: 1}}\n") == ["a", "a.b"] and names("items:\n  - id: 1\n") == ["items"]
    assert names("---\na: 1\n---\nb:\n  c: 2\n") == ["a", "b", "b.c"]
    assert names("x: &n\n  k: 1\ny:\n  <<: *n\n  z: 2\n") == ["x", "x.k", "y", "y.z"]
    assert names("\"web\": 1\n'svc': 2\n") == ["web", "svc"]
    assert names("a: [\nb:\n  c: 1\n") == ["a", "b", "b.c"] and extract("a.yaml", " \n").status == "error"


def test_graphql():
    src = 'type R implements Node & T @d(a: 1) { id(x: Int = 1): [ID!]! @e  name: String }\nenum S { OPEN CLOSED }\nunion V = Car | Bike\ninput I { c: String! }\nscalar D\nextend type R { extra: Int }\ndirective @auth on FIELD_DEFINITION\nquery Get($a: Int) { h: reservation { id } }\nquery { anon }\nquery F { ...X }\nmutation M { make { id } }\nfragment X on R { id }\ninterface Node { id: ID! }\n'
    x = extract("s.gql", src)
    assert x.status == "graph" and kinds(x) == {("<file>", "module"), ("R", "type"), ("R.id", "method"), ("R.name", "method"), ("S", "type"), ("S.OPEN", "method"), ("S.CLOSED", "method"), ("V", "type"), ("I", "type"), ("I.c", "method"), ("D", "type"), ("Get", "function"), ("F", "function"), ("M", "function"), ("X", "type"), ("Node", "interface"), ("Node.id", "method")}
    assert edges(x) == {("R", "Node", "import", "high"), ("R", "T", "import", "high"), ("X", "R", "import", "high"), ("Get", "Query.reservation", "call", "low"), ("M", "Mutation.make", "call", "low")}
    assert extract("s.graphql", "").status == "error" and extract("s.graphqls", src).status == "file"
