import pytest

from clonewright.sources.frontends import FRONTENDS
from clonewright.sources.frontends.python import PythonFrontend
from clonewright.sources.frontends.rust import RustFrontend
from clonewright.sources.frontends.typescript import TypeScriptFrontend


def found(frontend, text, path="t"):
    return {(d.kind_id, d.name): d for d in frontend.scan(path, text)}


def py(text):
    return found(PythonFrontend(), text)


def ts(text, path="t.ts"):
    return found(TypeScriptFrontend(), text, path)


def rs(text):
    return found(RustFrontend(), text)


def test_registry():
    assert list(FRONTENDS) == ["py", "ts", "rs"]
    assert all(f.lang == lang and f.extensions for lang, f in FRONTENDS.items())
    assert "interfaces" not in FRONTENDS["py"].kinds


def test_python_kinds_and_nesting():
    d = py(
        "LIMIT = 3\nquiet = 1\nNOTE: str = 'x'\ntype Names = list[str]\n\n"
        "def outer(a):\n    def inner():\n        return a + 1\n    return inner() * 2\n\n"
        "class Box:\n    def open(self, key):\n        return self.items[key] + 1\n\n"
        "    class Lid:\n        def turn(self):\n            return self.angle + 1\n"
    )
    assert set(d) == {
        ("constants", "LIMIT"), ("constants", "NOTE"), ("type-aliases", "Names"), ("functions", "outer"), ("classes", "Box"),
        ("methods", "Box.open"), ("methods", "Box.Lid.turn"),
    }
    assert d["methods", "Box.open"].args == 2 and d["methods", "Box.open"].line == 11 and d["methods", "Box.open"].col == 4
    assert d["constants", "LIMIT"].text == "LIMIT = 3" and d["constants", "LIMIT"].canonical is None


@pytest.mark.parametrize(
    "body", ["pass", "...", "'only a note'", "raise NotImplementedError", "raise NotImplementedError('later')", "return", "return 3", "return x", "'note'\n    pass"]
)
def test_python_trivial_bodies(body):
    assert py(f"def f(x):\n    {body}\n") == {}
    assert py(f"class K:\n  def f(self, x):\n    {body}\n").keys() == {("classes", "K")}


def test_python_decorators_and_roles():
    d = py(
        "class P:\n    @property\n    def v(self):\n        return self.a + 1\n    @v.setter\n    def v(self, x):\n        self.a = x\n"
        "    @v.deleter\n    def v(self):\n        del self.a\n"
    )
    assert ("methods", "P.v") in d and ("methods", "P.v.setter") in d and ("methods", "P.v.deleter") in d
    assert d["methods", "P.v"].text.startswith("def v(self)")


def test_python_receiver_and_renaming():
    a = py("class A:\n    def load(self, key):\n        got = self.store.get(key)\n        return got or 0\n")["methods", "A.load"]
    b = py("class B:\n    def fetch(self, name):\n        row = self.store.get(name)\n        return row or 0\n")["methods", "B.fetch"]
    assert a.analysis.xname_canonical == b.analysis.xname_canonical and a.analysis.type3_lines == b.analysis.type3_lines
    assert a.canonical != b.canonical
    assert a.analysis.type3_lines[0] == "def _fn(_v0):"


def test_python_docstrings_and_nested_decorators():
    plain = py("def f(x):\n    def g(y):\n        return y + x\n    return g\n")["functions", "f"]
    noted = py("@cache\ndef f(x):\n    'doc'\n    @wraps(f)\n    def g(y):\n        'doc'\n        return y + x\n    return g\n")["functions", "f"]
    assert plain.analysis.type3_lines == noted.analysis.type3_lines
    assert plain.canonical != noted.canonical  # the nested decorator stays in the structural form


def test_python_places_are_characters():
    d = py("x = 'é'; MAXÉ = 1\nclass Ü:\n    def m(self): return self.a + 'é'\n")
    assert d["methods", "Ü.m"].text == "def m(self): return self.a + 'é'"


def test_unparseable_files_give_nothing():
    assert py("def f(:\n") == {} and ts("function (") == {} and rs("fn f( {") == {}
    assert py("") == {} and ts("") == {} and rs("") == {}


def test_typescript_kinds():
    d = ts(
        "export const LIMIT = 3;\nconst quiet = 1;\nlet LOUD = 2;\nexport type Ids = number[];\n"
        "export interface Repo { get(id: number): number; readonly n: string }\n"
        "export function f(a: number, ...rest: string[]) { const y = a + 1; return y * 2; }\n"
        "export const g = async (x: number): Promise<number> => { return x + 1; };\nexport const short = (x) => x;\n"
        "@Injectable()\nexport default class Box<T> extends Base<T> {\n  private n = 1;\n  get v() { return this.n + 1; }\n"
        "  set v(x: number) { this.n = x; }\n  static make(a: number) { return new Box(a); }\n  #hide() { return this.n + 1; }\n}\n"
    )
    assert set(d) == {
        ("constants", "LIMIT"), ("type-aliases", "Ids"), ("interfaces", "Repo"), ("functions", "f"), ("functions", "g"), ("functions", "short"),
        ("classes", "Box"), ("methods", "Box.v.getter"), ("methods", "Box.v.setter"), ("methods", "Box.make"), ("methods", "Box.#hide"),
    }
    assert d["functions", "f"].args == 2 and d["constants", "LIMIT"].text == "LIMIT = 3"
    assert d["type-aliases", "Ids"].text == "type Ids = number[];"
    assert d["classes", "Box"].text.startswith("class Box")
    assert d["methods", "Box.make"].analysis is None
    assert "Arrow" in d["functions", "g"].analysis.xname_canonical and len(d["functions", "g"].analysis.type3_lines) == 1


def test_typescript_renaming():
    a = ts("function add(x: number, y: number) { const z = x + y; return z * 2; }")["functions", "add"]
    b = ts("function plus(a: number, b: number) { const c = a + b; return c * 2; }")["functions", "plus"]
    c = ts("function plus(a: number, b: number) { const c = a - b; return c * 2; }")["functions", "plus"]
    assert a.analysis == b.analysis and a.analysis.xname_canonical != c.analysis.xname_canonical
    assert "'add'" in a.canonical and "'x'" in a.canonical


@pytest.mark.parametrize("body", ["", "return;", "return false", "return 'a'", "return this", "return null", "throw new Error('no')", "; return 1;", "return 1; return;"])
def test_typescript_trivial_bodies(body):
    assert set(ts(f"class A {{ f() {{ {body} }} }}")) == {("classes", "A")}


@pytest.mark.parametrize("body", ["throw Error('x')", "return f()", "throw new Broken()", "g(); return 1"])
def test_typescript_bodies_that_say_something(body):
    assert ("methods", "A.f") in ts(f"class A {{ f() {{ {body} }} }}")


def test_typescript_jsx_is_raw_text():
    d = ts("export function Badge(p: any) {\n  const t = `${p.a}: ${p.b}`;\n  return <b className={t} {...p}>{t} <i/> text</b>;\n}\n", "t.tsx")
    assert d["functions", "Badge"].canonical == d["functions", "Badge"].text and d["functions", "Badge"].analysis is None


def test_typescript_grammar_corners():
    text = """
const a = b < c ? d : e > f; const r = /x[/]y/g.test(s) && p / q / 2; const t = `a${`b${c}`}d`;
label: for (const [k, v] of m.entries()) { if (!k) continue label; }
for (let i = 0, n = 9; i < n; i++) ; for (const k in o) {} do { i--; } while (i)
function over(x: string): void; function over(x: any) { switch (x) { case 1: f<T>(x); break; default: try { g?.[0]?.(1) } catch { } finally { delete o.p } } return x as unknown as string; }
type M = { [K in keyof T]?: T[K] } | ((a: string) => void) extends infer R ? R : never;
class X<T> { [key: string]: any; static { init(); } async *gen<U>(this: X<T>, u?: U) { yield* u; } constructor(private a: string) { super(); this.a = a } }
({ a, b: [c = 1], ...rest } = obj); new Foo<Bar>(1).baz!.qux; enum E { A = 1 } declare module 'm' { export const y: number; }
"""
    assert {n for _, n in ts(text)} >= {"over", "X", "X.gen", "X.constructor", "M"}


def test_rust_kinds():
    d = rs(
        "pub const LIMIT: u32 = 5;\nconst quiet: u32 = 1;\nstatic HELLO: &str = \"hi\";\ntype Ids = Vec<u64>;\n"
        "pub fn sum(v: &[i32], w: i32) -> i32 {\n let mut t = 0;\n for x in v { t += x * w; }\n t\n}\n"
        "pub struct Repo<T: Clone> { store: Vec<T> }\npub enum State { On, Off(u8) }\n"
        "pub trait Fetch { fn get(&self, id: u64) -> u64; fn say(&self) -> String { let n = self.get(0); format!(\"{}\", n) } }\n"
        "impl<T: Clone> Repo<T> { pub fn item(&self, id: usize) -> u8 { let r = self.store[id]; r + 1 } }\n"
        "impl fmt::Display for crate::State { fn fmt(&self, f: &mut F) -> R { let a = 1; f.pad(a) } }\n"
        "mod a { pub mod b { pub fn h(x: i32) -> i32 { let y = x + 2; y } } }\n"
        "fn maker() -> u8 { struct Hidden; impl Hidden { fn no(&self) -> u8 { let x = 1; x + 1 } } let z = 7; z }\n"
    )
    assert set(d) == {
        ("constants", "LIMIT"), ("constants", "HELLO"), ("type-aliases", "Ids"), ("functions", "sum"), ("classes", "Repo"), ("classes", "State"),
        ("interfaces", "Fetch"), ("methods", "Fetch::say"), ("methods", "Repo::item"), ("methods", "State::fmt"), ("functions", "a::b::h"), ("functions", "maker"),
    }
    assert d["methods", "Repo::item"].args == 1 and len(d["functions", "sum"].analysis.type3_lines) == 3


@pytest.mark.parametrize("body", ["", "true", "x", "todo!()", "write!(f, \"a\")", "matches!(self, A | B)", "return matches!(1, 1);", "unimplemented!()", "1; 2", "x; return Foo::BAR;", "todo!(); x"])
def test_rust_trivial_bodies(body):
    assert rs(f"fn f(x: i32) {{ {body} }}") == {}


@pytest.mark.parametrize("body", ["Foo::BAR", "()", "let y = 1;", "g(x)", "<T as K>::Z"])
def test_rust_bodies_that_say_something(body):
    assert ("functions", "f") in rs(f"fn f(x: i32) {{ {body} }}")


def test_rust_cfg_siblings_collapse_and_receiver_strip():
    d = RustFrontend().scan("t", "#[cfg(unix)]\nfn p(x: i32) -> i32 { let y = x + 1; y }\n#[cfg(windows)]\nfn p(x: i32) -> i32 { let y = x - 1; y }\n")
    assert [x.name for x in d] == ["p"] and d[0].line == 1 and d[0].text.startswith("fn p")
    both = rs("struct S;\nimpl S { fn add(&self, a: i32, b: i32) -> i32 { let t = a + b; t } }\nfn free(x: i32, y: i32) -> i32 { let u = x + y; u }\n")
    assert both["methods", "S::add"].analysis == both["functions", "free"].analysis


def test_rust_grammar_corners():
    text = r"""
#![allow(x)]
use std::{a, b::*};
macro_rules! m { ($x:expr) => { $x + 1 } }
fn f<'a, T>(x: &'a mut Vec<Vec<T>>, g: impl Fn(i32) -> i32) -> Result<(), Box<dyn E + 'a>> where T: Copy + 'a {
    let Some(y) = x.first() else { return Err(e) };
    let r#raw = r##"a "# b"##; let c = 'c'; let b = b'\n'; let t = (1, 2.0, 0xff_u8, 1..=3, ..4);
    if let Some(z) = y && z > 1 { loop { break 'a 3; } } else if x.is_empty() { return Ok(()) }
    match y { A::B { ref p, q: 1 | 2, .. } if *p > 1 => {} C(a, ..) | D([h, rest @ ..]) => g(a)?, -1..=5 => {}, _ => unreachable!() }
    let s = S { a, b: 1, ..Default::default() }; let k = |a: i32, &b| -> i32 { a + b };
    let v = vec![1; 3].iter().map(|x| x as i64).collect::<Vec<_>>(); v[0].0.await?; *v = &mut w; x <<= 2; a && b || !c
}
"""
    assert set(rs(text)) == {("functions", "f")}


def test_column_functions(spark):
    from clonewright.functions.canonical import analysed, canonical

    texts = ["def add(a, b):\n    c = a + b\n    return c\n", "def plus(x, y):\n    z = x + y\n    return z\n", "not python (", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", canonical("py")("text").alias("c"), analysed("py")("text").alias("a")).collect()
    assert rows[0].a.xname_canonical == rows[1].a.xname_canonical and rows[0].c != rows[1].c and rows[0].a.size > 0
    assert rows[2].c == texts[2] and rows[2].a.size is None and rows[3].c is None and rows[4].c == ""


def test_register_a_language(spark):
    from clonewright.sources.frontends import register
    from clonewright.sources.frontends.base import Definition
    from clonewright.sources.walk import scan

    class Lines:
        lang, extensions, kinds = "txt", (".txt",), ("constants",)

        def scan(self, path, text):
            return [Definition("constants", x, i, 0, 0, x) for i, x in enumerate(text.split())]

    with pytest.raises(ValueError, match="taken"):
        register(PythonFrontend())
    register(Lines())
    try:
        df = spark.createDataFrame([("txt", "a.txt", "B A")], "lang string, file string, content string")
        assert [(r.name, r.line) for r in scan(df).collect()] == [("B", 0), ("A", 1)]
    finally:
        del FRONTENDS["txt"]
