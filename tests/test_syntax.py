import random

import pytest

from codestrata import constants as C
from codestrata.syntax.nodes import tree_rows
from codestrata.syntax.parser import parse

COLUMNS = ("pre", "post", "parent", "field", "type", "start", "end", "named", "text", "fn_pre", "fn_stack", "nest", "name", "params", "operator", "console", "visit")


def rows(code, tsx=False, **options):
    return [dict(zip(COLUMNS, r, strict=True)) for r in tree_rows(code, tsx, **options)]


def functions(code, tsx=False, **options):
    """By the definitions, over the rows: name -> (type, line, lines, nesting, parameters, complexity), in walking order."""
    out, every = [], rows(code, tsx, **options)
    for f in sorted((r for r in every if r["name"] is not None), key=lambda r: r["visit"]):
        inner = [r for r in every if f["pre"] in r["fn_stack"]]
        branches = sum((r["type"] in C.BRANCH_TYPES or r["operator"] in C.BRANCH_OPERATORS) and r["fn_pre"] == f["pre"] for r in inner)
        out.append((f["name"], f["type"], f["start"] + 1, f["end"] - f["start"] + 1, max(r["nest"] for r in inner) - f["nest"], f["params"], 1 + branches))
    return out


@pytest.mark.parametrize(
    ("body", "complexity"),
    [
        ("return 1;", 1), ("if (a) { b(); } if (c) { d(); }", 3), ("if (a || b) { return 1; }", 3), ("switch (x) { case 1: break; case 2: break; case 3: break; default: }", 4),
        ("try { a(); } catch (e) { b(); }", 2), ("return a ? 1 : 2;", 2), ("if (a && b || c) {}", 4), ("if (a) {} else {}", 3), ("return a ?? b;", 1), ("for (;;) {} for (const x of y) {} while (a) {} do {} while (b)", 5),
    ],
)
def test_complexity(body, complexity):
    assert functions(f"function f() {{ {body} }}")[0][-1] == complexity


def test_function_shapes():
    assert functions("function add(a: number, b: number): number {\n  return a + b;\n}\n") == [("add", "function_declaration", 1, 3, 0, 2, 1)]
    assert functions("function f() { if (a) { for (const x of y) { g(x); } } }")[0][4] == 2
    got = {f[0]: f for f in functions("const f = (a, b) => a + b;\nclass K { m(a, b, c) { return a; } }")}
    assert got["f"][5] == 2 and got["f"][3] == 1 and got["m"][5] == 3
    outer, inner = functions("function outer() {\n  function inner() {\n    return 1;\n  }\n  return inner();\n}")
    assert (outer[0], outer[3], inner[0], inner[3]) == ("outer", 6, "inner", 3)
    assert functions("") == []
    assert [f[0] for f in functions("function a() {}\nfunction b() {}\nfunction c() {}")] == ["c", "b", "a"]
    assert functions("const f = x => x;")[0][5] == 0
    assert functions("const o = { k: () => 1, m() {} };\nfoo(() => 2);") == [("(anonymous)", "arrow_function", 2, 1, 0, 0, 1), ("m", "method_definition", 1, 1, 0, 0, 1), ("k", "arrow_function", 1, 1, 0, 0, 1)]
    assert functions("const f = function () {};") == []
    assert functions("const f = function () {};", function_expressions=True)[0][:2] == ("f", "function")
    assert functions("const g = function* () {};")[0][:2] == ("g", "generator_function")
    assert functions("function f(a: string): void;\nfunction f(a: any) {}\ndeclare function g(): void;\nabstract class A { abstract m(): void; n() {} }")[-1][0] == "f"


def test_types_and_expressions_that_look_alike():
    assert functions("const a = b ? (c) : (d); const e = x < y && z > (w);") == []
    assert [f[0] for f in functions("const e = x ? (y): number => y : z;")] == ["(anonymous)"]
    assert functions("const r = /[/]\\/(/g; const s = a / b / c; const t = `x${ (() => 1)() }y${`n${z}`}`;")[0][1] == "arrow_function"
    assert [f[0] for f in functions("type F = (a: () => void) => string; interface I { m(): void }\nfunction k<T extends { a: () => void }>(x: T): x is T { return !!x; }")] == ["k"]
    assert [f[0] for f in functions("const f = async <T,>(x: T): Promise<Map<string, Array<T>>> => x as any;", True)] == ["f"]
    got = functions('const V = () => (<A b="it\'s" {...c} d={() => 1}>don\'t {x && <B.C/>} <></></A>);', True)
    assert [f[0] for f in got] == ["V", "(anonymous)"] and got[0][-1] == 2


def test_statement_smells():
    empty = lambda code: sum(r["type"] == "statement_block" and r["field"] == "body" and r["named"] == 0 and rows(code)[r["parent"]]["type"] == "catch_clause" for r in rows(code))
    assert empty("try { a(); } catch (e) {}") == 1 and empty("try { a(); } catch { b(); }") == 0 and empty("try {} catch (e) { /* on purpose */ }") == 0
    assert sum(r["console"] for r in rows("console.log(1); console.warn(2); console.error(3); console.info(4); a.console.log(5);")) == 3


def test_rows_are_an_interval_encoding():
    every = rows("class A { m(a = () => { if (x) { while (y) {} } }) { return [1, { b: () => 2 }]; } }")
    assert sorted(r["pre"] for r in every) == list(range(len(every))) == sorted(r["post"] for r in every) == sorted(r["visit"] for r in every)
    for r in every[1:]:
        parent = every[r["parent"]]
        assert parent["pre"] < r["pre"] and r["post"] < parent["post"] and parent["visit"] < r["visit"]


def test_anything_parses():
    dice = random.Random(5)
    pieces = ["function", "(", ")", "{", "}", "=>", "<", ">", "`", "${", "'", '"', "/", "if", "class", "=", "a", "1", "?", ":", "...", "async", "[", "]", ";", "\n", "/*", "//", "case", "x.", "é", "<T>"]
    for _ in range(300):
        code = " ".join(dice.choice(pieces) for _ in range(dice.randrange(40)))
        for tsx in (False, True):
            assert parse(code, tsx).type == "program"


def test_walk_with_a_visitor():
    from codestrata.syntax.nodes import SKIP, tree_rows, walk
    from codestrata.syntax.parser import parse

    code = "function a() { if (x) { y(); } }\nfunction b() { return () => 1; }\n"
    root, seen, left = parse(code, False, False), [], []
    walk(root, lambda n: seen.append(n.type), lambda n: left.append(n.type))
    assert seen == [r[4] for r in sorted(tree_rows(code), key=lambda r: r[-1])] and sorted(left) == sorted(seen) and left[-1] == seen[0]
    seen.clear(), left.clear()
    walk(root, lambda n: seen.append(n.type) or (SKIP if n.type == "function_declaration" else None), lambda n: left.append(n.type))
    assert seen.count("function_declaration") == 2 and "if_statement" not in seen and "function_declaration" not in left
    seen.clear()
    walk(root, None, lambda n: seen.append(n.type))
    assert seen[-1] == root.type


def test_measured_rows_are_those_of_the_whole_tree():
    """What leaves the parser for measures: the rows that they depend on, with the numbers of the whole tree; prose leaves its root only."""
    from codestrata.syntax.nodes import _MEASURED

    def asked(r):
        return r[0] == 0 or r[4] in _MEASURED or r[4] == "statement_block" and r[7] == 0 or r[14] in ("&&", "||") or r[15]

    r = random.Random(3)
    words = ["a", "b1", "été", "x×y", "as", "in", "of", "if", "else", "async", "yield", "new", "typeof", "get", "class", "function", "let", "=>", "(", ")", "{", "}", "[", "]", ".", ",", ";", ":", "?", "!", "&&", "||", "=", "<", ">", "5", ".5", "'s'", "`t`", "/", "// c\n", "\n", "console.log(1)", "try {} catch (e) {}", "(p, q) => { if (p) r }", "for (;;) { u v, w. z y }", "switch (a) { case 1: b c }"]
    for i in range(1500):
        code = r.choice([" ", "", "\n", "\t"]).join(r.choice(words if r.random() < 0.5 else words[:3]) for _ in range(r.randint(1, 40)))
        for tsx in (False, True):
            try:
                whole = tree_rows(code, tsx)
            except (RecursionError, ValueError, IndexError) as e:
                whole = e
            if isinstance(whole, Exception):
                with pytest.raises(type(whole)):
                    tree_rows(code, tsx, measured=True)
            else:
                assert tree_rows(code, tsx, measured=True) == [x for x in whole if asked(x)], (i, code)
    prose = "Words of a text, with commas. And full stops " * 200
    assert len(tree_rows(prose, measured=True)) == 1 and len(tree_rows(prose)) > 3000
