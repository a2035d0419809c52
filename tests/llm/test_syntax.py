import ast
import json
import random
import tomllib

import pytest

from quarrylight.llm.syntax import check, gll
from quarrylight.llm.syntax.grammars import grammar

GOOD = {
    "python": ["x = 1\n", "def f(a, *, b=2, **k) -> int:\n    return [i async for i in a if i]\n", "@d\nclass A(B, metaclass=C):\n    x: int = 1\n\n    def g(self): pass\n", "match x:\n    case [1, *rest] if rest:\n        pass\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nfinally:\n    pass\n", "with (open(a) as f, b):\n    x = lambda *a, y=1: (yield)\n", 'f"{x!r:>{w}}" \'a\'\n', "if (n := 3) > 2: print(n)\nelse: pass\n", "a[1:2, ::3] = {**b, 'c': d}\n"],
    "javascript": ["const a = async (b) => { await c?.d?.[e] ?? 1 };", "for (const [k, v] of Object.entries(o)) { continue }", "class A extends B { #x = 1; static async *f() { yield* g() } get y() { return this.#x } }", "const r = /[(]{0,}/g; a = b / c / d", "x = `a${`b${c}`}d`", "label: while (true) { break label }", "import a, { b as c } from './d'\nexport default function () {}\n", "a\nb\n", "!function(g){g.x=function(n){for(var w=0;w<3;w++)n(w)}}(this);", "switch (a) { case 1: default: b() }", "var f0=j=>j.lang||{token:612,v:[612,!0]}"],
    "typescript": ["export const f = async <T,>(a: T[], b?: number): Promise<Map<string, T[]>> => { return a as any };", "interface A<T> extends B { readonly x?: string; f(y: number): void; [k: string]: unknown }", "type X = { [K in keyof T]?: T[K] } | (A extends infer U ? U : never)", "abstract class C<T> implements D { private x!: T; constructor(private readonly a: number) { super() } }", "enum E { A = 1, B }", "declare module 'x' { export function f(a: string): asserts a is 'b' }", "const v = x!.y<string>(z satisfies Q)"],
    "java": ["package a.b;\nimport java.util.*;\npublic final class A<T extends B & C> extends D implements E { private static final int[] X = {1, 2}; @Override public <U> List<? super U> f(final int... a) throws G { for (int v : a) { if (v > 1) continue; } return x -> (y) ? 1 : 2; } }", "record P(int x, @N String y) { P { } }", "enum E { A(1) { void f() {} }, B; E() {} }", "class A { void f() { try (var x = y) { s = switch (a) { case 1, 2 -> 3; default -> { yield 4; } }; } catch (X | Y e) { } } }"],
    "json": ['{"a": [1, -2.5e3, true, null], "b": {}}', "3"],
    "yaml": ["a: 1\nb:\n  - x\n  - y: 2\n    z: [1, {q: r}]\n", "- a\n- - b\n  - c\n", "k: |\n  text: {[\n  more\nj: >-\n  folded\n", 'a: "x\n  y"\n', "---\na: b\n...\n", "a: plain text\n  goes on\nb: &x 1\nc: *x\n", "a:\n- b\n- c\n", "", "# only\n"],
    "toml": ['a = 1\n[b.c]\nd = "x"\n[[e]]\nf = [1, [2, 3],\n 4]\ng = {h = 1979-05-27T07:32:00Z, i.j = true}\n'],
    "sql": ["SELECT a, COUNT(*) AS n FROM t LEFT JOIN u USING (id) WHERE a IN (1, 2) AND b BETWEEN 1 AND 3 OR NOT c IS NULL GROUP BY a HAVING count(*) > 1 ORDER BY n DESC LIMIT 3;", "CREATE TABLE IF NOT EXISTS a (id INTEGER PRIMARY KEY, b VARCHAR(10) DEFAULT 'x', FOREIGN KEY (b) REFERENCES c (d));", "WITH x AS (SELECT 1) INSERT INTO t (a) SELECT * FROM x;", "SELECT CASE WHEN a THEN 1 ELSE 2 END, sum(x) OVER (PARTITION BY y ORDER BY z) FROM (VALUES (1)) v(a); UPDATE t SET a = 1 WHERE b = 'it''s';", "SELECT offset FROM t"],
    "shell": ["#!/bin/sh\nset -eu\nif [ \"$a\" -gt 1 ]; then\n  echo \"x $(date '+%Y') ${b:-c}\" >&2\nfi\n", "f() {\n  for x in *.txt; do case $x in a|b) echo 1;; *) :;; esac; done\n}\nf && { ls | wc -l; } || exit 1\n", "cat <<EOF\nunclosed ' \" (\nEOF\nwhile read -r l; do echo $l; done < f\n", "echo if then fi # done (\n"],
}
BAD = {
    "python": ["def f(:\n    pass\n", "x = (1\n", "if x:\npass\n", "print 'a', b\n", "<<<<<<< HEAD\nx = 1\n", "def f():\n    x = 1\n  y = 2\n", "x = '''a\n"],
    "javascript": ["const a = ;", "function f( { }", "if (a { b }", "x = `a${b`", "class A { f( }", "<!doctype html>", '{"a": 1, "b": 2}', "const a = 1 const b = 2"],
    "typescript": ["const f = (a: ) => 1", "interface A { x: string", "export const x = async a: any) => {}"],
    "java": ["class A { void f( { } }", "class A { int x = ; }", "class A {", "import { base } from './base';"],
    "json": ["", "{'a': 1}", '{"a": 1,}', "// c\n{}", '{"a": 1', '{"a" 1}'],
    "yaml": ["a: [1, 2\n", "a: {x: 1\nb: 2\n", 'a: "open\nb: 1\n', "a: b: c\n", "a:\n\tb: 1\n", "a: 1\n  b: 2\n", "- a\nb: 1\n"],
    "toml": ["a = \n", "[a\nb = 1\n", "a = [1, 2\n", "a b = 1\n", 'a = "x\n'],
    "sql": ["SELECT a FROM (SELECT 1;", "CREATE TABLE a id INTEGER, ;", "SELECT FROM t WHERE", "def f(x):\n    return x", ">>>>>>> theirs\nSELECT 1;"],
    "shell": ["while true; do\n  echo a\n", "if [ a ]; then echo b\n", 'echo "open\n', "f() {\n", "case a in b) ;;\n", "done\n"],
}


MORE = {
    "python": (
        ['x: int', 'a.b[c] += 1', '(a, *b), c = d = e', 'for x, (y, z) in w: pass', 'del a, b[1]', 'def f(a, /, b=1, *, c, d=2, **e): pass', 'lambda a, b=1, *c, d: 0', 'def f(*, a): pass', 'def f(a, b=1, *c): pass\n', 'async def f():\n    async with a as b, c: await d\n', 'with a as b.c, d as (e, f): pass', 'f(x for x in y)', 'x = yield', 'x = y = yield z', 'type X[T: int] = list[T]', 'class A[T]: pass', '@a\n@b.c(d)\ndef f(): pass', 'if x:\n  pass\n# c\nelse:\n  pass', '(yield)', 'x = *a, b', 'return', 'await x', 'print(a, file=b)', 'match = 1; case = 2', 'for i in a, b: pass', 'with (a): pass', 'with (a, b) as c: pass', 'f(**a, *b)', 'a if b else c', 'not a', 'x[a, b:c] = 1', '[a, b] = c', 'async for x in y: pass', "match x:\n  case A(b=1) | {'a': 1, **r}:\n    pass\n  case -1 | [1, *_]: pass\n  case str() as s if s: pass", 'raise', 'global a, b', 'try:\n  a\nexcept A:\n  b\nelse:\n  c\nfinally:\n  d'],
        ['f() = 1', 'def f(a=1, b): pass', '1 = x', 'a + b = c', 'lambda a=1, b: 0', 'def f(*): pass', 'x = ', 'for 1 in x: pass', 'del f()', 'f() += 1', 'if x\n  pass', 'def f(**a, b): pass', 'else:\n  pass', '@x\n'],
    ),
    "java": (
        ['module a.b { requires transitive c.d; exports e.f to g; provides h with i; }', 'public non-sealed class A extends B { }', 'sealed interface A permits B, C {}', 'class A { int open = 1; void to(int with) { module = 2; } }', 'class A { <T> void f(T... x) throws E { int[][] a = new int[3][]; a[0][1]++; String s = """\n x"""; var q = x instanceof String t && t.length() > 1; } }'],
        ['class A { int 1x; }', 'class A { void f() { return } }', 'import a.b'],
    ),
    "javascript": (
        ["import x from 'y'; await z;", 'export const a = 1;', 'with (a) { b }', 'var let = 1; yield = 2; await = 3', 'a = async x => await x', 'for await (const x of y) {}', 'async function f() { await g(); for (const a in b) {} }', 'x = { async *f() {}, get a() { return 1 }, [b]: c, ...d }', 'if (a) b; else c', 'a = b ? c : d ? e : f', 'label: for (;;) { continue label }', 'x = a => ({ b: a })', 'let { a, b: { c } = {} , ...r } = x', "class A { static { x = 1 } static x = 1; 'y' = 2; #p() {} }", 'export default class extends A {}', "export * as x from 'y'", 'new Foo', 'new (a.b())().c', 'a?.[b]?.(c)', '`a${b}c${`d${e}`}`', "const { data } = await import('x')"],
        ['export const a = ;', "import { a } 'b'", 'function () {}', 'var 1a = 2'],
    ),
    "typescript": (
        ['let x = <T,>(a: T) => a', 'export type A = keyof typeof b[number]', 'function f(this: A, b?: string, ...c: any[]): b is string { return true }', 'export default interface A {}', 'let a: (b: string) => void = c!', 'type A = `x${string}`', 'declare global { interface Window { a: string } }', "class A { constructor(private a = 1) {} get b(): string { return '' } declare c: number; abstract d(): void }", "import type { A } from 'b'; export type { A }", "enum A { B = 1 << 2, C = 'x' }", 'let x = y as const satisfies Z', 'namespace A.B { export const c = 1 }', 'let a: [b: string, c?: number]', 'abstract class A { protected abstract b(): void; }'],
        ['interface A { b: }', 'let x: = 1'],
    ),
    "sql": (
        ['DROP TABLE t;', 'ALTER TABLE t ADD COLUMN a INT;', 'GRANT SELECT ON t TO u;', 'BEGIN; COMMIT;', 'EXPLAIN SELECT 1;', 'TRUNCATE t;', 'USE db;', 'VACUUM;', 'MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = s.a WHEN NOT MATCHED THEN INSERT (id) VALUES (s.id);', 'CREATE OR REPLACE VIEW v AS SELECT 1;', 'CREATE OR REPLACE FUNCTION f(a int) RETURNS int AS $$ SELECT 1 $$ LANGUAGE sql;', 'SET x = 1;', 'SHOW TABLES;', 'SELECT * FROM t FOR UPDATE;', 'INSERT INTO t (a) VALUES (1) ON CONFLICT DO NOTHING;', 'INSERT INTO t (a) VALUES (1) ON CONFLICT (a) DO UPDATE SET a = excluded.a;', 'SELECT TOP 5 a FROM t;', 'CREATE INDEX i ON t (a);', 'CREATE UNIQUE INDEX IF NOT EXISTS i ON t USING btree (a DESC, lower(b));', 'INSERT INTO t VALUES (1) ON DUPLICATE KEY UPDATE a = 2;', 'PRAGMA foreign_keys = ON;', 'CREATE TABLE t (id INT AUTO_INCREMENT PRIMARY KEY, KEY k (id)) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;', 'REPLACE INTO t VALUES (1);', 'CREATE TRIGGER a AFTER INSERT ON t FOR EACH ROW EXECUTE FUNCTION f();', 'DECLARE @x INT = 1;\nSELECT @x;', "COMMENT ON COLUMN t.a IS 'x';", 'REVOKE ALL ON t FROM u CASCADE;', "COPY t FROM 'x.csv' WITH (FORMAT csv);", 'ROLLBACK TO SAVEPOINT a;', 'ALTER TABLE t ALTER COLUMN a TYPE bigint USING a::bigint, DROP CONSTRAINT c;', 'CALL p(1, 2);', 'CREATE EXTENSION IF NOT EXISTS pgcrypto;', 'SELECT count(*) FILTER (WHERE a > 1) OVER (PARTITION BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t', 'CREATE PROCEDURE p() BEGIN SELECT 1; UPDATE t SET a = 2; END;', 'SELECT a FROM t LIMIT 5, 10', 'CREATE SEQUENCE s START WITH 1 INCREMENT BY 2;', 'DELETE FROM t WHERE a = 1 RETURNING *;', 'CREATE TABLE a (ts TIMESTAMP WITH TIME ZONE DEFAULT now() NOT NULL, d DOUBLE PRECISION, n NUMERIC(10, 2) CHECK (n > 0), CONSTRAINT u UNIQUE (d, n));', 'ANALYZE t;', "SELECT extract(year FROM ts), substring(a FROM 1 FOR 2), x AT TIME ZONE 'UTC' FROM t", 'ALTER TABLE t RENAME TO u;', 'LOCK TABLE t IN ACCESS EXCLUSIVE MODE;', 'CREATE MATERIALIZED VIEW m AS SELECT 1 WITH NO DATA;', 'REFRESH MATERIALIZED VIEW m;', 'CREATE TABLE b AS SELECT 1 AS x;', 'START TRANSACTION;', 'DO $$ BEGIN END $$;', 'ALTER TABLE t ENABLE ROW LEVEL SECURITY;'],
        ['CREATE INDEX , = 5 . . SELECT', 'DROP t;', 'ALTER TABLE;', 'GRANT ON t;', 'CREATE TABLE t (a INT,);', 'SELECT a FROM;', 'INSERT INTO VALUES;', 'UPDATE t SET;', 'SELECT a b c FROM t', 'DELETE t WHERE', 'CREATE INDEX i ON t;', 'SELECT * FROM t WHERE a = ', 'CREATE VIEW v SELECT 1;'],
    ),
}


@pytest.mark.parametrize("language", sorted(MORE))
def test_statements_of_every_kind(language):
    checker = check.Checker()
    assert [t for t in MORE[language][0] if not checker.valid(t, language)] == []
    assert [t for t in MORE[language][1] if checker.valid(t, language)] == []


@pytest.mark.parametrize("language", sorted(GOOD))
def test_accepted_and_rejected(language):
    checker = check.Checker()
    assert [t for t in GOOD[language] if not checker.valid(t, language)] == []
    assert [t for t in BAD[language] if checker.valid(t, language)] == []


def test_ambiguous_and_left_recursive_grammars():
    g = gll.Grammar("s: s s | s '+' s | 'a' | ;", "s")
    assert g.parse(["a"] * 12) == -1 and g.parse(["a", "+", "a"]) == -1 and g.parse(["+"]) == -1 and g.parse(["a", "b"]) == 1
    h = gll.Grammar("e: e '-' t | t ; t: 'x' | '(' e ')' ;", "e")
    assert h.parse(list("x-(x-x)-x")) == -1 and h.parse(list("x--x")) == 2


def test_python_json_toml_as_their_own_parsers():
    rng, checker = random.Random(6), check.Checker()
    own = {"python": ast.parse, "json": json.loads, "toml": tomllib.loads}
    for language, parse in own.items():
        for text in GOOD[language]:
            for _ in range(60):
                i = rng.randrange(len(text) + 1)
                damaged = text[:i] + rng.choice(["", "(", ")", "]", " = ", ",", ":", "\n"]) + text[i + rng.randrange(2) :]
                try:
                    parse(damaged)
                    ok = True
                except (SyntaxError, ValueError):
                    ok = False
                got = checker.valid(damaged, language)
                # Some rules lie beyond a grammar: targets of assignments, repeated names, contents of f-strings.
                if ok and damaged.strip():
                    assert got, (language, damaged)
                elif language == "json" and not ok:
                    assert not got, damaged


def test_dialects_run_together():
    one, two = gll.read_rules("file: a* ; a: 'x' b | 'y' b ; b: 'z' ;"), gll.read_rules("file: a* ; a: 'x' b | 'w' b ; b: 'z' ;")
    rules = gll.together({"one": one, "two": two})
    # What both have in common is one nonterminal; a text in a mixture of dialects is in neither.
    assert sum(n.startswith("b~") for n in rules) == 1
    g = gll.Grammar(rules, "file")
    assert g.parse(list("xzyz")) == -1 and g.parse(list("wzxz")) == -1 and g.parse(list("wzyz")) == 2
    with pytest.raises(ValueError):
        gll.Grammar("file: START | 'START' ;", "file")
    old = check.Checker(("python2",))
    assert old.valid("print 'a', b\nexec x in y\ntry:\n    a\nexcept A, e:\n    print >>f, x\n", "python") and old.valid("print(a, file=b)\nx: int = 1\n", "python")
    assert not old.valid("print 'a'\nnonlocal x\nx: int\n", "python") and not check.Checker().valid("print 'a'\n", "python")
    assert not check.Checker().valid("import a from 'b'\nwith (a) { let = 1 }", "javascript")


def test_brackets_as_one_symbol_decide_like_the_whole():
    rng, rules = random.Random(3), "file: s* ; s: '(' s* ')' | '{' s* '}' s? | 'a' | '{' 'b' '}' ;"
    whole, folded = gll.Grammar(rules, "file"), gll.Grammar(rules, "file", [("(", ")"), ("{", "}")])
    for _ in range(3000):
        tokens = [rng.choice("(){}ab") for _ in range(rng.randrange(9))]
        assert (whole.parse(tokens) < 0) == (folded.parse(tokens) < 0), tokens
    checker = check.Checker()
    for n in (3, 200, 5000):
        assert checker.valid("x = " + "[" * n + "]" * n, "python") and not checker.valid("x = " + "[" * n + "]" * (n - 1), "python")
        assert checker.valid("x = " + "{a:" * n + "1" + "}" * n, "javascript") and not checker.valid("x = " + "{a:" * n + "}" * n, "javascript")


def test_kept_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(gll, "MAX_KEPT", 50)
    checker = check.Checker()
    for i in range(40):
        assert checker.valid("f(" + "a, " * i + "b)\n", "python") and not checker.valid("f(" + "a, " * i + "= b)\n", "python")
    assert grammar("python", ()).kept < 200


def test_pieces_and_wholes_agree():
    checker = check.Checker()
    text = "def f(\n\n):\n    pass\n\nx = [\n\n1]\n\n\nif x:\n    y = 1\n\nelse:\n    y = 2\n"
    assert checker.valid(text, "python")
    assert grammar("python").parse(check.LANGUAGES["python"](text)[0]) == -1


def test_rows(spark):
    files = spark.createDataFrame(
        [(1, "r", "a.py", "python", None, "x = (", "ok"), (1, "r", "a.py", "python", None, "x = (", "ok"), (2, "r", "b.py", "python", None, "x = 1", "bad"), (1, "r", "c.md", "markdown", None, "(", "ok"), (1, "r", "n.py", "python", "00", None, "ok"), (1, "r", "e.json", "json", None, "", "ok"), (1, "r", "l.py", "python", None, "x = 1\n" * 30000 + "(", "ok"), (3, None, "z.sql", "sql", None, "SELECT (", None)],
        "generation_id int, repository_id string, path string, language string, content_hash string, text string, parse_state string",
    )
    assert {(r.generation_id, r.path) for r in check.invalid_files(files).collect()} == {(1, "a.py"), (1, "e.json"), (1, "l.py"), (3, "z.sql")}
    assert {(r.repository_id, r.language): (r.files, r.invalid) for r in check.invalid_rates(files).collect()}["r", "python"] == (4, 2)
    assert check.invalid_files(files.limit(0)).count() == 0


def test_sql_needs_a_semicolon_before_a_blank_line():
    from quarrylight.llm.syntax.check import Checker

    assert not Checker().valid("SELECT a FROM t WHERE b = 1\n\nSELECT c FROM u;", "sql")
    assert Checker().valid("SELECT a FROM t WHERE b = 1;\n\nSELECT c FROM u;", "sql")


def test_lines_read_once_mean_the_same():
    """A line's tokens are kept; in another place, such as in an open string, the same line means something else."""
    from quarrylight.llm.syntax import lexers

    rng = random.Random(9)
    for language, lines in (("python", ["x = (1,", "2)", "x = 1", 'y = """', '"""', "if a:", "    b = {", "    }", "f'{a}'", "z = 'a \\\\", "b'", "# c", ""]), ("javascript", ["a = `x", "${b}`", "/* c", "*/", "d = e /", "f / g", "// h", "if (a) {", "}", "'q \\\\", "r'", "x = a", "/re/g.test(y)", ""])):
        for _ in range(400):
            text = "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))
            lex = check.LANGUAGES[language]
            held = lex(text)
            lexers._LINES.clear()
            assert lex(text) == held, text
