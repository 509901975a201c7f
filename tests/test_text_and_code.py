import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import code as C
from weftline.operators import diffs as D


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("selectedSite", ["selectedsite", "selected", "site"]), ("a_b1", ["a_b1", "a", "b1"]), ("foo", ["foo"]), ("x$y", ["x$y"]), ("42", ["42"]), (None, []), ("été ok", ["t", "ok"])],
)
def test_identifier_tokens(spark, text, tokens):
    assert one(spark, text, X.identifier_tokens) == tokens


def test_unicode_tokens(spark):
    assert one(spark, "été ok", lambda c: X.identifier_tokens(c, unicode=True)) == ["été", "ok"]


def test_paths(spark):
    assert one(spark, " ./..\\a/b.py", X.normalize_path) == "b.py"
    assert one(spark, ".github/x", X.normalize_path) == "github/x"
    assert one(spark, "a/src/X.TSX", X.language_of) == "typescript"
    assert one(spark, "docs/readme.md", X.is_code_path) is False
    assert one(spark, "src/my_test file/x.py", X.is_test_path) is True
    assert one(spark, "src/contest.py", X.is_test_path) is False
    assert one(spark, "src/tests/x.py", X.in_test_folder) is True
    assert one(spark, "src/a/b.py", lambda c: X.matches_path(c, "src/**/*.py")) is True
    assert one(spark, "src/b.py", lambda c: X.matches_path(c, "src/**/*.py")) is True
    assert one(spark, "src/b.py", lambda c: X.matches_path(c, "b.p")) is True
    assert one(spark, "x/.env", X.extension) == "<none>"
    assert one(spark, "https://u@H.com:8/x", X.domain) == "u@h.com:8"


def test_scalars(spark):
    assert one(spark, "fooBar/baz-qux.ts", X.aliases) == ["foo", "bar", "baz", "qux", "ts"]
    assert one(spark, '["a", " ", "b"]', X.string_list) == ["a", "b"]
    assert one(spark, '{"a": 1}', X.string_list) == ['{"a": 1}']
    assert one(spark, "  ", X.string_list) == []
    assert one(spark, "see src/a/b.ts and 'some text' of MyClass, plain", X.symbols) == ["src/a/b.ts", "some text", "MyClass"]
    assert one(spark, "The answer, is: A  5 USD!", X.normalize_answer) == "answer is 5"
    assert one(spark, "owner__repo-12-3", X.repository_of) == "owner/repo-12"
    assert one(spark, "x" * 300, X.truncate) == "x" * 217 + "..."
    assert one(spark, "a\nb", X.numbered) == "1 | a\n2 | b"
    assert one(spark, "nan?", X.weight) == 1.0 and one(spark, "-3", X.weight) == 0.0
    assert one(spark, "key=abc abcd", lambda c: X.redact_secrets(c, ["abc", "abcd"])) == "key=<secret_hidden> <secret_hidden>"
    assert [tuple(c)[:2] for c in one(spark, "line1\n\nline3\n\n\nline6", lambda c: X.fixed_chunks(c, 2))] == [(1, 2), (3, 4), (5, 6)]
    assert [tuple(c)[:2] for c in one(spark, "\n".join("abcdefg"), lambda c: X.line_windows(c, 3, 2))] == [(1, 3), (3, 5), (5, 7), (7, 7)]


JS = """import type { Props } from './types'
import { help } from './lib/help'
export class Card extends Base {
  render(props) {
    const x = new Store()
    help(props)
    return <Button onClick={x} />
  }
}
export const go = async (a) => {
  setTitle(a)
}
"""
PY = "import os\nfrom a.b import c\n\n@deco\nclass K(Base, m.Other):\n    def __init__(self):\n        helper()\n    def run(self):\n        def inner():\n            hidden()\n        os.walk(1)\n\ndef helper():\n    return K()\n"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("src/card.js", JS), ("src/lib/help.js", "export function help(x) {\n  return x\n}\n"), ("src/k.py", PY), ("src/bad.py", "def ("), ("src/none.js", None)], "file string, text string")


def test_pattern_entities(files):
    got = {(r.file, r.kind, r.qualified_name, r.start_line, r.end_line) for r in C.pattern_entities(files).collect()}
    assert got == {("src/card.js", "class", "Card", 3, 9), ("src/card.js", "method", "Card.render", 4, 8), ("src/card.js", "function", "go", 10, 12), ("src/lib/help.js", "function", "help", 1, 3)}


def test_entities_of_other_languages(spark):
    go = "package a\n// struct No\ntype S struct {\n}\nfunc Run(x int) {\n  if x {\n  }\n}\n"
    rust = "struct P { x: i32 }\nfn go() {\n}\n"
    rows = [("a.go", go), ("a.rs", rust), ("a.c", "int main(void) {\n  while (1) { }\n}"), ("a.md", "class No {"), ("README.c", "class No {")]
    got = {(r.file, r.kind, r.name, r.start_line, r.end_line) for r in C.pattern_entities(spark.createDataFrame(rows, "file string, text string")).collect()}
    assert got == {("a.go", "function", "Run", 5, 8), ("a.rs", "class", "P", 1, 1), ("a.rs", "function", "go", 2, 3), ("a.c", "function", "main", 1, 3)}


@pytest.mark.parametrize(
    "name, line, kind, found",
    [
        ("a.js", "const g = function () {}", "function", "g"),
        ("a.ts", "A.prototype.run = async function () {}", "method", "run"),
        ("a.jsx", "module.exports = class K {", "class", "K"),
        ("a.js", "let f = async (a, b) => a", "function", "f"),
        ("a.js", "  async load(x) { }", "method", "load"),
        ("a.js", "if (x) { A.prototype.go = function () {} }", "method", "go"),
        ("a.js", "while (x) {", None, None),
        ("a.js", "# class No {", None, None),
        ("a.ts", " * function no() {", None, None),
        ("a.js", "function* gen() {", None, None),
        ("A.java", "public static List<String> of(int x) throws E {", "function", "of"),
        ("A.java", "abstract class B extends C {", "class", "B"),
        ("A.java", "interface No {", None, None),
        ("A.java", "int x = f(1);", None, None),
        ("a.go", "type S struct {", None, None),
        ("a.rs", "fn go() {", "function", "go"),
        ("a.cpp", "std::vector<int> all(int x) {", "function", "all"),
    ],
)
def test_shapes_of_definitions(spark, name, line, kind, found):
    got = [(r.kind, r.name, r.start_line) for r in C.pattern_entities(spark.createDataFrame([(name, "x\n" + line)], "file string, text string")).collect()]
    assert got == ([(kind, found, 2)] if kind else [])


def test_common_names_take_rows_in_proportion(spark):
    """Files that all define and call the same names: one edge a file, and no name is joined with all files that have it."""
    files = spark.createDataFrame([(f"s{i}.js", "function run() {\n}\nrun()") for i in range(300)], "file string, text string")
    edges = C.symbol_edges(C.mentions(files), C.pattern_entities(files))
    assert {tuple(r) for r in edges.collect()} == {(f"s{i}.js", f"s{i}.js::run", "calls") for i in range(300)}
    elsewhere = C.symbol_edges(spark.createDataFrame([("t.js", "calls", "x.run"), ("t.js", "exports", "run"), ("s7.js", "calls", "run")], "file string, type string, target string"), C.pattern_entities(files))
    assert {tuple(r) for r in elsewhere.collect()} == {("t.js", "s0.js::run", "calls"), ("s7.js", "s7.js::run", "calls")}


def test_python_files_that_do_not_parse(spark):
    bad = "class K:\n    def a(self):\n        x = (\n# note\n        y\n\n    async def b(self):\n        z\nq\n@deco\ndef c():\n  pass\n"
    rows = [("bad.py", bad), ("good.py", "def f():\n    pass\n"), ("none.py", None), ("x.js", "class K:")]
    got = {(r.file, r.kind, r.qualified_name, r.start_line, r.end_line) for r in C.python_entities(spark.createDataFrame(rows, "file string, text string")).collect()}
    assert got == {("bad.py", "class", "K", 1, 8), ("bad.py", "function", "a", 2, 6), ("bad.py", "function", "b", 7, 8), ("bad.py", "function", "c", 11, 13), ("good.py", "function", "f", 1, 2)}


def test_block_ends_against_brute_force(spark):
    """Blocks of random braces end where a scan from each head says."""
    import random

    rng = random.Random(5)
    files = []
    for f in range(20):
        lines = [rng.choice(["function f%d() {" % i, "{", "}", "} }", "x", "{ }", "const g%d = (a) => a" % i, "}}{", "function h%d()" % i, "x // {", "function k%d() { // }" % i]) for i in range(40)]
        files.append((f"f{f}.js", "\n".join(lines)))
    expected = set()
    for file, text in files:
        lines = [line.split("//")[0] for line in text.split("\n")]
        for i, line in enumerate(lines):
            if line[:1] not in ("f", "c"):
                continue
            open_, balance, end = False, 0, i
            for j in range(i, len(lines)):
                balance, open_ = balance + lines[j].count("{") - lines[j].count("}"), open_ or "{" in lines[j]
                if open_ and balance <= 0:
                    end = j
                    break
            expected.add((file, i + 1, end + 1))
    got = {(r.file, r.start_line, r.end_line) for r in C.pattern_entities(spark.createDataFrame(files, "file string, text string")).collect()}
    assert got == expected


def test_relations_resolve(files):
    entities = C.pattern_entities(files)
    edges = {tuple(r) for r in C.symbol_edges(C.mentions(files), entities).select("src", "dst", "type").collect()}
    assert ("src/card.js", "src/lib/help.js::help", "calls") in edges
    assert ("src/card.js", "src/card.js", "writes_state") in edges
    assert not any(t == "instantiates" for *_, t in edges)
    assert {tuple(r) for r in C.import_edges(files).collect()} == {("src/card.js", "src/lib/help.js", "imports")}


def test_python_graph(files):
    entities, references = C.python_graph(files)
    assert {(r.kind, r.qualified_name, r.start_line) for r in entities.collect()} == {("class", "K", 5), ("method", "K.__init__", 6), ("method", "K.run", 8), ("method", "K.run.inner", 9), ("function", "helper", 13)}
    got = {(r.owner, r.kind, r.target) for r in references.collect()}
    assert {("K", "inherits", "Base"), ("K", "inherits", "Other"), ("K", "invokes", "helper"), ("K.run", "invokes", "walk"), ("helper", "invokes", "K"), ("", "imports", "a.b.c")} <= got
    assert ("K.run", "invokes", "hidden") not in got


def test_documents_gold_and_ranking(spark, files):
    entities = C.pattern_entities(files)
    assert {(r.doc_id, r.level) for r in C.documents(files, entities).where("level <> 'file'").collect()} == {("src/card.js::Card", "module"), ("src/card.js::Card.render", "function"), ("src/card.js::go", "function"), ("src/lib/help.js::help", "function")}
    patch = "--- a/src/card.js\n+++ b/src/card.js\n@@ -5,2 +5,2 @@\n-    const x = new Store()\n+    const x = 1\n     help(props)\n"
    gold = C.gold_entities(spark.createDataFrame([("i", patch)], "instance_id string, patch string"), entities)
    assert {(r.level, r.item) for r in gold.collect()} == {("file", "src/card.js"), ("module", "src/card.js::Card"), ("function", "src/card.js::Card.render")}
    ranked = C.rank_entities(entities, F.lit("Card.render fails in help")).orderBy("rank").collect()
    assert ranked[0].qualified_name == "Card.render"


def test_ui_edges(spark):
    bodies = [("1", "App", "App", "return <Card title={x} />"), ("2", "Card", "Card", "setTitle(1); Card()"), ("3", "setTitle", "m.setTitle", "")]
    got = {tuple(r) for r in C.ui_edges(spark.createDataFrame(bodies, "id string, name string, qualified_name string, body string")).collect()}
    assert got == {("1", "2", "renders"), ("1", "2", "passes_props"), ("2", "3", "calls"), ("2", "3", "writes_state")}

    styled = [("1", "App", "App", "<Card style={y}/>; if (Card) {}"), ("2", "Card", "Card", "<App kind='x'/>"), ("3", "if", "if", "")]
    got = {tuple(r) for r in C.ui_edges(spark.createDataFrame(styled, "id string, name string, qualified_name string, body string")).collect()}
    assert got == {("1", "2", "renders"), ("1", "2", "passes_props"), ("1", "2", "applies_style"), ("2", "1", "renders")}


def test_diffs(spark):
    patch = "@@ -2,4 +2,4 @@\n line\n-gone\n+new\n line\n\\ No newline at end of file"
    rows = D.changed_old_lines(spark.createDataFrame([("i", "--- a/f.py\n+++ b/f.py\n" + patch)], "instance_id string, patch string")).collect()
    assert {(r.file, r.old_line) for r in rows} == {("f.py", 3), ("f.py", 4)}
    assert one(spark, "--- a\n+++ b\n-x\n+y\n z", D.modified_lines) == 2
    log = "\x1b[32mtest_a (m.T) ... ok\x1b[0m\ntest_b (m.T) ... FAIL\n"
    got = D.test_statuses(spark.createDataFrame([("i", log)], "instance_id string, log string"), grammar="unittest").collect()
    assert {(r.test, r.status) for r in got} == {("test_a (m.T)", "PASSED"), ("test_b (m.T)", "FAILED")}
    after = D.test_statuses(spark.createDataFrame([("i", "PASSED early\n== short test summary info\nPASSED late")], "instance_id string, log string"), after="short test summary info").collect()
    assert [r.test for r in after] == ["late"]
    log = "FAILED t[MouseButton.LEFT] - no\nPASSED u[MouseButton.RIGHT]\nFAILED - v\nPASSED"
    got = D.test_statuses(spark.createDataFrame([("i", log)], "instance_id string, log string"), grammar="matplotlib").collect()
    assert {(r.test, r.status) for r in got} == {("t[1]", "FAILED"), ("u[3]", "PASSED"), ("v", "FAILED")}
    log = "--version is equivalent to version x\ntest_a (m) ... Internal Server Error: /x/\nok\ntest_b (m) ... System check identified no issues (0 silenced)\nok\nFAIL: test_b (m)\ntest_b (m) ... FAIL"
    got = D.test_statuses(spark.createDataFrame([("i", log)], "instance_id string, log string"), grammar="unittest").collect()
    assert {("--version is equivalent to version", "PASSED"), ("test_a (m)", "PASSED"), ("test_b (m)", "PASSED")} <= {(r.test, r.status) for r in got}
    lines = spark.createDataFrame([("f", 1, i + 1, x) for i, x in enumerate(["a {", " b {", " }", "}", "c"])], "key string, start_line int, line_no int, line string")
    assert [tuple(r) for r in D.block_ends(lines, "key").collect()] == [("f", 1, 4)]


def test_call_tree(spark):
    rows = [(1, 1, 1, 0.0, 100.0, "a"), (2, 1, 1, 10.0, 50.0, "b"), (3, 1, 1, 20.0, 5.0, "c"), (4, 1, 2, 15.0, 5.0, "other"), (5, 1, 1, 70.0, 10.0, "d")]
    got = {r.id: (r.parent, r.depth) for r in C.call_tree(spark.createDataFrame(rows, "id long, pid int, tid int, ts double, dur double, name string")).collect()}
    assert got == {1: (None, 0), 2: (1, 1), 3: (2, 2), 4: (None, 0), 5: (1, 1)}


def test_targets_of_relations(spark):
    """What each relation captures: objects, components and modules, not events, addresses or fields."""
    text = """import type { T } from './types';
import a, { type U } from "./u";
import css from './look.scss';
export { go as run, stop } from './moves';
export default class Card extends Base implements One, Two {
const q = require('./q'); import('./late'); export_ = x.y.call (1);
bus.on('ready', f); store.dispatch(act); emit('x'); useSyncExternalStore(s);
useSelector(s => s.user); store.getState(); this.state.n; this.setState({}); setName(1);
<Theme.Provider><Theme.Consumer/><Route path="/x" component={Home} element={<Page/>} render={() => <Late/>}/>
const v: Kind = z as Other; f<Type>(new Made(1)); new NotMade; routes: [
if (useContext(Ctx)) {}
"""
    got: dict[str, set] = {}
    for r in C.mentions(spark.createDataFrame([("a.js", text), ("b.js", None)], "file string, text string")).collect():
        got.setdefault(r.type, set()).add(r.target)
    assert got["imports"] == {"./types", "./u", "./look.scss", "./moves", "./q", "./late"}
    assert (got["type_imports"], got["re_exports"], got["uses_style"]) == ({"./types", "./u"}, {"./moves"}, {"./look.scss"})
    assert (got["exports"], got["extends"], got["implements"]) == ({"go", "stop", "Card"}, {"Base"}, {"One", "Two"})
    assert {"y.call", "bus.on", "emit", "useContext"} <= got["calls"] and not {"if", "require", "import"} & got["calls"]
    assert got["instantiates"] == {"Made"}
    assert (got["subscribes_to"], got["dispatches"]) == ({"bus", "useSyncExternalStore"}, {"store", "dispatch", "emit"})
    assert (got["reads_state"], got["writes_state"]) == ({"useSelector", "getState", "store", "this"}, {"this", "this.setState", "setName"})
    assert (got["provides_context"], got["consumes_context"]) == ({"Theme"}, {"Theme", "Ctx"})
    assert (got["routes_to"], got["type_uses"]) == ({"Home", "Page", "Late"}, {"Kind", "Other", "Type", "One"})


def test_repeats_of_mentions_are_told_apart_by_strings(spark):
    """No list of structs is made distinct, which would compare each mention of a file with all others."""
    text = "\n".join(f"f{i % 700}(g{i % 900}())" for i in range(1800)) + "\nexport { f1 as x, f2 }\nexport class f1 {"
    df = C.mentions(spark.createDataFrame([("a.js", text)], "file string, text string"))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {("a.js", "calls", f"{x}{i}") for x, n in (("f", 700), ("g", 900)) for i in range(n)} | {("a.js", "exports", "f1"), ("a.js", "exports", "f2")}
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_distinct(") > 10 and "array_distinct(concat(transform" not in plan


def test_a_long_file_is_read_once(spark, monkeypatch):
    """Blocks of a file of 60,000 lines, by one pass over its lines: no frame is read anew for each line, and lines are ordered by file alone."""
    kept = []
    monkeypatch.setattr(C, "cut", lambda df: (kept.append(df._jdf.queryExecution().optimizedPlan().toString()), df.cache())[1])
    text = "\n".join(f"class A{i} {{\n  go{i}() {{\n  }}\n}}\nfunction f{i}()" for i in range(12_000))
    got = C.pattern_entities(spark.createDataFrame([("a.js", text)], "file string, text string"))
    rows = {(r.qualified_name, r.start_line, r.end_line) for r in got.collect()}
    assert rows == {x for i in range(12_000) for x in ((f"A{i}", 5 * i + 1, 5 * i + 4), (f"A{i}.go{i}", 5 * i + 2, 5 * i + 3), (f"f{i}", 5 * i + 5, 5 * i + 9 if i < 11_999 else 5 * i + 5))}
    assert "currentrow$(), unboundedfollowing$()" not in kept[0] and kept[0].count("posexplode") == 1


def test_calls_are_read_once(spark):
    """Odd texts: what is found in a file's calls is what each pattern finds in its whole text, and only the rest reads that."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(7)
    parts = ["a", "b$", "$c", "\u00e9", "\u0301", "9", "_", "use", "useX", "setState", "setA", "this", ".", ".", ".", "(", "(", "(", " ", "\n", "\r", "\t", "getState", "dispatch", "emit", ".on", "state", "selectA", "new ", "import(", "'x'", "require(", "as T", "useContext(C)", "class K ", "element = {<P", "useSyncExternalStore"]
    texts = spark.createDataFrame([(f"f{i}.js", "".join(rng.choice(parts) for _ in range(80))) for i in range(400)], "file string, text string")
    got = C.mentions(texts)
    each = [F.struct(F.lit(k).alias("type"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("found")) for k in C.RELATIONS for p in C.RELATIONS[k]]
    alone = texts.select("file", F.inline(F.array(*each))).select("file", "type", F.explode("found").alias("target")).distinct()
    alone = alone.where("target <> ''").where((F.col("type") != "calls") | ~F.substring_index("target", ".", 1).isin(*C.NOT_CALLS)).where("type <> 'uses_style'")
    lists = ("exports", "implements", "uses_style")
    expected = {tuple(r) for r in alone.collect() if r.type not in lists}
    assert {tuple(r) for r in got.collect() if r.type not in lists} == expected and len({t for _, t, _ in expected}) > 9
    assert got._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(called") == 9


def test_what_a_file_has_of_its_own_is_found_once(spark, monkeypatch):
    """The language is told once a file, not a line, and the words of a document are taken once, not for a filter too."""
    from weftline.plans import shape_plans

    kept = []
    monkeypatch.setattr(C, "cut", lambda df: (kept.append(df._jdf.queryExecution().optimizedPlan().toString()), df.cache())[1])
    C.pattern_entities(spark.createDataFrame([("a.js", "class A {\n}")], "file string, text string"))
    assert "lower(file" not in kept[0].split("posexplode")[0] and "lower(file" in kept[0]
    plan = shape_plans.files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_references_meet_their_file_once(spark):
    """Own full name, own short name, anywhere, own file; by an exchange a name, one of names and one a file."""
    entities = spark.createDataFrame([("a", "run", "K.run"), ("a", "run", "B.run"), ("b", "run", "run"), ("b", "go", "go")], "file string, name string, qualified_name string")
    asked = [("a", "calls", "K.run"), ("a", "calls", "x.run"), ("a", "calls", "y.run"), ("a", "calls", "go"), ("a", "exports", "go"), ("a", "uses_hook", "useX"), ("a", "uses_hook", "useY"), ("b", "renders", "K.run"), ("c", "calls", "run"), ("c", "renders", "No")]
    edges = C.symbol_edges(spark.createDataFrame(asked, "file string, type string, target string"), entities)
    got = [tuple(r) for r in edges.select("src", "dst", "type").collect()]
    assert sorted(got) == [("a", "a", "uses_hook"), ("a", "a::B.run", "calls"), ("a", "a::K.run", "calls"), ("a", "b::go", "calls"), ("b", "b::run", "renders"), ("c", "a::B.run", "calls")]
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3
