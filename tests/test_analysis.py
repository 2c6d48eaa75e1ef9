"""From two versions of a tree to scores, with symbols, owners and the parse cache."""

import random

from pyspark.sql import functions as F

from faultline.operators import analysis
from faultline.sources import parse_cache, parsers, symbols

OLD = {
    "src/db.py": "class Store:\n    def get(self, k):\n        return k\n\n    def put(self, k):\n        return k\n\n\ndef close():\n    pass\n",
    "src/auth/login.py": "import src.db\n\n\ndef login(user):\n    return user\n",
    "web/a.ts": "import { B } from './b'\n// class Ghost { }\nexport class A {\n  run(x: number): void {\n    const s = `class Text ${ [1].map(x => { return `function inner() {` }) } }`\n  }\n}\n\nfunction later() {\n  return 1\n}\n",
    "web/b.ts": "export class B { }\n",
    "core/K.kt": "package core\n/* class Old { } */\nclass K {\n  fun one(a: Int) {\n    println(\"} fun two() {\")\n  }\n  fun three() = 3\n}\n",
    "core/J.java": "package core;\npublic class J {\n  public void go(int x) {\n    if (x > 0) {\n      x = 1;\n    }\n  }\n}\n",
    "gone.py": "def gone():\n    pass\n",
}
NEW = OLD | {
    "src/db.py": OLD["src/db.py"].replace("    def put(self, k):\n        return k", "    def put(self, k):\n        return k + 1"),
    "web/a.ts": OLD["web/a.ts"].replace("return 1", "return 2"),
    "core/K.kt": OLD["core/K.kt"].replace("= 3", "= 4"),
    "new.py": "def fresh():\n    pass\n",
}
del NEW["gone.py"]
SOURCES = "repo_id string, analysis_id long, ord long, path string, text string"


def frame(spark, tree, repos=(("one", 1), ("two", 2))):
    return spark.createDataFrame([(r, a, k, p, t) for r, a in repos for k, (p, t) in enumerate(tree.items())], SOURCES)


def test_symbols():
    python = [("Store", "class", 1, 6), ("get", "function", 2, 3), ("put", "function", 5, 6), ("close", "function", 9, 10)]
    assert symbols.of_python(OLD["src/db.py"]) == python and symbols.of_python("def (") == []
    assert symbols.braced(OLD["web/a.ts"], "typescript") == [("A", "class", 3, 7), ("run", "function", 4, 6), ("later", "function", 9, 11)]
    assert symbols.braced(OLD["core/K.kt"], "kotlin") == [("K", "class", 3, 8), ("one", "function", 4, 6), ("three", "function", 7, 7)]
    assert symbols.braced(OLD["core/J.java"], "java") == [("J", "class", 2, 8), ("go", "function", 3, 7)]
    assert symbols.braced("<p>class Foo</p>\nclass Bar { }\n'it\\'s class Baz'\n", "typescript", True) == [("Bar", "class", 2, 2)]
    assert symbols.braced("class Open {\n  x", "typescript") == [("Open", "class", 1, 1)] and symbols.braced("", "java") == []


def test_blanked_keeps_places():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(['"', "'", "`", "${", "}", "{", "//", "/*", "*/", "\n", "\\", "a", " "]) for _ in range(r.randrange(0, 40)))
        out = symbols.blanked(text)
        assert len(out) == len(text) and [k for k, c in enumerate(out) if c == "\n"] == [k for k, c in enumerate(text) if c == "\n"]
        assert all(a == b or a == " " for a, b in zip(out, text))


def test_typescript_reads_code_only(spark):
    text = "// import x from 'ghost'\n/* class Ghost {}\n*/ import y from './real'\nconst s = \"class Fake { }\"\nconst t = `function fake() {`\nclass Real { go(x) {\n} }\nconst e = <p>class Jsx</p>\n"
    d = spark.createDataFrame([("a.tsx", text), ("b.ts", "\"" + "x" * 50_000 + "\"; class Far { }"), ("c.ts", None)], "path string, text string")
    got = {x.path: x for x in parsers.typescript(d).collect()}
    assert got["a.tsx"].defined_classes == ["Real"] and [i.source_module for i in got["a.tsx"].imports] == ["./real"] and "fake" not in got["a.tsx"].defined_functions
    assert got["b.ts"].defined_classes == ["Far"] and got["c.ts"].defined_classes is None


def test_from_versions_to_scores(spark):
    changed, ranges = analysis.changed_files(frame(spark, OLD), frame(spark, NEW))
    assert {(x.analysis_id, x.path) for x in changed.collect()} == {(a, p) for a in (1, 2) for p in ("src/db.py", "web/a.ts", "core/K.kt", "new.py")}
    owners = spark.createDataFrame([("one", "src/db.py", "Ann")], "repo_id string, path string, owner string")
    a = analysis.analyse(frame(spark, NEW).drop("analysis_id"), changed, None, ranges, owners)
    found = {(x.path, x.name, x.kind) for x in a.affected.where("analysis_id = 1").collect()}
    assert found == {("src/db.py", "Store", "class"), ("src/db.py", "put", "function"), ("web/a.ts", "later", "function"), ("core/K.kt", "K", "class"), ("core/K.kt", "three", "function"), ("new.py", "fresh", "function")}
    one = {x.analysis_id: x for x in a.inputs.collect()}[1]
    assert one.affected_functions == ["three", "fresh", "put", "later"] and one.ownership == {"src/db.py": "Ann"}
    assert one.dependency_count == one.unique_components == 1 and one.edges == 1
    signals = {(x.analysis_id, x.signal) for x in a.evidence.collect()}
    assert {(1, "function_level_impact"), (2, "function_level_impact"), (1, "large_blast_radius")} <= signals
    without = analysis.analyse(frame(spark, NEW).drop("analysis_id"), changed, None)
    assert without.affected.count() == 0 and {x.analysis_id for x in without.scores.collect()} == {1, 2}
    assert without.scores.where("analysis_id = 1").first().score < a.scores.where("analysis_id = 1").first().score


def test_cache_parses_each_text_once(spark, tmp_path, monkeypatch):
    folder, parsed = f"file://{tmp_path}/cache", []
    real = parsers.parse
    monkeypatch.setattr(parsers, "parse", lambda d: (parsed.append({x.path for x in d.collect()}), real(d))[1])
    files = frame(spark, OLD).unionByName(frame(spark, {"copy/K.kt": OLD["core/K.kt"], "README.md": "# x", "package.json": '{"dependencies": {"a": "1"}}'}))
    rows = lambda d: sorted(str(x.asDict(recursive=True)) for x in d.select(sorted(d.columns)).collect())
    plain = rows(real(files).select("repo_id", "path", "language", *parse_cache.FACTS))
    assert parse_cache.misses(files, folder) == 7
    first = parse_cache.parse(files, folder).select("repo_id", "path", "language", *parse_cache.FACTS)
    assert rows(first) == plain and len(parsed[1]) == 7 and parse_cache.misses(files, folder) == 0
    parsed.clear()
    again = parse_cache.parse(files, folder).select("repo_id", "path", "language", *parse_cache.FACTS)
    assert rows(again) == plain and parsed[1] == set()
    parsed.clear()
    more = files.where("path <> 'gone.py'").unionByName(frame(spark, {"next.py": "import os\n", "as.tsx": OLD["web/b.ts"]}))
    assert rows(parse_cache.parse(more, folder).select("repo_id", "path", "language", *parse_cache.FACTS)) == rows(real(more).select("repo_id", "path", "language", *parse_cache.FACTS))
    assert parsed[1] == {"next.py", "as.tsx"}
    count = spark.read.parquet(folder).count()
    parse_cache.compact(spark, folder)
    assert spark.read.parquet(folder).count() == count == 9 and parse_cache.misses(more, folder) == 0


def test_analysis_with_a_cache_is_the_same(spark, tmp_path):
    changed, ranges = analysis.changed_files(frame(spark, OLD), frame(spark, NEW))
    sources = frame(spark, NEW).drop("analysis_id")
    runs = [analysis.analyse(sources, changed, None, ranges, cache=c) for c in (None, f"file://{tmp_path}/cache", f"file://{tmp_path}/cache")]
    for part in ("nodes", "edges", "scores"):
        frames = [getattr(r, part) for r in runs]
        assert len({tuple(sorted(str(x) for x in f.select(sorted(f.columns)).collect())) for f in frames}) == 1
