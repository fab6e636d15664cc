"""Entity files and source trees."""

import random
import uuid

from loomgraph.sources import code, frontmatter


def test_frontmatter_values():
    header, body = frontmatter.split('---\nid: x\ntags: [a, "b, c", 3]\nn: 3\nf: 1.0\nt: true\nu: http://a:b\nq: "7"\ne: null\n---\n\nbody\n')
    assert frontmatter.parse(header) == {"id": "x", "tags": ["a", "b, c", "3"], "n": 3, "f": 1.0, "t": True, "u": "http://a:b", "q": "7", "e": ""}
    assert body == "body\n"
    assert frontmatter.split("no") is None and frontmatter.split("---\nopen") is None


def test_frontmatter_round_trip():
    rng = random.Random(7)
    alphabet = 'ab1 .:,"\\-#é[]\n\'true'
    for _ in range(500):
        fields = {f"k{i}": rng.choice([lambda: rng.randint(-9, 9), lambda: rng.random(), lambda: rng.random() < 0.5, lambda: "".join(rng.choices(alphabet, k=rng.randint(0, 9))), lambda: [w for w in ("".join(rng.choices("abc ,:", k=4)) for _ in range(3))]])() for i in range(5)}
        header, body = frontmatter.split(frontmatter.serialise(fields, "text"))
        assert frontmatter.parse(header) == fields and body == "text"


def test_read_entities(spark, tmp_path):
    good, ref = str(uuid.uuid4()), str(uuid.uuid4())
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "a.md").write_text(frontmatter.serialise({"id": good, "title": "T", "type": "rule", "references": [ref], "created_at": "2024-01-01T00:00:00Z"}, "hello"))
    (tmp_path / "b.md").write_text("---\nid: nope\ntitle: x\n---\n\n")
    (tmp_path / "c.md").write_text("plain")
    got = {r.title: r for r in frontmatter.read_entities(spark, str(tmp_path)).collect()}
    assert got["T"].error is None and got["T"].content == "hello" and got["x"].error == "id is not a UUID" and got[""].error == "no frontmatter"
    edges = frontmatter.edges_of(frontmatter.read_entities(spark, str(tmp_path))).collect()
    assert [(e.source_id, e.target_id) for e in edges] == [(good, ref)]


PYTHON = "import os\nfrom a import b\n\nclass C(Base):\n    def m(self):\n        return helper(1)\n\ndef helper(x):\n    return os.path.join(x)\n"
RUST = "use std::io;\npub struct S { a: u8 }\nimpl Show for S {\n    fn show(&self) {\n        emit(1);\n    }\n}\nfn emit(x: u8) {}\nmod inner;\n"
GO = 'package main\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n}\n\nfunc (t *T) Run() {\n\tfmt.Println(1)\n}\n'
TS = "import { a } from './lib';\nexport interface I {}\nexport class K extends Base {}\nexport const go = (x) => {\n  run(x);\n};\nfunction run(y) {\n}\n"
BASH = "source ./lib.sh\nbuild() {\n  echo hi\n}\n"


def names(path, text, kind):
    return [e[2] for e in code.extract(path, text)[0] if e[0] == kind]


def test_extraction():
    assert names("x.py", PYTHON, "function") == ["C::m", "helper"] and names("x.py", PYTHON, "class") == ["C"]
    edges = code.extract("x.py", PYTHON)[1]
    assert ("C", "Base", "extends") in edges and ("C::m", "helper", "calls") in edges and ("x.py", "a.b", "imports") in edges
    assert names("x.rs", RUST, "function") == ["S::show", "emit"] and names("x.rs", RUST, "class") == ["S"] and names("x.rs", RUST, "module") == ["inner"]
    assert ("S::show", "emit", "calls") in code.extract("x.rs", RUST)[1] and ("S", "Show", "extends") in code.extract("x.rs", RUST)[1]
    assert names("x.go", GO, "function") == ["Run"] and names("x.go", GO, "class") == ["T"] and ("x.go", "fmt", "imports") in code.extract("x.go", GO)[1]
    assert names("x.ts", TS, "function") == ["go", "run"] and set(names("x.ts", TS, "class")) == {"I", "K"} and ("go", "run", "calls") in code.extract("x.ts", TS)[1]
    assert names("x.sh", BASH, "function") == ["build"] and ("x.sh", "./lib.sh", "imports") in code.extract("x.sh", BASH)[1]
    assert code.extract("bad.py", "def (")[2] == "SyntaxError" and len(code.extract("bad.py", "def (")[0]) == 1


def test_structural_hash_ignores_layout():
    a, b = "def f(x):\n    return x\n", "def f(x):  # note\n\n    return (x)\n"
    assert code.extract("a.py", a)[0][1][5] == code.extract("a.py", b)[0][1][5] != code.extract("a.py", a.replace("x", "y"))[0][1][5]


def test_relative_modules():
    assert code.resolve_relative("a/b/c.ts", "../d") == "a/d.ts" and code.resolve_relative("a/c.ts", "./x/") == "a/x/index.ts"
    assert code.resolve_relative("a/c.ts", "./x", {"a/x/index.js"}) == "a/x/index.js" and code.resolve_relative("c.ts", "./y.js") == "y.js"


def test_source_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "src" / "x.py").write_text(PYTHON)
    (tmp_path / "src" / "big.go").write_text("package a\n" + " " * (code.LIMIT + 1))
    (tmp_path / ".hidden" / "y.py").write_text("x = 1")
    (tmp_path / "src" / "note.txt").write_text("x")
    files = code.source_files(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[-1], r.too_large) for r in files.collect()) == [("big.go", True), ("x.py", False)]
    assert {r.qualified_name for r in code.code_entities(files).where("type <> 'file'").collect()} == {"C", "C::m", "helper"}
    assert code.raw_edges(files).where("edge_type = 'extends'").count() == 1
