"""Code cut by its brackets: hand-made sources in all languages, broken ones, and the lateral call."""

from __future__ import annotations

import time

from lanternlake.operators import chunkers as K

CSHARP = '''using System;
// class InAComment { }
namespace Shop.Payments
{
    /// <summary>Pays { or not }.</summary>
    [Route("api/{id}")]
    public sealed class Handler : Base<Order>, IDisposable
    {
        private readonly Db _db = new Db { Size = 1 };
        public int Count { get; set; } = 5;
        public string Name => _db.Name + "}";
        public static readonly int[] Sizes = { 1, 2 };
        public event EventHandler Done;

        public Handler(Db db) : base(db) { _db = db; }

        /* Handle(x) { */
        [HttpPost("{id}")]
        public async Task<Result<Order>> HandleAsync<T>(Command command, CancellationToken ct)
        {
            if (command.Ok) { return new Result { Id = 1 }; }
            var text = $"brace {{ {command}";
            char c = '{';
            return null;
        }

        public int Twice(int x) => x * 2;
        ~Handler() { }
        private class Nested { void Hidden() { } }
    }

    public interface IStore { void Save(Order o); int Size { get; } }
    public record Point(int X, int Y);
    enum Color { Red, Green }
}
'''


def units(text, language):
    return [(k, s, c) for _, k, s, c, _ in K.code_units(text, language)]


def test_csharp_types_and_members():
    rows = list(K.code_units(CSHARP, "CSharp"))
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert units(CSHARP, "csharp") == [
        ("Class", "Handler", None), ("Property", "Count", "Handler"), ("Property", "Name", "Handler"), ("Constructor", "Handler", "Handler"), ("Method", "HandleAsync", "Handler"), ("Method", "Twice", "Handler"), ("Destructor", "Handler", "Handler"),
        ("Interface", "IStore", None), ("Method", "Save", "IStore"), ("Property", "Size", "IStore"), ("Record", "Point", None), ("Enum", "Color", None),
    ]
    by_name = {(r[1], r[2]): r[4] for r in rows}
    whole = by_name["Class", "Handler"]
    assert whole.startswith('[Route("api/{id}")]\n    public sealed class Handler') and "class Nested" in whole
    assert whole.endswith("\n// members:\n// Property: Count\n// Property: Name\n// Constructor: Handler\n// Method: HandleAsync\n// Method: Twice\n// Destructor: Handler")
    method = by_name["Method", "HandleAsync"]
    assert method.startswith('[HttpPost("{id}")]') and method.endswith("return null;\n        }") and "Task<Result<Order>>" in method
    assert by_name["Property", "Name"] == 'public string Name => _db.Name + "}";' and by_name["Method", "Twice"] == "public int Twice(int x) => x * 2;"
    assert by_name["Record", "Point"] == "public record Point(int X, int Y);" and by_name["Enum", "Color"] == "enum Color { Red, Green }"


def test_small_unknown_and_broken_sources():
    assert list(K.code_units("class Tiny { }", "csharp")) == [(0, "Class", "Tiny", None, "class Tiny { }")]
    assert list(K.code_units("Class Foo\nEnd Class", "vbnet")) == [(0, "File", None, None, "Class Foo\nEnd Class")]
    assert list(K.code_units(None, None)) == [(0, "File", None, None, "")]
    assert units("int x = 1;", "csharp") == [("File", None, None)]
    assert units("public class Open {\n  public void Go() {\n", "csharp") == [("Class", "Open", None), ("Method", "Go", "Open")]
    assert units("} } class A { void M() { } } }", "csharp") == [("Class", "A", None), ("Method", "M", "A")]
    assert units('class S { string a = "unclosed {\n; void M() { } }', "csharp") == [("Class", "S", None), ("Method", "M", "S")]
    assert units("namespace A; class B { int C() => 1; }", "csharp") == [("Class", "B", None), ("Method", "C", "B")]


def test_scripts_and_python():
    script = "export default class View extends Base {\n  static x = { a: 1 };\n  constructor(a) { super(a); }\n  async load(id) { if (id) { return; } }\n  #hid() { }\n}\nfunction help(a) { return { a }; }\nconst f = () => { };\n"
    assert units(script, "javascript") == [("Class", "View", None), ("Method", "constructor", "View"), ("Method", "load", "View"), ("Method", "#hid", "View"), ("Function", "help", None)]
    typed = "export interface Shape { area(): number; }\ntype Id = { a: string };\nenum Kind { A, B }\nabstract class Box implements Shape { private get size() { return 1; } }\n"
    assert units(typed, "typescript") == [("Interface", "Shape", None), ("TypeAlias", "Id", None), ("Enum", "Kind", None), ("Class", "Box", None), ("Method", "size", "Box")]
    python = "import x\n\n@wrap\nclass A(B):\n    def m(self):\n        return 1\n\n    y = 2\n\nasync def go():\n    def inner():\n        pass\n\nprint(1)\n"
    rows = list(K.code_units(python, "python"))
    assert [(r[1], r[2]) for r in rows] == [("Class", "A"), ("Function", "go")]
    assert rows[0][4] == "class A(B):\n    def m(self):\n        return 1\n\n    y = 2" and rows[1][4].endswith("        pass")


def test_one_pass_over_long_sources():
    source = "class Big {\n" + "".join(f"  public int M{k}(int x) {{ if (x > {k}) {{ return {k}; }} return x; }}\n" for k in range(20_000)) + "}\n"
    began = time.perf_counter()
    assert len(units(source, "csharp")) == 20_001
    assert time.perf_counter() - began < 20
    nested = "class A { void M() { " + "{ " * 20_000 + "} " * 20_000 + "} }"
    assert units(nested, "csharp") == [("Class", "A", None), ("Method", "M", "A")]


def test_lateral_call(spark):
    docs = spark.createDataFrame([(1, CSHARP, "csharp", 9), (2, "text", None, 9), (3, None, "python", 9), (1, "class B { }", "csharp", 9)], "document_id bigint, content string, language string, position int")
    out = K.code_chunks(docs).collect()
    assert len(out) == 12 + 3 and {(r.document_id, r.chunk_type, r.chunk) for r in out} >= {(2, "File", "text"), (3, "File", ""), (1, "Class", "class B { }")}
    assert K.code_chunks(docs.limit(0)).collect() == []


def test_code_chunks_leave_in_parts(spark, monkeypatch):
    from lanternlake.operators import ingest

    monkeypatch.setattr(ingest, "PART_CHARS", 40)
    texts = [None, "", "plain", "class A {\n public int B() {\n return 1;\n }\n}\n", "x" * 100, *("class C%d {\n}" % i for i in range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id bigint, content string").coalesce(1)
    out = sorted(ingest.code_chunks(docs).collect())
    assert [tuple(r) for r in out] == [(i, k, *piece) for i, t in enumerate(texts) for k, piece in enumerate(ingest._code_pieces(t or ""))]
