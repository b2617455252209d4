"""Extracted declarations and the rules on them, dead-code whitelist, match ranges, namespace chains."""

import re
import time

import pytest

from factloom.operators import declaration_rules as rules
from factloom.operators import graph, rollup, search, structure
from factloom.plans import catalog
from factloom.queries import sources
from factloom.sources import declared, lexical, profiles

SOURCE = """global using Z.Y; using System; using static A.B; using X = C.D; using Shop.Core.Sub;
namespace Shop.Core.Sub { [Serializable] public partial class Main : Window, IList<int> { public Main(int data) { InitializeComponent(); } public void OnClick(object item, int Tmp, int count) { var t = Type.GetType("x"); Assembly.LoadFrom("y"); x.GetType(); }
  public int X { get; set; } = F(1, 2); private readonly int _a = F(1, 2); event Action E; int Q => 3; [A] public string S { get; init; } } // class MyClass3 { }
public record PriceValueObject(int V); public class OldValueObject { public int V { get; set; } } public readonly struct RateValueObject { } class MyClass1 { void NewMethod() { } } }
class P { static void Main() { app.MapGet("/x", (int a, Foo b, [AsParameters] Bar c, string d, Baz<int> e) => 1); app.MapPost("/y", (Foo b) => 2); app.Map("/z", (A a, B b, C c, D d, E e) => 3); } }"""


def files(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "file_id long, text string")


def test_what_a_file_declares():
    got = {}
    for kind, _, owner, name, sort, words in declared.facts_of(SOURCE):
        got.setdefault(kind, []).append((owner, name, sort, tuple(words)))
    assert [x[1] for x in got["using"]] == ["Z.Y", "System", "A.B", "Shop.Core.Sub"]
    assert {x[1] for x in got["type"]} == {"Main", "PriceValueObject", "OldValueObject", "RateValueObject", "MyClass1", "P"}
    assert {(x[0], x[1]) for x in got["base"]} == {("Shop.Core.Sub.Main", "Window"), ("Shop.Core.Sub.Main", "IList")}
    assert ("Shop.Core.Sub.Main", "X", "property", ("public", "get", "set")) in got["member"] and ("Shop.Core.Sub.Main", "_a", "field", ("private", "readonly")) in got["member"]
    assert [x[1] for x in got["parameter"]] == ["item", "Tmp", "count"]
    assert sum(x[0] == "MapGet" for x in got["endpoint"]) == 5 and not [x for x in got["endpoint"] if x[0] == "Map"]


def test_declaration_rules(spark):
    facts = declared.declared_facts(files(spark, SOURCE, None, "", "}{ class", "namespace"))
    got = sorted((r["rule"], r["details"]) for r in rules.declaration_rules(facts, spark.createDataFrame([("System",), ("A.B.C",)], "name string")).collect())
    assert got == sorted([
        ("EnforceSemanticNaming", "item"), ("EnforceSemanticNaming", "Tmp"), ("EnforceSemanticNaming", "MyClass1"), ("EnforceSemanticNaming", "NewMethod"), ("EnforceMinimalApiAsParameters", "b of 5"),
        ("EnforceValueObjectContracts", "OldValueObject"), ("EnforceValueObjectContracts", "V"), ("DetectAndBanPhantomDependencies", "Z.Y"), ("DetectAndBanPhantomDependencies", "Type.GetType"), ("DetectAndBanPhantomDependencies", "Assembly.LoadFrom"),
        ("WpfRequireMinimalCodeBehind", "6: OnClick(), E, Q"),
    ])
    assert not [r for r in rules.semantic_naming(facts, ["onclick"]).collect() if r["details"] in ("item", "Tmp")]
    tests = spark.createDataFrame([(1,)], "file_id long")
    assert {r["rule"] for r in rules.declaration_rules(facts, facts.select("name").limit(0), tests).collect()} == {"EnforceValueObjectContracts"}


def test_generated_files(spark):
    f = files(spark, "[GeneratedCode(\"x\", \"1\")] class A { }", "[System.CodeDom.Compiler.GeneratedCodeAttribute(\"x\", \"1\")] class A { }", "// GeneratedCode\nclass A { }", None)
    assert sorted(r["file_id"] for r in rules.generated_files(f).collect()) == [1, 2]


def test_duplicate_code(spark):
    rows = [(1, "Exact", 1, "b.cs", 9), (1, "Exact", 2, "A.cs", 4), (1, "Exact", 2, "A.cs", 2), (5, "Near", 3, "c.cs", 1), (5, "Near", 4, "d.cs", 1), (9, "Exact", 5, "e.cs", 1), (9, "Exact", 6, "f.cs", 1)]
    members = spark.createDataFrame(rows, "root long, bucket string, file_id long, rel_path string, line int")
    off = spark.createDataFrame([(6,)], "file_id long")
    assert [tuple(r) for r in rules.duplicate_code(members, off).collect()] == [(2, 2, "DuplicateCode", "3 members")]
    assert rules.duplicate_code(members).count() == 2


def test_clones_without_a_path_are_never_first(spark):
    rows = [(1, "Exact", 1, None, 3), (1, "Exact", 2, "b.cs", 7), (1, "Exact", 3, "C.cs", 1), (5, "Exact", 4, None, 4), (5, "Exact", 5, None, 2)]
    members = spark.createDataFrame(rows, "root long, bucket string, file_id long, rel_path string, line int")
    got = {tuple(r) for r in rules.duplicate_code(members).collect()}
    assert got == {(2, 7, "DuplicateCode", "3 members"), (None, 2, "DuplicateCode", "2 members")}


def test_whitelist(spark):
    rows = [
        ("a", "T", "Run", "method", "private", ["Fact"], False, 0), ("b", "T", "Load", "method", "private", ["Xunit.TheoryAttribute"], False, 0), ("c", "T", "<Clone>$", "method", "private", None, False, 0), ("d", "T", "op_Add", "operator", "public", [], True, 2),
        ("T", None, "T", "class", "public", [], False, 0), ("main", "T", "Main", "method", "private", [], True, 1), ("e", "U", "U", "constructor", "private", [], False, 0), ("f", "U", "Help", "method", "public", [], True, 0), ("g", "T", "T", "constructor", "private", [], False, 0), ("h", "T", "Idle", "method", "private", ["Obsolete"], False, 0),
    ]
    symbols = spark.createDataFrame(rows, "symbol_id string, container_id string, name string, kind string, visibility string, attributes array<string>, is_static boolean, parameters int")
    assert {r["symbol_id"] for r in graph.whitelisted(symbols, ["main"]).collect()} == {"a", "b", "c", "d", "main", "T", "e"}
    facts = catalog.Facts(symbols=symbols.withColumn("rel_path", symbols["name"]).withColumn("start_line", symbols["parameters"]).withColumn("file_id", symbols["parameters"]), references=spark.createDataFrame([("T",), ("U",)], "callee_id string"))
    assert {r["symbol_id"] for r in catalog.find_dead_code(facts)[0].collect()} == {"main", "g", "h"}


def test_dead_locals(spark):
    own = spark.createDataFrame([(1, 1, "a"), (2, 1, "_"), (3, 1, "b"), (4, 2, "c")], "symbol_id long, container_id long, name string")
    uses = spark.createDataFrame([(1, True), (3, False), (3, True)], "symbol_id long, is_write boolean")
    assert sorted(r["symbol_id"] for r in graph.dead_locals(own, uses).collect()) == [1, 4]


@pytest.mark.parametrize("pattern", [r"\d{2,}", "a|ab", "^x", "x$", r"(?<=a)b", r"(a)\1", "b*", "(?i)A.", r"\b"])
def test_ranges_equal_the_matcher(spark, pattern):
    lines = ["", "12 345 6 78", "abab aab x", "xx x", "aa aaa a", "bbb a b", "Ab aB é12", "x"]
    hits = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    got = {r["n"]: [(x["col"], x["len"]) for x in r["ranges"]] for r in search.match_ranges(hits, pattern).collect()}
    assert got == {i: [(m.start() + 1, m.end() - m.start()) for m in re.finditer(pattern, t)] for i, t in enumerate(lines)}


@pytest.mark.parametrize("pattern", [r"\d{3,}", r"\d{3,}|(?=zz)|$"])
def test_ranges_of_long_lines_take_time_in_proportion(spark, pattern):
    """The rest of a line after its last match is not searched from each of its characters, nor are matches found anew for each match."""
    lines = {1: "1234 " + "word " * 100_000, 2: "no 999 " * 3000 + "zz" + "x" * 100_000}
    hits = spark.createDataFrame(list(lines.items()), "n int, line string")
    began = time.perf_counter()
    got = {r["n"]: [(x["col"], x["len"]) for x in r["ranges"]] for r in search.match_ranges(hits, pattern).collect()}
    assert time.perf_counter() - began < 30
    assert got == {n: [(m.start() + 1, m.end() - m.start()) for m in re.finditer(pattern, t)] for n, t in lines.items()}


def test_plain_ranges_and_what_they_lie_on(spark):
    hits = spark.createDataFrame([(1, "a.B A.b aXb")], "file_id long, line string")
    assert [(x["col"], x["len"]) for x in search.term_ranges(hits, "a.b").first()["ranges"]] == [(1, 3), (5, 3)]
    f = spark.createDataFrame([(1, "x.cs", "p", "int total;\nTotal += 1;\n")], "file_id long, rel_path string, project string, text string")
    tokens = spark.createDataFrame([(1, 1, "local", "L1", "p")], "file_id long, line_no int, kind string, symbol_id string, project string")
    rows = {r["line_no"]: r for r in catalog.search_pattern(catalog.Facts(files=f, tokens=tokens), "total")[0].collect()}
    assert rows[1]["resolution"] == "resolved" and rows[1]["symbol_id"] == "L1" and rows[2]["resolution"] == "unavailable"
    assert [(x["col"], x["len"]) for x in rows[1]["ranges"]] == [(5, 5)]


def test_chains_of_namespaces_collapse(spark):
    types = spark.createDataFrame([("A.B.C.D", "p"), ("A.B.C.E", "p"), ("A.B.C.E", "q"), ("X.Y", "p"), ("X", "p")], "namespace string, project string")
    got = {r["namespace"]: (r["types"], r["label"]) for r in rollup.collapsed_namespaces(rollup.namespaces(types, 5)).collect()}
    assert got == {"A.B.C": (3, "A.B.C"), "A.B.C.D": (1, "D"), "A.B.C.E": (2, "E"), "X": (2, "X"), "X.Y": (1, "Y")}


def test_object_initialisers(spark):
    text = """namespace N { class C {
      R Fill(int? a, int? b) { if (a == 3) return null; var x = a ?? 1; return new R { A = a ?? 1, B = b == null ? 1 : 2, C = 3 }; }
      R Copy(R r, int? a) => r with { A = a ?? r.A };
      R Plain(int a) { return new R { A = a, B = F(a ?? 2) }; }
      R Late(int? a) { Log(a ?? 1); return new R { A = a ?? 1 }; }
      int Not(int? a) { return a ?? 1; } } }"""
    f = files(spark, text, None, "class {")
    filled = profiles.object_initialisers(f)
    assert {r["member_id"] for r in filled.collect()} == {"M:N.C.Fill(int?,int?)", "M:N.C.Copy(R,int?)"}
    with_points = {r["member_id"]: r["cyclomatic"] for r in structure.cyclomatic(lexical.branching_nodes(f)).collect()}
    without = {r["member_id"]: r["cyclomatic"] for r in structure.cyclomatic(lexical.branching_nodes(f), filled).collect()}
    assert with_points["M:N.C.Fill(int?,int?)"] == 5 and without["M:N.C.Fill(int?,int?)"] == 2
    assert without["M:N.C.Late(int?)"] == with_points["M:N.C.Late(int?)"] == 3


def test_rules_read_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    own = files(spark, SOURCE, "namespace A { class data { } }")
    facts = declared.declared_facts(own.mapInArrow(count, own.schema))
    assert rules.declaration_rules(facts, spark.createDataFrame([("System",)], "name string")).count() > 0
    assert read.value == 2


@pytest.mark.parametrize("texts", ["part_sources", "components", "declaring_sources"])
def test_texts_of_a_small_table_are_dealt(spark, texts):
    """A table of few bytes is one split, and its texts would all be read by one task."""
    assert getattr(sources, texts)(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
