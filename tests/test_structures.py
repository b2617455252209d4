"""Extraction, indexes, sweeps, layers, refresh, log reading and profiling on small inputs, against brute force."""

import itertools
import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from factloom.operators import coverage, graph, intervals, layers, profile_search, ranked, search, similarity, structure, webrules
from factloom.queries import sources
from factloom.sources import files as src
from factloom.sources import profiler, profiles, webscan
from factloom.streaming.refresh import FileTable, sweep


# structure profiles
def features(code, name):
    found = {p[0].partition("(")[0].rpartition(".")[2]: p for p in profiles.profiles_of(code)}
    return found[name][4], found[name][3]


def test_switch_expression():
    f, said = features("public static class D { public static string Describe(ITypeSymbol symbol) => symbol.TypeKind switch { TypeKind.Class => \"C\", _ => \"O\" }; }", "Describe")
    assert f["ret:string"] == 3.0 and f["param:ITypeSymbol"] == 0.8 and f["cf:switch-expr"] == 1.2 and f["paramkind:interface"] == 2.0
    assert "ret=string" in said and said.endswith("form=switch")


def test_flow_in_the_order_of_the_tree():
    f, said = features("class L { int E(int a, object b) { do { if (b is string s) return a > 0 ? 1 : 2; } while (a > 0); yield return 3; using (var x = F()) { lock (this) { } } throw new X(); } }", "E")
    assert "cflowseq:do>if>is-pattern>return>ternary>yield>using>lock" in f and f["cf:throw"] == 1.2 and "cf:while" not in f
    assert f["cf:return"] == 1.2 and "form=if" in said


def test_state_and_io():
    code = "namespace N; public class A { private int _t; static int S; public List<int> Xs { get; } public void Add(int v) { _t += v; } void See() { F(this._t, this.Xs); } void Put() { S = 1; int _t = 2; _t++; } void Say() { Console.WriteLine(\"_t += 1\"); } bool Is(A o) => !o.Ready; bool Test(object x) => x is A; bool Pat(object x) => x is not A; }"
    assert features(code, "Add")[0]["purity:mutates"] == 2.0
    seen = features(code, "See")[0]
    assert seen["purity:stateful"] == 2.0 and seen["member:int"] == 1.8 and seen["member:List<int>"] == 1.8
    assert features(code, "Put")[0]["purity:pure"] == 2.0
    assert features(code, "Say")[0]["purity:io"] == 2.0
    assert "cf:is-pattern" not in features(code, "Test")[0] and features(code, "Pat")[0]["cf:is-pattern"] == 1.2


def test_odd_sources(spark):
    rows = [(1, None), (2, ""), (3, "class A { void M("), (4, "}}}) class A { void M() { if (x { } }"), (5, "class A { void M() { } void M() { } }"), (None, "class A { int X => 1; delegate int D(int a); A() { } ~A() { } int this[int i] => i; }")]
    got = profiles.structure_profiles(spark.createDataFrame(rows, "file_id long, text string")).collect()
    assert sum(r["file_id"] == 5 for r in got) == 2 and not [r for r in got if r["file_id"] in (1, 2)]
    assert all(r["features"] for r in got)


# weighted prefix index
def random_profiles(rng, n, kinds=40):
    out = []
    for u in range(n):
        base = [f"f{rng.randrange(kinds)}" for _ in range(rng.randint(1, 8))] + ["ret:int" if rng.random() < 0.7 else "x", "purity:pure"]
        out.append((u, [(k, rng.choice([0.5, 1.0, 2.0, 3.0])) for k in base]))
    return out


def brute_pairs(rows, least):
    vectors = {}
    for u, fs in rows:
        v = vectors.setdefault(u, {})
        for k, w in fs:
            v[k] = v.get(k, 0) + w
    norm = {u: math.sqrt(sum(w * w for w in v.values())) for u, v in vectors.items()}
    out = {}
    for a, b in itertools.combinations(sorted(vectors), 2):
        both = vectors[a].keys() & vectors[b].keys()
        score = sum(vectors[a][k] * vectors[b][k] for k in both) / (norm[a] * norm[b])
        if score >= least - 1e-9 and any(k.startswith("ret:") for k in both):
            out[a, b] = score
    return out


def test_cosine_search_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = random_profiles(rng, 120)
    rows += [(1000 + i, rows[i % 9][1]) for i in range(30)]
    d = spark.createDataFrame(rows, "unit_id long, features array<struct<feature:string,weight:double>>")
    for least in (0.7, 0.9):
        got = {(r["a"], r["b"]): r["score"] for r in profile_search.structural_pairs(d, least).collect()}
        want = brute_pairs(rows, least)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    sets = {r["unit_id"]: (r["root"], r["size"]) for r in profile_search.structural_sets(d, 0.9).collect()}
    parent = {u: u for u, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(rows, 0.9):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    groups = {}
    for u in parent:
        groups.setdefault(find(u), []).append(u)
    assert sets == {u: (r, len(g)) for r, g in groups.items() if len(g) > 1 for u in g}


def test_candidates_grow_with_the_data_and_not_with_its_square(spark):
    """Every unit has the two common features, which weigh too little for a likeness; its own come from a pool that grows with the data."""
    met = []
    for n in (150, 1500):
        rng = random.Random(5)
        rows = [(u, [(f"f{rng.randrange(n)}", rng.choice([2.0, 3.0])) for _ in range(rng.randint(3, 6))] + [("ret:int", 1.0), ("purity:pure", 1.0)]) for u in range(n)]
        d = spark.createDataFrame(rows, "unit_id long, features array<struct<feature:string,weight:double>>")
        index = profile_search.prefix_index(profile_search.classes(d)[1], 0.9)
        assert index.filter("feature in ('ret:int', 'purity:pure')").count() == 0
        met.append(profile_search.candidates(index, 0.9).count())
    assert met[1] <= 12 * met[0]


# ranks and sums
@pytest.mark.parametrize("n", [0, 1, 5000])
def test_ranks_equal_the_window(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(50), i, rng.choice([None, 1, 7, 30])) for i in range(n)]
    got = ranked.ordered(spark.createDataFrame(rows, "k int, i int, s int"), "k", "i", size=F.col("s"), ranges=7)
    total, want = 0, {}
    for place, (k, i, s) in enumerate(sorted(rows, key=lambda r: r[:2]), 1):
        total += s or 0
        want[i] = (place, total)
    assert {r["i"]: (r["rank"], r["used"]) for r in got.collect()} == want


def test_byte_cap_counts_the_payload(spark):
    rows = [(1, "b.cs", 1, "x"), (2, "A.cs", 2, "yy"), (3, "A.cs", 10, "zzz")]
    hits = spark.createDataFrame(rows, "file_id long, rel_path string, line_no int, line string")
    order = [json.dumps({"rel_path": p, "line_no": n, "line": t}, separators=(",", ":")) for _, p, n, t in [rows[1], rows[2], rows[0]]]
    for k in range(4):
        payload = "[" + ",".join(order[:k]) + "]"
        got = search.capped(hits, 0, 0, len(payload)).count()
        assert got == k, (payload, got)
        assert search.capped(hits, 0, 0, max(1, len(payload) - 1)).count() == max(0, k - 1)


# intervals
def random_intervals(rng, n, most=60):
    return [(i, rng.randrange(3), lo := rng.randrange(most), lo + rng.randrange(20)) for i in range(n)]


def test_touched_equals_the_self_join(spark):
    rng = random.Random(4)
    for _ in range(4):
        d = random_intervals(rng, 60)
        c = [(rng.randrange(3), lo := rng.randrange(60), lo + rng.randrange(4) - 1) for _ in range(8)]
        hit = [x for x in d if any(p == x[1] and lo <= hi and x[3] >= lo and x[2] <= hi for p, lo, hi in c)]
        want = sorted(x[0] for x in hit if not any(y[1] == x[1] and y[2] >= x[2] and y[3] <= x[3] and y[2:] != x[2:] for y in hit))
        got = graph.touched(spark.createDataFrame(c, "path int, start_line int, end_line int"), spark.createDataFrame(d, "symbol_id long, path int, start_line int, end_line int"))
        assert sorted(r["symbol_id"] for r in got.collect()) == want


def test_innermost_equals_the_self_join(spark):
    rng = random.Random(6)
    d = random_intervals(rng, 80)
    points = [(i, rng.randrange(4), rng.randrange(90)) for i in range(150)]
    want = {}
    for i, p, line in points:
        around = [x for x in d if x[1] == p and x[2] <= line <= x[3]]
        want[i] = (min(around, key=lambda x: (-x[2], x[3], x[0]))[0] if around else None, len(around))
    got = intervals.innermost(spark.createDataFrame(points, "point_id long, path int, line int"), spark.createDataFrame(d, "symbol_id long, path int, d_lo int, d_hi int"))
    assert {r["point_id"]: (r["symbol_id"], r["depth"]) for r in got.collect()} == want


def test_many_intervals_of_one_file(spark):
    n = 100_000
    d = spark.range(n).select(F.col("id").alias("symbol_id"), F.lit("f").alias("path"), F.col("id").alias("start_line"), (F.lit(2 * n) - F.col("id")).alias("end_line"))
    got = graph.touched(spark.createDataFrame([("f", 5, 6)], "path string, start_line long, end_line long"), d).collect()
    # all that begin by line 6 are hit, and lie in each other
    assert [r["symbol_id"] for r in got] == [6]
    inner = intervals.innermost(spark.createDataFrame([(1, "f", n - 1)], "point_id long, path string, line long"), d.select("symbol_id", "path", F.col("start_line").alias("d_lo"), F.col("end_line").alias("d_hi"))).first()
    assert (inner["symbol_id"], inner["depth"]) == (n - 1, n)


# layers
def brute_layers(edges, nodes):
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    part = {n: max(m for m in reach[n] if n in reach[m]) for n in nodes}
    layer = dict.fromkeys(part.values(), 0)
    for _ in nodes:
        for a, b in edges:
            if part[a] != part[b]:
                layer[part[a]] = max(layer[part[a]], layer[part[b]] + 1)
    return {n: (part[n], layer[part[n]], sum(part[m] == part[n] for m in nodes) > 1 or (n, n) in edges) for n in nodes}


def test_layers_equal_brute_force(spark):
    rng = random.Random(2)
    for n, m in ((12, 14), (20, 34)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        got = layers.layers(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.range(n).select(F.col("id").alias("node")))
        assert {r["node"]: (r["component"], r["layer"], r["cyclic"]) for r in got.collect()} == brute_layers(edges, range(n))


def test_hierarchy_and_footprint_of_one_type(spark):
    bases = spark.createDataFrame([("C", "B"), ("B", "A"), ("D", "B"), ("X", "Y"), ("Y", "X")], "type_id string, base_id string")
    got = {(r["relative"], r["side"], r["level"]) for r in graph.hierarchy(bases, spark.createDataFrame([("B",)], "node string")).collect()}
    assert got == {("A", "base", 1), ("C", "derived", 1), ("D", "derived", 1)}
    assert {r["type"]: r["depth"] for r in graph.inheritance_depth(bases).collect()} == {"A": 0, "B": 1, "C": 2, "D": 2, "X": 0, "Y": 0}
    edges = bases.select(F.col("type_id").alias("src"), F.col("base_id").alias("dst"))
    sizes = spark.createDataFrame([(n, f"{n}.cs", 100, n == "A") for n in "ABCDXY"], "node string, file string, lines long, declaration_only boolean")
    whole = {r["src"]: r["footprint"] for r in graph.footprint(edges, sizes).collect()}
    assert whole == {"A": 100, "B": 110, "C": 210, "D": 210, "X": 200, "Y": 200}
    assert {r["src"]: r["footprint"] for r in graph.footprint(edges, sizes, blocks=3).collect()} == whole
    assert [tuple(r) for r in graph.footprint(edges, sizes, asked=spark.createDataFrame([("C",)], "node string")).collect()] == [("C", 210, 3)]


# refresh
CHANGE = "path string, mtime timestamp, bytes long, sha256 string, text string, deleted boolean"


def change(spark, *rows):
    import datetime as dt

    return spark.createDataFrame([(p, dt.datetime(2026, 1, 1, 0, 0, t), len(x or ""), x, x, gone) for p, x, t, gone in rows], CHANGE)


def texts(table, number=None):
    return {r["path"]: r["text"] for r in table.read(number).collect()}


def test_batches_rewrite_their_buckets_only(spark, tmp_path):
    t = FileTable(spark, str(tmp_path / "t"), 16)
    first = t.apply(change(spark, *((f"p{i}", "a", 1, False) for i in range(40))), 0)
    second = t.apply(change(spark, ("p3", "b", 2, False), ("p3", "old", 1, False), ("p4", None, 2, True), ("new", "n", 1, False)), 1)
    moved = [b for b in second.folders if second.folders[b] != first.folders.get(b)]
    assert len(moved) <= 3 and texts(t) == {**{f"p{i}": "a" for i in range(40) if i not in (3, 4)}, "p3": "b", "new": "n"}
    # a reader of the first version still has it; the same batch again changes nothing
    assert len(texts(t, first.number)) == 40 and t.apply(change(spark, ("p5", None, 3, True)), 1).number == second.number
    assert t.vacuum(keep=1) >= 1 and len(texts(t)) == 40
    # another handle, with other settings, sees the table as it was made
    assert texts(FileTable(spark, str(tmp_path / "t"), 99)) == texts(t)


@pytest.mark.parametrize("step", ["written", "drafted", "published"])
def test_a_crash_leaves_a_whole_version(spark, tmp_path, step):
    def fail(at):
        if at == step:
            raise RuntimeError(at)

    t = FileTable(spark, str(tmp_path / "t"), 4)
    t.apply(change(spark, ("a", "1", 1, False), ("b", "1", 1, False)), 0)
    broken = FileTable(spark, str(tmp_path / "t"), 4, fail)
    with pytest.raises(RuntimeError):
        broken.apply(change(spark, ("a", "2", 2, False), ("b", None, 2, True)), 1)
    before, after = {"a": "1", "b": "1"}, {"a": "2"}
    assert texts(t) == (after if step == "published" else before)
    t.apply(change(spark, ("a", "2", 2, False), ("b", None, 2, True)), 1)
    assert texts(t) == after


def test_two_writers_of_one_version(spark, tmp_path):
    t = FileTable(spark, str(tmp_path / "t"), 4)
    t.apply(change(spark, ("a", "1", 1, False)), 0)
    slow = FileTable(spark, str(tmp_path / "t"), 4, lambda at: at == "written" and t.apply(change(spark, ("b", "2", 1, False)), 1))
    with pytest.raises(RuntimeError):
        slow.apply(change(spark, ("c", "3", 1, False)), 1)
    assert texts(t) == {"a": "1", "b": "2"}


def test_sweep_follows_a_tree(spark, tmp_path):
    root = tmp_path / "src"
    (root / "app").mkdir(parents=True), (root / "other").mkdir()
    (root / "app/a.cs").write_text("one"), (root / "app/b.cs").write_text("two"), (root / "other/c.cs").write_text("three")
    t = FileTable(spark, str(tmp_path / "t"), 4)
    projects = spark.createDataFrame([(f"file:{root}/app",)], "dir string")
    t.apply(sweep(t, [str(root)], "*.cs", projects), 0)
    assert sorted(p.rpartition("/")[2] for p in texts(t)) == ["a.cs", "b.cs"]
    assert sweep(t, [str(root)], "*.cs", projects).count() == 0
    (root / "app/a.cs").write_text("one more"), (root / "app/b.cs").unlink(), (root / "app/d.cs").write_text("four")
    changes = sweep(t, [str(root)], "*.cs", projects)
    assert {(r["path"].rpartition("/")[2], r["deleted"]) for r in changes.collect()} == {("a.cs", False), ("b.cs", True), ("d.cs", False)}
    t.apply(changes, 1)
    assert sorted(texts(t).values()) == ["four", "one more"]


def test_a_stream_keeps_a_table(spark, tmp_path):
    from factloom.streaming.refresh import followed

    (tmp_path / "in").mkdir()
    t = FileTable(spark, str(tmp_path / "t"), 8)
    for name, text in (("a.cs", "one"), ("b.cs", "two"), ("a.cs", "three")):
        (tmp_path / "in" / name).write_text(text)
        # a stream sees a changed file again only if its time has moved on
        q = followed(spark, str(tmp_path / "in"), "*.cs").writeStream.foreachBatch(t.apply).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {p.rpartition("/")[2]: x for p, x in texts(t).items()}
    assert got["b.cs"] == "two" and got["a.cs"] in ("one", "three")


# logs
def test_one_log_in_many_tasks(spark, tmp_path):
    n = 20000
    lines = [json.dumps({"recordType": "tool_call", "toolName": f"t{i}", "timestamp": "2026-01-01T00:00:00Z"}) if i % 10 else "" for i in range(n)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + '\n{"torn": ')
    (tmp_path / "b.jsonl").write_bytes(b"x\r\ny\n\nz")
    (tmp_path / "a.feedback.jsonl").write_text("{}\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        got = src.log_lines(spark, str(tmp_path))
        rows = got.withColumn("part", F.spark_partition_id()).collect()
        scanned = spark.read.option("pathGlobFilter", "*.jsonl").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    a = {r["line_no"]: r["value"] for r in rows if r["log_file"].endswith("/a.jsonl")}
    assert scanned > 10 and a == {i + 1: x for i, x in enumerate(lines) if x} | {n + 1: '{"torn": '}
    assert sorted((r["line_no"], r["value"]) for r in rows if r["log_file"].endswith("/b.jsonl")) == [(1, "x"), (2, "y"), (4, "z")]
    calls, counts = src.tool_calls(src.log_lines(spark, str(tmp_path / "a.jsonl")))
    assert counts.first()["invalid"] == 1 and calls.count() == n - n // 10


# component markup
def test_scanner_states():
    text = '@* { @foreach <div> *@\n<p>don\'t {count}</p>\n<!-- <div> } -->\n<div title="a > b"><br><b/></div>\n@foreach (var x in F("{"))\n{\n  <i>it\'s "}</i>\n  @foreach (var y in x) { @(a ? b : c) }\n}\n@code {\n  string s = "}\\"}"; char c = \'}\'; // }\n  /* } */ void M() { }\n}\n@code { never'
    got = webscan.scan(text)
    assert got["code_blocks"] == [(10, 13)] and got["loop_depth"] == 1 + 0
    assert got["depth"] == 1 and got["flow"] == 2


def test_component_rules(spark):
    deep = "<div>" * 7
    rows = [
        (1, "A.razor", deep), (2, "b.RAZOR", "@code {" + "\n" * 21 + "}"), (3, "c.razor", '<Grid @onclick="() => { A(); }" @bind:x="y" Z=\'1\' /><Other @onclick="() => A()" @onfocus="() => A(); B(); C();" />'), (4, "d.razor", "".join(f"@if (a{i}) {{ }}" for i in range(9))),
        (5, "e.razor", "<Wide " + " ".join(f'A{i}="x"' for i in range(11)) + " />"), (6, "f.css", deep), (7, "g.razor", None), (8, "h.razor", '<p class="@(on ? "a" : "b")">@(x ? 1 : 2)</p>'), (9, "i.razor", "\n" * 300 + "x"),
        (10, "j.razor", "@foreach (var a in b) { @foreach (var c in d) { @foreach (var e in f) { } } }"),
    ]
    d = spark.createDataFrame(rows, "file_id long, rel_path string, text string")
    got = sorted((r["file_id"], r["rule"], r["details"]) for r in webrules.component_rules(d).collect())
    assert got == sorted([
        (1, "RAZOR_MaxMarkupNestingDepth", "7 > 6"), (2, "RAZOR_MaxRazorCodeBlockLines", "22"), (3, "RAZOR_BanInlineEventLambdas", "@onclick"), (3, "RAZOR_BanInlineEventLambdas", "@onfocus"), (4, "RAZOR_MaxControlFlowBlocks", "9 > 8"),
        (5, "RAZOR_MaxComponentParameterCount", "Wide 11"), (8, "RAZOR_BanInlineTernaryInAttributes", ""), (8, "RAZOR_BanInlineTernaryInAttributes", ""), (9, "RAZOR_MaxRazorLineCount", "301 > 300"), (10, "RAZOR_MaxForeachNestingDepth", "3 > 2"),
    ])
    off = {"RAZOR_MaxMarkupNestingDepth": 0, "RAZOR_BanInlineEventLambdas": 0}
    assert not {r["file_id"] for r in webrules.component_rules(d, off).collect()} & {1, 3}


def test_marks_turn_rules_off(spark):
    files = spark.createDataFrame([(1, "a.css", "/* Lint-Off css_x */"), (2, "b.razor", "@* lint-off all *@"), (3, "c.css", None)], "file_id long, rel_path string, text string")
    found = spark.createDataFrame([(i, r) for i in (1, 2, 3) for r in ("CSS_X", "RAZOR_Y")], "file_id long, rule string")
    left = lambda *ignored: sorted(tuple(r) for r in webrules.unsuppressed_web(found, files, "lint-off", list(ignored)).collect())
    assert left() == [(1, "RAZOR_Y"), (3, "CSS_X"), (3, "RAZOR_Y")]
    assert left("css") == [(1, "CSS_X"), (1, "RAZOR_Y"), (2, "CSS_X"), (3, "CSS_X"), (3, "RAZOR_Y")]
    assert len(left("all")) == 6


# profiler
def test_profiled_steps(spark, tmp_path):
    p = profiler.Profiler(spark, str(tmp_path))
    with p.step("count"):
        p.watch("rows", spark.range(100), most=F.max("id")).write.format("noop").mode("overwrite").save()
    with pytest.raises(ValueError), p.step("bad"):
        raise ValueError
    p.close()
    got = {r["step"]: (r["rows"], r["error"]) for r in profiler.steps(spark, str(tmp_path)).collect()}
    assert got == {"count": (100, None), "bad": (0, "ValueError")}
    assert json.loads(p.lines[0])["metrics"]["rows"]["most"] == 99
    assert profiler.slowest(profiler.steps(spark, str(tmp_path)), 1).count() == 1


def test_clone_links_keep_each_window_once(spark, tmp_path, monkeypatch):
    """What stays on disk is one table with the windows, and what is shared; tables that are read no more are removed."""
    monkeypatch.setattr("factloom.session.shared_folder", lambda _: str(tmp_path))
    units = [(i, [f"{i}w{k}" for k in range(2000)]) for i in range(40)] + [(100 + i, [f"{i}w{k}" for k in range(2000 - i)]) for i in range(2)]
    prints = similarity.fingerprints(spark.createDataFrame(units, "unit_id long, tokens array<string>"))
    assert sorted(tuple(r)[:2] for r in similarity.clone_links(prints, 0.65).collect()) == [(0, 100), (1, 101)]
    held = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert held < 12 * 42 * 1996


def test_ties_are_listed_alike_however_rows_are_dealt(spark):
    """members alike in kind and name are in the order of their lines."""
    rows = [("k", "n", i) for i in range(1000)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = structure.class_structure(spark.createDataFrame(rows, "kind string, name string, start_line int").repartition(7), "kind", 500)
        assert [r["start_line"] for r in got.collect()] == list(range(200))


def test_overloads_that_cant_be_confused_never_meet(spark):
    """F8: 20,000 overloads of one name, and two pairs among them."""
    members = spark.range(20_000).selectExpr("id as member_id", "1 as type_id", "'f' as name", "array('int', concat('T', id)) as param_types")
    more = spark.createDataFrame([(-1, 1, "f", ["int", "long"]), (-2, 1, "f", ["long", "long"]), (-3, 1, "f", ["T7", "T7"]), (-4, 1, "f", ["T7", "T7"]), (-5, 1, "f", ["int", None]), (-6, 1, "f", ["int", None]), (-7, 1, "f", None)], "member_id long, type_id int, name string, param_types array<string>")
    began = time.perf_counter()
    assert sorted((r["a"], r["b"]) for r in structure.confusable_overloads(members.unionByName(more), ["int", "long"]).collect()) == [(-4, -3), (-2, -1)]
    assert time.perf_counter() - began < 20


def test_vectors_meet_as_matrices(spark, monkeypatch):
    """any number of matrices gives what vector by vector gives; no nested loop over pairs of rows."""
    monkeypatch.setattr(similarity, "VECTORS", 7)
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(3 + i % 2)]) for i in range(100)] + [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, 2.0, 3.0]), (103, [2.0, 4.0, 6.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = similarity.like_query(e, e.filter("vec_id % 3 = 0"), 0.3)
    whole = [(i, [float(x) for x in v]) for i, v in ((r["vec_id"], r["embedding"]) for r in e.collect()) if v and None not in v]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    score = {(i, j): dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)) for i, x in whole if i % 3 == 0 for j, y in whole if i != j and len(x) == len(y)}
    assert {(r["query_id"], r["vec_id"]): round(r["score"], 9) for r in got.collect()} == {k: round(s, 9) for k, s in score.items() if s >= 0.3}
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_larger_tables_have_more_logs(spark, tmp_path, monkeypatch):
    """a log's lines are placed by one task."""
    monkeypatch.setattr(sources, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(sources, "LOG_ROWS", 50)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert sum(r["calls"] for r in sources.log_files(spark, "/root/testdata/sf0.001").collect()) == events
    lines = [sum(1 for _ in f.open()) for f in tmp_path.rglob("*.json")]
    assert sum(lines) == events and max(lines) < 100


def test_uncovered_needs_no_words(spark):
    """F16: mentions don't count, so texts aren't read."""
    symbols = spark.createDataFrame([("A", 9), ("B", 9), ("C", 9), ("D", 9), ("E", 1)], "name string, cognitive int")
    tests = spark.createDataFrame([("f", "ATests", ["B"], []), ("g", None, [], ["C"])], "file string, class_name string, covers array<string>, typeofs array<string>")
    assert [r["name"] for r in coverage.uncovered(symbols, tests).collect()] == ["D"]


def test_layers_write_one_table_a_round(spark, monkeypatch):
    """rounds are many and small, so what each writes and starts is what they cost."""
    written, kept = [], layers._kept
    monkeypatch.setattr(layers, "_kept", lambda df: written.append(1) or kept(df))
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 13)], "src long, dst long")
    assert {r["node"]: r["layer"] for r in layers.peeled(edges, spark.range(13).withColumnRenamed("id", "node")).collect()} == {i: i for i in range(13)}
    assert len(written) < 20
