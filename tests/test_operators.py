"""Operators on small fact tables with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.functions import measures, paths
from factloom.functions import text as tx
from factloom.operators import change, coverage, graph, logs, rollup, rules, search, similarity, structure
from factloom.plans import catalog, render
from factloom.sources import files as src


def one(spark, schema, row, expression):
    return spark.createDataFrame([row], schema).select(expression.alias("x")).first()["x"]


# logs
def write_logs(folder):
    a, b = folder / "2026-08-20", folder / "2026-08-21"
    a.mkdir(parents=True), b.mkdir(parents=True)

    def call(second, tool, response, ms, error=False, truncated=False):
        return f'{{"recordType":"tool_call","timestamp":"2026-08-20T10:00:0{second}Z","processId":10,"instanceId":"abc","toolName":"{tool}","durationMs":{ms},"success":true,"isErrorResult":{str(error).lower()},"response":"{response}","responseTruncated":{str(truncated).lower()}}}'

    loading = "[ERROR]: SOLUTION_NOT_LOADED: still loading"
    rows = [call(0, "get_symbol_body", loading, 1), call(1, "get_symbol_body", loading, 2), call(2, "get_symbol_body", loading, 3, True), call(4, "get_symbol_body", "complete", 4), call(6, "find_symbol", "partial", 5, False, True), '{"recordType":"feedback"}', "not-json"]
    (a / "one_10_abc.jsonl").write_text("\n".join(rows) + "\n")
    (b / "one_20_def.jsonl").write_text(call(8, "find_symbol", "x", 9).replace('"durationMs":9', '"durationMs":"nine"') + "\n")
    (b / "one.feedback.jsonl").write_text("{}\n")


def test_log_records(spark, tmp_path):
    write_logs(tmp_path)
    calls, counts = src.tool_calls(src.log_lines(spark, str(tmp_path)))
    totals = counts.agg(F.sum("invalid"), F.sum("ignored")).first()
    assert tuple(totals) == (1, 1)
    r = logs.report(calls).first()
    assert (r["logs"], r["calls"], r["errors"], r["truncated"]) == (2, 6, 1, 1)
    assert (r["n_complete"], r["n_truncated"], r["n_unknown"]) == (1, 1, 4)
    assert {(x["tool"], x["n"]) for x in logs.count_by(calls, "tool").collect()} == {("get_symbol_body", 4), ("find_symbol", 2)}
    assert tuple(logs.burst_totals(calls).first()) == (1, 3)
    first = min(logs.sessions(calls).collect(), key=lambda s: s["log_file"])
    assert (first["seconds"], first["duration_ms"], first["pid"], first["tools"][-1]) == (6.0, 15, 10, "find_symbol")


def test_no_calls_have_no_error_rate(spark, tmp_path):
    write_logs(tmp_path)
    calls, _ = src.tool_calls(src.log_lines(spark, str(tmp_path)))
    r = logs.report(calls.limit(0)).first()
    assert (r["calls"], r["error_rate"]) == (0, 0.0)


def test_bursts_break(spark):
    t0 = dt.datetime(2026, 1, 1)
    at = lambda s: None if s is None else t0 + dt.timedelta(seconds=s)
    rows = [("l", i, at(s), tool, load) for i, (s, tool, load) in enumerate([(0, "a", True), (5, "a", True), (11, "a", True), (12, "b", True), (13, "b", False), (14, "b", True), (None, "b", True)])]
    calls = spark.createDataFrame(rows, "log_file string, line_no long, ts timestamp, tool string, is_loading boolean")
    assert [(r["tool"], r["calls"]) for r in logs.bursts(calls).collect()] == [("a", 2)]


@pytest.mark.parametrize("text,want", [("[error]:  A_1 : x", "A_1"), ("[ERROR]: bad: [ERROR]: GOOD:", "UNCLASSIFIED"), ("fine", "UNCLASSIFIED"), (None, "UNCLASSIFIED")])
def test_error_codes(spark, text, want):
    assert one(spark, "t string", (text,), tx.error_code(F.col("t"), F.lit(None).cast("string"), F.lit(True), F.lit(True))) == want


# text
def test_line_counts(spark):
    for text, want in (("", (1, 0, 0)), ("a", (1, 1, 1)), ("a\n", (2, 1, 2)), ("a\n\nb", (3, 3, 3))):
        assert tuple(one(spark, "t string", (text,), f(F.col("t"))) for f in (tx.tree_lines, tx.read_lines, tx.web_lines)) == want


def test_comment_fold(spark):
    r = one(spark, "t string", ("a\n// b\n/* c\n\nd */\n\n/* e */\nf",), tx.comment_counts(F.col("t")))
    assert (r["code"], r["comment"], r["blank"]) == (2, 5, 1)


def test_markup(spark):
    assert one(spark, "t string", ("</p><div><p>x<br></p><ul><li/></ul></div>",), tx.nesting_depth(F.col("t"))) == 2
    assert one(spark, "t string", (".a > .b,.c",), tx.selector_depth(F.col("t"))) == 2


def test_search(spark):
    f = spark.createDataFrame([(1, "b.txt", "x\nanchor Anchor\ny\nz"), (2, "A.txt", "anchor")], "file_id long, rel_path string, text string")
    hits = search.plain_hits(f, "ANCHOR")
    assert {(r["file_id"], r["line_no"], r["matches"]) for r in hits.collect()} == {(1, 2, 2), (2, 1, 1)}
    near = {r["file_id"]: (r["before"], r["after"]) for r in search.with_context(f, hits, 1, 1).collect()}
    assert near == {1: (["x"], ["y"]), 2: ([], [])}
    shown = search.capped(hits, 1, 10)
    assert [r["file_id"] for r in shown.collect()] == [2]
    done = search.completeness(hits, shown, 1, 10, 0).first()
    assert (done["total"], done["shown"], done["truncated"], done["reasons"]) == (2, 1, True, ["maxFiles"])
    ranges = search.match_ranges(search.regex_hits(f, "[Aa]nchor"), "[Aa]nchor").filter("file_id = 1").first()["ranges"]
    assert [(r["col"], r["len"]) for r in ranges] == [(1, 6), (8, 6)]


@pytest.mark.parametrize("pattern, want", [("^using", {(1, 2)}), (";$", {(1, 2), (1, 3), (2, 1)}), (r"\Ax\z", {(1, 1)}), (r"(?<!.)b;(?!.)", {(1, 3)})])
def test_anchors_hold_for_lines(spark, pattern, want):
    f = spark.createDataFrame([(1, "a", "x\nusing a;\nb;\nz"), (2, "b", "c;\nd")], "file_id long, rel_path string, text string")
    assert {(r["file_id"], r["line_no"]) for r in search.regex_hits(f, pattern).collect()} == want


def test_globs(spark):
    d = spark.createDataFrame([("src/a/b.cs",), ("src/b.cs",), ("SRC/x.CS",)], "p string")
    got = lambda g, seg: [r[0] for r in d.filter(paths.matches_any(F.col("p"), [g], seg)).collect()]
    assert got("src/*.cs", True) == ["src/b.cs", "SRC/x.CS"] and len(got("src/*.cs", False)) == 3 and len(got("**/*.cs", True)) == 3
    assert one(spark, "p string", ("a/obj/x.cs",), paths.is_generated_path(F.col("p")))


# rules
def test_suppression_by_prefix(spark):
    found = spark.createDataFrame([(1, "MaxLineCount"), (1, "Other"), (2, "MaxLineCount"), (3, "Other")], "file_id long, rule string")
    marks = spark.createDataFrame([(1, "maxline"), (3, "all")], "file_id long, rule string")
    assert {tuple(r) for r in rules.unsuppressed(found, marks).collect()} == {(1, "Other"), (2, "MaxLineCount")}


def test_suppression_marks(spark):
    lines = spark.createDataFrame([(1, 1, "// off MaxA, more"), (1, 2, "// off"), (1, 3, "// off ALL"), (1, 4, "x")], "file_id long, line_no int, line string")
    assert [r["rule"] for r in rules.suppressions(lines, "// off").orderBy("line_no").collect()] == ["MaxA", "all", "all"]


def test_gate_is_clamped(spark):
    found = spark.createDataFrame([("error",)] * 50, "severity string")
    classes = spark.createDataFrame([(1.0, 10.0, True)], "complexity double, footprint double, is_sealed boolean")
    low, high = rules.gate_score(found, classes).first(), rules.gate_score(found.limit(0), classes).first()
    assert (low["score"], low["passed"], high["score"], high["passed"]) == (0.0, False, 10.0, True)


def test_thresholds(spark):
    got = [one(spark, "v int, l int", (v, limit), measures.threshold_status(F.col("v"), F.col("l"), F.lit(1))) for v, limit in ((5, 0), (6, 5), (4, 5), (3, 5))]
    assert got == ["OK", "VIOLATION", "WARN", "OK"]


def test_status_codes_win(spark):
    assert one(spark, "v string", ("360",), measures.number_kind(F.col("v"), F.lit("int"), F.lit("TIMEOUT"))) == "http_status"


# similarity
def test_clone_ladder(spark):
    base = [f"t{i}" for i in range(100)]

    def changed(n):
        out = list(base)
        for k in range(n):
            out[5 + 8 * k] = f"x{k}"
        return out

    units = spark.createDataFrame([(1, base), (2, list(base)), (3, changed(1)), (4, changed(4)), (5, changed(11))], "unit_id long, tokens array<string>")
    pairs = {(r["a"], r["b"]): r["bucket"] for r in similarity.clone_pairs(similarity.fingerprints(units), 0.60).collect()}
    assert pairs[(1, 2)] == "Exact" and pairs[(1, 3)] == "Near" and pairs[(1, 4)] == "Fuzzy" and (1, 5) not in pairs


def test_chain_is_one_cluster(spark):
    pairs = spark.createDataFrame([(i, i + 1, 0.9) for i in range(1, 20)] + [(50, 51, 0.96)], "a long, b long, score double")
    got = {r["root"]: (r["size"], r["bucket"]) for r in similarity.clusters(pairs).collect()}
    assert got == {1: (20, "Near"), 50: (2, "Exact")}


def test_large_groups_of_clones(spark):
    base = [f"t{i}" for i in range(60)]
    copies = [(i, base) for i in range(100, 180)]
    near = [(i, [f"u{k}" for k in range(80)] + [f"end{i}"]) for i in range(300, 370)]
    units = spark.createDataFrame(copies + near + [(7, [f"own{k}" for k in range(30)])], "unit_id long, tokens array<string>")
    prints = similarity.fingerprints(units)
    pairs = similarity.clone_pairs(prints, 0.65)
    assert pairs.count() == 80 * 79 // 2 + 70 * 69 // 2
    links = similarity._kept(similarity.clone_links(prints, 0.65))
    assert links.filter("b < 300").count() == 79
    got = {r["root"]: (r["size"], r["weakest"], r["bucket"]) for r in similarity.clusters(links).collect()}
    assert got == {r["root"]: (r["size"], r["weakest"], r["bucket"]) for r in similarity.clusters(pairs).collect()}
    assert {k: v[0] for k, v in got.items()} == {100: 80, 300: 70}


# graph
EDGES = [("B", "A", 1, 1), ("C", "B", 1, 2), ("D", "C", 2, 1), ("E", "D", 2, 2), ("A", "C", 3, 1)]


def test_callers_are_bounded(spark):
    refs = spark.createDataFrame(EDGES, "caller_id string, callee_id string, file_id long, line int")
    start = spark.createDataFrame([("A",)], "node string")
    levels = lambda d: {(r["caller_id"], r["level"]) for r in graph.callers(refs, start, d).collect()}
    assert levels(2) == {("B", 1), ("C", 2)}
    assert levels(9) == levels(3) == {("B", 1), ("C", 2), ("D", 3), ("A", 3)}


def test_node_limit_is_flagged(spark):
    refs = spark.createDataFrame([(f"c{i:03}", "A", 1, i) for i in range(230)] + [(f"d{i:03}", f"c{i:03}", 2, i) for i in range(230)], "caller_id string, callee_id string, file_id long, line int")
    start = spark.createDataFrame([("A",)], "node string")
    got = lambda d, n: [(r["truncated"], r["n"]) for r in graph.callers(refs, start, d, n).groupBy("truncated").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert got(1, 200) == [(False, 230)] and got(2, 200) == [(True, 230 + 199)] and got(2, 231) == got(2, None) == [(False, 460)]
    symbols = spark.createDataFrame([("A", "A", "p", 1, 9)], "symbol_id string, name string, rel_path string, start_line int, end_line int")
    for depth, want in ((1, (230, 230, False, False)), (2, (429, 429, True, True))):
        assert tuple(catalog.find_references(catalog.Facts(references=refs, symbols=symbols), "A", 1000, depth)[1].first()) == want


def test_hierarchy_has_no_end_of_rounds(spark):
    bases = spark.createDataFrame([(f"t{i:02}", f"t{i + 1:02}") for i in range(35)], "type_id string, base_id string")
    got = graph.hierarchy(bases, spark.createDataFrame([("t00",)], "node string"))
    assert sorted(r["level"] for r in got.collect()) == list(range(1, 36))


def test_closure_and_footprint(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert graph.closure(edges).count() == 9
    sizes = spark.createDataFrame([("a", "f", 100, False), ("b", "g", 50, True), ("c", "g", 30, False)], "node string, file string, lines int, declaration_only boolean")
    assert {r["src"]: r["footprint"] for r in graph.footprint(edges, sizes).collect()} == {"a": 110, "b": 150, "c": 130}


def test_innermost_change(spark):
    d = spark.createDataFrame([("outer", "p", 1, 50), ("inner", "p", 10, 20), ("other", "p", 60, 70)], "symbol_id string, path string, start_line int, end_line int")
    c = spark.createDataFrame([("p", 12, 12)], "path string, start_line int, end_line int")
    assert [r["symbol_id"] for r in graph.touched(c, d).collect()] == ["inner"]


def test_hunks(spark):
    lines = ["+++ b/x.cs", "@@ -1 +3 @@", "+a", "@@ -5,2 +8,0 @@", "+++ b/y.cs", "@@ -1,2 +1,4 @@"]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "diff_id long, line_no long, line string")
    assert [tuple(r)[1:] for r in graph.hunks(d).orderBy("path", "start_line").collect()] == [("x.cs", 3, 1), ("x.cs", 8, 0), ("y.cs", 1, 4)]


def test_dead_code(spark):
    symbols = spark.createDataFrame([("T", None, "T"), ("m", "T", "m"), ("u", None, "u"), ("Main", None, "Main")], "symbol_id string, container_id string, name string")
    refs = spark.createDataFrame([("x", "u")], "caller_id string, callee_id string")
    assert [r["symbol_id"] for r in graph.dead_symbols(symbols, refs, alive=["Main"]).collect()] == ["T"]


# change
def test_baseline_cases(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    stored, now = frame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]), frame([("a", "1"), ("b", "9"), ("e", "3"), ("f", "7")])
    assert {tuple(r) for r in change.compare(stored, now).collect()} == {("b", "changed", None), ("e", "renamed", "c"), ("d", "removed", None), ("f", "new", None)}
    assert change.compare(stored, stored).count() == 0


def test_upsert(spark, tmp_path):
    from factloom.streaming.incremental import upsert

    path, frame = str(tmp_path / "t"), lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    merge = upsert(path)
    merge(frame([("a", "1"), ("b", "2")]), 0)
    merge(frame([("b", "3"), ("c", "4")]), 1)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


def test_stream_of_bursts_and_windows(spark, tmp_path):
    from factloom.streaming.incremental import call_stream, stream_bursts, windowed_counts

    folder = tmp_path / "in"
    folder.mkdir()
    at = lambda s: f"2026-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    rows = [("a", 0, True), ("a", 3, True), ("a", 6, True), ("b", 8, False), ("b", 3000, False)]
    (folder / "1.json").write_text("\n".join(f'{{"log_file":"l","line_no":{i},"ts":"{at(s)}","tool":"{t}","is_loading":{str(x).lower()},"is_error":false}}' for i, (t, s, x) in enumerate(rows)))
    for name, make, want in (("bursts", stream_bursts, {("l", "a", 3)}), ("windows", windowed_counts, None)):
        q = make(call_stream(spark, str(folder))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.table(name).collect()
        assert {tuple(r) for r in got} == want if want else sum(r["calls"] for r in got) == 4


# structure, coverage, rollup
def test_structure(spark):
    m = spark.createDataFrame([("T", "f", "a", ["int"]), ("T", "f", "b", ["long"]), ("T", "f", "c", ["Foo"])], "type_id string, name string, member_id string, param_types array<string>")
    assert [(r["a"], r["b"]) for r in structure.confusable_overloads(m, ["int", "long"]).collect()] == [("a", "b")]
    f = spark.createDataFrame([("x.razor",), ("X.razor.cs",), ("y.razor",)], "path string")
    assert [r["path"] for r in structure.companions_missing(f, ".razor", ".cs").collect()] == ["y.razor"]
    t = spark.createDataFrame([(1, "s.AddScoped<IA, A>(); s.AddSingleton<B>(); // AddOther<C>")], "file_id long, text string")
    names = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    assert [(r["name"], r["life"]) for r in structure.registrations(t, names).collect()] == [("A", "Scoped"), ("B", "Singleton")]


def test_reasons(spark):
    tests = spark.createDataFrame([("t1", "FooTests", ["Bar"], [], []), ("t2", "X", ["Foo"], ["Foo"], [])], "file string, class_name string, text_words array<string>, covers array<string>, typeofs array<string>")
    s = spark.createDataFrame([("Foo", 9), ("Bar", 9)], "name string, cognitive int")
    assert {tuple(r) for r in coverage.covering_tests(s, tests).collect()} == {("Foo", "t1", "name"), ("Foo", "t2", "covers"), ("Bar", "t1", "mention")}
    assert [r["name"] for r in coverage.uncovered(s, tests).collect()] == ["Bar"]


def test_upper_median(spark):
    d = spark.createDataFrame([("a/b/1", n, False) for n in (1, 2, 3, 9)], "path string, lines long, flag boolean")
    assert rollup.slices(d, "flag").first()["median_lines"] == 3


def test_files_and_catalog(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.cs").write_text("class A\n{\n  void F() {}\n}\n")
    (tmp_path / "p" / "b.bin").write_bytes(b"\0\1")
    (tmp_path / "p" / "c.g.cs").write_text("x")
    files = src.source_files(spark, [str(tmp_path), str(tmp_path / "p")])
    assert {(r["rel_path"].rpartition("/")[2], r["text"] is None) for r in files.collect()} == {("a.cs", False), ("b.bin", True)}
    assert src.distinct_roots(["/a/b", "/a", "/ab"]) == ["/a", "/ab"]
    f = catalog.Facts(files=files)
    rows, done = catalog.search_pattern(f, "void")
    assert rows.first()["line_no"] == 3 and tuple(done.first())[:3] == (1, 1, False)
    rows, _ = catalog.get_hotspots(f, 4)
    assert rows.first()["level"] == "critical"
    rows, done = catalog.metrics_tree(catalog.Facts(files=files.withColumn("rel_path", F.lit("p/a.cs"))), "p", "lines", 1)
    assert rows.count() and done.first()["truncated"] is False
    assert "| ext |" in render.markdown(catalog.get_index_scope(f, spark.createDataFrame([(".cs",), (".js",)], "ext string"))[0])


def test_config():
    assert src.load_config('{"a": {"x": 2}, "b": null}', {"a": {"x": 1, "y": 1}, "b": 3}) == {"a": {"x": 2, "y": 1}, "b": 3}


def test_upsert_after_a_crash_before_the_rename(spark, tmp_path):
    from factloom.streaming.incremental import upsert

    table = str(tmp_path / "files")
    merge = upsert(table)
    batch = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    merge(batch(("a", "1"), ("b", "1")), 0)
    (tmp_path / "files").rename(tmp_path / "files.next-1")
    merge(batch(("b", "2")), 1)
    assert sorted(map(tuple, spark.read.parquet(table).select("path", "text").collect())) == [("a", "1"), ("b", "2")]
