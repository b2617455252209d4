"""The lexical extractor and the rule catalogue on small sources."""

from pyspark.sql import functions as F

from factloom.operators import catalogue, structure
from factloom.sources import lexical

SOURCE = """namespace Shop.Core
{
    /* class Hidden { */
    public sealed class Cart<T> : Base where T : class
    {
        private readonly string text = "class Not { void Here() { } }";
        public Cart(int a, string b) { this.a = a; }
        public async Task<int> Run(Dictionary<string, int> map, bool flag = true)
        {
            if (flag && map != null || a > 1)
            {
                foreach (var x in map)
                {
                    while (x > 0) { y ??= x; z = x > 1 ? 1 : 2; }
                }
            }
            switch (a) { case 1: break; case 2: break; default: break; }
            return 1; // if
        }
    }
    internal static partial class Extra { }
}
"""


def files(spark):
    return spark.createDataFrame([(1, SOURCE), (2, None), (3, "")], "file_id long, text string")


def test_members(spark):
    got = {r["name"]: r for r in lexical.members(files(spark)).collect()}
    assert set(got) == {"Cart", "Run"}
    assert got["Run"]["param_types"] == ["Dictionary<string,int>", "bool"] and got["Run"]["member_id"] == "M:Shop.Core.Cart.Run(Dictionary<string,int>,bool)"
    assert (got["Cart"]["kind"], got["Run"]["kind"], got["Run"]["visibility"], got["Run"]["start_line"], got["Run"]["end_line"]) == ("constructor", "method", "public", 8, 19)


def test_types(spark):
    got = {r["name"]: r for r in lexical.types(files(spark)).collect()}
    assert set(got) == {"Cart", "Extra"} and got["Cart"]["is_sealed"] and got["Extra"]["is_partial"] and got["Extra"]["visibility"] == "internal"


def test_complexity(spark):
    nodes = lexical.branching_nodes(files(spark))
    cc = {r["member_id"]: r["cyclomatic"] for r in structure.cyclomatic(nodes).collect()}
    assert cc == {"M:Shop.Core.Cart.Run(Dictionary<string,int>,bool)": 9}
    cog = structure.cognitive(nodes).first()["cognitive"]
    assert cog == 1 + 1 + 1 + 2 + 3 + 4 + 1  # if, two operator runs, foreach, while, conditional, switch


def test_rules(spark):
    f = spark.createDataFrame([(1, "a/b/c/d/e/x.css", ".a .b .c .d{}"), (2, "x.js", "window.a = 1"), (3, "y.js", "export const a = 1"), (4, "z.cs", "#nullable enable")], "file_id long, rel_path string, text string")
    got = {(r["file_id"], r["rule"]) for r in catalogue.run({"files": f}).collect()}
    assert got == {(1, "MaxDirectoryDepth"), (1, "CSS_MaxCssSelectorComplexity"), (2, "JS_EnforceJsModules")}
    none = catalogue.run({"files": f}, {"MaxDirectoryDepth": {"depth": 0}, "CSS_MaxCssSelectorComplexity": {"limit": 9}})
    assert {r["rule"] for r in none.collect()} == {"JS_EnforceJsModules"}


def test_small_operators(spark):
    loops = spark.createDataFrame([(1, 0, 9), (1, 2, 8), (1, 3, 4), (2, 0, 1)], "file_id long, start int, end int")
    assert {r["file_id"]: r["depth"] for r in catalogue.nested_loops(loops).collect()} == {1: 3, 2: 1}
    uses = spark.createDataFrame([("App.Ui", "App.Data"), ("App.Data", "App.Ui")], "source string, target string")
    assert [r["source"] for r in catalogue.forbidden_dependencies(uses, [("*.Ui", "*.Data")]).collect()] == ["App.Ui"]
    placed = spark.createDataFrame([(1, "src/App/Ui/a.cs", "Root.App.Ui"), (2, "src/App/b.cs", "App.Data")], "file_id long, rel_path string, namespace string")
    assert [r["file_id"] for r in catalogue.misplaced_namespaces(placed).collect()] == [2]
    m = spark.createDataFrame([("Task<Result<int>>", 0), ("int", 2)], "return_type string, throws int")
    assert tuple(catalogue.playbook_totals(m).first()) == (1, 2, 2)
    assert spark.range(1).select(catalogue.guidance(F.lit("MaxLineCount"), F.lit(1), F.lit(900)).alias("g")).first()["g"].startswith("Split the file")
