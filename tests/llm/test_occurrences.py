"""Occurrences of benchmark items: all of them, one block at a time, and operators on executors without this package."""

import os
import random
import subprocess
import sys

from factloom.llm import decontam

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def brute(item, text, k):
    """Disjoint occurrences from left to right, by the full table of distances: the definition of the docstring."""
    lo, out = 0, []
    while True:
        # rows of the table for ends after lo: least distance of item to text[s:end] over s >= lo
        row, ends = list(range(len(item) + 1)), []
        for end in range(lo + 1, len(text) + 1):
            new = [0]
            for i, c in enumerate(item, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != text[end - 1])))
            row = new
            ends.append((row[-1], end))
        first = next((e for d, e in ends if d <= k), None)
        if first is None:
            return out
        d, end = min((d, e) for d, e in ends if first <= e <= first + 2 * k)
        out.append((d, end))
        lo = end - (k == 0)


def test_periodic_items_are_found_at_each_occurrence():
    m = decontam.Matcher([(1, ("ab " * 30).strip())])
    found = list(m.matches("ab " * 300))
    assert len(found) == 10 and [x[1] for x in found] == [0] * 10
    assert all(a[3] <= b[2] for a, b in zip(found, found[1:]))
    # short items share the border between two occurrences
    assert len(list(decontam.Matcher([(1, "ab ab")]).matches("ab ab ab ab ab"))) == 2


def test_occurrences_equal_the_table_of_distances():
    rng = random.Random(4)
    for _ in range(60):
        unit = "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + " "
        item = decontam.normal("".join(unit if rng.random() < 0.9 else rng.choice("abc") + " " for _ in range(rng.randint(1, 25))))
        text = list("".join(rng.choice([unit, unit, unit, "zz "]) for _ in range(60)))
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = rng.choice("abcz")
        text = decontam.normal("".join(text))
        m, k = decontam.Matcher([(7, item)]), decontam.budget(len(item))
        pad = f" {text} "
        want = brute(decontam.bordered(item), pad, k)
        assert [x[1] for x in m.matches(text)] == [d for d, _ in want], (item, text)


def test_blocks_of_items_give_what_one_block_gives(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(30)]
    docs = [(i, " ".join([word(), items[i % 30][1], word()]) if i % 2 else " ".join(word() for _ in range(30))) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontam.contaminated(d, b, n).collect())) for n in (10**9, 900))
    assert one == many and len(one) == 20
    assert sorted(r["doc_id"] for r in decontam.clean_documents(d, b, 900).collect()) == list(range(0, 40, 2))
    # a block is made only when the one before it is done with
    blocks = decontam.item_blocks(b, 900)
    assert next(blocks) >= 3 and sum(len(x) for x in blocks) == 30


BARE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1500]").config("spark.executor.memory", "1000m").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def seen(_):
    import importlib.util
    return importlib.util.find_spec("factloom") is not None
assert not any(spark.sparkContext.parallelize([1]).map(seen).collect()), "executors see the package"
from factloom.llm.queries import queries
for name, query in queries().items():
    print(name, query(spark, "/root/testdata/sf0.001").count() > 0)
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", BARE, ROOT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True)
    rows = dict(x.rsplit(" ", 1) for x in done.stdout.splitlines() if x.startswith("op"))
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(rows) == 13 and all(v == "True" for v in rows.values()), rows
