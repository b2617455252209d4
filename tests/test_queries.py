"""Every registered query of the main operators against its SQL, and twice alike."""

import duckdb
import pytest

from factloom.operators import similarity
from factloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def base():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, base, name):
    got, want = QUERIES[name](spark, SF), base.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["search_ranges", "markup_nesting", "log_sessions"])
def test_runs_are_alike(spark, name):
    runs = [sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2)]
    assert runs[0] and runs[0] == runs[1]


def documents(folder, rows):
    """A connection with a table of documents (doc_id, text, lang, source) that is written to the folder."""
    c = duckdb.connect()
    c.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?, ?)", rows)
    c.sql(f"copy documents to '{folder}/documents.parquet'")
    return c


def test_duplicate_code_of_documents_without_language_or_source(spark, tmp_path):
    text = lambda k: " ".join(f"t{k}x{i}" for i in range(12))
    rows = [(1, text(1), None, "a"), (2, text(1), "en", "b"), (3, text(1), "de", "b"), (4, text(2), "en", None), (5, text(2), None, "a"), (6, text(3), "en", "c"), (7, text(3), "EN", "C"), (8, None, None, None)]
    base = documents(tmp_path, rows)
    got, want = QUERIES["duplicate_code"](spark, str(tmp_path)), base.sql(SQL["duplicate_code"])
    found = canonical(got.columns, [tuple(r) for r in got.collect()])
    assert found == canonical(want.columns, want.fetchall()) and len(found) == 3


@pytest.mark.parametrize("name", ["clone_pairs", "clone_clusters", "duplicate_code"])
def test_clones_share_windows_however_common(spark, tmp_path, name):
    """The SQL leaves out windows of over 60 units, the queries don't: that limit is all that they differ by."""
    words = lambda k, n: [f"{k}x{i}" for i in range(n)]
    rows = [(i, words("copy", 9)) for i in range(61)] + [(100 + i, words("near", 20) + [f"end{i}"]) for i in range(62)] + [(200 + i, words("few", 9)) for i in range(60)] + [(300 + i, words("near", 9) + words(i, 3)) for i in range(3)]
    base = documents(tmp_path, [(i, " ".join(w), "en", "a") for i, w in rows])
    limit = "between 2 and 60"
    assert SQL[name].count(limit) == 1
    got = QUERIES[name](spark, str(tmp_path))
    found = canonical(got.columns, [tuple(r) for r in got.collect()])
    whole, limited = (canonical(x.columns, x.fetchall()) for x in (base.sql(SQL[name].replace(limit, ">= 2")), base.sql(SQL[name])))
    assert found == whole and set(limited) < set(found)


def _drift_rows(pairs_from):
    """Documents of own words, and from a number on ones that are like each other: some in French, some with words added, one with no words."""
    words = lambda k, n: [f"{k}x{i}" for i in range(n)]
    own = [(i, words(f"own{i}", 30), "en") for i in range(1, pairs_from)]
    near = [(pairs_from + i, words("near", 40) + words(i, i), "fr" if i % 3 == 2 else "en") for i in range(14)]
    rows = [(i, " ".join(w), lang, "a") for i, w, lang in own + near]
    return rows + [(pairs_from + 20, None, "en", "a"), (pairs_from + 21, "t0 t1 t2 t3 t4 t5", "en", "a"), (pairs_from + 22, "t0 t1 t2 t3 t4 t5", "en", "a")]


@pytest.mark.parametrize("held", [1 << 20, 10])
def test_drift_candidates_need_no_search_for_all_pairs(spark, tmp_path, monkeypatch, held):
    """the helper is the smallest document of any pair, and the smallest documents are enough to find it."""

    def refuse(*_):
        raise AssertionError("all pairs were sought")

    monkeypatch.setattr(similarity, "clone_links", refuse)
    monkeypatch.setattr(similarity, "AHEAD", (4, 8), raising=False)
    monkeypatch.setattr(similarity, "HELD", held, raising=False)
    base = documents(tmp_path, _drift_rows(7))
    got, want = QUERIES["drift_candidates"](spark, str(tmp_path)), base.sql(SQL["drift_candidates"])
    found = canonical(got.columns, [tuple(r) for r in got.collect()])
    assert found == canonical(want.columns, want.fetchall()) and len(found) == 6


def test_drift_candidates_where_the_smallest_documents_are_like_none(spark, tmp_path, monkeypatch):
    """then all pairs are sought; and where no document is like another, there is no helper."""
    sought, whole = [], similarity.clone_links
    monkeypatch.setattr(similarity, "clone_links", lambda *a: sought.append(1) or whole(*a))
    monkeypatch.setattr(similarity, "AHEAD", (2, 3), raising=False)
    for name, rows, times, n in (("some", _drift_rows(9), 1, 6), ("few", _drift_rows(4)[:3], 1, 0), ("none", [(-1, "a b c d e f g h", "en", "a"), *_drift_rows(9)[:8]], 2, 0)):
        folder = tmp_path / name
        folder.mkdir()
        base = documents(folder, rows)
        got, want = QUERIES["drift_candidates"](spark, str(folder)), base.sql(SQL["drift_candidates"])
        found = canonical(got.columns, [tuple(r) for r in got.collect()])
        assert found == canonical(want.columns, want.fetchall()) and len(found) == n and len(sought) == times


def test_class_structure_lists_parts_without_brand_or_name_last(spark, tmp_path):
    """as in the SQL; no ties here, which it leaves open."""
    base = duckdb.connect()
    rows = [(i, None if i in (0, 50, 111, 153) else f"name{i:03}", None if i % 40 == 1 else f"Brand#{i % 4}") for i in range(203)]
    base.sql("create table part (p_partkey bigint, p_name varchar, p_brand varchar)")
    base.executemany("insert into part values (?, ?, ?)", rows)
    base.sql(f"copy part to '{tmp_path}/part.parquet'")
    got, want = QUERIES["class_structure"](spark, str(tmp_path)), base.sql(SQL["class_structure"])
    assert [tuple(r) for r in got.collect()] == want.fetchall()


def test_windows_are_told_apart_whatever_their_words_hold(spark, tmp_path):
    """words may hold any character but white space, also one that joins words: five words of the same six parts each."""
    parts = [f"p{i}" for i in range(60)]
    one = " ".join(p + ("\x01" if i % 6 == 0 else " ") for i, p in enumerate(parts)).replace("\x01 ", "\x01")
    two = " ".join(p + ("\x01" if i % 6 == 1 else " ") for i, p in enumerate(parts)).replace("\x01 ", "\x01")
    base = documents(tmp_path, [(1, one, "en", "a"), (2, two, "en", "a"), (3, one, "en", "a")])
    got, want = QUERIES["clone_clusters"](spark, str(tmp_path)), base.sql(SQL["clone_clusters"])
    found = canonical(got.columns, [tuple(r) for r in got.collect()])
    assert found == canonical(want.columns, want.fetchall()) and len(found) == 1


def test_duplicate_code_orders_paths_letter_by_letter(spark, tmp_path):
    """letters of which a whole upper case makes two."""
    pairs = [(x, y) for x in ("ß", "ŉ", "ﬁ", "ᾳ", "ǰ", "é") for y in ("st", "T", "Fj", "Ω", "j", "ʼo", "É", "\U00010428")]
    rows = [(2 * i + k, " ".join(f"t{i}x{j}" for j in range(9)), lang, "a") for i, pair in enumerate(pairs) for k, lang in enumerate(pair)]
    base = documents(tmp_path, rows)
    got, want = QUERIES["duplicate_code"](spark, str(tmp_path)), base.sql(SQL["duplicate_code"])
    found = canonical(got.columns, [tuple(r) for r in got.collect()])
    assert found == canonical(want.columns, want.fetchall()) and len(found) == len(pairs)
