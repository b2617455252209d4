"""Prefix-tree join, turn repair and vector codes against brute force, libraries and odd rows."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from factloom.llm import prefix_tree, turn_repair, vector_codes
from factloom.llm.queries import queries

SF = "/root/testdata/sf0.001"


# prefix-tree join
def linked(a, b):
    return len(a) and len(b) and 190 * len(np.intersect1d(a, b)) >= 90 * (len(a) + len(b))


def least_of_components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def plain_set(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute_components(texts):
    sets = {d: plain_set(t) for d, t in texts.items()}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in least_of_components(sets, edges).items()}


def family(rng, n, size, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_linked_sets_have_a_key_in_common():
    rng, tried = np.random.default_rng(3), 0
    for n in [*range(9, 90), 333, 1000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([rng.permutation(a)[int(rng.integers(0, n // 9 + 1)) :], rng.integers(0, 2**64, int(rng.integers(0, n // 9 + 1)), dtype=np.uint64)]))
            if linked(a, b):
                tried += 1
                assert len(np.intersect1d(prefix_tree.keys(a), prefix_tree.keys(b)))
    assert tried > 700


@pytest.mark.parametrize("sided", [False, True])
def test_blocks_connect_what_links_connect(sided):
    rng = np.random.default_rng(5)
    for _ in range(80):
        base = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
        sets = [np.unique(np.concatenate([rng.permutation(base)[int(rng.integers(0, 9)) :], rng.integers(0, 2**64, int(rng.integers(0, 5)), dtype=np.uint64)])) for _ in range(rng.integers(2, 25))]
        m = len(sets)
        sides = [int(x) for x in rng.integers(0, 2, m)] if sided else [2] * m
        got = prefix_tree.block_links(list(range(m)), list(range(m)), sides, sets)
        want = {(i, j) for i, j in itertools.combinations(range(m), 2) if (not sided or sides[i] != sides[j]) and linked(sets[i], sets[j])}
        assert len(got) == len(set(got)) <= m
        assert least_of_components(range(m), got) == least_of_components(range(m), want)


def test_a_block_of_near_copies_costs_looks_by_its_sets():
    """A look is at one stretch of one node; pairs of sets grow fourfold here."""
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
    looks = {}
    for m in (400, 800):
        sets = [base] + [np.unique(np.append(rng.permutation(base)[2:], rng.integers(0, 2**64, 2, dtype=np.uint64))) for _ in range(m)]
        tree, has, order = prefix_tree.Tree(), np.zeros(200, bool), {int(x): i for i, x in enumerate(base)}
        for i, s in enumerate(sets):
            local = np.array(sorted(order[int(x)] for x in s if int(x) in order))
            has[:] = False
            has[local] = True
            tree.probe(local, has, len(s), i)
            tree.insert(local, len(s), i, i)
        looks[m] = tree.seen
        assert len({tree.find(i) for i in range(m + 1)}) == 1
    assert looks[800] < 3 * looks[400] and looks[800] < 800 * 200


@pytest.mark.parametrize("block", [1 << 17, 300])
def test_components_against_brute_force(spark, monkeypatch, block):
    """The small block deals nearly every family, through leaders and cells."""
    monkeypatch.setattr(prefix_tree, "BLOCK", block)
    rng = random.Random(7)
    texts = [t for size, edits in ((12, 1), (25, 1), (60, 2), (120, 4), (150, 9)) for t in family(rng, 12, size, edits)]
    texts += [None, "", "a", "a b", "A  B", "a b c", *["same words here"] * 3, " ".join(f"w{i % 977}" for i in range(200000))]
    d = {i: t for i, t in enumerate(texts)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_tree.joined(spark.createDataFrame(list(d.items()), "doc_id long, text string")).collect()}
    assert got == brute_components(d)


def test_join_of_repeated_rows_null_ids_and_no_rows(spark):
    d = spark.createDataFrame([(1, "one two three", 5, 1), (1, "one two three", 6, 2), (None, "one two three", 7, 3), (2, "ONE TWO\tthree", 8, 4), (None, "of its own", 7, 3)], "doc_id long, text string, id int, family int")
    got = sorted(tuple(r) for r in prefix_tree.joined(d).collect() if r["doc_id"] is not None)
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert [r["component_id"] for r in prefix_tree.joined(d).collect() if r["doc_id"] is None] == [None, None]
    assert prefix_tree.joined(d.limit(0)).count() == 0


# turn repair
def brute_repair(turns):
    """The cheapest edit sequences of a conversation by exhaustive search over (row, role that stayed last); turns: (initial, fault)."""
    memo = {}

    def rest(i, q):
        if (i, q) in memo:
            return memo[i, q]
        memo[i, q] = (10**9, "")
        found = [(0, "")] if i == len(turns) and q in ("", "a") else []
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[q]
        # at most two inserts in a row are ever of use
        for n in (1, 2):
            r = after if n == 1 else {"u": "a", "a": "u"}[after]
            c, a = leaf(i, r)
            found.append((3 * n + c, "I" * n + a))
        found.append(leaf(i, q))
        memo[i, q] = min(found)
        return memo[i, q]

    def leaf(i, q):
        if i == len(turns):
            return (0, "") if q in ("", "a") else (10**9, "")
        c, fault = turns[i]
        found = []
        x, a = rest(i + 1, q)
        found.append((4 + x, "D" + a))
        if fault not in ("blank", "duplicate"):
            extra = 3 if fault == "truncated" else 0
            after = {"": "u", "s": "u", "u": "a", "a": "u"}[q]
            for r in {after, "s" if q == "" else after}:
                if c == r:
                    x, a = rest(i + 1, r)
                    found.append((extra + x, "K" + a))
                elif r != "s":
                    x, a = rest(i + 1, r)
                    found.append((3 + extra + x, "R" + a))
        return min(found)

    return rest(0, "")


def test_plans_equal_exhaustive_search():
    rng, kinds = random.Random(2), {"": turn_repair.WHOLE, "blank": turn_repair.BLANK, "duplicate": turn_repair.DUPLICATE, "truncated": turn_repair.TRUNCATED}
    for _ in range(1500):
        turns = [(rng.choice("suauat "), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 9))]
        plan = turn_repair.Repair()
        for c, fault in turns:
            plan.add(c, kinds[fault])
        assert plan.close() == brute_repair(turns), turns


def test_a_long_conversation_is_linear():
    plan = turn_repair.Repair()
    for i in range(100_000):
        plan.add("uasu"[i % 4], turn_repair.TRUNCATED if i % 7 == 0 else turn_repair.WHOLE)
    cost, audit = plan.close()
    assert sum(x != "I" for x in audit) == 100_000 and cost > 0 and len(plan.steps) == 400_000


def plain_conversation(rows):
    """rows: (conv_id, turn, role, text) of one conversation, after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] = counts.get(fault, 0) + 1
        turns.append((role[:1], fault))
    cost, audit = brute_repair(turns)
    out, at, last = [], 0, ""
    due = lambda: "assistant" if last == "u" else "user"
    for x in audit:
        if x == "I":
            out.append((due(), ""))
        else:
            _, _, role, text = rows[at]
            at += 1
            if x == "D":
                continue
            out.append((role if x == "K" else due(), text))
        last = out[-1][0][:1]
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def plain_damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def test_repair_of_odd_rows(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No", "", " \n", None, "Why?", "Long " * 60000 + "!", "é.\x0b"]
    rows = [(rng.choice([*range(40), None]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(texts)) for _ in range(260)]
    # one conversation with a third of all rows, ties and repeated rows among them
    rows += [(7, rng.randrange(40), rng.choice(["user", "assistant"]), rng.choice(texts[:6])) for _ in range(130)]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, head int, digest string")
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair(turn_repair.damage(d)).collect()}
    by = {}
    for r in plain_damage(rows):
        by.setdefault(r[0], []).append(r)
    # exhaustive search is cheap enough: states are (row, role)
    want = {c: plain_conversation(by.get(c, [])) for c in {r[0] for r in rows}}
    assert got == want
    assert turn_repair.repair(turn_repair.damage(d.limit(0))).count() == 0


def test_repaired_turns_are_rows_in_order(spark):
    d = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (2, 0, "assistant", " ")], "conv_id long, turn long, role string, text string")
    planned = turn_repair.plans(d)
    got = sorted(map(tuple, turn_repair.repaired_turns(d, planned).collect()))
    assert [(r["conv_id"], r["audit"], r["cost"]) for r in sorted(planned.collect())] == [(1, "KR", 3), (2, "D", 4)]
    assert got == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Still there?")]


# vector codes
def plain_lloyd(vectors, parts=16, entries=64, rounds=2):
    """Every part against every entry. vectors: (vec_id, components), kept ones."""
    q = [(v, [math.floor(256 * x) for x in c]) for v, c in vectors]
    w = len(q[0][1]) // parts
    cut = [[c[p * w : p * w + w] for p in range(parts)] for _, c in q]
    first = {}
    for (v, c), pieces in sorted(zip(q, cut), key=lambda x: x[0]):
        first.setdefault(v, pieces)
    books = [[first[v][p] for v in sorted(first)[:entries]] for p in range(parts)]

    def near(p, piece):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for pieces in cut:
                members.setdefault(near(p, pieces[p])[1], []).append(pieces[p])
            books[p] = [[sum(x) // len(m) for x in zip(*m)] if (m := members.get(i)) else e for i, e in enumerate(books[p])]
    found = [[near(p, pieces[p]) for p in range(parts)] for pieces in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [("".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for f in found], digest


def test_tree_assigns_like_all_distances():
    rng = np.random.default_rng(1)
    for n in (1, 5, 31, 32, 500, 3000):
        for spread in (1, 6, 400):
            points = rng.integers(-spread, spread + 1, (n, 4))
            entries = np.concatenate([rng.integers(-spread, spread + 1, (20, 4)), points[: min(5, n)], points[: min(5, n)]])
            labels, sums, counts = vector_codes.assign(vector_codes.build(points), entries)
            want = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
            assert (labels == want).all()
            assert (counts == np.bincount(want, minlength=len(entries))).all()
            assert all((sums[i] == points[want == i].sum(axis=0)).all() for i in range(len(entries)))


def test_tree_gives_subtrees_whole(monkeypatch):
    """Most points get their entry from a node, not by a comparison of their own."""
    rng, compared = np.random.default_rng(2), []
    plain = vector_codes._distances
    monkeypatch.setattr(vector_codes, "_distances", lambda p, e: compared.append(len(p)) or plain(p, e))
    centres = rng.integers(-5000, 5000, (64, 4))
    points = np.concatenate([c + rng.integers(-20, 21, (500, 4)) for c in centres])
    tree = vector_codes.build(points)
    vector_codes.assign(tree, centres)
    assert sum(compared) < len(points) / 4


@pytest.mark.parametrize("block", [8192, 40])
def test_codes_against_plain_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    t += [{"vec_id": 3, "embedding": t[3]["embedding"], "label": None}] * 2 + [{"vec_id": 9001, "embedding": t[0]["embedding"], "label": 1}]
    odd = [(9002, None, 1), (9003, [float("nan")] * 64, 1), (9004, [0.5] * 63 + [float("inf")], None), (9005, [None] + [0.5] * 63, 2), (9006, [0.5] * 32, 2), (9007, [], 2)]
    d = spark.createDataFrame([(r["vec_id"], r["embedding"], r["label"], "x", 1) for r in t] + [(*r, None, None) for r in odd], "vec_id long, embedding array<float>, label int, code string, n int")
    want, digest = plain_lloyd([(r["vec_id"], r["embedding"]) for r in t])
    total = {}
    for r, (_, e) in zip(t, want):
        total[r["label"]] = total.get(r["label"], 0) + e
    rows = sorted((r["vec_id"], c, e, total[r["label"]], digest) for r, (c, e) in zip(t, want))
    assert sorted(map(tuple, vector_codes.code_vectors(d).collect())) == rows


def test_codes_of_few_and_no_vectors(spark):
    d = spark.createDataFrame([(None, [0.5] * 16, None), (2, [0.25] * 16, None), (1, [1e30] * 16, 4)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vector_codes.code_vectors(d).collect()}
    assert got == {1: ("00" * 16, 0, 0), 2: ("01" * 16, 0, 0), None: ("02" * 16, 0, 0)}
    assert vector_codes.code_vectors(d.limit(0)).count() == 0


def test_decoding_comes_near(spark):
    rows = vector_codes.kept(spark.read.parquet(f"{SF}/embeddings.parquet"))
    books = vector_codes.train(rows)
    got = vector_codes.decode(vector_codes.encode(rows, books), books).join(rows.select("vec_id", "vector"), "vec_id").collect()
    off = [sum((a - b) ** 2 for a, b in zip(r["approx"], r["vector"])) for r in got]
    assert all(abs(o * 256**2 - r["error"]) <= 2 * 16 * 64 + 2 * r["error"] ** 0.5 * 8 + 64 for o, r in zip(off, got))


@pytest.mark.parametrize("name", ["op11_prefix_tree_join", "op12_turn_repair", "op13_filtering_lloyd"])
def test_queries_have_rows_twice_alike(spark, name):
    runs = [sorted(map(str, queries()[name](spark, SF).collect())) for _ in range(2)]
    assert runs[0] and runs[0] == runs[1]
