"""The values of each pipeline stage on small tables, against plain Python on what the stage before it kept."""

import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from factloom.llm import byte_bpe, secret_scan

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def representatives(texts):
    """The smallest id of each group of texts that share 3/4 of their shingles."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        return i if root[i] == i else find(root[i])

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def redacted(text):
    found = sorted((m.start(), n, r.kind, m.end()) for n, r in enumerate(secret_scan.RULES) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least)
    out, at = "", 0
    for start, _, kind, end in found:
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]


def test_stages_by_value(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good, one, clean, safe = ({r["doc_id"]: r["text"] for r in d.collect()} for d in kept[:4])
    assert 0 < len(good) < len(start) and all(start[i] == t for i, t in good.items())
    assert set(one) == representatives(good)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r["text"]]
    assert all(one[i] == t for i, t in clean.items()) and not any(x in (t or "") for t in clean.values() for x in items)
    assert safe == {i: t if t is None else redacted(t) for i, t in clean.items()}
    ranks = {w: n for n, w in enumerate(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r["doc_id"]: list(r["tokens"]) for r in kept[4].collect()} == {i: library.encode_ordinary(t or "") for i, t in safe.items()}
