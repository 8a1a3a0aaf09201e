"""Small tests of each operator: brute force, round trips, and the defined results of odd inputs."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm import bpe, chat, jaccard, licenses, mixing, pages, tokenfile, topk, toxicity, vectors
from helixframe.llm import catalog as llm_catalog
from helixframe.llm.words import shingle_sets, word_hashes
from helixframe.plans.components import connected_components
from tests.oracle import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7), (None, "one two three four five six", "en", "b", 0), (5, "word " * 30000, "en", "b", 150000)]


def reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400, x) for x in range(500, 560)] + [(7, 7), (None, 3)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    nodes = set(range(300)) | {400} | set(range(500, 560))
    for node, root in reachable(nodes, [e for e in edges if e[0] is not None]).items():
        assert found.get(node, node) == root
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words():
    texts = ["A b\tc\x0bd  e", "a B c d E", None, "", "x", "ü Ü"]
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [5, 5, 0, 0, 1, 2]
    assert (hashes[:5] == hashes[5:10]).all() and hashes[11] != hashes[12]
    assert [len(s) for s in shingle_sets(texts)] == [1, 1, 0, 0, 1, 1]
    assert len(shingle_sets(["a b c d a b c d a b c d"])[0]) == 4


def brute_jaccard(rows):
    sets = {}
    for i, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, links


@pytest.mark.parametrize("settings", [jaccard.Settings(), jaccard.Settings(common=2, long=3, rows=7), jaccard.Settings(common=1 << 20, long=2, rows=4, least_blocks=3)])
def test_jaccard(spark, settings):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (1, 3, 6, 12, 30, 60):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(18):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.05]) else w for w in base]
            rows.append((n, " ".join(copy[: rng.choice([size, size, max(1, size - 2)])])))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "A  b C d e F g"), (n + 3, "a b\nc D e f G"), (n + 4, "  ")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, component_id string, n long").repartition(3)
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs, settings=settings).collect()}
    sets, links = brute_jaccard(rows)
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    roots = reachable(sets, links)
    assert len(got) == len(rows)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (len(sets[i]), roots[i], degree[i])


def test_jaccard_of_many_groups(spark):
    """Unrelated groups of near copies: all links, and no row meets rows of other groups."""
    rng = random.Random(8)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(40)]
        for _ in range(rng.choice([2, 6, 12])):
            rows.append((len(rows), " ".join(f"x{rng.randrange(5000)}" if rng.random() < 0.02 else w for w in base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs, settings=jaccard.Settings(common=1 << 20, long=3, rows=8, least_blocks=3)).collect()}
    sets, links = brute_jaccard(rows)
    roots = reachable(sets, links)
    assert all(got[i].component_id == roots[i] for i in sets) and sum(r.n_links for r in got.values()) == 2 * len(links)
    hot = spark.createDataFrame([(i, i // 10, 50, 1) for i in range(400)], "id long, group long, n long, size long")
    cells = jaccard._row_blocks(hot, jaccard.Settings(rows=10))
    assert cells.count() == 400 and cells.groupBy("cell").count().count() == 40


def test_jaccard_odd(spark):
    out = jaccard.jaccard_join(spark.createDataFrame(ODD, DOCS)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.n_links) for r in out) == [(-1, 2, None, 0), (1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0), (4, 1, 4, 1), (4, 1, 4, 1), (5, 1, 5, 0)]
    assert jaccard.jaccard_join(spark.createDataFrame([], DOCS)).count() == 0


def test_chat_layouts(spark):
    records = [
        ('{"messages": [{"role": "user", "content": "hi <s> [INST] \\\\ "}, {"role": "assistant", "content": "</s>[/INST]"}], "id": 3}', [("user", "hi <s> [INST] \\ "), ("assistant", "</s>[/INST]")]),
        ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"instruction": "do", "input": "this", "output": "done"}', [("user", "do"), ("user", "this"), ("assistant", "done")]),
        ('{"prompt": "p", "completion": "c", "meta": {"k": [1]}}', [("user", "p"), ("assistant", "c")]),
        ('{"question": "q", "answer": ""}', [("user", "q"), ("assistant", "")]),
        ('{"other": 1}', None), ("no json", None), (None, None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(records)], "id long, record string")
    out = chat.format_records(df, "record").withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    for row in out.collect():
        want = records[row.id][1]
        assert (None if row.turns is None else [tuple(t) for t in row.turns]) == want
        if want:
            assert row.loss == "".join(t for r, t in want if r == "assistant")
            assert row.formatted.count("</s>") == len(want) == row.formatted.count("<s>")
    assert chat.format_records(df.limit(0), "record").count() == 0


def test_chat_mixed_layouts(spark):
    """Records that mix the fields of several layouts lose no text; those without any are counted."""
    records = [
        ('{"prompt": "a", "prompt_id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"prompt": "x", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}', [("user", "x"), ("user", "a"), ("assistant", "b")]),
        ('{"instruction": "do", "input": "this", "output": "done", "system": "s"}', [("system", "s"), ("user", "do"), ("user", "this"), ("assistant", "done")]),
        ('{"question": "q", "answer": "a", "system": "s"}', [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "text": "b"}, {"role": "user", "content": "c", "text": "d"}, {"role": "assistant"}]}', [("user", "a"), ("assistant", "b"), ("user", "c\nd"), ("assistant", "")]),
        ('{"conversations": [{"from": "human", "value": "a"}, {"role": "gpt", "content": "b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"messages": [{"content": "a"}]}', [("", "a")]), ('{"messages": [{"role": "user"}]}', None), ('{"other": 1}', None),
    ]
    out = chat.format_records(spark.createDataFrame([(i, r) for i, (r, _) in enumerate(records)], "id long, record string"), "record").withColumn("turns", chat.read_back(F.col("formatted"))).cache()
    for row in out.collect():
        assert (None if row.turns is None else [tuple(t) for t in row.turns]) == records[row.id][1]
    assert sum(r.n_records for r in chat.unmapped_counts(out).collect()) == 2


def test_chat_table(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "x"), (2, 0, None, "y"), (2, 0, None, "y"), (3, 0, "assistant", "\\<s>\\"), (None, 0, "user", "z")]
    records = chat.collect_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.conv_id: r for r in chat.format_records(records, "record").withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "x"), ("assistant", "")]
    assert [tuple(t) for t in out[2].turns] == [("", "y"), ("", "y")]
    assert [tuple(t) for t in out[3].turns] == [("assistant", "\\<s>\\")]


def test_chat_long_conversations_and_names(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} </s>") for i in range(1500)] + [(2, None, "user", "last"), (2, 0, "assistant", "first"), (None, 0, "user", "x")]
    records = chat.collect_records(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    named = records.select("conv_id", "record", F.lit(1).alias("_chat_record"), F.lit(2).alias("_chat_turns"), F.lit("z").alias("formatted"))
    out = chat.format_records(named, "record").withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    assert got[1].loss == "".join(t for _, _, role, t in rows[:1500] if role == "assistant") and len(got[1].turns) == 1500
    assert [t.text for t in got[2].turns] == ["first", "last"] and (got[1]["_chat_record"], got[1]["_chat_turns"]) == (1, 2) and None in got


def test_mixing_names(spark):
    df = spark.createDataFrame([(i, "a b c", "s" if i % 2 else None, i, i) for i in range(40)], "doc_id long, text string, source string, _mix_target long, _mix_copy long")
    plan = mixing.mixing_plan(df)
    assert plan.columns == [*df.columns, "mix"] and plan.where("_mix_target <> doc_id").count() == 0
    assert mixing.mix_sources(df).columns == df.columns and mixing.mix_sources(df).where("_mix_copy <> doc_id").count() == 0


def test_chat_random_texts(spark):
    rng = random.Random(2)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", " [/INST] ", "\\", "<", "[", "/", "s>", "INST]", "é", "\n", " ", "a", "😀"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "[INST]"]), "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for c in range(80) for t in range(3)]
    out = chat.format_records(chat.collect_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "record")
    out = out.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    for r in out.collect():
        want = [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
        assert [tuple(t) for t in r.turns] == want and r.loss == "".join(t for role, t in want if role == "assistant")


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(6):
            base = rng.standard_normal(16)
            for _ in range(9):
                rows.append((n, (base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2])).tolist(), label))
                n += 1
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [None] * 16, 1), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1), (n + 7, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(i, v, g, "x") for i, v, g in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.vec_id: r for r in vectors.near_duplicates(df, settings=vectors.Tables(block=8)).collect()}
    good = {i: (np.array(v), g) for i, v, g in rows if v and g is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.93]
    roots = reachable([i for i, *_ in rows], links)
    found = sum(r.n_links for r in got.values())
    assert 0.98 * 2 * len(links) <= found <= 2 * len(links)
    assert all(got[i].component_id == roots[i] for i in roots) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def brute_top(rows, k=5, every=50):
    """(query, rank, id, score) from whole numbers; ids that repeat are one query and one candidate, by their best."""
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(256 * x) for x in v)]
    best = {}
    for q, u in whole:
        if q % every == 0:
            for i, v in whole:
                if i != q and len(u) == len(v):
                    score = max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(u, v))))
                    best[q, i] = max(score, best.get((q, i), score))
    out = []
    for q in {q for q, _ in best}:
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted((-s, i) for (p, i), s in best.items() if p == q)[:k])]
    return sorted(out)


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-4, 4, 12) / 8 if i % 3 else np.ones(12) / 4).tolist()) for i in range(240)]
    rows += [(1000, None), (1050, [float("inf")] * 12), (1100, [1.0, None] + [0.0] * 10), (1150, [0.5, 0.5]), (1151, [0.25, 0.5]), (1200, [1e12] * 12)]
    rows += [(50, (rng.integers(-4, 4, 12) / 8).tolist()), (50, (rng.integers(-4, 4, 12) / 8).tolist()), (7, [2.0] * 12), (7, [2.0] * 12), (None, [1.0] * 12), (1250, [1e200] * 12), (1300, [3e305] * 12), (1301, [-1e307] * 12)]
    schema = "vec_id long, embedding array<double>, score string"
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute_top(rows)
    monkeypatch.setattr(topk, "VECTORS", 40)  # leaves, parts and boxes
    monkeypatch.setattr(topk, "QUERIES", 2)
    assert sorted(map(tuple, topk.top_k(df, every=10).collect())) == brute_top(rows, every=10)
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0


def test_topk_of_wide_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(768).tolist()) for i in range(120)] + [(500 + i, (1e9 * rng.standard_normal(768)).tolist()) for i in range(4)]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())) == brute_top(rows)


def test_topk_bounds():
    """Every level leaves the best pairs, and finer ones leave no more pairs."""
    rng = np.random.default_rng(7)
    centres = np.repeat(rng.standard_normal((20, 8)), 8, axis=1)
    x = np.floor(256 * (centres[rng.integers(0, 20, 2000)] + 0.1 * rng.standard_normal((2000, 64))))
    left: dict = {}
    q_ids, ids, scores = topk.top_pairs(x[:50], x, np.arange(50), np.arange(2000), 5, survivors=left)
    exact = x[:50] @ x.T
    exact[np.arange(50), np.arange(50)] = -np.inf
    assert (scores.reshape(50, 5) == -np.sort(-exact, axis=1)[:, :5]).all()
    assert left[2] >= left[8] >= left[32] and left[8] < 0.3 * exact.size


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 60), "en", rng.choice(["a", "a", "a", "b", "é", None]), 0) for i in range(3000)] + [(5000, None, "en", "empty", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.mixing_plan(docs).select("doc_id", "text", "source", "mix.*").collect()
    size = defaultdict(int)
    for r in plan:
        assert r["size"] == len((r.text or "").split())
        size[r.source] += r["size"]
    target = {r.source: r.target for r in plan}
    sources = ["a", "b", "empty", "é", None]
    weight = dict(zip(sources, (5, 2, 1, 5, 2)))
    want, open_ = {}, set(sources)
    while True:  # share by weight, stop the sources above their cap, share again
        level = (1.5 * sum(size.values()) - sum(want.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not above:
            break
        want |= {s: 2 * size[s] for s in above}
        open_ -= above
    want |= {s: level * weight[s] for s in open_}
    assert all(abs(target[s] - want[s]) < 1e-6 for s in sources)
    for s in sources:
        taken = sum(r["size"] * r.copies for r in plan if r.source == s)
        assert abs(taken - target[s]) <= 0.1 * target[s] + 1 and all(r.copies <= 2 for r in plan)
    copies = {r.doc_id: r.copies for r in plan}
    emitted = mixing.mix_sources(docs)
    assert emitted.columns == docs.columns
    counted = {r.doc_id: r["count"] for r in emitted.groupBy("doc_id").count().collect()}
    assert counted == {i: c for i, c in copies.items() if c}
    assert mixing.mixing_plan(docs.limit(0)).count() == 0 and mixing.mixing_plan(docs.withColumn("MIX", F.lit(1))).count() == len(rows)


TEXTS = [None, "", "  ", "Hello world's end, it'll do!\n\n x", "naïve café 漢字 😀́", "a" * 30000, " " * 3000, "<|endoftext|> [x]", "\x00\x1c\x85\xa0", "ΑΣ İ ΟΔΟΣ", "x1y22z", "don't--stop%%% it's."]


def test_bpe(spark):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        pieces = bpe.read_ranks(f.read())
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, IDS string")
    out = bpe.decode(bpe.encode(df, pieces, public_tokenizers.PATTERN), pieces)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    for r in out.collect():
        assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(df.limit(0), pieces, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    rows = [(i * 3 % 13, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (2, "again"), (2, "again")]
    folder, files = tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), model, end_id=2)
    got = [(r.doc_id, r.start, r.ids) for r in tokenfile.read_tokens(spark, folder, files).orderBy("start").collect()]
    tokenizer, start = Tokenizer.from_str(model), 0
    for (key, text), (doc_id, at, ids) in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())), got, strict=True):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (doc_id, at, ids) == (key, start, want)
        start += len(want)
    folder, files = tokenfile.write_tokens(spark.createDataFrame([], "doc_id long, text string"), model, end_id=2)
    assert tokenfile.read_tokens(spark, folder, files).count() == 0


def test_token_query(spark, tmp_path):
    """The registered query's columns, with many files, equal ids and a hot id."""
    texts = ["one two three", "Some WORDS, and more.", "", None, "naïve façade ﬁn"]
    rows = [(i % 70 if i % 3 else 4, texts[i % 5], "x") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, start string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in llm_catalog.QUERIES["op7_token_files"](spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = Tokenizer.from_str(f.read())
    want, start = [], 0
    for key, text, _ in sorted(rows, key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode())):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_huffman():
    rng = np.random.default_rng(7)
    for size, limit in ((1, 20), (2, 20), (300, 20), (3000, 12)):
        counts = np.floor(rng.pareto(0.5, size) + 1).astype(np.int64)
        lengths = tokenfile.code_lengths(counts, limit)
        assert lengths.max() <= limit and (2.0 ** -lengths.astype(float)).sum() <= 1
    ids = [rng.integers(0, 3000, n).astype(np.uint32) for n in (0, 1, 5000, 700)]
    lengths = tokenfile.code_lengths(np.bincount(np.concatenate(ids), minlength=3000))
    keys, back = tokenfile.read_bytes(tokenfile.write_bytes([1, None, 3, 3], ids, lengths))
    assert keys == [1, None, 3, 3] and all((a == b).all() for a, b in zip(ids, back))


def test_pages(spark):
    cases = [
        (None, ""), ("", ""), ("<p>", ""), ("a  b <i>c</i>", "a b c"),
        ("<body><nav><a href=x>m</a></nav><header>top</header><article><h1>T &amp; U</h1><p>One<br>two <b>th</b>ree<p>Four &lt;x&gt;</article><footer>f</footer>", "T & U\nOne two three\nFour <x>"),
        ('<div id="cookie-notice">ok</div><div class="content"><h2>H</h2><p>Some text of some length here.</p><script>var t="</p><p>no";</script><ul><li>a<li>b</ul></div><div class=comments><p>me too</p></div>', "H\nSome text of some length here.\na\nb"),
        ("<article><p>x<!-- <p>no --> y</p><form><p>f</p></form><aside>s</aside>z</article>", "x y\nz"),
        ("1 < 2 <b", "1 < 2 <b"),
        ('<div class="page has-sidebar"><div class="site-header">S</div><div class="entry-header"><h1>T</h1></div><div><p>Text here, and more.</p></div><div class="sidebar">x</div><div class="page-footer">y</div></div>', "T\nText here, and more."),
        ('<div class="widget"><main><p>kept</p></main></div><div id="comments"><article class="comment"><p>gone</p></article></div>', "kept"),
    ]
    df = spark.createDataFrame([(i, h, "t") for i, (h, _) in enumerate(cases)], "page_id long, html string, text string")
    for r in pages.extract_pages(df).collect():
        assert r.text == cases[r.page_id][1] and r.n_chars == len(r.text)
    assert pages.extract_pages(df.limit(0)).count() == 0
    deep = "<div>" * 3000 + "x" + "<p>y"
    assert pages.main_text(deep) == "x\ny"


def test_pages_by_density():
    """Dense siblings, titles and leads outside the core are kept, lists of links are not, even inside main."""
    links = "<div><ul>" + "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(8)) + "</ul></div>"
    text = lambda word: f"<p>{' '.join([word] * 40)}</p>" * 5
    words = lambda page: set(pages.main_text(page).split())
    assert words(f"<body><article>{text('one')}</article><article>{text('two')}</article>{links}</body>") == {"one", "two"}
    assert words(f"<body>{links}<div><h1>Title</h1></div><article>{text('one')}</article></body>") == {"Title", "one"}
    assert words(f"<body>{links}<h1>Title</h1><p>Lead</p><article>{text('one')}</article></body>") == {"Title", "Lead", "one"}
    assert words(f"<main>{links}<section>{text('one')}</section><section><p>end</p></section></main>") == {"one", "end"}


def test_pages_in_doubtful_wrappers():
    """Forms and classes on a wrapper of the page do not empty it; small forms, side parts and long comments go."""
    text = lambda word, n=5: f"<p>{' '.join([word] * 40)}</p>" * n
    words = lambda page: set(pages.main_text(page).split())
    small = '<form class="login"><p>name</p></form><div class="sidebar"><p>side</p></div>'
    assert words(f'<form id="aspnetForm" action="/x"><div><article>{text("one")}</article></div>{small}</form>') == {"one"}
    assert words(f'<form role="form">{text("one")}</form>{small}') == {"one"}
    assert words(f'<div id="page" class="right-sidebar">{text("one")}{small}</div><footer>end</footer>') == {"one"}
    assert words(f'<div class="content sidebar-left"><h1>one</h1>{text("one")}</div>{small}') == {"one"}
    assert words(f'<div class="page comments-open"><h1>one</h1>{text("one")}</div>{small}') == {"one"}
    assert words(f'<div class="comments-open">{text("one")}</div>{small}') == {"one"}
    assert words(f'<div><h1>one</h1>{text("one", 2)}</div><div id="comments">{text("two")}</div>') == {"one"}


def test_pages_inline_and_siblings():
    assert pages.main_text("<p><b>Hello</b>\n<i>world</i></p>") == "Hello world"
    paragraph = "<p>" + "word " * 40 + "</p>"
    assert pages.main_text(f"<article>{paragraph * 5}</article><article>{paragraph * 5}</article>").count("word") == 400
    kept = pages.main_text(f"<article>{paragraph * 5}<blockquote class='share'>a quotation of some words</blockquote><p class='notice-of-intent'>what is intended</p><div class='ad'>buy</div></article>")
    assert "a quotation of some words\nwhat is intended" in kept and "buy" not in kept


@pytest.mark.parametrize("page", ["<div>" * 50000 + "</p>" * 50000, "<a " * 100000, "<i><div>" + "<b>" * 50000 + "</i>" * 50000, "<ul>" + "<li><div>" * 40000, "<!--" * 100000, "<script>" + "</script " * 50000, "<div>" * 50000 + "<p>some words</p>" * 10000])
def test_pages_in_linear_time(page):
    start = time.process_time()
    pages.main_text(page)
    assert time.process_time() - start < 5


def test_densities_by_definition():
    """Counts and densities of random trees, from nested lists and the formula."""
    rng = random.Random(3)

    def make(depth):
        tag = rng.choice(["div", "p", "span", "a"] if depth else ["div"])
        if tag == "p":
            return tag, ["w" * rng.randrange(1, 30)]
        inner = [make(depth + 1) if depth < 4 and tag != "a" and rng.random() < 0.6 else "w" * rng.randrange(1, 30) for _ in range(rng.randrange(1, 5))]
        return tag, inner

    def source(node):
        return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(source, node[1]))}</{node[0]}>"

    def counts(node):
        if isinstance(node, str):
            return len(node), 0, 0, 0
        parts = [(counts(x), not isinstance(x, str)) for x in node[1]]
        c, t, lc, lt = (sum(p[i] for p, _ in parts) + (sum(e for _, e in parts) if i == 1 else 0) for i in range(4))
        return (c, t, c, max(t, 1)) if node[0] == "a" else (c, t, lc, lt)

    def density(node, ratio):
        c, t, lc, lt = counts(node)
        t = max(t, 1)
        inner = c / max(lc, 1) * t / max(lt, 1)
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        log = math.log(max(inner, 1.0))
        return c / t * (log / math.log(base) if base > 1.0000001 else log)

    for _ in range(60):
        tree = ("body", [make(0) for _ in range(3)])
        root = pages.parse("".join(map(source, tree[1])))
        pages.score(root)
        ratio = counts(tree)[2] / counts(tree)[0]
        todo = [(tree, root)]
        while todo:
            mine, node = todo.pop()
            children = [x for x in mine[1] if not isinstance(x, str)]
            assert node.tag == mine[0] and (node.chars, node.tags, node.link_chars, node.link_tags) == counts(mine)
            assert math.isclose(node.total, sum(density(x, ratio) for x in children), abs_tol=1e-9)
            todo += zip(children, [x for x in node.items if isinstance(x, pages.Node)], strict=True)


def test_licenses(spark):
    rng = random.Random(8)
    parts = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC", "under", "the", "cc by", "nc", "Ünder", ". ", "\n", "x"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for i in range(300)] + [(900, None), (901, "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception\nfoo")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        places = [(k, label) for k in range(len(words)) for phrase, label in licenses.BASE_PHRASES.items() if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert got[901].labels == "apache-2.0,gpl-2.0-only,mit" and got[901].permissive is True
    assert licenses.evaluate("mit and (gpl-3.0 or bsl-1.0) rest") == (["mit", "gpl-3.0", "bsl-1.0"], True)
    assert got[901].exceptions == "llvm-exception"
    df = spark.createDataFrame([(1, "The SPDX-License-Identifier is a tag", "a"), (2, "SPDX-License-Identifier: see LICENSE", "b"), (3, "SPDX-License-Identifier: MIT. Then", "c"), (4, "SPDX-License-Identifier: MIT and " * 30000, "d")], "doc_id long, text string, labels string")
    assert [r.labels for r in licenses.scan_licenses(df).orderBy("doc_id").collect()] == ["", "", "mit", "mit"]  # clashing name, in linear time
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    assert licenses.evaluate("mit and gpl-3.0")[1] is False and licenses.evaluate(") x") is None


def test_toxicity(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(2500):
        toxic = i % 8 == 0
        text = [rng.choice(words) for _ in range(40)] + ([rng.choice(["scoundrel", "dolt"]) + "!"] if toxic else [])
        rng.shuffle(text)
        docs.append((i, " ".join(text), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs += [(9001, None, None, None, None), (9002, "", "en", "s", 0)]
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks)
    out = toxicity.score(df, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in out if r.held_out and r.doc_id < 9000]
    assert sum(r.predicted == int(r.doc_id % 8 == 0) for r in held) / len(held) > 0.97
    again = df.select("*", F.lit(0.5).alias("score"), F.lit("x").alias("predicted"))  # clashing names, repeated ids, a long text
    again = again.unionByName(again.limit(50)).unionByName(again.where("doc_id = 8").withColumn("text", F.repeat(F.lit("dolt word "), 200_000)))
    other = toxicity.score(again, toxicity.fit(again, marks.unionByName(marks)))
    assert other.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "score", "predicted"] and other.count() == again.count()
    assert other.where("predicted = 1").count() > 250
    empty = toxicity.fit(df.limit(0), marks.limit(0))
    assert [r.predicted for r in toxicity.score(df.limit(3), empty).collect()] == [0, 0, 0]


def test_odd_rows_pass_everywhere(spark):
    """Null, empty, repeated and long rows, and clashing names, leave every operator with one row per row."""
    df = spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("clash") for c in ("n_words", "labels", "mix", "ids", "score", "predicted")})
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        pieces = bpe.read_ranks(f.read())
    outs = {
        "n_words": licenses.scan_licenses(df), "mix": mixing.mixing_plan(df), "ids": bpe.encode(df, pieces, public_tokenizers.PATTERN), "predicted": toxicity.score(df, model),
    }
    for name, out in outs.items():
        assert out.count() == len(ODD) and out.columns.count(name) == 1 and out.where(F.col(name).cast("string") == "clash").count() == 0
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in ODD)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_registered_queries(spark):
    """The queries that SQL cannot express, over whole tables, against plain Python."""
    table = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    run = lambda name: llm_catalog.QUERIES[name](spark, DATA)
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    sets, links = brute_jaccard(docs)
    roots = reachable(sets, links)
    out = run("op1_ngram_jaccard")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out.collect()} == {(i, len(sets[i]), roots[i]) for i in sets}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        pieces = bpe.read_ranks(f.read())
    coder = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: k for k, p in enumerate(pieces)}, special_tokens={})
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = set()
    for i, text in docs:
        ids = coder.encode(text or "", disallowed_special=())
        want.add((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run("op5_byte_bpe").collect()} == want
    got = run("op6_html_extract")
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in got.collect()} == {(r.page_id, r.url, pages.main_text(r.html), len(pages.main_text(r.html))) for r in table("pages").collect()}
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = Tokenizer.from_str(f.read())
    want, start = set(), 0
    for i, text in sorted(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run("op7_token_files").collect()} == want
    want = set()
    for i, text in docs:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        places = [(k, label) for k in range(len(words)) for phrase, label in licenses.BASE_PHRASES.items() if words[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        want.add((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    out = run("op8_license_scan").collect()
    assert {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out} == want
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)
    out = run("op10_toxicity").collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), "en", f"s{i % 3}", 0) for i in range(200)]
    rows += [(300 + i, rows[i][1] + " tail", "en", "s1", 0) for i in range(30)] + [(7, rows[7][1], "en", "s1", 0), (400, None, "en", None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))
    assert clean.count() == len(rows) and clean.columns == docs.columns
    kept = corpus_pipeline.drop_near_copies(spark, clean, str(tmp_path))
    _, links = brute_jaccard([(r[0], r[1]) for r in rows])
    roots = reachable({r[0] for r in rows}, links)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))
    plan = {r.doc_id: r.mix.copies for r in mixing.mixing_plan(kept).collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, c in plan.items() for _ in range(c))
    text = {r[0]: r[1] for r in rows}
    assert all(r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest() and r.n_tokens == len(r.ids) for r in out)
