import json
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomtext.llm import textkit as K
from loomtext.llm.ann import AnnConfig, Index, fit_index, nearest_neighbours
from loomtext.llm.chat import ChatConfig, canonical_json, format_chats
from loomtext.llm.embeddings import EmbeddingConfig, cosine_bounds, embedding_near_duplicates, integer_products, quantise
from loomtext.llm.toxicity import FEATURES, INSULTS, Lexicon, ToxicityConfig, crc_fold, features, fit_toxicity, fit_trees, isotonic, score_toxicity

DATA, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
KIND = "vec_id long, embedding array<float>, label int, id long, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label, 1, 0.0) for i, v, label in rows], KIND).repartition(3)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for n, d in ((200, 32), (60, 1041), (20, 9000)):
        x = rng.normal(size=(n, d)) * rng.uniform(0.1, 10, (n, 1))
        x[1] = x[0] * 3
        part = quantise(x)
        products = integer_products(part[0], part[0])
        assert (products == part[0].astype(np.int64) @ part[0].astype(np.int64).T).all()
        low, high = cosine_bounds(part, part)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        exact = unit @ unit.T
        assert (high >= exact).all() and (low <= exact).all() and (high - low).max() < 0.1


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 24))
    rows = [(i, centres[i % 6] + rng.normal(size=24) * rng.choice([0.0, 0.2, 0.3]), i % 2) for i in range(240)]
    rows += [(300, None, 0), (301, [0.0] * 24, 0), (302, [float("nan")] * 24, 0), (303, [None] * 24, 0), (304, centres[0], None), (305, centres[0] * 3, 0), (306, centres[0][:5], 0), (None, centres[0], 0)]
    got = embedding_near_duplicates(vectors(spark, rows), EmbeddingConfig(block=50)).collect()
    assert len(got) == len(rows)
    good = [(i, np.asarray(v, np.float32).astype(float), l) for i, v, l in rows if v is not None and l is not None and i is not None and len(v) == 24 and None not in list(v) and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float))]
    parent, n = {i: i for i, _, _ in good}, dict.fromkeys((i for i, _, _ in good), 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, u, l1) in enumerate(good):
        for j, v, l2 in good[a + 1 :]:
            if l1 == l2 and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93:
                n[i] += 1
                n[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    for r in got:
        assert (r.n_links, r.component_id) == ((n[r.vec_id], find(r.vec_id)) if r.vec_id in n else (0, r.vec_id))
    assert max(n.values()) > 5 and embedding_near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16), 0) for i in range(1500)] + [(2000 + i, np.ones(16), 0) for i in range(60)] + [(3000, None, 0), (3001, [0.0] * 16, 0), (None, np.ones(16), 0), (3002, np.ones(3), 0)]
    frame = vectors(spark, rows)
    got = nearest_neighbours(frame, frame.where("vec_id % 20 = 0"), AnnConfig(list_rows=64, shard_rows=300, query_rows=20)).collect()
    x = {i: np.asarray(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and np.any(v)}
    hit = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in x if i % 20 == 0}
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 for r in found)
        best = sorted((i for i in x if i != q), key=lambda i: (-round(float(x[q] @ x[i]), 9), i))[:20]
        hit, total = hit + len({r.vec_id for r in found} & set(best)), total + 20
    assert hit / total >= 0.9
    assert [r.vec_id for r in by[2000]][:5] == [i for i in sorted(x, key=lambda i: (-round(float(x[2000] @ x[i]), 9), i)) if i != 2000][:5]
    few = nearest_neighbours(frame.where("vec_id < 5"), frame.where("vec_id = 0")).collect()
    assert len(few) == 4 and nearest_neighbours(frame.limit(0), frame).count() == 0


def test_lists_are_balanced():
    rng = np.random.default_rng(5)
    # Half of the vectors are in one dense spot, and a few far away.
    x = np.concatenate([rng.normal(size=(2000, 12)) * 0.05 + 1, rng.normal(size=(1900, 12)), rng.normal(size=(100, 12)) * 6])
    index = fit_index(x, 40_000, float((x**2).sum(axis=1).max()), AnnConfig(list_rows=500))
    held = [lists[0] for lists in index.lists(x, 1.0, 1)]
    sizes = np.bincount(held, minlength=len(index.centroids))
    assert isinstance(index, Index) and len(sizes) >= 60 and sizes.max() <= 3 * sizes.mean() and sizes.min() > 0


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [r for r in table.collect() if r.embedding is not None]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    good = np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)
    ids, x = ids[good], x[good]
    found = {}
    for r in nearest_neighbours(table, table.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hit, total = hit + len(found[int(ids[q])] & set(best.tolist())), total + len(best)
    assert hit / total >= 0.9


def test_isotonic_and_trees():
    knots, values = isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    raw = fit_trees(x, y, ToxicityConfig(trees=30)).raw(x)
    assert ((raw > 0) == y).mean() > 0.95


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet")
    model = fit_toxicity(docs, labels.where(crc_fold(F.col("doc_id")) != 0))
    odd = spark.createDataFrame([(-1, None, 0.1), (-2, "", 0.1), (-3, "x" * 500_000, 0.1), (-3, "you stupid idiot", 0.1)], "doc_id long, text string, score double")
    scored = score_toxicity(docs.select("doc_id", "text").unionByName(odd, allowMissingColumns=True), model)
    rows = scored.join(labels, "doc_id").where(crc_fold(F.col("doc_id")) == 0).collect()
    hits = sum(r.score >= 0.5 and r.toxic == 1 for r in rows)
    assert hits >= 0.8 * sum(r.toxic == 1 for r in rows) > 0 and hits >= 0.8 * sum(r.score >= 0.5 for r in rows)
    bad, fine = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert sum((b > f) + 0.5 * (b == f) for b in bad for f in fine) > 0.95 * len(bad) * len(fine)
    assert all(0 <= r.score <= 1 for r in scored.collect()) and scored.count() == docs.count() + 4
    same = fit_toxicity(docs.repartition(5), labels.where(crc_fold(F.col("doc_id")) != 0)).scores(pa.array(["you stupid idiot", None]))
    assert np.allclose(same, model.scores(pa.array(["you stupid idiot", None])))


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(docs, fit_toxicity(docs, none)).first().score == 0.0 and score_toxicity(docs.limit(0), fit_toxicity(docs.limit(0), none)).count() == 0


def test_features_are_of_one_document_alone():
    bad = INSULTS[0]
    texts = [f"you {bad}", f"a b c {bad}", "you a b c d e f g", f"{bad} a b c d e f g you", "", f"a b c you d {bad}", "you", bad]
    of = lambda some: features(*K.flat(pa.array(some, pa.string())), Lexicon(), ToxicityConfig())
    together = of(texts)
    assert np.array_equal(together, np.concatenate([of([t]) for t in texts])) and np.array_equal(together[::-1], of(texts[::-1]))
    assert (together[:, FEATURES.index("second_person_near")] > 0).tolist() == [True, False, False, False, False, True, False, False]


def test_chats(spark):
    call = lambda i, name, args: {"id": i, "name": name, "arguments": args}
    calls = json.dumps({"tool_calls": [call("b", "add", '{"y": {"$ref": "a"}, "x": 1}'), call("a", "get", '{"key":"k"}'), call("c", "get", '{"other":1}'), call("l", "get", '{"key":{"$ref":"l"}}')]})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", calls), (1, 2, "tool", '{"tool_call_id":"b","content":"3"}'), (1, 3, "tool", '{"tool_call_id":"a","content":"2"}'), (1, 4, "tool", '{"tool_call_id":"zz","content":"?"}'), (1, 5, "assistant", None), (2, None, None, ""), (None, 0, "user", "x"), (2, 1, "assistant", "{not json"), (2, 1, "assistant", "{not json")]
    cfg = ChatConfig({"add": {"x": "number", "y": "object"}, "get": {"key": "string"}}, {"get": ("key",)})
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), cfg).collect()}
    r = got[1]
    assert (r.n_messages, r.n_calls, r.n_linked, r.n_orphans, r.n_unordered) == (9, 4, 2, 1, 1) and r.n_invalid == 2
    chat = json.loads(r.chat)
    order = [m.get("id") or m.get("tool_call_id") or m["role"] for m in chat]
    assert order == ["user", "a", "a", "c", "b", "b", "l", "zz", "assistant"]
    assert chat[4]["arguments"] == '{"x":1,"y":{"$ref":"a"}}' and all(list(m) == sorted(m) for m in chat)
    assert got[2].n_messages == 3 and got[None].n_messages == 1
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_calls_wait_for_later_turns(spark):
    early = json.dumps({"tool_calls": [{"id": "x", "name": "f", "arguments": '{"v":{"$ref":"y"}}'}]})
    late = json.dumps({"tool_calls": [{"id": "y", "name": "f", "arguments": "{}"}]})
    rows = [(1, 0, "assistant", early), (1, 1, "user", "wait"), (1, 2, "assistant", late)]
    chat = json.loads(format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first().chat)
    assert [m.get("id", m["role"]) for m in chat] == ["user", "y", "x"]


def test_long_chains_of_calls(spark):
    n = 3000
    call = lambda i, ref: json.dumps({"tool_calls": [{"id": f"c{i}", "name": "f", "arguments": json.dumps({"v": {"$ref": f"c{ref}"}} if ref < n else {})}]})
    rows = [(1, i, "assistant", call(i, i + 1)) for i in range(n)] + [(2, 0, "assistant", call(0, 1)), (2, 1, "assistant", call(1, 0)), (2, 2, "assistant", call(2, 1))]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    assert [m["id"] for m in json.loads(got[1].chat)] == [f"c{i}" for i in reversed(range(n))] and (got[1].n_unordered, got[2].n_unordered) == (0, 3)


def test_calls_that_share_an_identifier_all_stay(spark):
    said = lambda text, *calls: json.dumps({"content": text, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})
    result = lambda i, text: json.dumps({"tool_call_id": i, "content": text})
    twice = said(None, ("d", "h", "{}"))
    rows = [
        (1, 0, "assistant", said("I look.", ("call_1", "f", '{"a":1}'))), (1, 1, "tool", result("call_1", "first")), (1, 2, "user", "and?"),
        (1, 3, "assistant", said("", ("call_1", "g", '{"b":2}'), ("call_2", "g", '{"v":{"$ref":"call_1"}}'))), (1, 4, "tool", result("call_1", "second")), (1, 5, "tool", result("call_2", "third")),
        (1, 6, "assistant", said(None, ("call_1", "f", '{"v":{"$ref":"call_1"}}'))), (1, 7, "assistant", '{"content":"none","tool_calls":[null]}'),
        (2, 0, "tool", result("d", "early")), (2, 1, "assistant", twice), (2, 1, "assistant", twice), (2, None, "tool", result("d", "null")),
        (3, None, "assistant", twice), (3, None, "assistant", twice), (3, None, "tool", result("d", "null")),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in format_chats(frame).collect()}
    chat = [m.get("content", m.get("arguments")) for m in json.loads(got[1].chat)]
    assert chat == ["I look.", '{"a":1}', "first", "and?", "", '{"b":2}', "second", '{"v":{"$ref":"call_1"}}', "third", '{"v":{"$ref":"call_1"}}', '{"content":"none","tool_calls":[null]}']
    assert (got[1].n_messages, got[1].n_calls, got[1].n_linked, got[1].n_orphans, got[1].n_unordered) == (11, 4, 3, 0, 0)
    assert (got[2].n_messages, got[2].n_calls, got[2].n_linked, got[2].n_orphans) == (4, 2, 2, 0)
    assert [m.get("content", "call") for m in json.loads(got[2].chat)] == ["call", "null", "early", "call"]
    assert [m.get("content", "call") for m in json.loads(got[3].chat)] == ["call", "call", "null"]


def test_chats_keep_every_message(spark):
    table = spark.read.parquet(f"{DATA}/conversations.parquet")
    got = {r.conv_id: r for r in format_chats(table).collect()}
    want = {}
    for r in table.orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append({"content": r.text, "role": r.role})
    assert {k: json.loads(v.chat) for k, v in got.items()} == want


def test_canonical_json(spark):
    rng = random.Random(0)
    value = {f"k{i}": rng.choice([1, 2.5, "é", None, True, [1, {"b": 1, "a": 2}]]) for i in range(20)}
    text = json.dumps(value)
    got = spark.createDataFrame([(text,)], "t string").select(canonical_json(F.col("t"))).first()[0]
    assert json.loads(got) == value and spark.createDataFrame([("{",)], "t string").select(canonical_json(F.col("t"))).first()[0] is None


def test_op4_checks_calls_against_tools_of_the_conversation(spark, tmp_path):
    from loomtext.llm.queries import op4_chat_format

    add = {"name": "add", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}, "a.b": {"type": ["string", "null"]}, "any": {}}, "required": ["x"]}}
    tools = json.dumps({"content": "be kind", "tools": [add, None, {"type": "function", "function": {"name": "free"}}]})
    args = ['{"x":1}', '{"x":1,"a.b":null,"any":[1]}', '{"x":"1"}', '{"a.b":"k"}', '{"x":1,"other":2}', '{"x":1,"a.b":2}', "[1]", '{"x":{"$ref":"c0"}}', None]
    say = lambda turn, i, name, a: (turn, "assistant", json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": a}]}))
    talk = [say(i + 2, f"c{i}", "add", a) for i, a in enumerate(args)] + [say(20, "f", "free", '{"z":1}'), say(21, "u", "none", "{}"), say(22, "n", None, "{}"), (23, "tool", '{"tool_call_id":"c0","content":"r"}')]
    rows = [(c, *m) for c in (1, 2, None) for m in [(0, "system", tools if c != 2 else "be kind"), *talk]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op4_chat_format(spark, str(tmp_path)).collect()}
    assert {k: (r.n_messages, r.n_calls, r.n_linked, r.n_invalid) for k, r in got.items()} == {1: (14, 12, 1, 9), None: (14, 12, 1, 9), 2: (14, 12, 1, 2)}
    chat = json.loads(got[1].chat)
    assert chat[0] == {"content": tools, "role": "system"} and [m.get("id", m.get("tool_call_id")) for m in chat[1:4]] == ["c0", "c0", "c1"]
