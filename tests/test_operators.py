import json

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions.prompts import Prompts
from loomtext.operators import dedup, diff, formats, frontier, generators, merge, pairs, stats
from loomtext.plans import finetune, ingest, postprocess
from loomtext.schema import RECORDS
from loomtext.sources import connectors, html, readers, writers


def records(spark, rows):
    names = ["ordinal", "source_url", "content", "status", "source_type"]
    return spark.createDataFrame([tuple(r) + ("ok", "html")[len(r) - 3 :] if len(r) < 5 else tuple(r) for r in rows], "ordinal long, source_url string, content string, status string, source_type string").select(*names)


def test_duplicates(spark):
    rows = records(spark, [(0, "u0", "same text here"), (1, "u1", "same  text here "), (2, "u2", "other"), (3, "u2?utm_x=1", "third"), (4, "u4", "same text here", "error", "html"), (5, "u5", None)])
    assert [tuple(r) for r in dedup.exact_duplicates(rows).collect()] == [(1, "u0")]
    assert [tuple(r) for r in dedup.url_duplicates(rows).collect()] == [(3, "u2")]
    flagged = {r.ordinal: (r.is_duplicate, r.duplicate_of) for r in dedup.flag_duplicates(rows, images=False).collect()}
    assert flagged == {0: (False, None), 1: (True, "u0"), 2: (False, None), 3: (True, "u2"), 4: (False, None), 5: (False, None)}
    assert tuple(dedup.dedup_stats(dedup.flag_duplicates(rows, minhash=False, images=False)).first()) == (6, 4, 2)


def test_first_wins_is_a_scan_in_order(spark):
    import random

    rng = random.Random(4)
    entries = [(o, rng.randrange(30)) for o in range(60) for _ in range(2)]
    by = {}
    for o, b in entries:
        by.setdefault(o, set()).add(b)
    index, kept = set(), set()
    for o in sorted(by):
        if not by[o] & index:
            kept.add(o)
            index |= by[o]
    removed = {r.ordinal for r in dedup.first_wins(spark.createDataFrame(entries, "ordinal long, bucket long")).collect()}
    assert removed == set(by) - kept


def test_minhash_finds_near_copies(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = records(spark, [(0, "a", base), (1, "b", base + " tail"), (2, "c", " ".join(f"other{i}" for i in range(400)))])
    assert [(r.ordinal, r.keeper) for r in dedup.minhash_duplicates(rows).collect()] == [(1, 0)]


def test_similar_to_earlier_is_the_greedy_scan(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = [" ".join(words[: 4 + i % 5]) + (" x" if i % 3 == 0 else "") for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "ordinal long, prompt string")
    sigs = [r[1] for r in df.select("ordinal", dedup.sha1_signature("prompt", 16)).orderBy("ordinal").collect()]
    kept = []
    for i, s in enumerate(sigs):
        if not any(sum(a == b for a, b in zip(s, sigs[j], strict=True)) / 16 >= 0.5 for j in kept):
            kept.append(i)
    removed = {r.ordinal for r in dedup.similar_to_earlier(df, "prompt", 0.5, 16).collect()}
    assert removed == set(range(20)) - set(kept)


def test_images(spark):
    kind = "array<struct<type:string,local_path:string,sha1:string>>"
    rows = spark.createDataFrame([(0, [("image", "p0", "h")]), (1, [("image", "p1", "h"), ("pdf", "p2", "h")])], f"ordinal long, downloaded_files {kind}")
    got = {r.ordinal: [(f.is_duplicate, f.duplicate_of) for f in r.downloaded_files] for r in dedup.mark_image_duplicates(rows).collect()}
    assert got == {0: [(False, None)], 1: [(True, "p0"), (False, None)]}


def test_pairs(spark):
    rows = [(0, "What is this thing about?", "It is about things, mostly.", "qa"), (1, "What is this thing about?", "It is about things, mostly.", "qa"), (2, "short", "It is about things, mostly.", "qa"), (3, "12345 67890 12345 67890", "It is about things, mostly.", "x")]
    df = spark.createDataFrame(rows, "ordinal long, prompt string, completion string, task_type string")
    assert {r.reason: r.n for r in pairs.rejected_counts(df).collect()} == {"prompt_too_short": 1, "low_alpha_prompt": 1}
    assert sorted(r.ordinal for r in pairs.dedup_pairs(df).collect()) == [0, 2, 3]
    assert sorted(r.ordinal for r in pairs.dedup_pairs(df, keep="last").collect()) == [1, 2, 3]
    assert tuple(pairs.dedup_stats(df).first()) == (4, 3, 1)
    with pytest.raises(ValueError):
        pairs.dedup_pairs(df, "nonsense")


def test_balance_and_split(spark):
    df = spark.createDataFrame([(i, "qa" if i < 100 else "code") for i in range(150)], "ordinal long, task_type string")
    counts = lambda d: {r[0]: r[1] for r in d.groupBy("task_type").count().collect()}
    assert counts(pairs.balance_by_type(df, 30)) == {"qa": 30, "code": 30}
    assert counts(pairs.balance_by_type(df, 70, 60)) == {"qa": 70}
    split = pairs.split_dataset(df, 0.1)
    assert {(r[0], r[1]): r[2] for r in split.groupBy("task_type", "split").count().collect()} == {("qa", "val"): 10, ("qa", "train"): 90, ("code", "val"): 5, ("code", "train"): 45}
    again = pairs.split_dataset(df.repartition(7), 0.1)
    assert sorted(map(tuple, split.select("ordinal", "split").collect())) == sorted(map(tuple, again.select("ordinal", "split").collect()))
    for bad in (0, 1):
        with pytest.raises(ValueError):
            pairs.split_dataset(df, bad)


def test_formats(spark):
    talk = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}, {"role": "user", "content": ""}, {"role": "tool", "content": "t"}]
    df = spark.createDataFrame([(0, "first\nrest", "done", "qa", None, talk), (1, "p", "", "qa", None, None)], "ordinal long, prompt string, completion string, task_type string, source string, conversation array<struct<role:string,content:string>>")
    one = lambda f, **k: json.loads(formats.convert(df, f, **k).first()[0])
    assert formats.convert(df, "jsonl").count() == 1 and one("jsonl") == {"prompt": "first\nrest", "completion": "done", "task_type": "qa"}
    assert one("alpaca") == {"instruction": "first", "input": "rest", "output": "done"}
    assert one("chatml", system="s")["text"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>tool\nt<|im_end|>"
    assert [t["from"] for t in one("sharegpt")["conversations"]] == ["human", "gpt", "human"]
    assert one("llama_factory", system="s")["messages"][0] == {"role": "system", "content": "s"} and "conversation" in one("axolotl")
    assert formats.convert_all(df).count() == 6
    with pytest.raises(ValueError):
        formats.convert(df, "other")


def test_diff(spark):
    schema = "ordinal long, source_url string, content_sha1 string, content string"
    old = spark.createDataFrame([(0, "a", "1", "x"), (1, "b", "2", "y")], schema)
    new = spark.createDataFrame([(0, "a", "9", "z"), (1, "b", "2", "y"), (2, "c", "3", "w")], schema)
    d = diff.diff_corpora(old, new)
    assert d.stats.first().asDict() == {"old_total": 2, "new_total": 3, "added": 2, "removed": 1, "changed": 1}
    assert [r.source_url for r in d.changed.collect()] == ["a"] and "Corpus diff" in diff.render_diff(d.stats.first().asDict(), [r.asDict() for r in d.changed.collect()])


def test_merge(spark):
    rows = [(0, "https://e.com/a?utm_x=1", ["x"]), (1, "https://e.com/a/", ["y"]), (2, "https://e.com/b", None)]
    got = {r.ordinal: r.categories for r in merge.merge_sources(spark.createDataFrame(rows, "ordinal long, url string, categories array<string>")).collect()}
    assert got == {0: ["x", "y"], 2: []}


def test_frontier(spark):
    links = spark.createDataFrame([("http://s/", "http://s/a"), ("http://s/a", "http://s/b"), ("http://s/b", "http://s/c"), ("http://s/", "http://other/"), ("http://s/a", "http://s/#x")], "url string, link string")
    got = {r.url: r.depth for r in frontier.crawl_frontier(spark.createDataFrame([("http://s/",)], "url string"), links, 2).collect()}
    assert got == {"http://s/": 0, "http://s/a": 1, "http://s/b": 2}


THREAD = "# T\n\n## Вопрос\n\nHow does one measure the current here?\n\n## Ответ (score=5)\n\nUse a shunt resistor and measure the voltage across it.\n\n## Ответ (score=2) [ПРИНЯТ]\n\nUse a clamp meter, it measures current without contact."


def test_generators(spark):
    article = "\n\n".join(f"This is the first sentence of paragraph {i}. And more text follows it here." for i in range(20))
    code = "Some words before. This function adds numbers together nicely.\n\n```python\n" + "def add(a, b):\n    return a + b\n" * 3 + "```\n" + "Afterwards there is more to say about this, at some length, so that context suffices."
    faq = "## FAQ\n\nQ: What is the purpose of this device here?\n\nA: It measures things, and does so with care.\n\n"
    meta = json.dumps({"title": "Clamp", "answers": [{"is_accepted": True}], "tags": ["t"]})
    pdf = json.dumps({"toc": [[1, "Op Amp overview", 1], [2, "Limits", 2]], "title": "X"})
    rows = [(0, "u0", article, "html", None), (1, "u1", code, "html", None), (2, "u2", faq, "html", None), (3, "u3", THREAD, "stackexchange", meta), (4, "u4", "x EXTRACTED TABLES | a | b |", "pdf", pdf), (5, "u5", "# Heading one\n" + "text " * 40 + "\n## Heading two\n" + "more " * 40, "html", None)]
    df = spark.createDataFrame(rows, "ordinal long, source_url string, content string, source_type string, metadata string").withColumn("is_duplicate", F.lit(False)).withColumn("status", F.lit("ok")).withColumn("downloaded_files", F.expr("cast(array() as array<struct<type:string,local_path:string,original_file:string>>)"))
    got = {(r.ordinal, r.task_type) for r in generators.extract_pairs(df).collect()}
    assert {(1, "code_to_explanation"), (2, "faq_qa"), (3, "qa_stackexchange"), (4, "datasheet_to_specs"), (4, "datasheet_structure")} <= got
    qa = generators.extract_qa(df).first()
    assert qa.completion == "Use a clamp meter, it measures current without contact." and qa.tags == ["t"]
    made = generators.generate_pairs(df).collect()
    kinds = {(r.ordinal, r.task_type) for r in made}
    assert {(0, "article_summary"), (1, "code_explanation"), (2, "faq_qa"), (3, "qa_stackexchange"), (3, "multi_turn_dialogue"), (4, "datasheet_specs"), (5, "concept_explanation")} <= kinds
    talk = next(r for r in made if r.task_type == "multi_turn_dialogue")
    assert [t.role for t in talk.conversation] == ["user", "assistant"] * 2 and talk.completion.startswith("Use a shunt")
    concept = [r for r in made if r.task_type == "concept_explanation"]
    assert len(concept) == 2 and all("Heading two" not in r.completion for r in concept)
    assert {r.task_type for r in generators.generate_pairs(df, tasks=("faq_qa", "unknown")).collect()} == {"faq_qa"}
    assert Prompts().variations("faq_qa") and sorted(map(str, made)) == sorted(map(str, generators.generate_pairs(df.repartition(3)).collect()))


def test_bom_and_kicad(spark):
    kicad = '(lib_id "Device:R") (property "Reference" "R1") (property "Value" "10k")' + " " * 60
    files = spark.createDataFrame([("p", kicad)], "local_path string, text string")
    df = spark.createDataFrame([(0, "u", "README text. " * 30, "github_repo", [("kicad", "p", "a.kicad_sch")])], "ordinal long, source_url string, content string, source_type string, downloaded_files array<struct<type:string,local_path:string,original_file:string>>")
    assert "| R1 | 10k | Device:R |" in generators.bom_pairs(df, files, Prompts()).first().completion
    assert {r.task_type for r in generators.extract_kicad(df, files).collect()} == {"kicad_to_description", "description_to_kicad"}
    assert generators.kicad_pairs(df, Prompts()).first().completion == "This project contains 1 KiCad schematic files."


def test_pipelines(spark):
    good = "The schematic of this circuit has many parts and each of them matters for the result. " * 5
    df = records(spark, [(0, "a", good), (1, "b", good), (2, "c", "tiny")]).withColumn("language", F.lit("en")).withColumn("metadata", F.lit(None).cast("string"))
    out = postprocess.postprocess(df, postprocess.PostprocessConfig(images=False))
    assert [r.ordinal for r in out["corpus"].collect()] == [0] and {r.reason: r.n for r in out["rejected"].collect()} == {"too_short": 1}
    made = spark.createDataFrame([(i, f"Question number {i} about something?", "An answer that is long enough, a@b.com.", "qa") for i in range(5)], "ordinal long, prompt string, completion string, task_type string")
    stages = finetune.refine(made)
    assert stages["balanced"].count() == 5 and "a@b.com" not in stages["balanced"].first().completion
    assert stats.collapse_warnings(stats.stage_counts(stages)).count() == 0


def test_sources(spark, tmp_path):
    lines = ['{"source_url":"a","content":"x","status":"ok"}', "", "broken", '{"source_url":"b","content":null}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    assert [r.source_url for r in readers.read_jsonl(spark, str(tmp_path / "c.jsonl")).collect()] == ["a", "b"]
    assert [r.source_url for r in readers.read_jsonl(spark, str(tmp_path / "c.jsonl"), with_ordinal=True).orderBy("ordinal").collect()] == ["a", "b"]
    import gzip

    (tmp_path / "packed").write_bytes(gzip.compress("\n".join(lines).encode()))
    assert readers.read_any_jsonl(spark, str(tmp_path / "packed")).count() == 2 and readers.gzip_files(spark, str(tmp_path / "packed")).first().is_gzip
    (tmp_path / "s.csv").write_text("url;type;categories\nhttps://e.com/x.pdf;;a|b\n")
    assert tuple(readers.read_source_csv(spark, str(tmp_path / "s.csv")).first()) == ("https://e.com/x.pdf", "pdf", ["a", "b"])
    deep = spark.createDataFrame([("https://a.b", "2.7", "x,y"), ("ftp://a", "1", ""), ("http://c", "9999", None), ("http://d", "zz", None)], "url string, depth string, categories string")
    assert [(r.url, r.depth) for r in readers.depth_list(deep).collect()] == [("https://a.b", 2), ("http://c", 1000), ("http://d", 0)]
    (tmp_path / "b.html").write_text('<DL><DT><H3>News</H3><DL><DT><A HREF="https://n.com/">N</A></DL></DL>')
    assert tuple(readers.read_bookmarks(spark, str(tmp_path / "b.html")).first()) == ("https://n.com/", "html", ["News"])
    (tmp_path / "map.xml").write_text("<urlset><url><loc>https://s.com/a</loc></url><url><loc>https://s.com/b</loc></url></urlset>")
    assert {r.url for r in readers.read_sitemap(spark, str(tmp_path / "map.xml"), "/a$").collect()} == {"https://s.com/a"}
    with pytest.raises(ValueError):
        connectors.parser_for("nonsense")


def test_html_and_threads(spark):
    page = '<html><head><title>A &amp; B</title></head><body><nav>menu</nav><article><h1>Head</h1><p>Text<script>x()</script></p></article><a href="/in">i</a><a href="#f">f</a><a href="rel">r</a></body></html>'
    df = spark.createDataFrame([("https://e.com/d/p", page)], "url string, html string")
    assert df.select(html.title("html"), html.main_text("html")).first()[:] == ("A & B", "Head\nText")
    assert sorted(r.link for r in html.page_links(df).collect()) == ["https://e.com/d/rel", "https://e.com/in"]
    q = spark.createDataFrame([(1, "u", "T", "<p>Why?</p>", ["a"], 1600000000)], "question_id long, url string, title string, body string, tags array<string>, creation_date long")
    a = spark.createDataFrame([(1, 10, "<p>Because.</p>", 9, False), (1, 11, "<p>Indeed.</p>", 1, True)], "question_id long, answer_id long, body string, score int, is_accepted boolean")
    r = connectors.thread_records(q, a).first()
    assert r.license == "CC BY-SA 4.0" and r.content.index("Indeed.") < r.content.index("Because.") and "[ПРИНЯТ]" in r.content


def test_ingest(spark):
    sources = spark.createDataFrame([(i, f"https://h{i % 2}.com/p{i}", "html") for i in range(6)], "ordinal long, url string, type string")
    state = spark.createDataFrame([("https://h0.com/p0", "done"), ("https://h1.com/p1", "error")], "url string, status string")
    assert ingest.pending_sources(sources, state).count() == 4 and ingest.pending_sources(sources, state, retry_errors=True).count() == 5
    rules = ingest.robots_rules(spark.createDataFrame([("h0.com", 200, "User-agent: *\nDisallow: /p2\nAllow: /p2x"), ("h1.com", 403, "")], "host string, status_code int, body string"))
    assert {r.ordinal for r in ingest.allowed_sources(sources, rules).collect()} == {0, 4}
    assert {r.ordinal for r in ingest.allowed_by_first(sources, rules).collect()} == {0, 2, 4}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("u", "html", "c", "s", None, None, None, None, None, None)], "source_url string, source_type string, content string, content_sha1 string, language string, license string, quality_score double, is_duplicate boolean, categories array<string>, date_accessed string")
    writers.write_parquet(df, str(tmp_path / "p"))
    assert tuple(spark.read.parquet(str(tmp_path / "p")).first()) == ("u", "html", "c", "s", "", "", 0.0, False, [], None)
    writers.write_jsonl(df, str(tmp_path / "j"), gzip=True)
    assert readers.read_jsonl(spark, str(tmp_path / "j"), RECORDS).count() == 1
    assert T.SPACE


def test_depth_lists_follow_each_seed_on_its_own(spark):
    links = [("http://s/", "http://s/a"), ("http://s/a", "http://s/b"), ("http://s/b", "http://s/c"), ("http://s/", "http://other/"), ("http://t/", "http://t/a")] + [("http://m/", f"http://m/{i:03}") for i in range(80)]
    seeds = spark.createDataFrame([("http://s/", 2, 0), ("http://s/b", 1, 1), ("http://t/", 0, 2), ("http://m/", 1, 3), ("http://t/", None, 4)], "url string, depth int, ordinal long")
    got = {r.url: (r.seed, r.depth) for r in frontier.crawl_depth_list(seeds, spark.createDataFrame(links, "url string, link string")).collect()}
    assert {u: got[u] for u in got if "/m/" not in u} == {"http://s/": ("http://s/", 0), "http://s/a": ("http://s/", 1), "http://s/b": ("http://s/", 2), "http://s/c": ("http://s/b", 1), "http://t/": ("http://t/", 0)}
    assert sum("//m/" in u for u in got) == 51 and "http://m/049" in got and "http://m/050" not in got


def test_sitemaps_are_followed_to_their_end(spark):
    entry = lambda tag, *urls: "".join(f"<{tag}><loc>{u}</loc></{tag}>" for u in urls)
    bodies = [("i", entry("sitemap", "i", "m1", "j")), ("j", entry("sitemap", "m2", "gone")), ("m1", entry("url", "p1", "p2&amp;x")), ("m2", entry("url", "p1", "p3"))]
    frame = spark.createDataFrame(bodies, "url string, body string")
    follow = lambda **k: sorted(r.url for r in readers.follow_sitemaps(spark.createDataFrame([("i",)], "url string"), frame, **k).collect())
    assert follow() == ["p1", "p2&x", "p3"] and follow(depth=1) == ["p1", "p2&x"] and follow(max_urls=1) == ["p1"] and follow(pattern="3$") == ["p3"]


def test_bookmarks_of_one_url(spark, tmp_path):
    link = lambda folder, url: f'<DT><H3>{folder}</H3><DL><DT><A HREF="{url}">N</A></DL>'
    for i in range(6):
        (tmp_path / f"{i}.html").write_text("<DL>" + link(f"{i}a", "https://n.com/") + link(f"{i}b", "https://n.com/") + link(f"{i}c", f"https://n.com/{i}.pdf") + "</DL>")
    first = {r.url: (r.type, r.categories) for r in readers.read_bookmarks(spark, str(tmp_path)).collect()}
    assert first == {"https://n.com/": ("html", ["0a"])} | {f"https://n.com/{i}.pdf": ("pdf", [f"{i}c"]) for i in range(6)}
    every = sorted((r.url, r.categories[0]) for r in readers.read_bookmarks(spark, str(tmp_path), every=True).collect())
    assert every == sorted([("https://n.com/", f"{i}{x}") for i in range(6) for x in "ab"] + [(f"https://n.com/{i}.pdf", f"{i}c") for i in range(6)])
