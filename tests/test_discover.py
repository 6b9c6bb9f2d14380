import json

from loomtext.sources import discover as D


def test_discovery(spark):
    repos = json.dumps({"items": [{"html_url": f"https://github.com/o/r{i}", "stargazers_count": i} for i in range(3)]})
    more = json.dumps({"items": [{"html_url": "https://github.com/o/r1"}, {"html_url": None}]})
    a = D.repositories(spark.createDataFrame([("kicad", 1, repos), ("pcb", 1, more)], "topic string, page int, json string"), 2)
    asked = json.dumps({"items": [{"question_id": 5, "score": 3}, {"question_id": 6, "link": "https://x.stackexchange.com/questions/6", "score": -1}]})
    b = D.questions(spark.createDataFrame([("rf", 1, asked)], "tag string, page int, json string"), min_score=0)
    members = json.dumps({"query": {"categorymembers": [{"title": "Op amp"}, {"title": "File:x"}, {"title": "AC/DC"}]}})
    c = D.category_articles(spark.createDataFrame([("en", "Category:Analog", members)], "lang string, category string, json string"))
    rows = {r.url: r for r in D.discover(a, b, c).collect()}
    assert set(rows) == {"https://github.com/o/r0", "https://github.com/o/r1", "https://electronics.stackexchange.com/questions/5", "https://en.wikipedia.org/wiki/Op_amp", "https://en.wikipedia.org/wiki/AC/DC"}
    assert rows["https://github.com/o/r1"].categories == ["pcb", "stars:0"] and rows["https://en.wikipedia.org/wiki/Op_amp"].categories == ["wikipedia:en", "category:analog"]
    assert D.preset_topics(spark).count() == 7 and sum(r.n for r in D.found_by_platform(D.discover(a, b, c)).collect()) == 5
    sub = json.dumps({"query": {"categorymembers": [{"title": "Category:Filters"}]}})
    assert [tuple(r) for r in D.subcategories(spark.createDataFrame([("en", "x", sub)], "lang string, category string, json string")).collect()] == [("en", "Filters")]
