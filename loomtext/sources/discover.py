"""Sources found by searches: answers of search APIs that were fetched before become rows of the sources relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import detect_source_type, domain
from ..operators.dedup import first_by

# Which files of a repository are of use, and ready-made sets of topics.
REPOSITORY_FILES = ("*.md", "*.kicad_sch", "*.kicad_pcb", "*.csv", "*.dcm", "*.lib")
PRESETS = {
    "electronics_general": (("kicad", "pcb", "embedded", "electronics"), ("kicad", "pcb", "schematic", "embedded"), ("Electronics", "Printed circuit boards", "Electronic circuits"), ("en",)),
    "analog_design": (("analog", "op-amp", "ltspice"), ("analog", "operational-amplifier", "op-amp"), ("Operational amplifiers", "Analog circuits", "Analog electronics"), ("en",)),
    "microcontrollers": (("stm32", "avr", "esp32", "arduino"), ("stm32", "avr", "esp32", "arduino"), ("Microcontrollers", "STM32", "Arduino"), ("en",)),
    "power_electronics": (("power-electronics", "smps", "dc-dc-converter"), ("power-electronics", "smps", "dc-dc"), ("Power electronics", "Switched-mode power supplies", "Voltage regulators"), ("en",)),
    "rf_microwave": (("rf", "antenna", "microwave", "sdr"), ("rf", "antenna", "microwave", "sdr"), ("Radio frequency", "Antennas (radio)", "Microwave technology"), ("en",)),
    "russian_electronics": (("electronics", "kicad"), (), ("Электроника", "Печатные платы", "Радиоэлектроника"), ("ru",)),
    "multilingual_electronics": (("kicad", "pcb", "electronics"), ("kicad", "pcb"), ("Electronics", "Printed circuit boards", "Microcontrollers"), ("en", "ru", "de", "fr")),
}


def preset_topics(spark) -> DataFrame:
    """``name, github_topics, se_tags, wiki_categories, wiki_langs`` of the ready-made sets."""
    kind = "name string, github_topics array<string>, se_tags array<string>, wiki_categories array<string>, wiki_langs array<string>"
    return spark.createDataFrame([(k, *map(list, v)) for k, v in PRESETS.items()], kind)


def _rows(found: DataFrame, url: Column, kind: Column, categories: Column, files: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return found.select(url.alias("url"), kind.alias("type"), categories.alias("categories"), (none if files is None else files).alias("include_files"), "ordinal").where("url is not null and url <> ''")


def _capped(found: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    place = Window.partitionBy(group).orderBy(*order)
    return found.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= n).drop("_rank")


def repositories(answers: DataFrame, max_repos: int = 50) -> DataFrame:
    """Repositories of topic searches (``topic, page, json``), the first so many of each topic."""
    items = F.from_json("json", "items array<struct<html_url:string,stargazers_count:long>>")["items"]
    found = answers.select("topic", "page", F.posexplode(items).alias("place", "i")).where("i.html_url is not null")
    found = _capped(found, "topic", ["page", "place"], max_repos).withColumn("ordinal", F.col("page") * 1000 + F.col("place"))
    stars = F.concat(F.lit("stars:"), F.coalesce("i.stargazers_count", F.lit(0)).cast("string"))
    return _rows(found, F.col("i.html_url"), F.lit("github_repo"), F.array("topic", stars), F.array(*[F.lit(g) for g in REPOSITORY_FILES]))


def questions(answers: DataFrame, site: str = "electronics", max_questions: int = 100, min_score: int | None = None) -> DataFrame:
    """Questions of tag searches (``tag, page, json``), the first so many of each tag."""
    items = F.from_json("json", "items array<struct<question_id:long,link:string,score:int>>")["items"]
    found = answers.select("tag", "page", F.posexplode(items).alias("place", "q")).where("q.question_id is not null")
    if min_score is not None:
        found = found.where(F.coalesce("q.score", F.lit(0)) >= min_score)
    found = _capped(found, "tag", ["page", "place"], max_questions).withColumn("ordinal", F.col("page") * 1000 + F.col("place"))
    link = F.coalesce("q.link", F.concat(F.lit(f"https://{site}.stackexchange.com/questions/"), F.col("q.question_id").cast("string")))
    return _rows(found, link, F.lit("stackexchange"), F.array("tag", F.concat(F.lit("score:"), F.coalesce("q.score", F.lit(0)).cast("string"))))


def _quoted(title: Column) -> Column:
    """As part of a path: slashes stay, and so do ``_.-~``."""
    coded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, char in (("%2F", "/"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(char))
    return F.replace(coded, F.lit("*"), F.lit("%2A"))


def category_articles(answers: DataFrame, max_articles: int = 100) -> DataFrame:
    """Articles of encyclopedia categories (``lang, category, json``), the first so many of each; other name spaces are left out."""
    members = F.from_json("json", "query struct<categorymembers:array<struct<title:string>>>")["query"]["categorymembers"]
    rows = answers.select("lang", F.trim(F.regexp_replace("category", "^(?:Category|Категория):", "")).alias("category"), F.posexplode(members).alias("ordinal", "m"))
    rows = rows.where("m.title <> ''").where(~F.col("m.title").rlike("^(?:Category|File|Template|Wikipedia):")).withColumn("_group", F.concat_ws("|", "lang", "category"))
    rows = _capped(rows, "_group", ["ordinal"], max_articles)
    url = F.concat(F.lit("https://"), F.col("lang"), F.lit(".wikipedia.org/wiki/"), _quoted(F.col("m.title")))
    return _rows(rows, url, F.lit("html"), F.array(F.concat(F.lit("wikipedia:"), F.col("lang")), F.concat(F.lit("category:"), F.lower("category"))))


def subcategories(answers: DataFrame, limit: int = 10) -> DataFrame:
    """``lang, category`` of the first subcategories that answers (``lang, category, json``) name: the next level's searches."""
    members = F.slice(F.from_json("json", "query struct<categorymembers:array<struct<title:string>>>")["query"]["categorymembers"], 1, limit)
    return answers.select("lang", F.explode(members).alias("m")).select("lang", F.trim(F.regexp_replace("m.title", "^(?:Category|Категория):", "")).alias("category")).distinct()


def literal_seeds(seeds: DataFrame) -> DataFrame:
    """URLs given as they are (``url, ordinal``)."""
    return _rows(seeds, F.col("url"), detect_source_type("url"), F.expr("cast(array() as array<string>)"))


def discover(*found: DataFrame) -> DataFrame:
    """All that was found, in the order of the searches given, each URL where it came first: by search, page and place."""
    parts = [df.withColumn("_part", F.lit(i)) for i, df in enumerate(found)]
    union = reduce(DataFrame.unionByName, parts).withColumn("_order", F.struct("_part", "ordinal", F.array_join("categories", ",")))
    return first_by(union, F.col("url"), order="_order").drop("_part", "_order")


def found_by_platform(sources: DataFrame) -> DataFrame:
    """Sources by type and domain."""
    return sources.groupBy("type", domain("url").alias("domain")).agg(F.count("*").alias("n"))
