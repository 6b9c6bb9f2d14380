"""Secret scans with an incremental ledger of content-addressed blobs; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import written


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches from the left without overlap; those stay whose ``group`` has ``least`` characters.

    ``hint`` is a pattern that stands in every text with a match and is cheap to look for.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# What each kind of secret looks like.  The order of kinds is the order of equal starts.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)passw|secret|token|api_?key"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"PRIVATE KEY-----"),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, r"xox[abprs]-"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, r"eyJ[A-Za-z0-9_-]{8}"),
)
BASE_KINDS = ("assign", "access", "hex")
_SPAN = "struct<start:int,place:int,end:int,kind:string>"


#: Matches whose positions are summed up in one go; the sums of such blocks are then summed up themselves.
_BLOCK = 128


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, though ``use`` names it inside other lambdas."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule's matches, in code points: the texts between matches tell where each starts.

    Each block of matches is summed up on its own, and then the blocks' sums, so that no growing array
    is copied once for every match.
    """
    # Short runs fail anyway, and dropping them in the pattern keeps a long text's arrays short.
    pattern = rule.pattern if rule.group or rule.least <= 1 else rule.pattern[:-1] + "{%d,}" % (rule.least - len(rule.pattern.partition("[")[0]))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    pieces = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("size"), kept.alias("kept"))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def span(begin: Column, end: Column) -> Column:
        return F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        after = begin + F.coalesce(x["size"], F.lit(0))
        return F.struct(after.alias("at"), F.when(F.coalesce(x["kept"], F.lit(False)), F.concat(acc["found"], F.array(span(begin, after)))).otherwise(acc["found"]).alias("found"))

    def blocks(all_pieces: Column) -> Column:
        last = F.size(all_pieces) - 1
        of = lambda b: F.sequence(b * _BLOCK, F.least(b * _BLOCK + _BLOCK - 1, last))
        return F.transform(F.sequence(F.lit(0), F.floor(last / _BLOCK).cast("int")), lambda b: F.aggregate(of(b), start, lambda acc, i: step(acc, F.get(all_pieces, i))))

    def moved(all_blocks: Column) -> Column:
        begins = F.aggregate(all_blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        shifted = lambda b, by: F.when(by == 0, b["found"]).otherwise(F.transform(b["found"], lambda x: span(x["start"] + by, x["end"] + by)))
        return F.flatten(F.zip_with(all_blocks, F.slice(begins, 1, F.size(all_blocks)), shifted))

    return _let(_let(pieces, blocks), moved)


def blob_id(text: Column) -> Column:
    """A text's content address; null reads as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_versions(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings of every path version, and the ledger's new rows.

    ``paths`` has a row per path and version with its content.  Contents are addressed by SHA-256, and of each only
    the pairs of blob and rule version are scanned that ``ledger`` (``blob, rule, spans``) doesn't have; one row that
    holds the blob is read for that.  Findings, old and new, are joined back to all paths.

    The first result is ``id, blob, spans``: spans sorted by start, then by the rules' order.  A null text
    is an empty blob.  Null and repeated ids are paths like others.  Rules of other versions in the ledger are
    ignored.  An empty table gives empty results; other columns are ignored.
    """
    names = [r.name for r in rules]
    rows = paths.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    addressed = written(rows.select("id", blob_id(F.col("text")).alias("blob")), "paths")
    blobs = addressed.groupBy("blob").agg(F.min("id").alias("reader"))
    if ledger is None:
        unseen = blobs.withColumn("missing", F.array(*[F.lit(n) for n in names]))
    else:
        seen = ledger.where(F.col("rule").isin(names)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        missing = F.array_except(F.array(*[F.lit(n) for n in names]), F.coalesce("seen", F.expr("cast(array() as array<string>)")))
        unseen = blobs.join(seen, "blob", "left").withColumn("missing", missing).where("size(missing) > 0").drop("seen")
    unseen = written(unseen.withColumnRenamed("blob", "address"), "unseen")
    # The small side is the one that is hashed; texts stream past and aren't sorted.
    readers = unseen.hint("shuffle_hash")
    texts = rows.withColumn("blob", blob_id(F.col("text"))).join(readers, (F.col("blob") == F.col("address")) & F.col("id").eqNullSafe(F.col("reader")))
    hints = {r.name: F.col("text").rlike(r.hint) for r in rules}
    found = [
        F.when(F.array_contains("missing", r.name) & hints[r.name], _matches(F.col("text"), r, i)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)")).alias(f"f{i}")
        for i, r in enumerate(rules)
    ]
    scanned = texts.select("blob", "missing", *found).select("blob", "missing", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"f{i}") for i in range(len(rules))])).alias("by_rule"))
    fresh = scanned.select("blob", F.explode("missing").alias("rule"), "by_rule").select("blob", "rule", F.col("by_rule")[F.col("rule")].alias("spans"))
    # A reader that repeats in the table is read as often, so its blob is taken once.
    fresh = written(fresh.groupBy("blob", "rule").agg(F.first("spans").alias("spans")), "ledger")
    known = fresh if ledger is None else fresh.unionByName(ledger.where(F.col("rule").isin(names)).select("blob", "rule", F.col("spans").cast(f"array<{_SPAN}>")))
    hits = known.where("size(spans) > 0").groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    joined = addressed.join(written(hits, "hits"), "blob", "left")
    return joined.select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.expr(f"cast(array() as array<{_SPAN}>)")).alias("spans")), fresh


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
