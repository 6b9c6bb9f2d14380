"""Every operator and stage on odd tables: nulls anywhere, empty and long texts, ties, repeated rows, clashing names, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm.ann import nearest_neighbours
from loomtext.llm.chat import format_chats
from loomtext.llm.embeddings import embedding_near_duplicates
from loomtext.llm.licenses import scan_licenses
from loomtext.llm.linededup import dedup_lines
from loomtext.llm.minhash import near_duplicates
from loomtext.llm.mixing import mix_sources, take_copies
from loomtext.llm.packing import pack
from loomtext.llm.secrets import scan_versions
from loomtext.llm.toxicity import fit_toxicity, score_toxicity

DATA = "/root/testdata/sf0.001"
#: Names that operators use inside, in either case.
NAMES = (
    "_i _s _n _copy _id _ranges _gone _short _score _key _same id SIZE bucket k n sketch ranges copies rank target source_size taken h1 h2 part leaves ratio whole key node component "
    "vector block blob reader missing spans address n_removed removed score first last content print line words n_words labels matches start length sequence_id offset ids conv calls said result"
).split()
BLOCK = "\n".join(f"line {i} of a passage that stands in many documents" for i in range(8))
TEXTS = [
    (1, "one text with some words in it"), (1, "one text with some words in it"), (1, "quite another text that shares the id of the first"), (2, None), (3, ""), (4, " \n\t "),
    (None, "no id at all"), (None, "no id either"), (None, None), (5, "y" * 2_000_000), (6, "é ü ñ\n" * 30_000), (7, BLOCK), (8, f"a\n{BLOCK}"), (9, f"b\n{BLOCK}\nc"), (2**62, "large"), (2**62 + 1, "large"),
]


def documents(spark):
    rows = [(i, t, None if n % 4 == 3 else "en", None if n % 3 == 2 else f"s{n % 2}", None if t is None else len(t)) for n, (i, t) in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES]).repartition(3)


def ids(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=lambda x: (x is None, x or 0))


ALL = sorted((i for i, _ in TEXTS), key=lambda x: (x is None, x or 0))
OPERATORS = {
    "near_duplicates": near_duplicates, "mix_sources": mix_sources, "dedup_lines": dedup_lines, "scan_licenses": scan_licenses, "scan_versions": lambda d: scan_versions(d)[0],
    "score_toxicity": lambda d: score_toxicity(d, fit_toxicity(d, d.sparkSession.read.parquet(f"{DATA}/labels.parquet"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_every_row(spark, name):
    frame = documents(spark)
    assert ids(OPERATORS[name](frame)) == ALL and OPERATORS[name](frame.limit(0)).count() == 0


def test_own_columns_stay(spark):
    frame = documents(spark)
    done = dedup_lines(frame, added=("cut", "cuts"))
    assert done.columns == [*frame.columns, "cut", "cuts"] and all(r[c] == f"own {c}" for r in done.collect() for c in NAMES)
    assert {r.doc_id: r.cut for r in done.collect() if r.doc_id in (7, 8, 9)} == {7: 0, 8: 8, 9: 8}
    taken = take_copies(frame)
    assert taken.columns == frame.columns and all(r[c] == f"own {c}" for r in taken.collect() for c in NAMES)
    copies = {r.doc_id: r.copies for r in mix_sources(frame).where("doc_id > 1000").collect()}
    assert {i: n for i in copies if (n := taken.where(F.col("doc_id") == i).count())} == {i: n for i, n in copies.items() if n}


def test_pieces(spark):
    assert sorted({(i is None, i or 0) for i in ids(pack(documents(spark)))}) == sorted({(i is None, i or 0) for i in ALL}) and pack(documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    frame = documents(spark)
    out = run(spark, frame, DATA)
    rows = out.collect()
    assert out.columns == frame.columns and all(r[c] == f"own {c}" for r in rows for c in NAMES) and run(spark, frame.limit(0), DATA).count() == 0
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in rows)
    given = sorted((i is None, i or 0, t is None, t or "") for i, t in TEXTS)
    if name == "toxicity":
        assert texts == given
    elif name == "line dedup":
        # Text 6 repeats its own line, of which the first stays, as does the empty last one.
        assert [x for x in texts if x[1] not in (6, 8, 9)] == [x for x in given if x[1] not in (6, 8, 9)] and [r.text for r in rows if r.doc_id == 6] == ["é ü ñ\n"] and [r.text for r in sorted(rows, key=lambda r: r.doc_id or 0) if r.doc_id in (8, 9)] == ["a", "b\nc"]
    elif name == "MinHash near-dedup":
        # One row of the two that repeat id and text goes, both unlike texts of id 1 stay, and of near copies one stays.
        assert sum(r.doc_id == 1 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 3 and sum(r.doc_id in (7, 8, 9) for r in rows) == 1 and sum((r.doc_id or 0) >= 2**62 for r in rows) == 1
        assert len(rows) == len(TEXTS) - 4
    else:
        assert {(r.doc_id, r.text) for r in rows} <= set(TEXTS)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("inf"), 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (8, [], 0), (2**62, [0.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *[F.lit("own").alias(c) for c in NAMES])
    got = embedding_near_duplicates(frame).collect()
    assert len(got) == len(rows) and {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id in (1, 2, 7, 2**62)} == {1: (2, 1), 2: (2, 1), 7: (0, 7), 2**62: (0, 2**62)}
    near = nearest_neighbours(frame, frame.where("vec_id = 1")).collect()
    assert [r.vec_id for r in sorted(near, key=lambda r: r["rank"])] == [2, 7, 2**62]
    assert embedding_near_duplicates(frame.limit(0)).count() == 0 and nearest_neighbours(frame.limit(0), frame.limit(0)).count() == 0


def test_chats(spark):
    rows = [(1, 0, "user", "x" * 2_000_000), (1, None, None, None), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (None, 0, "user", "none"), (2, 0, "assistant", ""), (2**62, 1, "tool", "{}")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("own").alias(c) for c in NAMES])
    got = {r.conv_id: r.n_messages for r in format_chats(frame).collect()}
    assert got == {1: 4, None: 1, 2: 1, 2**62: 1} and format_chats(frame.limit(0)).count() == 0
