"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .cluster import written

# A general lexicon of insults, and second-person words of four languages.
INSULTS = "idiot moron stupid loser pathetic scum worthless trash clown disgusting dumb fool jerk filthy vermin garbage imbecile dimwit hate kill shut ugly liar coward freak creep".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr tu te toi ton vous votre vos tú ti usted ustedes vosotros".split()


@dataclass(frozen=True)
class ToxicityConfig:
    """A model is fitted on at most ``sample`` labelled rows, chosen by a hash of their ids: half teach the
    lexicon, three tenths the trees, two tenths the calibration.  ``terms`` bounds the lexicon."""

    sample: int = 20_000
    terms: int = 4096
    min_documents: int = 4
    min_log_odds: float = 2.5
    prefixes: tuple[int, ...] = (4, 5, 6)
    near: int = 5
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    seed: int = 3


# Letters that stand for others in obfuscated words (fixed values): 0 o, 1 i, 3 e, 4 a, 5 s, 7 t, @ a, $ s, ! i.
_LEET = K.LOWER.copy()
for _a, _b in zip(b"013457@$!", b"oieastasi", strict=True):
    _LEET[_a] = _b
_PLAIN = K.ALNUM.copy()
_PLAIN[0x41:0x5B] = True
_PLAIN[ord("'")] = True
_MASKED = _PLAIN.copy()
_MASKED[list(b"@$!*#")] = True
_UPPER, _DIGIT, _ALPHA, _PUNCT, _BANG, _MARK = (np.zeros(256, bool) for _ in range(6))
_UPPER[0x41:0x5B] = _DIGIT[0x30:0x3A] = True
_ALPHA[0x41:0x5B] = _ALPHA[0x61:0x7B] = _ALPHA[0x80:] = True
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_BANG[list(b"!?")] = True
_MARK[list(b"*#@$")] = True

FEATURES = (
    "insult_density", "insult_count", "term_density", "term_count", "term_weight", "prefix_density", "prefix_count", "prefix_weight", "masked_insult_density",
    "second_person_density", "second_person_near", "capital_rate", "shouted_words", "punctuation_rate", "bang_rate", "mark_rate",
    "digit_in_word_rate", "single_letter_rate", "repeated_letter_rate", "log_words", "mean_word_bytes",
)


@dataclass
class Lexicon:
    """Sorted hashes of learnt words and word beginnings, with their log-odds."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    word_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    start_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _cut_starts(data: np.ndarray, s: np.ndarray, e: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words longer than ``width`` bytes, by number, and hashes of their first ``width`` bytes."""
    long = np.flatnonzero(e - s > width)
    return long, K.hash_spans(data, s[long], s[long] + width, True, 100 + width)


def _found(h: np.ndarray, table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(table) or not len(h):
        return np.zeros(len(h))
    i = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[i] == h, weights[i], 0.0)


_SELF = {}


def _fixed() -> tuple[np.ndarray, np.ndarray]:
    if not _SELF:
        _SELF["insults"] = np.sort(np.concatenate(K.hash_words(INSULTS, _PLAIN)))
        _SELF["you"] = np.sort(np.concatenate(K.hash_words(SECOND_PERSON, _PLAIN)))
    return _SELF["insults"], _SELF["you"]


def features(data: np.ndarray, offs: np.ndarray, lexicon: Lexicon, cfg: ToxicityConfig) -> np.ndarray:
    """A row of dense features for each text; an empty text has zeros."""
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)))
    s, e, row = K.spans(data, offs, _PLAIN)
    per = np.maximum(np.bincount(row, minlength=n), 1) if n else np.zeros(0)
    size = np.maximum(np.diff(offs), 1)
    insults, you = _fixed()
    h = K.hash_spans(data, s, e, True, 1)
    insult = np.isin(h, insults)
    word = _found(h, lexicon.words, lexicon.word_weights)
    begin = np.zeros(len(h))
    for width in cfg.prefixes:
        at, hs = _cut_starts(data, s, e, width)
        begin[at] = np.maximum(begin[at], _found(hs, lexicon.starts, lexicon.start_weights))
    second = np.isin(h, you)
    total = lambda x: np.bincount(row, weights=x, minlength=n) if n else np.zeros(0)
    ms, me, mrow = K.spans(data, offs, _MASKED)
    plain_too = np.isin(ms, s) & np.isin(me, e)
    mh = K.hash_spans(_LEET[data], ms, me, True, 1)
    masked = ~plain_too | (np.diff(np.concatenate([[0], np.cumsum(_DIGIT[data])])[np.stack([ms, me])], axis=0)[0] > 0) if len(ms) else np.zeros(0, bool)
    masked = masked & (np.isin(mh, insults) | (_found(mh, lexicon.words, lexicon.word_weights) > 0))
    hostile = insult | (word > 0) | (begin > 0)
    close = np.concatenate([[0], np.cumsum(hostile)])
    # The words around end with the document's own first and last word.
    begins, ends = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), side="right")
    around = close[np.minimum(np.arange(len(h)) + cfg.near + 1, ends[row])] - close[np.maximum(np.arange(len(h)) - cfg.near, begins[row])]
    running = lambda lut: np.concatenate([[0], np.cumsum(lut[data])])
    inside = lambda lut: (lambda c: c[offs[1:]] - c[offs[:-1]])(running(lut))
    upper, digit, alpha = running(_UPPER), running(_DIGIT), running(_ALPHA)
    letters = np.maximum(alpha[offs[1:]] - alpha[offs[:-1]], 1)
    length = e - s
    repeats = np.zeros(len(data) + 1, np.int64)
    if len(data) > 2:
        three = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _ALPHA[data[2:]]
        repeats[3:] = np.cumsum(three)
    strongest = np.zeros(n)
    np.maximum.at(strongest, row, word)
    strongest_start = np.zeros(n)
    np.maximum.at(strongest_start, row, begin)
    columns = (
        total(insult) / per, total(insult), total(word > 0) / per, total(word > 0), strongest, total(begin > 0) / per, total(begin > 0), strongest_start,
        np.bincount(mrow, weights=masked, minlength=n) / per if n else np.zeros(0),
        total(second) / per, total(second & (around > 0)) / per, (upper[offs[1:]] - upper[offs[:-1]]) / letters,
        total((upper[e] - upper[s] == length) & (length > 2)) / per, inside(_PUNCT) / size, inside(_BANG) / size, inside(_MARK) / size,
        total((digit[e] > digit[s]) & (alpha[e] > alpha[s])) / per, total(length == 1) / per, (repeats[offs[1:]] - repeats[np.minimum(offs[:-1] + 2, offs[1:])]) / size,
        np.log1p(total(np.ones(len(h)))), total(length) / per,
    )
    for i, c in enumerate(columns):
        out[:, i] = c
    return out


@dataclass
class Trees:
    """Boosted trees of fixed depth: feature and cut by node, value by leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        lines = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[lines, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, cfg: ToxicityConfig) -> Trees:
    """Second-order boosting of logistic loss over histograms of quantile bins."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cfg.bins + 1)[1:-1])) for f in range(x.shape[1])]
    # Rare features are zero in most rows, so their quantiles are; cuts of their positive values are added.
    for f in range(x.shape[1]):
        some = x[x[:, f] > 0, f]
        if len(some):
            cuts[f] = np.unique(np.concatenate([cuts[f], [0.0], np.quantile(some, np.linspace(0, 1, 9)[:-1])]))
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    inner = 2**cfg.depth - 1
    score = np.full(len(y), base)
    trees = []
    for _ in range(cfg.trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            here = np.flatnonzero(node == at)
            best = 1e-6
            gs, hs = g[here].sum(), h[here].sum()
            for f, c in enumerate(cuts):
                if not len(c) or len(here) < 20:
                    continue
                b = binned[here, f]
                gl = np.cumsum(np.bincount(b, weights=g[here], minlength=len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, weights=h[here], minlength=len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < 5) | (len(here) - nl < 5)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, feature[at], cut[at] = gain[i], f, c[i]
            node[here] = 2 * at + 1 + (x[here, feature[at]] > cut[at])
        leaf = node - inner
        gsum, hsum = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        value = cfg.rate * gsum / (hsum + 1)
        score = score + value[leaf]
        trees.append((feature, cut, value))
    pick = lambda i: np.stack([t[i] for t in trees])
    return Trees(base, pick(0), pick(1), pick(2), cfg.depth)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of labels on raw scores, by pooling adjacent violators; each pool is
    shrunk a little towards one half, so that no score is taken for certain."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for r, t in zip(raw[order], y[order], strict=True):
        pools.append([t, 1.0, r])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            t2, n2, r2 = pools.pop()
            t1, n1, r1 = pools[-1]
            pools[-1] = [t1 + t2, n1 + n2, (r1 * n1 + r2 * n2) / (n1 + n2)]
    return np.array([p[2] for p in pools]), np.array([(p[0] + 0.01) / (p[1] + 0.02) for p in pools])


@dataclass
class ToxicityModel:
    """A fitted scorer; without trees it gives the share of toxic rows, or 0 without labels."""

    cfg: ToxicityConfig
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, offs = K.flat(texts)
        if self.trees is None:
            return np.full(len(offs) - 1, self.share)
        raw = self.trees.raw(features(data, offs, self.lexicon, self.cfg))
        return np.clip(np.interp(raw, *self.knots) if len(self.knots[0]) else 1 / (1 + np.exp(-raw)), 0.0, 1.0)


def _terms(cfg: ToxicityConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.slices(batch, "text"):
                data, offs = K.flat(b.column("text"))
                s, e, row = K.spans(data, offs, _PLAIN)
                toxic = b.column("toxic").to_numpy(zero_copy_only=False)
                kinds = [(0, np.arange(len(s)), K.hash_spans(data, s, e, True, 1))] + [(w, *_cut_starts(data, s, e, w)) for w in cfg.prefixes]
                for kind, at, h in kinds:
                    pairs = np.unique(np.stack([row[at].astype(np.uint64), h]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
                    r = pairs[0].astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(r), kind), pa.int32()), pa.array(pairs[1].view(np.int64), pa.int64()), pa.array(toxic[r], pa.int64())], names=["kind", "term", "toxic"])

    return run


def _train_rows(lexicon: Lexicon, cfg: ToxicityConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.slices(batch, "text"):
                x = features(*K.flat(b.column("text")), lexicon, cfg)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel(), pa.float64()))
                yield pa.record_batch([b.column("doc_id"), b.column("toxic"), b.column("part"), lists], names=["doc_id", "toxic", "part", "x"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from the labelled rows given (``doc_id, toxic``): those to be held out are left out by the caller.

    Null ids and labels don't count; of several labels of an id the largest counts.
    """
    cfg = config or ToxicityConfig()
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit(cfg.seed), "doc_id"), "doc_id").limit(cfg.sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64(F.lit(cfg.seed + 1), "doc_id"), F.lit(10)))
    sample = written(sample, "labelled")
    teach = sample.where("part < 5")
    n1, n0 = (x or 0 for x in teach.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    lexicon = Lexicon()
    if n1 and n0:
        counts = teach.select("text", "toxic").mapInArrow(_terms(cfg), "kind int, term long, toxic long").groupBy("kind", "term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
        odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (n0 + 1.0))
        top = counts.withColumn("w", odds).where((F.col("t") >= cfg.min_documents) & (F.col("w") >= cfg.min_log_odds)).orderBy(F.desc("t"), "kind", "term").limit(cfg.terms).collect()
        tables = []
        for of in (lambda k: k == 0, lambda k: k > 0):
            some = sorted((int(np.int64(r["term"]).view(np.uint64)), r["w"]) for r in top if of(r["kind"]))
            tables += [np.array([a for a, _ in some], np.uint64), np.array([b for _, b in some], float)]
        lexicon = Lexicon(*tables)
    rows = sample.select("doc_id", "text", "toxic", "part").mapInArrow(_train_rows(lexicon, cfg), "doc_id long, toxic long, part long, x array<double>").where("part >= 5").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    y = rows["toxic"].to_numpy(float)
    share = float(n1 / (n1 + n0)) if n1 + n0 else (float(y.mean()) if len(y) else 0.0)
    grow = rows["part"].to_numpy() < 8 if len(rows) else np.zeros(0, bool)
    if not len(y) or y[grow].min(initial=1) == y[grow].max(initial=0) or grow.sum() < 40:
        return ToxicityModel(cfg, lexicon, None, None, share)
    x = np.stack(rows["x"].to_numpy())
    trees = fit_trees(x[grow], y[grow], cfg)
    calm = ~grow
    knots = isotonic(trees.raw(x[calm]), y[calm]) if calm.sum() >= 40 else (np.zeros(0), np.zeros(0))
    return ToxicityModel(cfg, lexicon, trees, knots, share)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with a column ``score`` of 0 to 1, in one pass without a shuffle.

    A null text scores as the empty one, whose features are zero; an existing ``score`` is replaced.
    Repeated rows score alike, and an empty table stays empty.
    """
    rest = [c for c in docs.columns if c != score_col]
    kept = docs.select(*[F.col(c) for c in rest])
    i = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.slices(batch, text_col):
                yield pa.record_batch([*b.columns, pa.array(model.scores(b.column(i)), pa.float64())], names=[*rest, score_col])

    schema = kept.withColumn(score_col, F.lit(0.0)).schema
    return kept.mapInArrow(run, schema)


def crc_fold(id_column, folds: int = 5):
    """crc32 of an id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds
