"""Operator 8, mixing to target weights: soft membership and fitted rates.

A multinomial classifier, fitted on labelled rows, predicts the probability of
each domain for every document.  Rates r in [0, max_rate], one per document, are
fitted by projected gradient on

    1/2 |G^-1/2 (sum_i r_i n_i p_i - target)|^2 + ridge/2 sum_i n_i (r_i - 1)^2

where n_i are tokens, p_i domain probabilities and G = sum_i n_i p_i p_i'.  A
step needs only the vector of expected domain totals: one aggregate over a narrow
table (tokens and probabilities), and a rate is a fold over the gradients so far,
so no rate is ever shuffled or collected.

Documents that most likely belong to the base domain and whose rate is within
``snap`` of one have rate one, so a confident document is not thinned by the
noise of its probabilities; the fit knows that and moves the others.  Rates
become whole copies by error diffusion: each task carries the tokens by domain
that it owes, and a document gets the whole number next to its rate that leaves
the least debt.  So the copies, not just the rates, meet the targets, up to about
one document a task.

Targets that the rates can't reach (too few labelled rows to tell the domains
apart, say) are missed by the copies as well: :func:`mix_report` has tokens,
targets and what rates and copies reach, and a warning names the domains that
rates miss by over a twentieth.

Edge cases: null and empty texts have no tokens and rate 1; a domain without
labelled rows has probability 0; without labels of two domains every document
belongs to the base domain; an empty table gives an empty result; extra columns
are kept by :func:`mix_sources`.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, keep, let, text_or_empty

DOMAINS = ["good", "poor", "toxic"]
#: Share of the mix by domain.  The base domain is kept whole; the others are cut to their share, never raised.
WEIGHTS = {"good": 0.97, "poor": 0.02, "toxic": 0.01}
FEATURES = 1 << 16
#: Labelled rows that the classifier is fitted on, at most (the only bound that looks at part of a table).
FIT_ROWS = 20_000


#: Standard errors by which a word's share must differ between domains.
LEAST_Z = 5.0


def label_domain() -> Column:
    """Index in DOMAINS of a row of the labels table."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)


def hashed_words(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds n_tokens (words) and _f: the distinct hashed words, in lower case without .,;:!? around them."""
    words = F.filter(F.split(F.lower(text_or_empty(text_col)), SPACE_CLASS + r"|[.,;:!?]"), lambda w: w != "")
    slots = F.array_distinct(F.transform("_words", lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int")))
    rows = docs.withColumn("_words", words).withColumn("n_tokens", F.size("_words").cast("long"))
    return rows.withColumn("_f", slots).drop("_words")


def class_scores(weights: np.ndarray, slots: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of documents whose features are slots[offsets[d]:offsets[d + 1]]; the last column of weights is the bias."""
    out = np.repeat(weights[:, -1:], len(offsets) - 1, axis=1).astype(np.float64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for k in range(len(weights)):
            out[k, full] += np.add.reduceat(weights[k, slots], offsets[full], dtype=np.float64)
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=0))
    return e / e.sum(axis=0)


def telling(slots: np.ndarray, offsets: np.ndarray, label: np.ndarray, classes: int, least: float = LEAST_Z) -> np.ndarray:
    """Which features differ between a class and the rest by ``least`` standard errors: words met by chance in few rows say nothing."""
    owner, n, out = np.repeat(np.arange(len(label)), np.diff(offsets)), len(label), np.zeros(FEATURES, bool)
    every = np.bincount(slots, minlength=FEATURES)
    for k in range(classes):
        inside = label == k
        m = int(inside.sum())
        if 0 < m < n:
            mine = np.bincount(slots, inside[owner], FEATURES)
            share = every / n
            error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / m + 1 / (n - m)))
            out |= np.abs(mine / m - (every - mine) / (n - m)) >= least * error
    return out & (every >= 5)


def fit_classifier(slots: np.ndarray, offsets: np.ndarray, label: np.ndarray, classes: int, rounds: int = 120, rate: float = 0.1, ridge: float = 1e-4) -> np.ndarray:
    """Multinomial logistic regression on binary features, full batches, with moment-scaled steps; classes x (features + bias)."""
    useful = telling(slots, offsets, label, classes)
    used = useful[slots]
    offsets = np.concatenate(([0], np.cumsum(used)))[offsets]
    slots = slots[used]
    weights, first, second = (np.zeros((classes, FEATURES + 1)) for _ in range(3))
    owner, n = np.repeat(np.arange(len(label)), np.diff(offsets)), max(1, len(label))
    for t in range(1, rounds + 1):
        error = softmax(class_scores(weights, slots, offsets))
        error[label, np.arange(len(label))] -= 1
        slope = np.stack([np.append(np.bincount(slots, e[owner], FEATURES), e.sum()) for e in error]) / n + ridge * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights -= rate / (1 + t / rounds) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return weights.astype(np.float32)


def _train(table: pa.Table) -> pa.Table:
    """The labelled rows (FIT_ROWS at most) in one task -> the weights."""
    table = table.sort_by([("_id", "ascending")]).combine_chunks()
    lists = table.column("_f").combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    label = table.column("_label").to_numpy().astype(np.int64)
    weights = fit_classifier(lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0], label, len(DOMAINS))
    for k in set(range(len(DOMAINS))) - set(label.tolist()):  # a domain without labelled rows is never predicted
        weights[k] = 0
        weights[k, -1] = -1e4
    return pa.table({"weights": pa.array([weights.tobytes()], pa.binary())})


def _predict(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            p = softmax(class_scores(weights, lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]))
            flat = pa.array(p.T.ravel())
            cuts = pa.array(np.arange(len(offsets), dtype=np.int32) * len(weights))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(cuts, flat)], names=["_id", "n_tokens", "p"])

    return run


def predict_domains(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, n_tokens, p (array of domain probabilities): a narrow cached table."""
    marked = labels.select(F.col(id_col).alias("_id"), label_domain().alias("_label")).where("_id is not null").groupBy("_id").agg(F.max("_label").alias("_label"))
    # The rows of least hash: a fixed random choice, alike on every run.
    marked = marked.orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS)
    narrow = docs.select(F.col(id_col).alias("_key"), F.col(text_col))
    rows = hashed_words(narrow.join(F.broadcast(marked), F.col("_key") == F.col("_id")), text_col)  # FIT_ROWS rows at most
    found = rows.select("_id", "_label", "_f", F.lit(0).alias("_g")).groupBy("_g").applyInArrow(_train, "weights binary").collect()  # one row of FEATURES numbers per domain
    if found:
        weights = np.frombuffer(found[0]["weights"], np.float32).reshape(len(DOMAINS), -1)
    else:  # nothing is labelled: all documents belong to the base domain
        weights = np.zeros((len(DOMAINS), FEATURES + 1), np.float32)
        weights[1:, -1] = -1e4
    out = hashed_words(docs.select(F.col(id_col).alias("_id"), F.col(text_col)), text_col).select("_id", "n_tokens", "_f")
    kind = docs.schema[id_col].dataType.simpleString()
    return keep(out.mapInArrow(_predict(weights), f"_id {kind}, n_tokens long, p array<double>"))


def targets(totals: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """Token totals by domain: the first domain whole, the others cut to their share beside it."""
    w = np.array([weights[d] for d in DOMAINS])
    scale = totals[0] / w[0] if totals[0] > 0 else totals.sum()
    return np.minimum(totals, w * scale)


def rate_of(gradients: list[np.ndarray], max_rate: float, ridge: float, step: float) -> Column:
    """The rate after projected-gradient steps with these preconditioned gradients, from 1."""
    if not gradients:
        return F.lit(1.0)
    g = F.array(*[F.struct(*[F.lit(float(x)).alias(f"g{k}") for k, x in enumerate(v)]) for v in gradients])

    def move(r: Column, v: Column) -> Column:
        along = sum((F.get("p", F.lit(k)) * v[f"g{k}"] for k in range(len(DOMAINS))), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(max_rate), r - F.lit(step) * (along + F.lit(ridge) * (r - 1))))

    return F.aggregate(g, F.lit(1.0), move)


def dealt(rate: Column, snap: float) -> Column:
    """The rate that copies are dealt by: one for rows without tokens and for those of the base domain within ``snap`` of it."""
    base = F.get("p", F.lit(0)) >= F.array_max("p")
    return F.when((F.col("n_tokens") == 0) | (base & (F.abs(rate - 1) <= snap)), 1.0).otherwise(rate)


def fit_rates(rows: DataFrame, weights: dict[str, float], max_rate: float = 1.0, ridge: float = 1e-3, step: float = 1.0, iterations: int = 25, tolerance: float = 1e-3, snap: float = 0.0) -> tuple[Column, np.ndarray, np.ndarray]:
    """(rate column, totals reached, totals aimed at) over rows of n_tokens and p."""
    size = len(DOMAINS)
    total = lambda r: [F.sum(r * F.col("n_tokens") * F.get("p", F.lit(k))) for k in range(size)]
    gram = [F.sum(F.col("n_tokens") * F.get("p", F.lit(a)) * F.get("p", F.lit(b))) for a in range(size) for b in range(size)]
    first = rows.agg(*[c.alias(f"c{k}") for k, c in enumerate(total(F.lit(1.0)) + gram)]).first()
    numbers = np.array([x or 0.0 for x in first], float)
    now, g = numbers[:size], numbers[size:].reshape(size, size)
    aim = targets(now, weights)
    solve = np.linalg.pinv(g + 1e-9 * np.eye(size) * max(1.0, np.trace(g)))
    gradients: list[np.ndarray] = []
    for _ in range(iterations if now.sum() > 0 else 0):
        if np.abs(now - aim).sum() <= tolerance * aim.sum():
            break
        gradients.append(solve @ (now - aim))
        r = let(rate_of(gradients, max_rate, ridge, step), lambda x: dealt(x, snap))
        now = np.array([x or 0.0 for x in rows.agg(*[c.alias(f"c{k}") for k, c in enumerate(total(r))]).first()], float)
    return let(rate_of(gradients, max_rate, ridge, step), lambda x: dealt(x, snap)), now, aim


def copy_dealer(aim: np.ndarray):
    """(_id, n_tokens, p, rate) -> the same and whole copies, by error diffusion over the rows of a task.

    What is owed counts by domain in shares of its target.  The first fraction
    met is drawn by the hash of the id, so a task with few rows has no leaning.
    """
    scale = 1.0 / np.maximum(aim, 1e-6 * max(aim.sum(), 1.0)) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owed, drawn = np.zeros(len(aim)), set()
        for batch in batches:
            n, rate, chance = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 3, 4))
            p = batch.column(2).flatten().to_numpy().reshape(len(n), -1)
            least = np.floor(rate + 1e-9)
            copies = least.astype(np.int64)
            for i in np.flatnonzero((rate - least > 1e-9) & (n > 0)).tolist():
                tokens, part = n[i] * p[i], rate[i] - least[i]
                kind = int(p[i].argmax())
                if kind not in drawn:
                    drawn.add(kind)
                    more = chance[i] < part
                else:
                    more = ((owed + tokens * (part - 1)) ** 2 * scale).sum() < ((owed + tokens * part) ** 2 * scale).sum()
                owed += tokens * (part - more)
                copies[i] += more
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(copies)], names=["_id", "n_tokens", "p", "rate", "copies"])

    return run


def _mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str, text_col: str, max_rate: float, snap: float) -> tuple[DataFrame, np.ndarray]:
    """(_id, n_tokens, p, rate, copies) of every row, and the totals aimed at."""
    rows = predict_domains(docs, labels, id_col, text_col)
    rate, reached, aim = fit_rates(rows, weights, max_rate, snap=snap)
    missed = [f"{d}: {x:.0f} of {y:.0f}" for d, x, y in zip(DOMAINS, reached, aim, strict=True) if abs(x - y) > 0.05 * max(y, 1.0)]
    if missed:
        logging.getLogger(__name__).warning("rates miss the targets (tokens reached of target): %s", ", ".join(missed))
    chance = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    kind = rows.schema["_id"].dataType.simpleString()
    rows = rows.withColumn("rate", F.round(rate, 6)).select("_id", "n_tokens", "p", "rate", chance.alias("_chance"))
    return rows.mapInArrow(copy_dealer(aim), f"_id {kind}, n_tokens long, p array<double>, rate double, copies long"), aim


def mix_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", max_rate: float = 1.0, snap: float = 0.25) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies of every row."""
    rows, _ = _mixed(docs, labels, weights, id_col, text_col, max_rate, snap)
    shares = [F.round(F.get("p", F.lit(k)), 6).alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return rows.select(F.col("_id").alias("doc_id"), "n_tokens", *shares, "rate", "copies")


def mix_report(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", max_rate: float = 1.0, snap: float = 0.25) -> DataFrame:
    """domain, tokens, target, by_rates, by_copies: expected tokens before the mix, aimed at, and after it."""
    rows, aim = _mixed(docs, labels, weights, id_col, text_col, max_rate, snap)
    total = lambda by, k: F.coalesce(F.sum(by * F.col("n_tokens") * F.get("p", F.lit(k))), F.lit(0.0))
    one = rows.agg(F.array(*[
        F.struct(F.lit(d).alias("domain"), total(F.lit(1.0), k).alias("tokens"), F.lit(float(aim[k])).alias("target"), total(F.col("rate"), k).alias("by_rates"), total(F.col("copies"), k).alias("by_copies"))
        for k, d in enumerate(DOMAINS)
    ]).alias("d"))
    return one.select(F.inline("d"))


def mix_sources(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with all their columns."""
    chosen = mix_rates(docs, labels, id_col=id_col, text_col=text_col, **parameters).where("copies > 0")
    chosen = chosen.groupBy("doc_id").agg(F.max("copies").alias("copies"))
    mark = uuid.uuid4().hex  # names that no column has
    chosen = chosen.toDF(f"id_{mark}", f"copies_{mark}")
    joined = docs.join(chosen, docs[id_col].eqNullSafe(F.col(f"id_{mark}")))
    repeated = F.explode(F.array_repeat(F.lit(0), F.col(f"copies_{mark}").cast("int"))).alias(f"copy_{mark}")
    return joined.select(*[docs[c] for c in docs.columns], repeated).drop(f"copy_{mark}")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_rates(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
