"""Mixing documents to target weights of domains, with soft membership. DataFrame functions only.

A classifier learned from the labelled rows gives each document a probability of each domain: naive Bayes
over quantised measures of the text, one of which counts marker words (the words that speak most for a
domain among labelled rows). Documents then get rates r >= 0 whose expected totals of tokens by domain,
sum of r * tokens * P(domain), are the targets in the sense of least squares.

The rates are fitted by projected gradient: all begin at 1; a step takes r to max(0, r - s * P . W e), where e are the
missed totals: P . W e is the gradient of e . W e / 2 in the metric weighted by tokens. W weighs the domains' misses by
the inverse of their Gram matrix, so that a rare domain counts as much as a frequent one; in the first ``following``
steps the matrix is that of the rates above 0, later that of all, which then defines what is least. Documents of equal
measures have equal probabilities and so equal rates: they are one cell, pre-aggregated, and a step is one aggregation
over the cells. A step that leads away is shortened, down to a length that can't; later steps have Barzilai and Borwein's. The same steps,
with rates of 0 to 1 and P - targets for P, fit shares of what is kept (``whole``). Only these few sums, the counts of
measures and the markers reach the driver; rates reach the documents by a join on the cell. The classifier learns from a
bounded sample of labelled rows (``Settings.sample``); totals and cells cover all documents, whose texts are read once.

Defined cases: null text has no tokens; without labelled rows every document has rate 1; domains without
labelled rows drop out and the other targets are scaled to sum to 1; targets that can't be met are approached as
far as the bounds of r allow; repeated rows each get their row (and, as copies are drawn by doc_id, the same number);
null doc_id is a key like any other; an empty table gives no rows. Columns named like the output are replaced, others
pass through."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.runtime import cut, discard

BLANK = r"[\x20\x09-\x0D]+"
#: Buckets of each measure (four bits of a cell), and how many measures there are.
BUCKETS, MEASURES = 16, 8
#: Columns of our own, beside those of the documents.
CELL, TOKENS, WORDS, OF_CELL, RATES = (f"__mixing_{x}" for x in ("cell", "tokens", "words", "of_cell", "rates"))


@dataclass(frozen=True)
class Settings:
    markers: int = 256
    least_rows: int = 20  # labelled rows that a marker stands in, at least
    sample: int = 20_000  # labelled rows that the classifier learns from, by a hash of doc_id
    steps: int = 100
    following: int = 25  # of these, the first ones whose weights follow the rates that are above 0
    tolerance: float = 1e-9
    replayed: int = 10  # steps, after which rates are written
    broadcast_cells: int = 1 << 19  # above that many cells (some 40 MB) rates are joined by a shuffle


@dataclass
class Classifier:
    domains: list[str]
    prior: list[float]  # log
    logs: list[list[list[float]]]  # domain, measure, bucket
    markers: list[int]


def _words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), lambda w: w != "")


def _measures(df: DataFrame, text: str, markers: list[int]) -> DataFrame:
    """``df`` with the number of tokens and the cell: the quantised measures, four bits each."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(WORDS, _words(text)).withColumn(TOKENS, F.size(WORDS).cast("long"))
    n, size = F.greatest(TOKENS, F.lit(1)), F.greatest(F.length(body), F.lit(1))
    lines = F.split(body, "\n")

    def share(part: Column, of: Column, scale: float) -> Column:
        return F.floor(part / of * scale)

    def without(pattern: str) -> Column:
        """Characters that the pattern takes away: it names the rare ones, which are quick to cut out."""
        return F.length(body) - F.length(F.regexp_replace(body, pattern, ""))

    hits = F.size(F.array_intersect(F.transform(WORDS, lambda w: F.xxhash64(w)), F.array(*map(F.lit, markers)))) if markers else F.lit(0)
    measures = [
        F.floor(F.log2(n)),
        share(F.size(F.array_distinct(WORDS)), n, 10),
        share(without(r"[^\p{L}\p{N}\s]+"), size, 40),
        share(without("[A-Z]+"), size, 40),
        share(without("[0-9]+"), size, 40),
        F.floor(size / n),
        share(F.size(F.array_distinct(lines)), F.size(lines), 10),
        hits,
    ]
    cell = F.lit(0).cast("long")
    for k, measure in enumerate(measures):
        cell = cell + F.shiftleft(F.least(measure.cast("long"), F.lit(BUCKETS - 1).cast("long")), 4 * k)
    return df.withColumn(CELL, cell).drop(WORDS)


def _bucket(measure: int) -> Column:
    return F.shiftright(F.col(CELL), 4 * measure).bitwiseAND(BUCKETS - 1).cast("int")


def train(docs: DataFrame, labels: DataFrame, domain: str, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> Classifier:
    """Learn from a bounded sample of labelled rows, drawn by a hash of ``doc_id``. ``domain``: SQL for the name of a
    label row's domain (null: teaches nothing). The sample's ids are broadcast (``sample`` rows at most), and its
    texts written once; words of other documents are not looked at, and no text is shuffled."""
    known = labels.select(F.col(doc_id).alias("id"), F.expr(domain).alias("domain")).where("domain IS NOT NULL AND id IS NOT NULL")
    known = known.groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64(F.lit(43), "id"), "id").limit(settings.sample)
    known = cut(known, "known")
    drawn = cut(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id").select("domain", "text"), "drawn")
    rows = {r["domain"]: r["n"] for r in drawn.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(rows)
    if not domains:
        discard(known, drawn)
        return Classifier([], [], [], [])
    every = sum(rows.values())
    words = drawn.select("domain", F.explode(F.transform(F.array_distinct(_words("text")), lambda w: F.xxhash64(w))).alias("w"))
    counted = words.groupBy("w").agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)))
    z = F.greatest(F.lit(0.0), *(_z(F.col(f"n{k}"), F.col("n"), rows[d], every) for k, d in enumerate(domains)))
    counted = counted.where(F.col("n") >= settings.least_rows).select("w", z.alias("z")).where(F.col("z") > 4)
    markers = sorted(r["w"] for r in counted.orderBy(F.desc("z"), "w").limit(settings.markers).collect()) if len(domains) > 1 else []

    cells = _measures(drawn, "text", markers).groupBy("domain", CELL).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), _bucket(m).alias("bucket")) for m in range(MEASURES)))).alias("x")
    counts = cells.select("domain", "n", each).groupBy("domain", "x").agg(F.sum("n").alias("n"))
    found = {(r["domain"], r["x"]["measure"], r["x"]["bucket"]): r["n"] for r in counts.collect()}
    discard(known, drawn)
    logs = [[[float(np.log((found.get((d, m, b), 0) + 0.5) / (rows[d] + 0.5 * BUCKETS))) for b in range(BUCKETS)] for m in range(MEASURES)] for d in domains]
    return Classifier(domains, [float(np.log(rows[d] / every)) for d in domains], logs, markers)


def _z(have: Column, n: Column, rows: int, every: int) -> Column:
    """How far the share of a domain's rows that have a word is above the other rows' share."""
    rest = max(every - rows, 1)
    p = n / every
    return (have / rows - (n - have) / rest) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / rows + 1 / rest))


def _posterior(model: Classifier) -> list[Column]:
    """The probability of each domain, from a cell."""
    scores = []
    for prior, table in zip(model.prior, model.logs):
        score = F.lit(prior)
        for m, row in enumerate(table):
            score = score + F.element_at(F.array(*map(F.lit, row)), _bucket(m) + 1)
        scores.append(score)
    shifted = F.transform(F.array(*scores), lambda s: s)
    shifted = F.transform(shifted, lambda s: F.exp(s - F.array_max(shifted)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return [shifted[k] / total for k in range(len(scores))]


def _moved(k: int, steps: list[np.ndarray], shift: np.ndarray, most: float | None, held: int | None) -> Column:
    """``r`` before and after the last of ``steps`` (each the vector s * e), replayed from ``r`` of the table; each step
    is projected."""
    move = [F.col(f"p{a}") - float(shift[a]) for a in range(k)]
    listed = ", ".join("array(" + ", ".join(f"{x!r}D" for x in e.tolist()) + ")" for e in steps)
    here = F.struct(F.col("r").alias("before"), F.col("r").alias("now"))

    def step(state: Column, e: Column) -> Column:
        now = state["now"]
        for a in range(k):
            now = now - move[a] * e[a]
        now = F.greatest(F.lit(0.0), now) if most is None else F.greatest(F.lit(0.0), F.least(F.lit(most), now))
        if held is not None:
            now = F.when(F.col(f"p{held}") >= 0.5, 1.0).otherwise(now)
        return F.struct(state["now"].alias("before"), now.alias("now"))

    return F.aggregate(F.expr(f"array({listed})"), here, step) if steps else here


def fit(cells: DataFrame, targets: np.ndarray, shares: bool = False, held: int | None = None, settings: Settings = Settings()) -> DataFrame:
    """``cells`` (p0, p1, ... and ``tokens``) with ``r``, the fitted rates. By projected gradient, the totals of r * tokens *
    p over all tokens come as near to ``targets`` as r >= 0 allows; with ``shares`` the shares of what is kept do, for
    r of 0 to 1, and 1 where p of the domain ``held`` is at least 0.5. The result is a table written by ``cut``."""
    k = len(targets)
    shift, goal, most = (targets, np.zeros(k), 1.0) if shares else (np.zeros(k), targets, None)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    move = [F.col(f"p{a}") - float(shift[a]) for a in range(k)]
    every = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cut(cells.withColumn("r", F.lit(1.0)), "rates")
    if not every:
        return now

    def look(steps: list[np.ndarray]) -> tuple[np.ndarray, float, np.ndarray]:
        """After the steps: the missed totals, how far the last step took the rates (squared), and the Gram matrix of
        the rates that are not at a bound."""
        r, t = F.col("m.now"), F.col("tokens")
        free = r > 0 if most is None else (r > 0) & (r < most)
        row = now.withColumn("m", _moved(k, steps, shift, most, held)).agg(
            *(F.sum(r * t * move[a]) for a in range(k)), F.sum(t * (r - F.col("m.before")) ** 2),
            *(F.sum(F.when(free | F.lit(not steps), t * move[a] * move[b]).otherwise(0.0)) for a, b in pairs),
        ).first()
        gram = np.zeros((k, k))
        for (a, b), x in zip(pairs, row[k + 1 :]):
            gram[a, b] = gram[b, a] = x / every
        return np.array(row[:k]) / every - goal, row[k] / every, gram

    steps: list[np.ndarray] = []
    error, _, every_gram = look(steps)
    ridge = 1e-6 * float(np.trace(every_gram)) * np.eye(k)
    weight, length, values, settled = np.linalg.pinv(every_gram + ridge), 1.0, [], False
    for n in range(settings.steps):
        if np.abs(error).max() < settings.tolerance:
            break
        following = n < settings.following and not settled
        least = 1 / max(1.0, float(np.abs(np.linalg.eigvals(weight @ every_gram)).max()))  # a step of this length can't lead away
        length = max(length, least)
        value = float(error @ weight @ error)
        values.append(value)
        while True:
            step = length * weight @ error
            new, far, gram = look([*steps, step])
            if length <= least or float(new @ weight @ new) <= (value if following else max(values[-5:])):
                break
            length = max(least, length / 4 if following else least)
        steps.append(step)
        if far < settings.tolerance**2:  # the projection stops every rate
            if not following:
                break
            settled = True
        if following:
            length, weight = min(1.0, 4 * length), np.linalg.pinv(gram + ridge)
            if settled or n + 1 == settings.following:
                weight, values = np.linalg.pinv(every_gram + ridge), []
        else:
            turn = float((new - error) @ weight @ (new - error))
            length = far / turn if turn > 0 else least
        error = new
        if len(steps) == settings.replayed:
            last, now = now, cut(now.withColumn("r", _moved(k, steps, shift, most, held)["now"]), "rates")
            discard(last)
            steps = []
    if steps:
        last, now = now, cut(now.withColumn("r", _moved(k, steps, shift, most, held)["now"]), "rates")
        discard(last)
    return now


def mix_to_targets(docs: DataFrame, labels: DataFrame, domain: str, targets: dict[str, float], settings: Settings = Settings(),
                   whole: str | None = None, seed: int = 41, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens`` (words), ``p_<domain>`` for each target, ``rate`` and ``copies`` (the rate
    rounded up or down by a hash of doc_id, so that its expectation is the rate). ``whole`` names a domain: each
    document that is as likely as not of it then has rate 1, others one of 0 to 1, under which the shares of what is
    kept are the targets, so that no row has to be repeated for them; if tokens of the others are too few, all rows are
    kept. Texts are read once: the measured documents (without text, if that is not wanted) are a table of ``cut``."""
    listed = ", ".join(f"'{d}'" for d in sorted(targets))  # labels of domains without a target teach nothing
    model = train(docs, labels, f"CASE WHEN ({domain}) IN ({listed}) THEN ({domain}) END", settings, doc_id, text)
    out = docs.drop("n_tokens", "rate", "copies", *(f"p_{d}" for d in targets))
    out = cut(_measures(out, text, model.markers).drop(*([] if with_text else [text])), "measured")
    if not model.domains:
        out = out.withColumn("n_tokens", F.col(TOKENS)).drop(CELL, TOKENS)
        return out.withColumns({**{f"p_{d}": F.lit(None).cast("double") for d in sorted(targets)}, "rate": F.lit(1.0), "copies": F.lit(1).cast("long")})
    goal = np.array([float(targets.get(d, 0)) for d in model.domains])
    goal = goal / goal.sum()
    names = [f"p{k}" for k in range(len(goal))]
    cells = out.groupBy(CELL).agg(F.sum(TOKENS).alias("tokens"))
    cells = cut(cells.select(CELL, "tokens", *(p.alias(n) for p, n in zip(_posterior(model), names))), "cells")
    held = model.domains.index(whole) if whole in model.domains else None
    rates = fit(cells, goal, whole is not None, held, settings)
    discard(cells)
    rates = rates.select(F.col(CELL).alias(OF_CELL), F.struct(*names, "r").alias(RATES))
    if rates.count() <= settings.broadcast_cells:
        rates = F.broadcast(rates)
    kept = out.columns
    out = out.join(rates, F.col(CELL) == F.col(OF_CELL))
    added = {f"p_{d}": F.col(f"{RATES}.p{model.domains.index(d)}") if d in model.domains else F.lit(0.0) for d in sorted(targets)}
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 40)) / float(1 << 40)
    rate = F.col(f"{RATES}.r")
    copies = (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return out.select(*(F.col(f"`{c}`") for c in kept if c not in (CELL, TOKENS)), *(v.alias(c) for c, v in added.items()), F.col(TOKENS).alias("n_tokens"), rate.alias("rate"), copies.alias("copies"))
