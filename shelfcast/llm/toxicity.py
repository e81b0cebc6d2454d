"""Toxicity by weak supervision.

Many voters (disjoint lexicons and patterns) fire or stay silent on each text. A generative label model is fitted to the vote patterns of all documents: within a class, votes
follow an exponential family with a factor for each voter (its accuracy) and one for each chosen pair of voters (their correlation), normalised
over all 2 ** VOTERS patterns. Its posteriors label a bounded sample, on which a linear classifier of the same evidence is trained; labelled rows in it keep their label.

Learned lexicons are word beginnings that labelled training texts show far more often in toxic ones. Bounds: about LABELLED_ROWS labelled rows for the
lexicons and the first guess of the label model, about TRAINING_ROWS rows of either kind, labelled and not, for the classifier, 2 ** VOTERS vote patterns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from shelfcast.llm.common import LOWER, bounded_batches, slices, spans, stored, words_of

LABELLED_ROWS, TRAINING_ROWS = 12_000, 12_000
#: Word beginnings have so many bytes; so many are kept, dealt over so many lexicon voters.
SHORTEST, LONGEST, ROOTS, LEXICONS = 4, 10, 64, 6
#: A beginning stands in so many toxic texts at least, and in this share of them; it is so many times as frequent as in clean ones.
LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO, LEAST_EVIDENCE = 3, 0.015, 4.0, 6.0
#: Common English insults of two kinds, words of threat, and words of address.
INTELLECT = frozenset(b"clown dumb fool idiot idiots imbecile moron morons stupid".split())
CONTEMPT = frozenset(b"creep disgusting freak garbage jerk loser losers pathetic pig scum trash vermin worthless".split())
THREATS = frozenset(b"destroy die hate hurt kill punch shoot stab strangle".split())
ADDRESS = frozenset(b"you your u ur are she he they".split())
INSULTS = INTELLECT | CONTEMPT
_STEPS = (0.002, 0.005, 0.008, 0.011, 0.014, 0.017)
#: A lexicon votes from this share of a text's words on.
LEAST_DENSITY = 0.003
#: Voters: the learned lexicons, three fixed ones, an insult after a word of address, shouting, repeated marks, drawn-out letters.
VOTERS = LEXICONS + 7
N_FEATURES = ROOTS + LEXICONS + 2 * len(_STEPS) + 9
#: Correlations within a class from which on a pair of voters may get a factor of its own (and so many standard errors), and the most pairs that do, strongest first.
LEAST_CORRELATION, LEAST_ERRORS, MOST_PAIRS = 0.1, 3.0, 20
_GAP = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
_NO_TOKEN = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c == 95) for c in range(256)])
_NO_MARK = np.array([c not in b"!?" for c in range(256)])


def _shares(data: np.ndarray, off: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Per word of each row: words all in capitals (four letters or more), runs of ! and ? (two or more), runs of one small letter (four or more)."""
    rows = len(n)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    first, after, row = spans(data, off, _NO_TOKEN)
    shout = row[(after - first >= 4) & (upper[after] - upper[first] == after - first)]
    first, after, row = spans(data, off, _NO_MARK)
    cry = row[after - first >= 2]
    new = np.ones(len(data), bool)
    new[1:] = data[1:] != data[:-1]
    new[off[(off > 0) & (off < len(data))]] = True
    at = np.flatnonzero(new)
    at = at[(np.diff(at, append=len(data)) >= 4) & (data[at] >= 97) & (data[at] <= 122)]
    drawl = np.searchsorted(off, at, "right") - 1
    return [np.bincount(r, minlength=rows) / n for r in (shout, cry, drawl)]


@dataclass(frozen=True)
class Lexicon:
    """Learned word beginnings, strongest first."""

    roots: tuple[bytes, ...]

    @cached_property
    def _index(self) -> tuple[np.ndarray, dict[bytes, int], list[int]]:
        """Which first three bytes any lexicon has, places of the roots, and their lengths, longest first."""
        heads = np.zeros(1 << 24, bool)
        for w in (*self.roots, *INSULTS, *THREATS):
            heads[w[0] << 16 | w[1] << 8 | w[2]] = True
        return heads, {r: i for i, r in enumerate(self.roots)}, sorted({len(r) for r in self.roots}, reverse=True)

    def _found(self, data: np.ndarray, off: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
        """Of each row: words, roots by place, insults of either kind, threats, and whether an insult follows a word of address closely."""
        heads, place, lengths = self._index
        low = LOWER[data]
        first, after, row = spans(data, off, _GAP)
        n = np.maximum(np.bincount(row, minlength=rows), 1)
        long = np.flatnonzero(after - first >= 3)
        at = first[long].astype(np.int64)
        head = low[at].astype(np.int64) << 16 | low[at + 1].astype(np.int64) << 8 | low[at + 2]
        by_root, fixed, addressed = np.zeros((rows, ROOTS)), np.zeros((3, rows)), np.zeros(rows, bool)
        raw = low.tobytes()
        for i in long[heads[head]].tolist():
            w, r = raw[first[i] : after[i]], row[i]
            for k in lengths:
                found = place.get(w[:k]) if len(w) >= k else None
                if found is not None:
                    by_root[r, found] += 1
                    break
            for kind, words in enumerate((INTELLECT, CONTEMPT, THREATS)):
                fixed[kind, r] += w in words
            if w in INSULTS and not addressed[r]:
                addressed[r] = any(raw[first[j] : after[j]] in ADDRESS for j in range(max(0, i - 3), i) if row[j] == r)
        return n, by_root, *fixed, addressed

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Feature vectors of whole texts (one row each) and their votes as bits. Null counts as empty. Words are looked at by numpy; only those that may be in a lexicon are met one by one."""
        features, votes = [np.zeros((0, N_FEATURES))], [np.zeros(0, np.int64)]
        for start, end, data, off in slices(texts):
            rows = end - start
            n, by_root, intellect, contempt, threats, addressed = self._found(data, off, rows)
            shout, cry, drawl = _shares(data, off, n)
            groups = np.stack([by_root[:, i::LEXICONS].sum(1) for i in range(LEXICONS)], 1) / n[:, None]
            roots = by_root.sum(1)
            learned, fixed, threat = roots / n, (intellect + contempt) / n, threats / n
            clean = (roots == 0) & (fixed == 0)
            single = [np.minimum(learned * 50, 2), np.minimum(fixed * 50, 2), np.minimum(threat * 50, 2), addressed, np.minimum(shout * 20, 1), np.minimum(cry * 20, 1), np.minimum(drawl * 20, 1), clean, roots >= 2]
            features.append(np.concatenate([
                np.minimum(by_root / n[:, None] * 100, 1), np.minimum(groups * 50, 1), learned[:, None] >= _STEPS, fixed[:, None] >= _STEPS, np.stack(single, 1),
            ], 1))
            dense = [g >= LEAST_DENSITY for g in (*groups.T, intellect / n, contempt / n, threat)]
            voted = np.stack([*dense, addressed, shout >= 0.05, cry >= 0.02, drawl >= 0.02], 1)
            votes.append(voted @ (1 << np.arange(VOTERS)))
        return np.concatenate(features), np.concatenate(votes)


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Word beginnings that toxic rows of labelled (text, toxic) show far more often; counts are summed by Spark, at most 8 * ROOTS come to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: tuple[dict, dict] = ({}, {})
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine: Counter = Counter()
                for w, n in Counter(words_of(text)).items():
                    mine[b""] += n
                    for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
                        mine[w[:k]] += n
                total = of[1 if toxic else 0]
                for root, n in mine.items():
                    words, texts = total.get(root, (0, 0))
                    total[root] = (words + n, texts + 1)
        for counts, toxic in ((of[0], 0), (of[1], 1)):
            keys = list(counts)
            for i in range(0, len(keys), 20_000):
                some = keys[i : i + 20_000]
                yield pa.RecordBatch.from_pydict({"root": pa.array(some, pa.binary()), "toxic": pa.array([toxic] * len(some), pa.int32()), "words": pa.array([counts[k][0] for k in some], pa.int64()), "texts": pa.array([counts[k][1] for k in some], pa.int64())})

    distinct = labelled.select(F.col("text").cast("binary").alias("text"), F.col("toxic").cast("int").alias("toxic")).dropDuplicates()
    parts = distinct.mapInArrow(counted, "root binary, toxic int, words long, texts long")
    sums = [F.sum(F.when(F.col("toxic") == t, F.col(c)).otherwise(0)).alias(f"{c}_{t}") for c in ("words", "texts") for t in (0, 1)]
    counts = parts.groupBy("root").agg(*sums).where(F.col("texts_1") >= LEAST_TEXTS).persist()
    whole = counts.where(F.octet_length("root") == 0).first()
    if whole is None or not whole["texts_0"]:
        counts.unpersist()
        return Lexicon(())
    rate = (F.col("words_1") / float(whole["words_1"])) / ((F.col("words_0") + 0.5) / float(whole["words_0"]))
    p, q = F.col("texts_1") / float(whole["texts_1"]), (F.col("texts_0") + 0.5) / float(whole["texts_0"])
    gain = F.col("texts_1") * F.ln(p / q) - (F.col("texts_1") - F.lit(float(whole["texts_1"])) * q)
    known = (F.octet_length("root") > 0) & (p >= LEAST_SHARE) & (rate >= LEAST_RATIO) & (p > q) & (gain >= LEAST_EVIDENCE)
    best = counts.where(known).orderBy(gain.desc(), F.octet_length("root").desc(), "root").limit(8 * ROOTS)
    roots: list[bytes] = []
    for row in best.collect():
        r = bytes(row["root"])
        if len(roots) < ROOTS and not any(r.startswith(x) or x.startswith(r) for x in roots):
            roots.append(r)
    counts.unpersist()
    return Lexicon(tuple(roots))


def _unpacked(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(VOTERS) & 1).astype(float)


@dataclass
class LabelModel:
    """Within class c (0 clean, 1 toxic) a vote pattern v has probability exp(sum theta[c, j] v_j + sum theta[c, jk] v_j v_k) / Z[c], jk over `pairs`."""

    pairs: list[tuple[int, int]]
    theta: np.ndarray
    prior: float

    def features(self, votes: np.ndarray) -> np.ndarray:
        return np.concatenate([votes, *[votes[:, [j]] * votes[:, [k]] for j, k in self.pairs]], 1)

    def _logs(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities by class of rows of features, up to Z, and log Z."""
        every = self.features(_unpacked(np.arange(1 << VOTERS))) @ self.theta.T
        most = every.max(0)
        return of @ self.theta.T, most + np.log(np.exp(every - most).sum(0))

    def rates(self) -> np.ndarray:
        """How often each voter fires, by class."""
        f = self.features(_unpacked(np.arange(1 << VOTERS)))
        logs, z = self._logs(f)
        return (np.exp(logs - z).T @ f)[:, :VOTERS]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of being toxic for rows of 0/1 votes."""
        logs, z = self._logs(self.features(votes))
        logit = np.log(self.prior / (1 - self.prior)) + (logs[:, 1] - z[1]) - (logs[:, 0] - z[0])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def with_pairs(self, pairs: list[tuple[int, int]]) -> LabelModel:
        return LabelModel(pairs, np.concatenate([self.theta[:, :VOTERS], np.zeros((2, len(pairs)))], 1), self.prior)


def _fitted(f: np.ndarray, moments: np.ndarray, theta: np.ndarray, ridge: float = 1e-3, rounds: int = 12) -> np.ndarray:
    """Parameters whose expected features are `moments`, by Newton steps with halving; f has the features of all patterns."""

    def at(t: np.ndarray) -> tuple[float, np.ndarray]:
        e = f @ t
        most = e.max()
        p = np.exp(e - most)
        return float(np.log(p.sum()) + most - t @ moments + ridge / 2 * (t @ t)), p / p.sum()

    loss, p = at(theta)
    for _ in range(rounds):
        mean = p @ f
        slope = mean - moments + ridge * theta
        curve = (f * p[:, None]).T @ f - np.outer(mean, mean) + ridge * np.eye(len(theta))
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-3:
            new, p_new = at(theta - size * step)
            if new <= loss:
                break
            size /= 2
        else:
            break
        theta, done = theta - size * step, loss - new < 1e-10
        loss, p = new, p_new
        if done:
            break
    return theta


def _correlated(votes: np.ndarray, toxic: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of voters that correlate most within either class. Toxic texts are few and of several kinds (languages): an average over classes would hide which voters their kinds share."""
    most = np.zeros((VOTERS, VOTERS))
    for weight in ((1 - toxic) * counts, toxic * counts):
        total = max(weight.sum(), 1e-9)
        centred = votes - weight @ votes / total
        covariance = (centred * weight[:, None]).T @ centred / total
        scale = np.sqrt(np.diag(covariance).clip(1e-9))
        found = np.abs(covariance / np.outer(scale, scale))
        most = np.maximum(most, np.where(found >= LEAST_ERRORS / np.sqrt(total), found, 0))
    best = sorted(((-most[j, k], j, k) for j in range(VOTERS) for k in range(j) if most[j, k] >= LEAST_CORRELATION))
    return [(j, k) for _, j, k in best[:MOST_PAIRS]]


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None, rounds: int = 10) -> LabelModel:
    """Expectation maximisation over vote patterns of all documents: `rounds` with independent voters, then, with the pairs that correlate most, as many again.

    `known` (patterns, toxic, counts) of labelled training rows gives the first guess and the prior, and keeps its classes: its rows together weigh as much as all documents.
    """
    votes, model = _unpacked(patterns), LabelModel([], np.zeros((2, VOTERS)), 0.1)
    anchored, anchors = np.zeros((0, VOTERS)), np.zeros((2, 0))
    if known is not None and len(known[0]) and 0 < (known[1] * known[2]).sum() < known[2].sum():
        anchored, toxic, n = _unpacked(known[0]), known[1], known[2]
        model.prior = float((toxic * n).sum() / n.sum())
        anchors = np.stack([(1 - toxic) * n, toxic * n])
        start = np.stack([(w @ anchored + 0.5) / (w.sum() + 1) for w in anchors])
        anchors = anchors * counts.sum() / n.sum()
    else:
        start = np.stack([np.full(VOTERS, 0.02), np.full(VOTERS, 0.4)])
    model.theta = np.log(start / (1 - start))
    every = _unpacked(np.arange(1 << VOTERS))
    for step in range(2 * rounds):
        toxic = model.posterior(votes)
        if step == rounds:
            seen, weight = np.concatenate([votes, anchored]), np.concatenate([counts, anchors.sum(0)])
            model = model.with_pairs(_correlated(seen, np.concatenate([toxic, anchors[1] / np.maximum(anchors.sum(0), 1e-9)]), weight))
        f, all_f, fixed = model.features(votes), model.features(every), model.features(anchored)
        for c, weight in enumerate(((1 - toxic) * counts, toxic * counts)):
            total = weight.sum() + anchors[c].sum() + 0.5
            model.theta[c] = _fitted(all_f, (weight @ f + anchors[c] @ fixed + 0.5 * all_f.mean(0)) / total, model.theta[c])
    return model


@dataclass
class Classifier:
    """Linear score of a text's evidence."""

    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    model: LabelModel

    def of_features(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return self.of_features(self.lexicon.evidence(pa.array(texts, pa.binary()))[0])


def evidence(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...]) -> DataFrame:
    """kept (a struct of the columns `keep`), features and votes of every row of docs (text, ...); stored, as they are counted, sampled and scored."""

    def described(texts: pa.Array) -> pa.Array:
        features, votes = lexicon.evidence(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(features) + 1, dtype=np.int32) * N_FEATURES), pa.array(features.ravel()))
        return pa.StructArray.from_arrays([lists, pa.array(votes, pa.int64())], ["features", "votes"])

    found = arrow_udf(described, "struct<features: array<double>, votes: long>")(F.col("text").cast("binary"))
    whole = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    return stored(docs.select(whole, "doc_id", found.alias("e")).select("kept", "doc_id", "e.*"), "toxicity-evidence", "zstd")


def _share(hashed: Column, rows: int, most: int) -> Column:
    """Whether a row is in a sample of about `most` of `rows` rows, by its hash."""
    return F.lit(True) if rows <= most else F.pmod(hashed, F.lit(1 << 32)) < int((1 << 32) * most / rows)


def train(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> tuple[Classifier, DataFrame]:
    """A classifier from docs (doc_id, text, ...) and the labels (doc_id, toxic) that may be learned from, and the evidence of all docs (kept, features, ...), for `scored`.

    Each text is read once for its evidence, and votes are counted over all docs. Labels of null are left out; without labels of both kinds the label model starts from a
    general guess and the fixed lexicons alone. Repeated labels count as often as they occur.
    The classifier learns labelled rows by their label, all others by the label model; the labelled ones together weigh as much as the others, or more if they are more.
    """
    from pyspark.ml.classification import LogisticRegression  # here, as the workers that score have no use for it
    from pyspark.ml.functions import array_to_vector

    bounded_batches(docs.sparkSession)
    labels = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    known = F.broadcast(labels.where(_share(F.xxhash64("doc_id"), labels.count(), LABELLED_ROWS)))
    lexicon = learn_lexicon(docs.select("doc_id", "text").join(known, "doc_id"))
    table = evidence(docs, lexicon, keep)
    seen = table.select("doc_id", "votes").join(known, "doc_id").groupBy("votes", "toxic").count().toPandas()
    patterns = table.groupBy("votes").count().toPandas()
    if patterns.empty:
        return Classifier(lexicon, np.zeros(N_FEATURES), -3.0, fit_label_model(np.zeros(1, np.int64), np.ones(1), None)), table
    votes, counts = patterns["votes"].to_numpy(np.int64), patterns["count"].to_numpy(float)
    toxic, labelled = seen["toxic"].to_numpy(float), seen["count"].to_numpy(float)
    model = fit_label_model(votes, counts, (seen["votes"].to_numpy(np.int64), toxic, labelled) if len(seen) else None)
    belief = docs.sparkSession.createDataFrame(list(zip(votes.tolist(), model.posterior(_unpacked(votes)).tolist(), strict=True)), "votes long, belief double")
    n_rows, n_known = int(counts.sum()), int(labelled.sum()) if 0 < toxic @ labelled < labelled.sum() else 0
    heavy = max(1.0, (n_rows - n_known) * min(1.0, TRAINING_ROWS / n_rows) / max(1, min(n_known, TRAINING_ROWS)))
    # Rows are sampled by place too: a doc_id may hold any share of them.
    place, given = F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("toxic").isNotNull()
    rows = table.join(known if n_known else known.limit(0), "doc_id", "left")
    sample = rows.where(F.when(given, _share(place, n_known, TRAINING_ROWS)).otherwise(_share(place, n_rows, TRAINING_ROWS))).join(F.broadcast(belief), "votes")
    weight, share = F.when(given, heavy).otherwise(1.0), F.coalesce(F.col("toxic").cast("double"), F.col("belief"))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (weight * share).alias("weight")), F.struct(F.lit(0.0).alias("label"), (weight * (1 - share)).alias("weight"))))
    sample = sample.select(array_to_vector("features").alias("features"), both.alias("s")).select("features", "s.*").where("weight > 0.0001").persist()
    fitted = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1e-4, maxIter=40, family="binomial").fit(sample)
    sample.unpersist()
    return Classifier(lexicon, fitted.coefficients.toArray(), max(-30.0, min(30.0, float(fitted.intercept))), model), table


def score(docs: DataFrame, classifier: Classifier, text: str = "text") -> Column:
    """Score from 0 to 1 of each whole text, by reading it; where its evidence is stored, see `scored`."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def of_texts(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.of_features(shared.value.lexicon.evidence(texts)[0]), pa.float64())

    return arrow_udf(of_texts, "double")(F.col(text).cast("binary"))


def scored(table: DataFrame, classifier: Classifier) -> DataFrame:
    """kept and score (0 to 1) of each row of evidence; null and empty texts get the score of no evidence."""
    weights, bias = classifier.weights, classifier.bias

    def score(features: pa.Array) -> pa.Array:
        rows = np.asarray(features.flatten()).reshape(len(features), N_FEATURES)
        return pa.array(1 / (1 + np.exp(-np.clip(rows @ weights + bias, -30, 30))), pa.float64())

    return table.select("kept", arrow_udf(score, "double")(F.col("features")).alias("score"))
