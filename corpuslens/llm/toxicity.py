"""Toxicity by maximum-scoring segments of token log-odds.

A token's weight is the log-odds of toxic against clean documents. The Dirichlet prior of a word prefix is the
distribution of the next shorter prefix, so an unseen form of a known stem has the weight of the stem; a word that ends
with a surely toxic word, once marks on letters are gone and digits are the letters they stand for, has a part of that
word's weight. A token is counted once per distinct pair of neighbours, so copies of
a document add nothing. Before that, signs inside words become the letters they stand for, and letters that stand alone
between dots, dashes or blanks are one word. Of toxic texts that words do not explain, three words in a row that significantly
many of them hold get a weight of their own, so a fixed passage of usual words counts, too. All maximal-scoring segments of a
document are found in one scan. Their scores follow an extreme-value law in clean text (Karlin and Altschul): a segment is
significant if fewer than one like it is expected in clean text of that length. The excess of all significant segments
is summed and mapped to a probability by a logistic curve, fitted on documents scored with the other half's weights.

Defined results: null or empty text has no segment and the lowest score; ties in score are possible and kept; rows that
repeat get equal scores; without labelled rows of both kinds every score is the share of toxic labels (0 without any).
The model reads a bounded number of labelled rows (``PER_LABEL`` of each label, lowest hash first). Only the id and text
column are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import Memo, id_and_text, map_texts
from corpuslens.session import written

WORD = re.compile(r"\w+")
PER_LABEL = 10_000
# Digits and signs that stand for letters inside a word.
DIGITS, SIGNS = str.maketrans("0134578", "oieastb"), str.maketrans("@$!|€", "asiie")
SIGNED = re.compile(r"(?<![^\W_])[^\W_]*[@$!|€]+(?=[^\W_])[\w@$!|€]*")
SIGN_INSIDE = re.compile(r"[@$!|€][^\W_]")
MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff]+")
SPELLED = re.compile(r"(?<!\w)[^\W_](?:[ .*_\-·]{1,2}[^\W_]){2,}(?!\w)")
GAPS = re.compile(r"[ .*_\-·]+")
# A word that ends with (or, without disguise, is) a surely toxic one (letters and weight at least) has this part of its weight.
INNER, INNER_WEIGHT, INNER_SHARE = 4, 1.5, 0.7
# Three words in a row: texts of either label that they need, their G-squared, the texts of their prior and their weight at most.
PHRASE_TEXTS, PHRASE_SIGNIFICANT, PHRASE_PRIOR, PHRASE_MOST = 5, 16.0, 10.0, 2.0
LAST = 1000.0
SHORTEST, LONGEST = 3, 16
# Strength of a prefix's prior, in tokens.
PRIOR = 10.0
EULER = 0.5772156649
# Bounds of the evidence, so that a few mislabelled documents do not bend the logistic curve.
LEAST, ENOUGH = -15.0, 9.0
END = "\0"


def prefixes(word: str) -> list[str]:
    """Beginnings that the word goes beyond, from short to long, then the whole word with its end marked."""
    return [word[:n] for n in range(SHORTEST, min(len(word) - 1, LONGEST) + 1)] + [word + END]


def words_of(text: str) -> tuple[str, list[str]]:
    """The text in lower case, without signs for letters and spelled words; and its words."""
    lowered = text.lower()
    if SIGN_INSIDE.search(lowered):
        lowered = SIGNED.sub(lambda m: m.group().translate(SIGNS) if any(map(str.isalpha, m.group())) else m.group(), lowered)
    lowered = SPELLED.sub(lambda m: GAPS.sub("", m.group()), lowered)
    return lowered, WORD.findall(lowered)


def plain_word(word: str) -> str:
    """A word without marks on its letters, and letters for digits if it has both."""
    if not word.isascii():
        word = MARKS.sub("", unicodedata.normalize("NFKD", word))
    return word if word.isalpha() or word.isdigit() else word.translate(DIGITS)


class Weights:
    """Log-odds by stem; a word has the weight of its longest stored stem, at least 0. Phrases of three words have their own."""

    def __init__(self, stems: dict[str, float], phrases: dict[tuple[str, str, str], float] | None = None):
        self.stems, self.phrases = stems, phrases or {}
        self.last = {words[2] for words in self.phrases}
        # Most words share neither their first nor their last letters with a stem.
        self.heads = {stem[:SHORTEST] for stem in stems}
        self.tails = {stem[: -len(END)][-INNER:] for stem, weight in stems.items() if stem.endswith(END) and weight >= INNER_WEIGHT}
        # Only one of the two is used in a task.
        self.of, self.marked = Memo(self._of), Memo(self.flagged, 300_000)

    def _of(self, word: str) -> float:
        if (word + END)[:SHORTEST] in self.heads:
            for stem in reversed(prefixes(word)):
                if stem in self.stems:
                    return max(0.0, self.stems[stem])
        word = plain_word(word)
        if word[-INNER:] not in self.tails:
            return 0.0
        known = (self.stems.get(word[n:] + END, 0.0) for n in range(len(word) - INNER + 1))
        return INNER_SHARE * max((weight for weight in known if weight >= INNER_WEIGHT), default=0.0)

    def flagged(self, word: str) -> float:
        """The weight; ``LAST`` more if the word is the last of a phrase."""
        return self._of(word) + (LAST if word in self.last else 0.0)

    @classmethod
    def fit(cls, counts: dict[str, tuple[float, float]], toxic: float, clean: float) -> Weights:
        """``counts``: toxic and clean tokens by stem; the totals are of all tokens."""
        base = toxic / (toxic + clean)
        # Both shares are kept: one minus the other would be 0 after a few long and surely toxic stems.
        shares, kept = {}, {}
        for stem in sorted(counts, key=lambda s: (len(s), s)):
            body = stem.removesuffix(END)
            parents = (body[:n] for n in range(len(body) - 1, SHORTEST - 1, -1))
            prior = next((shares[p] for p in parents if p in shares), (base, 1 - base))
            t, c = counts[stem]
            share = shares[stem] = tuple((n + PRIOR * p) / (t + c + PRIOR) for n, p in zip((t, c), prior))
            kept[stem] = float(math.log(share[0] / share[1]) - math.log(base / (1 - base)))
        return cls(kept)

    def positive(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words, places of those with a positive weight, and these weights."""
        words = words_of(text)[1]
        weights = np.fromiter(map(self.marked.__getitem__, words), np.float64, len(words))
        ends = np.flatnonzero(weights >= LAST)
        weights[ends] -= LAST
        for i in ends:
            if i >= 2:
                weights[i] = max(weights[i], self.phrases.get((words[i - 2], words[i - 1], words[i]), 0.0))
        places = np.flatnonzero(weights)
        return len(words), places, weights[places]


def segments(places, weights, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last, score)`` in linear time.

    Words not in ``places`` score ``-drift``. Each open segment keeps the running total before and after it; a new one
    joins an earlier segment whose start lies lower and whose end does not lie higher.
    """
    found: list[list] = []
    total, at = 0.0, -1
    for place, weight in zip(places, weights):
        before = total - drift * (place - at - 1)
        total, at = before + weight, place
        first, start = place, before
        while found:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= start:
                k -= 1
            if k < 0 or found[k][3] >= total:
                break
            first, start = found[k][0], found[k][2]
            del found[k:]
        found.append([first, place, start, total])
    return [(int(a), int(b), high - low) for a, b, low, high in found]


@dataclass
class Model:
    stems: dict[str, float] = field(default_factory=dict)
    phrases: dict[tuple[str, str, str], float] = field(default_factory=dict)
    drift: float = 0.05
    decay: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -30.0

    def passages(self, n_words: int, places, weights) -> list[tuple[int, int, float, float]]:
        """Segments with their excess ``decay * score - log(K * length)``."""
        length = self.log_k + math.log(max(1, n_words))
        return [(a, b, s, self.decay * s - length) for a, b, s in segments(places, weights - self.drift, self.drift)]

    def evidence(self, n_words: int, places, weights) -> float:
        """Excess of all significant passages, or of the best if none is; beyond ``ENOUGH`` it counts by its logarithm."""
        excess = [e for *_, e in self.passages(n_words, places, weights)]
        total = sum(e for e in excess if e > 0) or max(excess, default=LEAST)
        return max(LEAST, min(total, ENOUGH) + math.log1p(max(0.0, total - ENOUGH)))

    def probability(self, evidence):
        return 1 / (1 + np.exp(-(self.slope * np.asarray(evidence) + self.offset)))

    def scorer(self):
        """Function from a text to its score and significant passages ``(start, end, score, excess)`` in characters."""
        weights = Weights(self.stems, self.phrases)

        def score(text: str, spans: bool = True):
            n, places, values = weights.positive(text)
            evidence = self.evidence(n, places, values)
            found = []
            if spans and len(places):
                hits = [p for p in self.passages(n, places, values) if p[3] > 0]
                if hits:
                    # Offsets are those of the text without disguise, which is the text itself where there is none.
                    words = [m.span() for m in WORD.finditer(words_of(text)[0])]
                    found = [(words[a][0], words[b][1], s, e) for a, b, s, e in hits]
            return float(self.probability(evidence)), found

        return score


def labelled_sample(labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """``doc_id, label`` of at most ``per_label`` rows of each label, lowest hash of the id first."""
    rows = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "label").distinct()
    order = (F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"))
    kinds = [rows.where(F.col("label") == kind).orderBy(*order).limit(per_label) for kind in (0, 1)]
    return kinds[0].unionByName(kinds[1])


def _tokens(train: DataFrame) -> DataFrame:
    """Distinct ``word, context, label, half``."""

    def run(batches):
        for batch in batches:
            rows = set()
            for text, label, half in zip(*(column.to_pylist() for column in batch.columns)):
                words = ["", *words_of(text)[1], ""]
                rows.update((w, hash_pair(a, b), label, half) for a, w, b in zip(words, words[1:], words[2:]))
            if rows:
                columns = zip(*rows)
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["word", "context", "label", "half"])

    return train.mapInArrow(run, "word string, context long, label int, half int").distinct()


def _texts_with(train: DataFrame) -> DataFrame:
    """``word, d0, d1``: how many distinct texts of each label hold the word."""

    def run(batches):
        for batch in batches:
            counts = Counter()
            for text, label in zip(*(column.to_pylist() for column in batch.columns)):
                counts.update((word, label) for word in set(words_of(text)[1]))
            if counts:
                words, kinds = zip(*counts)
                arrays = [pa.array(words, pa.string()), pa.array(kinds, pa.int32()), pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["word", "label", "n"])

    counts = train.select("text", "label").distinct().mapInArrow(run, "word string, label int, n long")
    return counts.groupBy("word").agg(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"d{k}") for k in (0, 1)])


def _phrase_counts(train: DataFrame) -> tuple[dict[tuple[str, str, str], np.ndarray], float]:
    """Distinct texts ``[half, label]`` that hold three words in a row, for phrases that lean to toxic significantly.

    Also the share of toxic texts.
    """

    def run(batches):
        for batch in batches:
            for text, label, half in zip(*(column.to_pylist() for column in batch.columns)):
                words = words_of(text)[1]
                found = [" ".join(p) for p in set(zip(words, words[1:], words[2:]))]
                columns = [pa.array(found, pa.string()), pa.array([2 * half + label] * len(found), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["phrase", "kind"])

    texts = train.select("text", "label", "half").distinct()
    sizes = {(r["half"], r["label"]): r["count"] for r in texts.groupBy("half", "label").count().collect()}
    names = ["n00", "n01", "n10", "n11"]
    counts = texts.mapInArrow(run, "phrase string, kind int").groupBy("phrase").agg(
        *[F.count_if(F.col("kind") == k).alias(name) for k, name in enumerate(names)]
    )
    counts = counts.where(f"n01 + n11 >= {PHRASE_TEXTS}")
    # Each phrase has so many toxic texts of the bounded sample.
    kept = written(counts, "phrases").toArrow().to_pydict()
    toxic, clean = (sum(n for (_, label), n in sizes.items() if label == k) for k in (1, 0))
    base = min(max(toxic / max(1, toxic + clean), 1e-6), 1 - 1e-6)
    found = {}
    for phrase, *values in zip(kept["phrase"], *(kept[n] for n in names)):
        n = np.array(values, float).reshape(2, 2)
        if significance(n[:, 1].sum(), n[:, 0].sum(), base) >= PHRASE_SIGNIFICANT:
            found[tuple(phrase.split(" "))] = n
    return found, base


def significance(toxic: float, clean: float, base: float) -> float:
    """G-squared of a toxic share above ``base``; 0 below it."""
    n = toxic + clean
    if toxic <= base * n:
        return 0.0
    return 2 * (toxic * math.log(toxic / (n * base)) + (clean * math.log(clean / (n * (1 - base))) if clean else 0.0))


def phrase_weights(counts: dict[tuple[str, str, str], np.ndarray], halves: tuple[int, ...], base: float, words: Weights) -> dict:
    """Log-odds of the phrases; the prior is the largest share of their words."""
    out = {}
    for phrase, n in counts.items():
        clean, toxic = n[list(halves)].sum(0)
        odds = base * math.exp(max(map(words.of.__getitem__, phrase))) / (1 - base)
        weight = math.log((toxic + PHRASE_PRIOR * odds / (1 + odds)) / (clean + PHRASE_PRIOR / (1 + odds))) - math.log(base / (1 - base))
        if toxic and weight > 0:
            out[phrase] = min(weight, PHRASE_MOST)
    return out


def hash_pair(left: str, right: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{left}\0{right}") >> 1


def _stem_counts(train: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts as ``[half, label]``: by stem, for stems that lean to toxic and those right below such ones; and of all tokens.

    What a stem needs to count is met by contexts or by texts, so the words of a passage that many texts repeat are kept.
    """
    words = _tokens(train).groupBy("word").agg(
        *[F.count(F.when((F.col("half") == h) & (F.col("label") == k), 1)).alias(f"n{h}{k}") for h in (0, 1) for k in (0, 1)]
    )
    names = ["n00", "n01", "n10", "n11"]
    # Evidence by label: contexts of a word, or texts that hold it.
    words = words.join(_texts_with(train), "word")
    words = words.withColumns({f"e{k}": F.greatest(F.col(f"n0{k}") + F.col(f"n1{k}"), F.col(f"d{k}")) for k in (0, 1)})
    words = written(words, "words")
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.length("word") - 1, F.lit(LONGEST)))
    stems = F.when(F.length("word") > SHORTEST, F.transform(lengths, lambda n: F.expr("word").substr(F.lit(1), n)))
    stems = F.concat(F.coalesce(stems, F.array().cast("array<string>")), F.array(F.concat("word", F.lit(END))))
    sums = [*names, "e0", "e1"]
    rows = words.select(F.explode(stems).alias("stem"), *sums).groupBy("stem").agg(*[F.sum(n).alias(n) for n in sums])
    rows = written(rows.where("e0 + e1 >= 3"), "stems")
    total = written(words.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]), "totals").first()
    share = (total.n01 + total.n11) / max(1, sum(total))
    leaning = rows.where((F.col("e1") >= 3) & (F.expr("(n01 + n11) / (n00 + n01 + n10 + n11)") > 2 * share))
    parent = F.expr("substr(stem, 1, length(stem) - if(endswith(stem, '{}'), 2, 1))".format(END))
    below = rows.withColumn("parent", parent).join(leaning.select(F.col("stem").alias("parent")), "parent", "left_semi")
    # Bounded by the sample: each stem has three toxic contexts or texts, or follows one that has.
    kept = leaning.unionByName(below.drop("parent")).distinct().toArrow().to_pydict()
    counts = {s: np.array(v, float).reshape(2, 2) for s, *v in zip(kept["stem"], *(kept[n] for n in names))}
    return counts, np.array(total, float).reshape(2, 2)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from ``docs (doc_id, text)`` and ``labels (doc_id, label)``."""
    chosen = written(labelled_sample(labels, per_label), "sample")
    share = labels.where("label IN (0, 1)").agg(F.avg("label")).first()[0] or 0.0
    # At most 2 * per_label ids.
    train = id_and_text(docs).join(F.broadcast(chosen), "doc_id")
    train = written(train.select("text", F.col("label").cast("int"), F.expr("int(pmod(xxhash64(text), 2))").alias("half")), "train")
    constant = Model(offset=math.log(share / (1 - share)) if 0 < share < 1 else 30.0 * (2 * share - 1))
    if train.select("label").distinct().count() < 2:
        return constant
    counts, totals = _stem_counts(train)

    def weights_of(halves) -> Weights:
        half = list(halves)
        clean, toxic = totals[half].sum(0)
        chosen = {s: c[half].sum(0) for s, c in counts.items()}
        return Weights.fit({s: (t, c) for s, (c, t) in chosen.items() if t + c > 0}, max(toxic, 1.0), max(clean, 1.0))

    other = [(weights_of((1,)).stems, {}), (weights_of((0,)).stems, {})]
    model = Model(weights_of((0, 1)).stems)
    _calibrate(model, _sparse(train, other), share)
    # Phrases are learned from what words do not explain; often nothing is left.
    rest = written(_unexplained(train, model, other), "unexplained")
    if rest.where("label = 1").count() < PHRASE_TEXTS:
        return model
    phrases, base = _phrase_counts(rest)
    if phrases:
        halves = ((1,), (0,), (0, 1))
        *other, model.phrases = (phrase_weights(phrases, h, base, weights_of(h)) for h in halves)
        _calibrate(model, _sparse(train, [(weights_of(h).stems, found) for h, found in zip(halves, other)]), share)
    return model


def _sparse(train: DataFrame, other: list[tuple[dict, dict]]) -> pd.DataFrame:
    """Places of the few words with a positive weight by the other half's weights, for the bounded sample."""

    def run(batches):
        weights = [Weights(*known) for known in other]
        for batch in batches:
            rows = [(label, *weights[half].positive(text)) for text, label, half in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                label, n, places, values = zip(*rows)
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"label": label, "n": n, "places": places, "values": values}), schema=SPARSE, preserve_index=False
                )

    return train.mapInArrow(run, "label int, n long, places array<long>, values array<double>").toPandas()


def _unexplained(train: DataFrame, model: Model, other: list[tuple[dict, dict]]) -> DataFrame:
    """The clean rows, and the toxic ones that score below one half by the other half's words."""

    def run(batches):
        weights = [Weights(*known) for known in other]
        for batch in batches:
            text, label, half = (c.to_pylist() for c in batch.columns)
            keep = [y == 0 or model.probability(model.evidence(*weights[h].positive(x))) < 0.5 for x, y, h in zip(text, label, half)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return train.mapInArrow(run, "text string, label int, half int")


SPARSE = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("places", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])


def _calibrate(model: Model, sparse: pd.DataFrame, share: float) -> None:
    rows = [(int(r.label), int(r.n), np.asarray(r.places, int), np.asarray(r.values, float)) for r in sparse.itertuples()]
    clean = [r for r in rows if r[0] == 0]
    words = max(1, sum(r[1] for r in clean))
    histogram = Counter(np.round(np.concatenate([r[3] for r in clean] or [[]]), 2).tolist())
    gain = sum(v * n for v, n in histogram.items()) / words
    model.drift = 2 * gain + 0.05
    values = np.array([0.0, *histogram]) - model.drift
    shares = np.array([words - sum(histogram.values()), *histogram.values()]) / words
    # The decay solves E[exp(decay * weight)] = 1 in clean text.
    low, high = 0.0, 64.0
    for _ in range(60):
        middle = (low + high) / 2
        above = middle * values.max() > 500 or (shares * np.exp(middle * values)).sum() > 1
        low, high = (low, middle) if above else (middle, high)
    model.decay = min(max(low, 0.05), 4.0)
    best = []
    for _, n, places, weights in clean:
        top = max((s for *_, s in segments(places, weights - model.drift, model.drift)), default=0.0)
        if top > 0:
            best.append(model.decay * top - math.log(n))
    model.log_k = float(np.mean(best)) - EULER if best else 0.0
    evidence = np.array([model.evidence(*r[1:]) for r in rows])
    label = np.array([r[0] for r in rows])
    model.slope, model.offset = logistic(evidence, label, share)


def logistic(x: np.ndarray, label: np.ndarray, share: float) -> tuple[float, float]:
    """Rising logistic curve by Newton steps; labels weigh as in all labelled rows, the targets are Platt's."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label == 1, share / n1, (1 - share) / n0) * len(label)
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.array([0.1, math.log(share / (1 - share))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - target)) + 1e-3 * beta
        hessian = (design * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, passages`` for every row; passages are ``(start, end, score, excess)`` in characters."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("excess", pa.float64())]))

    def start():
        of = model.scorer()

        def work(ids, texts):
            results = [of(text) for text in texts]
            spans = [[dict(zip(("start", "end", "score", "excess"), p)) for p in found] for _, found in results]
            arrays = [pa.array(ids, pa.int64()), pa.array([s for s, _ in results], pa.float64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "passages"])

        return work

    schema = "doc_id long, score double, passages array<struct<start:int,end:int,score:double,excess:double>>"
    return map_texts(id_and_text(docs, id_col, text_col), start, schema)


def score_column(model: Model):
    """The score as a column function of a text, for filters that leave all other columns as they are."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # One scorer per task.
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([scorer(text or "", False)[0] for text in texts], dtype=float)

    return of
