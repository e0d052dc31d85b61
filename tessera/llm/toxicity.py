"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat, target, negation, report, other). Small transducers, each over the class alphabet, are composed into
one: one marks insults and threats that meet a target, one what is negated, one what is reported. The composed machine reads a clause
word by word; each insult or threat adds its weight, by its marks, and a document's score is the logistic of its clauses' weights on top of
a constant. Insults are stems and words learned from labels; the weights of threats, targets, negations, reports and
the constant are fitted to the clauses of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches, stored, texts

#: Labelled documents of each class that are learned from, at most.
SAMPLE_DOCS = 10_000
#: A learned term stands in at least this many, and this share, of the toxic documents, so that copies of a few don't make one, at this log
#: likelihood ratio (nats) from chance.
MIN_DOCS, MIN_SHARE, MIN_GAIN = 3, 0.02, 15.0
#: The least weight of a learned term: the log of how much more frequent it is in toxic documents.
MIN_WEIGHT = 3.0
STEM = range(4, 8)
#: Most that one clause adds.
CLAUSE_MOST = 12.0
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Hand-set words; learned insults come on top.
GRAMMAR = {
    INSULT: "idiot moron stupid imbecile scum loser pathetic worthless disgusting",
    THREAT: "kill hurt destroy attack beat stab shoot murder",
    TARGET: "you your yours u they them he she him her people",
    NEGATION: "not no never nobody isn't aren't don't doesn't nicht kein keine non pas jamais nunca",
    REPORT: "said says claimed reported wrote quoted alleged sagte dit dijo",
}
#: The weight of a hand-set insult.
INSULT_WEIGHT = 4.0
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
#: Words after a negation that it reaches; a report reaches to the clause's end.
REACH = 3


#: Marks of an insult or threat.
NEGATED, REPORTED, AIMED = 1, 2, 4


class Transducer:
    """A deterministic transducer over classes: (state, class) -> (state, class written, marks)."""

    def __init__(self, states: int, arcs: dict):
        self.states, self.arcs = states, arcs

    def step(self, state: int, symbol: int) -> tuple[int, int, int]:
        return self.arcs.get((state, symbol), (state, symbol, 0))

    def __matmul__(self, after: Transducer) -> Transducer:
        """The composition: what self writes, after reads; marks unite."""
        arcs = {}
        for a in range(self.states):
            for b in range(after.states):
                for x in range(6):
                    a2, y, m = self.step(a, x)
                    b2, z, n = after.step(b, y)
                    arcs[a * after.states + b, x] = (a2 * after.states + b2, z, m | n)
        return Transducer(self.states * after.states, arcs)


def machines() -> tuple[Transducer, Transducer, Transducer]:
    """negation, report, target."""
    harm = (INSULT, THREAT)
    # state n: the next n words are negated
    negation = {(s, x): (max(0, s - 1), x, NEGATED if s and x in harm else 0) for s in range(REACH + 1) for x in range(6)}
    negation |= {(s, NEGATION): (REACH, NEGATION, 0) for s in range(REACH + 1)}
    report = {(1, x): (1, x, REPORTED) for x in harm} | {(s, REPORT): (1, REPORT, 0) for s in (0, 1)}
    # state 1: a target was seen, state 2: harm was seen
    target = {(0, TARGET): (1, TARGET, 0), (2, TARGET): (1, TARGET, AIMED)}
    target |= {(0, x): (2, x, 0) for x in harm} | {(1, x): (2, x, AIMED) for x in harm}
    return Transducer(REACH + 1, negation), Transducer(2, report), Transducer(3, target)


def grammar() -> Transducer:
    negation, report, target = machines()
    return negation @ report @ target


#: What is fitted: (start, spread around it, least, most).
PARAMETERS = {"constant": (-4.0, 4.0, -20.0, 5.0), "insult": (1.0, 1.0, 0.05, 3.0), "threat": (2.0, 2.0, 0.0, 8.0), "target": (0.5, 0.5, 0.0, 4.0), "negated": (0.25, 0.25, 0.0, 1.0), "reported": (0.5, 0.25, 0.0, 1.0)}
START = {k: v[0] for k, v in PARAMETERS.items()}


class Scorer:
    def __init__(self, terms: dict[str, float], weights: dict[str, float] = START):
        """terms: learned insults, stems ending in *; weights: the fitted parameters."""
        self.weights, machine = weights, grammar()
        self.table = [[machine.step(s, x) for x in range(6)] for s in range(machine.states)]
        self.factor = [(weights["negated"] if m & NEGATED else 1.0) * (weights["reported"] if m & REPORTED else 1.0) for m in range(8)]
        self.words = {w: (c, INSULT_WEIGHT if c == INSULT else 1.0) for c, ws in GRAMMAR.items() for w in ws.split()}
        self.stems = {}
        for t, w in terms.items():
            if t.endswith("*"):
                self.stems[t[:-1]] = w
            else:
                self.words[t] = (INSULT, w)
        self.seen: dict[str, int] = {}

    def of(self, word: str) -> tuple[int, float]:
        kind, own = self.words.get(word, (OTHER, 0.0))
        found = [self.stems[word[:n]] for n in STEM if word[:n] in self.stems]
        return (INSULT, max([*found, own])) if found and kind in (OTHER, INSULT) else (kind, own)

    def clauses(self, text: str) -> list[list[tuple[int, int, float]]]:
        """The clauses with a match: for each insult, threat or mark its class, marks and own weight."""
        tokens = TOKEN.findall(text.lower())
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        for w in set(tokens).difference(seen):
            seen[w] = self.of(w)
        marks = [seen[w] for w in tokens]
        out, now, state = [], [], 0
        if not any(c in (INSULT, THREAT) for c, _ in set(marks)):
            return out
        for w, (c, own) in zip(tokens, marks, strict=True):
            if w in ".!?;:\n":
                out, now, state = [*out, now] if now else out, [], 0
            elif c != OTHER or state:
                state, _, mark = self.table[state][c]
                if c in (INSULT, THREAT) or mark:
                    now.append((c, mark, own))
        return [*out, now] if now else out

    def weight(self, clause: list[tuple[int, int, float]]) -> float:
        w = self.weights
        scale = {INSULT: w["insult"], THREAT: w["threat"]}
        return min(CLAUSE_MOST, sum(scale.get(c, 0.0) * own * self.factor[m] + (w["target"] if m & AIMED else 0.0) for c, m, own in clause))

    def matches(self, text: str) -> tuple[float, int]:
        """The weight of all clauses and the number of clauses with a match."""
        found = self.clauses(text)
        return sum(map(self.weight, found)), len(found)

    def score(self, text: str) -> tuple[float, int]:
        import math

        weight, clauses = self.matches(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights["constant"] + weight)))), clauses


def features(clauses: list) -> list[float]:
    """Sums over clauses, for each of 4 pairs of negated and reported: weights of insults, numbers of threats; and the number of targets met."""
    out = [0.0] * 9
    for clause in clauses:
        for c, m, own in clause:
            if c == INSULT:
                out[m & 3] += own
            elif c == THREAT:
                out[4 + (m & 3)] += 1
            out[8] += bool(m & AIMED)
    return out


def fitted_weights(x, y, share) -> dict[str, float]:
    """The parameters that predict y best from features x, each row counting share times, and that stay near their start if the rows
    don't say otherwise: the least logistic loss plus a square penalty, parameter by parameter."""
    import numpy as np

    names = list(PARAMETERS)

    def loss(w):
        pair = np.array([1.0, w[4], w[5], w[4] * w[5]])
        z = w[0] + w[1] * (x[:, :4] @ pair) + w[2] * (x[:, 4:8] @ pair) + w[3] * x[:, 8]
        return float((share * np.logaddexp(0, np.where(y > 0, -z, z))).sum()) + sum(((v - PARAMETERS[k][0]) / PARAMETERS[k][1]) ** 2 for k, v in zip(names, w, strict=True)) / 2

    w = [PARAMETERS[k][0] for k in names]
    for _ in range(12):
        for i, k in enumerate(names):
            low, high = PARAMETERS[k][2:]
            for _ in range(12):  # the loss has one valley in each parameter
                a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
                left, right = ([*w[:i], v, *w[i + 1 :]] for v in (a, b))
                low, high = (low, b) if loss(left) <= loss(right) else (a, high)
            w[i] = (low + high) / 2
    return dict(zip(names, w, strict=True))


def terms_of(text: str) -> Counter:
    """Words, each once, and stems as often as different words have them."""
    found = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
    out = Counter(found)
    out.update(w[:n] + "*" for w in found for n in STEM if len(w) > n)
    return out


def learned(rows: dict[str, tuple[int, int, int]], clean: int, toxic: int, documents: int) -> dict[str, float]:
    """Terms with weights from how often they stand in clean and toxic documents, and in how many toxic ones; clean and toxic: all words of either;
    documents: toxic ones."""
    import math

    terms, base = {}, toxic / max(1, clean + toxic)
    for t, (n0, n1, docs) in rows.items():
        n = n0 + n1
        gain = n1 * math.log(n1 / n / base) + (n0 * math.log(n0 / n / (1 - base)) if n0 else 0.0)
        weight = math.log((n1 + 0.5) / (toxic + 1)) - math.log((n0 + 0.5) / (clean + 1))
        if docs >= max(MIN_DOCS, MIN_SHARE * documents) and gain >= MIN_GAIN and weight >= MIN_WEIGHT:
            terms[t] = weight
    # the shortest stem stands for all that it begins
    short = {t for t in terms if not any(t[:n] + "*" in terms and terms[t[:n] + "*"] >= terms[t] - 0.7 for n in STEM if n < len(t.rstrip("*")))}
    return {t: terms[t] for t in short}


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[dict[str, float], dict[str, float]]:
    """Insult terms with weights, and the grammar's weights, from docs whose doc_id labels has.

    The sample has at most sample_docs labelled documents of each class, first by md5(doc_id); it is small enough to be
    broadcast at any input size. A doc_id labelled twice counts as toxic if any label says so; toxic is 1 for toxic, any other number for
    clean, and null labels are skipped. Without labelled documents of both classes the hand-set grammar scores alone.
    """
    import numpy as np

    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    marked = marked.withColumn("h", F.md5(F.col("doc_id").cast("string").cast("binary")))
    known = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = known.where("y = 1").orderBy("h", "doc_id").limit(sample_docs).unionByName(known.where("y = 0").orderBy("h", "doc_id").limit(sample_docs)).select("doc_id", "y")
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            c: dict[int, Counter] = {0: Counter(), 1: Counter()}
            stood: Counter = Counter()
            for y, t in zip(batch.column("y").to_pylist(), texts(batch), strict=True):
                own = terms_of((t or b"").decode("utf-8", "replace"))
                c[y].update(own)
                c[y][""] += sum(not k.endswith("*") for k in own)
                if y:
                    stood.update([*own, ""])
            keys = list(c[0] | c[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([x[k] for k in keys], pa.int64()) for x in (c[0], c[1], stood))], ["term", "n0", "n1", "docs"])

    text = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("y", "text"))
    counts = text.mapInArrow(counted, "term string, n0 bigint, n1 bigint, docs bigint").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("docs").alias("docs"))
    # a term must stand in enough toxic documents and be rare in others: this leaves some thousands
    counts = counts.where(f"term = '' or docs >= {MIN_DOCS} and n0 < n1")
    rows = {r["term"]: (r["n0"], r["n1"], r["docs"]) for r in counts.collect()}
    clean, toxic, documents = rows.pop("", (0, 0, 0))
    if not clean or not toxic:
        return {}, START
    terms = learned(rows, clean, toxic, documents)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def looked(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for batch in batches:
            x = [features(scorer.clauses((t or b"").decode("utf-8", "replace"))) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    # documents without a match are alike: at most 2 sample_docs rows
    seen = text.mapInArrow(looked, "y int, x array<double>").groupBy("y", "x").agg(F.count("*").alias("n")).collect()
    y, n = np.array([r["y"] for r in seen]), np.array([r["n"] for r in seen], float)
    times = {k: share.get(k, 0) / max(1.0, n[y == k].sum()) for k in (0, 1)}
    total = max(1, share.get(0, 0) + share.get(1, 0))
    sampled = n.sum() / total  # weights add up to the sample's size
    return terms, fitted_weights(np.array([r["x"] for r in seen]), y, n * np.array([times[int(k)] for k in y]) * sampled)


def scored(docs: DataFrame, model: tuple[dict[str, float], dict[str, float]]) -> DataFrame:
    """doc_id, score, n_clauses (clauses with a match) of every row of docs; null and empty texts score by the constant alone."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # learned from a bounded sample

    def score(batches):
        import pyarrow as pa

        scorer = Scorer(*shared.value)
        for batch in batches:
            out = [scorer.score((t or b"").decode("utf-8", "replace")) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in out], pa.float64()), pa.array([n for _, n in out], pa.int64())], ["doc_id", "score", "n_clauses"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, score double, n_clauses bigint")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses; learned from labels whose crc32(doc_id) mod folds isn't held_out.

    One row for each row of docs. Labels of absent documents teach nothing; without labels the hand-set grammar scores alone.
    """
    out = fold("doc_id", folds) == held_out
    model = fit(docs.where(~out), labels.where(~out))
    return scored(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")
