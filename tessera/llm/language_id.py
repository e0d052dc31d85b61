"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of one fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, found by the forward algorithm; a text's is the product over its words. The
probabilities are fitted by expectation-maximisation on a bounded sample of texts of known language.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, small_batches, texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Expected documents in the sample of each language.
SAMPLE_DOCS = 250
ROUNDS = 4
#: Probability of a character that no piece spells.
UNKNOWN = 1e-7
START = "▁"
#: Words are runs of letters.
WORD = re.compile(r"[^\W\d_]+")
#: Places after which sums are brought back to 1; characters of the words that are looked at at once.
RESCALE, GROUP_CHARS = 16, 1 << 20


def pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces that lower-case words can hold, with all their lower-case forms merged."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p.lower() for p in found if all(c.isalpha() or c == START for c in p)})


def words(text: bytes | None) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower()) if text else []


class Lattice:
    """Finds the pieces at every place of many words at once."""

    def __init__(self, vocabulary: list[str]):
        import numpy as np

        self.size = len(vocabulary)
        self.longest = max(map(len, vocabulary), default=1)
        # for each length, hashes of what pieces begin with, sorted, and the number of the piece that is no longer (or -1)
        self.levels = []
        for k in range(1, self.longest + 1):
            begins = {p[:k]: -1 for p in vocabulary if len(p) >= k}
            begins |= {p: i for i, p in enumerate(vocabulary) if len(p) == k}
            codes = np.frombuffer("".join(begins).encode("utf-32-le"), np.uint32).reshape(-1, k).astype(np.uint64)
            h = np.zeros(len(codes), np.uint64)
            for j in range(k):
                h = self.longer(h, codes[:, j])
            order = np.argsort(h)
            self.levels.append((h[order], np.array(list(begins.values()), np.int64)[order]))

    @staticmethod
    def longer(h, char):
        import numpy as np

        h = (h + char + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ h >> np.uint64(29)

    def of(self, words: list[str]) -> list[list[tuple]]:
        """For words of one length: [place - 1] -> the pieces that end there as (length, words, piece numbers), length by length; a character
        that is no piece has the number size."""
        import numpy as np

        n, length = len(words), len(words[0]) + 1
        chars = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), np.uint32).reshape(n, length).astype(np.uint64)
        out: list[list[tuple]] = [[] for _ in range(length)]
        row, start, h = np.repeat(np.arange(n), length), np.tile(np.arange(length), n), np.zeros(n * length, np.uint64)
        for k, (codes, numbers) in enumerate(self.levels[:length], 1):
            h = self.longer(h, chars[row, start + k - 1])
            at = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
            begins = codes[at] == h
            number = np.where(begins, numbers[at], -1)
            if k == 1:
                number[number < 0] = self.size
            ends = np.flatnonzero(number >= 0)
            ends = ends[np.argsort(start[ends], kind="stable")]
            edge = np.searchsorted(start[ends], np.arange(length + 1))
            for s in range(length - k + 1):
                mine = ends[edge[s] : edge[s + 1]]
                if len(mine):
                    out[s + k - 1].append((k, row[mine], number[mine]))
            going = begins & (start + k < length)  # what no piece begins with ends here
            row, start, h = row[going], start[going], h[going]
            if not len(row):
                break
        return out


def by_length(words: list[str]) -> list[list[int]]:
    """Indices of the words in groups of one length, of some thousand characters."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    out = []
    for length, g in groups.items():
        step = max(1, GROUP_CHARS // (length + 1))
        out += [g[i : i + step] for i in range(0, len(g), step)]
    return out


def longest_of(found: list) -> int:
    """The length of the longest piece in a lattice."""
    return max((k for pieces in found for k, _, _ in pieces), default=1)


def summed(steps, table, n: int, longest: int, keep: list | None = None):
    """The logs of the sums over all ways through a lattice, for n words and each language of the table; keep: gets them for every place.

    steps: for each place the (places back, words, piece numbers) that lead to it. Sums are brought back to 1 every RESCALE places, so
    that words may have any length.
    """
    import numpy as np

    width = table.shape[1]
    last, total = [np.ones((n, width))], np.zeros((n, width))
    if keep is not None:
        keep.append(total)
    for i, pieces in enumerate(steps, 1):
        now = np.zeros((n, width))
        for k, row, ids in pieces:
            now[row] += last[-k][row] * table[ids]
        last = [*last[1 - longest :], now] if longest > 1 else [now]
        if i % RESCALE == 0:
            total = total + np.log(now)
            last = [x / now for x in last]
        if keep is not None:
            keep.append(total + np.log(last[-1]))
    return total + np.log(last[-1])


def log_probabilities(lattice: Lattice, table, words: list[str]):
    """log P of each word under each language; table: pieces x languages, with a row for unknown characters."""
    import numpy as np

    out = np.empty((len(words), table.shape[1]))
    for group in by_length(words):
        found = lattice.of([words[i] for i in group])
        out[group] = summed(found, table, len(group), longest_of(found))
    return out


def backwards(found: list) -> list:
    """The same lattice from the words' ends: for each place back from the end, the pieces that begin there."""
    length = len(found)
    out: list[list[tuple]] = [[] for _ in range(length)]
    for i, pieces in enumerate(found, 1):
        for k, row, ids in pieces:
            out[length - i + k - 1].append((k, row, ids))
    return out


def fitted(vocabulary: list[str], words: list[str], counts, rounds: int = ROUNDS):
    """Piece probabilities (with a row for unknown characters) by expectation-maximisation on counted words of any length."""
    import numpy as np

    lattice, size = Lattice(vocabulary), len(vocabulary)
    groups = [(found, backwards(found), longest_of(found), counts[g]) for g in by_length(words) for found in (lattice.of([words[i] for i in g]),)]
    p = np.full(size + 1, 1.0 / size)
    p[size] = UNKNOWN
    for _ in range(rounds):
        expected = np.full(size, 0.01)  # no piece becomes impossible
        for found, back, longest, n in groups:
            alpha, beta = [], []
            every = summed(found, p[:, None], len(n), longest, alpha)
            summed(back, p[:, None], len(n), longest, beta)
            for i, pieces in enumerate(found, 1):
                for k, row, ids in pieces:
                    share = np.exp(alpha[i - k][row, 0] + beta[len(found) - i][row, 0] - every[row, 0]) * p[ids] * n[row]
                    expected += np.bincount(ids, share, size + 1)[:size]
        p[:size] = expected / expected.sum()
    return p


def fit(docs: DataFrame, path: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], list[str], object]:
    """Languages, vocabulary and the table pieces x languages, learned from text and lang of docs.

    Rows with null text or lang teach nothing. The sample has sample_docs documents of a language as expected value: those
    whose crc32 falls below a threshold that follows from the language's row count; each language's model is fitted in a task
    of its own over the sample's distinct words.
    """
    import numpy as np
    import pandas as pd

    known = docs.select(F.col("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    vocabulary = pieces(path)
    if not n:
        return [], vocabulary, np.zeros((len(vocabulary) + 1, 0))
    share = F.create_map(*[F.lit(x) for lang, c in n.items() for x in (lang, min(1.0, sample_docs / c))])
    sample = known.where(F.crc32(F.concat(F.lit("sample "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")) < share[F.col("lang")] * 2.0**32)

    def counted(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            c: Counter = Counter()
            for lang, t in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                c.update((lang, w) for w in words(t))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        p = fitted(vocabulary, group["word"].tolist(), group["n"].to_numpy(float))
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "p": [p.astype("float64").tobytes()]})

    rows = sample.select("lang", "text").mapInArrow(counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).groupBy("lang").applyInPandas(learn, "lang string, p binary").collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    uniform = np.r_[np.full(len(vocabulary), 1.0 / len(vocabulary)), UNKNOWN]
    langs = sorted(n)
    have = {r["lang"]: np.frombuffer(r["p"]) for r in rows}
    return langs, vocabulary, np.stack([have.get(x, uniform) for x in langs], axis=1)


def has_letter(text: str):
    """Whether a text has a letter, as identified() sees it; false for null."""
    from pyspark.sql.functions import udf

    return F.coalesce(udf(lambda t: any(c.isalpha() for w in words((t or "").encode()) for c in w), "boolean")(text), F.lit(False))


def identified(docs: DataFrame, model: tuple) -> DataFrame:
    """Per row of docs: all its columns, then __lang_pred and __score (the posterior under equal priors).

    Null texts and texts without a letter get und and score 0, as do all texts if the model has no language. Columns
    of docs by those two names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("__lang_pred", "__score")
    names = docs.columns
    shared = spark.sparkContext.broadcast(model)  # vocabulary x languages, both fixed

    def predict(batches):
        import numpy as np
        import pyarrow as pa

        langs, vocabulary, table = shared.value
        lattice, place, rows = Lattice(vocabulary), {}, np.zeros((0, len(langs)))
        for batch in batches:
            per = [words(t) for t in texts(batch)]
            if len(place) > 300_000:
                place, rows = {}, np.zeros((0, len(langs)))
            new = list({w for ws in per for w in ws if w not in place})
            if new:
                place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                rows = np.concatenate([rows, log_probabilities(lattice, table, new)])
            pred, score = [], []
            for ws in per:
                if not langs or not any(c.isalpha() for w in ws for c in w):
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = rows[[place[w] for w in ws]].sum(axis=0)
                best = int(total.argmax())
                pred.append(langs[best])
                score.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "__lang_pred", "__score"])

    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, T.StructField("__lang_pred", T.StringType()), T.StructField("__score", T.DoubleType())]))


def language_id(docs: DataFrame, path: str = VOCABULARY, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents whose crc32(doc_id) mod folds isn't held_out."""
    out = fold("doc_id", folds) == held_out
    model = fit(docs.where(~out), path)
    return identified(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))
