"""LM scoring by a probabilistic suffix tree over words.

The tree's nodes are contexts of up to DEPTH words. A context is a candidate if it stands LEAST times in the training texts, whatever their
size, so that the tree grows with the input. It stays if its next-word counts diverge from what its longest kept suffix predicts: each
occurrence, predicted from the others, must gain GAIN nats in all. A kept context's distribution is smoothed towards that suffix's, and a
token is scored by the longest kept context before it. The root is the smoothed unigram model.

Texts lie in blocks, contexts in shards. Blocks ask shards for the counts of their distinct words, then send each token, with the words before
it, to the shard of the last of these: there the whole subtree of that word is grown and its tokens are scored. A context that more
tokens follow than a block holds is split: its next words are counted by shards of their own, and its tokens go on to the shards of
contexts one word longer.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ASK, BLOCK_BYTES, by_block, pack, packed_blocks, pieces, sorted_names, table_of, unpack, unpacked_block
from .common import fold, mixed, stored, word_names

DEPTH = 4
#: Times that a candidate stands in the training texts.
LEAST = 2
#: Nats that a context must gain over its longest kept suffix.
GAIN = 2.0
#: Names beside the 64-bit names of words: a text's end, what stands before its start, and a word too rare to be part of a context.
END, START, NONE = 0, 1, 2
#: Numbers of words, where words go by numbers instead of names, begin after those. Powers of 2 that counts may have.
FIRST, POWERS = 3, 50
#: Bits of a word's number.
NUMBER_BITS = 40
#: Logs are sent in steps of 1 / STEPS.
STEPS = 2048
#: A context that stands more often than this many times a shard's average number of tokens is split.
HOT = 1
#: Parts of a shard that are grown one after another; a power of 2.
PARTS = 8


def zigzag(x):
    """Whole numbers of either sign as small ones of none; x >> 1 ^ -(x & 1) restores them."""
    return x << 1 ^ x >> 63


def extended(context, word):
    """The name of a context and one more, later word; equally that of a context and its next word."""
    import numpy as np

    return mixed(context * np.uint64(0x9E3779B97F4A7C15) + mixed(word + np.uint64(0x632BE59BD9B4E019)))


def context_name(before: list, d: int):
    """The name of the context of the last d words; before: arrays of the last word, the one before it and so on."""
    import numpy as np

    name = np.zeros(len(before[0]), np.uint64)
    for w in reversed(before[:d]):
        name = extended(name, w.astype(np.uint64))
    return name


def tokens(batch: list) -> tuple:
    """(text number, token, place in the text) of all tokens of the texts, each text's words and then its end."""
    import numpy as np

    names, begin, end = word_names([t.lower() if t else b"" for t in batch])
    n = end - begin + 1
    text = np.repeat(np.arange(len(batch)), n)
    token = np.zeros(len(text), np.uint64)
    last = np.cumsum(n) - 1
    inner = np.ones(len(text), bool)
    inner[last] = False
    token[inner] = names
    return text, token, np.arange(len(text)) - np.repeat(last - n + 1, n)


def words_before(number, place, depth: int) -> list:
    """The numbers of the word before each token, of the one before that and so on; START where there is none."""
    import numpy as np

    out = []
    for k in range(1, depth + 1):
        w = np.full(len(number), START, np.int64)
        w[k:] = np.where(place[k:] >= k, number[:-k], START)
        out.append(w)
    return out


class Keys:
    """The distinct keys of an array by shard and key: key, shard, and at, which of them each place has."""

    def __init__(self, keys, shards: int):
        import numpy as np
        import pandas as pd

        at, key = pd.factorize(keys)
        shard = (mixed(key + np.uint64(7)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((key, shard))
        place = np.empty(len(key), np.int64)
        place[order] = np.arange(len(key))
        self.key, self.shard, self.at = key[order], shard[order], place[at]

    def sums(self, weight):
        import numpy as np

        return np.bincount(self.at, weight, len(self.key)).astype(np.int64)

    def one(self, values):
        """The value of each key, which is the same wherever the key stands."""
        import numpy as np

        out = np.zeros(len(self.key), values.dtype)
        out[self.at] = values
        return out


def shard_of(name, shards: int):
    import numpy as np

    return (mixed(name + np.uint64(7)) % np.uint64(shards)).astype(np.int64)


def summed(messages: list) -> tuple:
    """(key, count, which key each message's entries are) of messages (names, counts, ...), keys in order."""
    import numpy as np
    import pandas as pd

    names = [np.cumsum(m[0], dtype=np.uint64) for m in messages]
    at, key = pd.factorize(np.concatenate(names))
    order = np.argsort(key)
    place = np.empty(len(key), np.int64)
    place[order] = np.arange(len(key))
    at = place[at]
    n = np.bincount(at, np.concatenate([m[1] for m in messages]), len(key)).astype(np.int64)
    return key[order], n, np.split(at, np.cumsum([len(x) for x in names])[:-1])


def gained(n, p, m, kinds):
    """Nats that occurrences gain if each is predicted from the others of its context; n, p: of the entry, m, kinds: of its context."""
    import numpy as np

    return n * np.log(((n - 1) + kinds * p) / (m - 1 + kinds) / p)


def power_of(n):
    """The power of 2 at or below each count; 0 for 0."""
    import numpy as np

    return np.frexp(np.maximum(n, 1).astype(np.float64))[1].astype(np.int64) - 1


class Model:
    """What is known so far: totals, and by depth the contexts that are split: their sorted names, m, kinds and whether they stay."""

    def __init__(self, shards: int, depth: int, least: int, gain: float):
        self.shards, self.depth, self.least, self.gain = shards, depth, least, gain
        self.total = self.vocabulary = 0
        self.split: list[tuple] = []
        self.begin = self.bound = None

    def number_words(self, sizes) -> None:
        """Numbers words by the power of 2 below their count, frequent ones first, then by shard; sizes: words of each shard and power."""
        import numpy as np

        each = np.array(sizes, np.int64).reshape(-1, POWERS)[:, ::-1].T  # by falling power, then by shard
        begin = np.cumsum(each.ravel()).reshape(each.shape) - each + FIRST
        self.begin = begin[::-1]  # of each power and shard the first number
        self.bound = np.append(begin[:, 0], FIRST + each.sum())  # of each falling power the first number

    def counts(self, number, rest):
        """Words' counts from their numbers and what their counts exceed the power of 2 by; 0 for NONE."""
        import numpy as np

        power = POWERS - np.searchsorted(self.bound, number, "right")
        return np.where(number >= FIRST, (1 << np.clip(power, 0, POWERS - 1)) + rest, 0)

    def find(self, d: int, name):
        """Whether contexts of d words are split, and their places."""
        import numpy as np

        names = self.split[d - 1][0]
        at = np.minimum(np.searchsorted(names, name), len(names) - 1)
        return names[at] == name, at

    def known(self, token, place, answers: list) -> tuple:
        """(level, p, count, number, the numbers of the words before) of each token: level says how many words of context are split and accounted
        for in p; a word without number is NONE. answers: by level, what shards say of the distinct entries."""
        import numpy as np

        words = Keys(token, self.shards)
        c, at = answers[0]
        number = np.where(c > 0, self.begin[power_of(c), words.shard] + at, NONE)[words.at]
        c = c[words.at]
        before = words_before(number, place, self.depth)
        p = (c + 1.0) / (self.total + self.vocabulary + 1.0)
        level = np.zeros(len(token), np.int64)
        here = np.arange(len(token))
        for d in range(1, len(answers)):
            here, at = self.follow(here, before, d)
            entry, known = self.entries(at, number[here])
            n = np.zeros(len(here), np.int64)
            n[known] = answers[d][0][Keys(entry, self.shards).at]
            _, m, kinds, stays = self.split[d - 1]
            p[here] = np.where(stays[at], (n + kinds[at] * p[here]) / (m[at] + kinds[at]), p[here])
            level[here] = d
        return level, p, c, number, before

    def follow(self, here, before: list, d: int) -> tuple:
        """Those of the places here at which the context of d words is split, and which one it is."""
        found, at = self.find(d, context_name([w[here] for w in before], d))
        return here[found], at[found]

    @staticmethod
    def entries(at, number) -> tuple:
        """(the names of a context's places and next words, as far as these have numbers; which have)."""
        import numpy as np

        known = np.flatnonzero(number != NONE)
        return (at[known] << NUMBER_BITS | number[known]).astype(np.uint64), known


def grown(train, level, p, token, before: list, model: Model):
    """p of each token by the longest kept context; the tokens are all that follow these contexts. Words go by numbers, NONE being one that stands
    too rarely for a context, or, as a token, never in training."""
    import numpy as np
    import pandas as pd

    p, alive = p.copy(), np.ones(len(token), bool)
    for d in range(1, model.depth + 1):
        alive &= (level >= d) | (before[d - 1] != NONE)
        here = np.flatnonzero(alive & (level < d))
        context, _ = pd.factorize(context_name([w[here] for w in before], d))
        m = np.bincount(context, train[here])
        often = m[context] >= model.least
        alive[here[~often]] = False
        here, context = here[often], context[often]
        if not len(here):
            continue
        context, _ = pd.factorize(context)
        m = np.bincount(context, train[here])
        entry = extended(context.astype(np.uint64), token[here].astype(np.uint64))
        rare = token[here] == NONE  # an entry of its own each time
        entry[rare] = mixed(np.arange(int(rare.sum()), dtype=np.uint64) + np.uint64(1 << 62))
        entry, kinds_of = pd.factorize(entry)
        size = len(kinds_of)
        n = np.bincount(entry, train[here], size)
        of, base = np.empty(size, np.int64), np.empty(size)
        of[entry], base[entry] = context, p[here]
        seen = n > 0
        kinds = np.bincount(of[seen], minlength=len(m))
        gain = np.bincount(of[seen], gained(n[seen], base[seen], m[of[seen]], kinds[of[seen]]), len(m))
        p[here] = np.where(gain[of] >= model.gain, (n + kinds[of] * base) / (m[of] + kinds[of]), base)[entry]
    return p


OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double"


def read_block(data: bytes) -> tuple:
    """(ids, held out, text number, token, place) of a block."""
    import numpy as np

    columns, held = unpacked_block(data)
    return columns["doc_id"], np.array(columns["held_out"], bool), *tokens(held)


def training_tokens(columns: dict, held: list) -> int:
    import numpy as np

    _, begin, end = word_names(held)
    return int((end - begin + 1)[~np.array(columns["held_out"], bool)].sum())


def in_order(rows: list, level: int) -> list:
    """The answers to a block at a level, by shard: counts, and at level 0 ranks."""
    import numpy as np

    found = [unpack(x) for _, x in sorted((r["shard"], r["data"]) for r in rows if r["level"] == level)]
    return [np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(1 if level else 2)]


def asked(blocks: DataFrame, told: DataFrame | None, model: Model) -> DataFrame:
    """Each block's distinct entries of the next level, by shard: at level 0 its words, then what follows the split contexts."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)  # as many split contexts a level as shards, at most

    def ask(block, data, rows):
        import numpy as np

        model = shared.value
        d = len(model.split)
        _, out, text, token, place = read_block(data)
        train = (~out[text]).astype(np.float64)
        if not d:
            keys = Keys(token, model.shards)
            n = keys.sums(train)
            return [(block, s, d, 0, pack(sorted_names(keys.key[x]), n[x])) for s, x in pieces(keys.shard)]
        _, p, _, number, before = model.known(token, place, [in_order(rows, k) for k in range(d)])
        here, at = np.arange(len(token)), None
        for k in range(1, d + 1):
            here, at = model.follow(here, before, k)
        entry, known = model.entries(at, number[here])
        here = here[known]
        keys = Keys(entry, model.shards)
        n, base = keys.sums(train[here]), keys.one(steps(p[here]))
        return [(block, s, d, 0, pack(sorted_names(keys.key[x]), n[x], base[x])) for s, x in pieces(keys.shard)]

    return by_block(blocks, told, ask)


def answered(ask: DataFrame, limit: int) -> DataFrame:
    """Of kind 0 the counts for each block and shard in the order of its entries, and at level 0 words' places among those of their shard and power;
    from each shard, of kind 1, at level 0 its words by power, the entries that stand limit times or more and their counts, and how often a text ends;
    of kind 2, at other levels, its entries."""

    def answer(group):
        import numpy as np

        shard, level = group.column("shard")[0].as_py(), group.column("level")[0].as_py()
        messages = [unpack(x.as_py()) for x in group.column("data")]
        key, n, at = summed(messages)
        often = np.flatnonzero(n >= limit)
        if level:
            base = np.zeros(len(key), np.int64)
            for x, message in zip(at, messages, strict=True):
                base[x] = message[2]
            seen = n > 0
            more = [(-1, shard, level, 1, pickle.dumps((None, key[often], n[often], 0))), (-1, shard, level, 2, pack(sorted_names(key[seen]), n[seen], base[seen]))]
            told = [(n[x],) for x in at]
        else:
            power = np.where(n > 0, power_of(n), POWERS)
            order = np.argsort(power, kind="stable")
            place = np.zeros(len(key), np.int64)
            place[order] = np.arange(len(key)) - np.searchsorted(power[order], power[order])
            hot = often[key[often] != END]
            more = [(-1, shard, level, 1, pickle.dumps((np.bincount(power, minlength=POWERS + 1)[:POWERS], place[hot], n[hot], int(n[key == END].sum()))))]
            told = [(n[x], place[x]) for x in at]
        return table_of([*((b.as_py(), shard, level, 0, pack(*x)) for b, x in zip(group.column("block"), told, strict=True)), *more])

    return stored(ask.groupBy("shard").applyInArrow(answer, ASK))


def of_contexts(told: DataFrame, size: int, work) -> list:
    """The sums, for each of a level's split contexts, of what work(context, n, base) says of the entries of each shard."""
    import numpy as np

    def run(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                key, n, base = unpack(data)
                context = (np.cumsum(key, dtype=np.uint64) >> np.uint64(NUMBER_BITS)).astype(np.int64)
                value = np.bincount(context, work(context, n, 2.0 ** (-base / STEPS)), size)
                own = np.unique(context)
                yield from table_of(list(zip(own.tolist(), value[own].tolist(), strict=True)), "context bigint, value double").to_batches()

    out = np.zeros(size)
    for r in told.where("kind = 2").mapInArrow(run, "context bigint, value double").groupBy("context").agg(F.sum("value").alias("value")).collect():  # a row a context
        out[r["context"]] = r["value"]
    return out


def steps(p):
    """Probabilities as numbers of steps."""
    import numpy as np

    return np.rint(-np.log2(p) * STEPS).astype(np.int64)


def split_contexts(blocks: DataFrame, model: Model) -> DataFrame:
    """Counts words, then, length by length, what follows contexts with more than HOT times the tokens of a shard. Returns the answers to the blocks."""
    import numpy as np

    def summaries(told: DataFrame) -> dict:
        return {r["shard"]: pickle.loads(r["data"]) for r in told.where("kind = 1").select("shard", "data").collect()}

    model.total = blocks.agg(F.sum("weight")).first()[0] or 0
    limit = max(1, HOT * model.total // model.shards)
    told = answered(asked(blocks, None, model), limit)
    said = summaries(told)
    model.number_words([said[s][0] if s in said else [0] * POWERS for s in range(model.shards)])
    model.vocabulary, ends = int(sum(x[0].sum() for x in said.values())), sum(x[3] for x in said.values())
    frequent = [(model.begin[power_of(n), s] + place, n) for s, (_, place, n, _) in said.items()]
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    number, m = (np.concatenate(x).astype(np.int64) for x in zip(none, *frequent, strict=True))
    name, start = extended(np.zeros(len(number), np.uint64), number.astype(np.uint64)), np.zeros(1, np.uint64)
    answers = told.where("kind = 0")
    for d in range(1, model.depth + 1):
        start = extended(start, np.full(1, START, np.uint64))
        if ends >= limit:
            name, m = np.r_[name, start], np.r_[m, ends]
        if not len(name):
            break
        order = np.argsort(name)
        name, m = name[order], m[order]
        model.split.append((name, m, None, None))
        told = answered(asked(blocks, answers, model), limit)
        kinds = of_contexts(told, len(name), lambda context, n, base: np.ones(len(n))).astype(np.int64)
        gain = of_contexts(told, len(name), lambda context, n, base, m=m, kinds=kinds: gained(n, base, m[context], kinds[context]))
        model.split[-1] = (name, m, kinds, gain >= model.gain)
        frequent = [(key, n) for _, key, n, _ in summaries(told).values()]
        entry, m = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), none[0]), *frequent, strict=True))
        name = extended(name[(entry >> np.uint64(NUMBER_BITS)).astype(np.int64)], entry & np.uint64((1 << NUMBER_BITS) - 1))
        answers = answers.unionByName(told.where("kind = 0"))
    return answers


def sent(block: int, data: bytes, rows: list, model: Model) -> list:
    """A block's tokens as messages to shards, and, of kind 1, what it knows of its texts itself."""
    import numpy as np

    ids, out, text, token, place = read_block(data)
    level, p, c, number, every = model.known(token, place, [in_order(rows, k) for k in range(len(model.split) + 1)])
    # a context with a rare word isn't a candidate, nor is a longer one
    frequent = words_before(np.where(c >= model.least, number, NONE), place, model.depth)
    before, going = [], np.ones(len(token), bool)
    for w in frequent:
        going &= w != NONE
        before.append(np.where(going, w, NONE))
    following, to = np.full(len(token), NONE, np.int64), np.zeros(len(token), np.int64)
    for d in range(model.depth):
        mine = np.flatnonzero(level == d)
        following[mine] = before[d][mine]
        to[mine] = shard_of(context_name([w[mine] for w in every], d + 1), model.shards)
    there, here = np.flatnonzero(following == NONE), np.flatnonzero(following != NONE)
    final = np.bincount(text[there], np.log10(p[there]), len(ids)).astype(np.float64)
    logs, n = np.bincount(text, np.log10(c + 1.0), len(ids)), np.bincount(text, minlength=len(ids))
    known = np.bincount(text, c > 0, len(ids)).astype(np.int64)
    found = [(block, block % model.shards, 0, 1, pickle.dumps((ids, out, n, known, logs, final)))]
    # by shard and last word, then as they stand
    here = here[np.lexsort((before[0][here], to[here]))]
    to, number, before, level, text = to[here], number[here], [w[here] for w in before], level[here], text[here]
    # what the count exceeds its power of 2 by, or p, if that comes from a split context
    more = np.where(level > 0, steps(p[here]), np.where(c[here] > 0, c[here] - (1 << power_of(c[here])), 0))
    for s, x in pieces(to):
        who = text[x]
        last, *rest = (w[x] for w in before)
        found.append((block, s, 0, 0, pack(zigzag(np.diff(who, prepend=0)), np.packbits(~out[who]), level[x], number[x], more[x], np.diff(last, prepend=0), *rest)))
    return found


def shard_scores(group, model: Model):
    """The sums of log10 p by text for each message of a shard; rows of kind 1 pass."""
    import numpy as np

    rows, parts, held = [], [], []
    for block, shard, level, kind, data in zip(*(group.column(i).to_pylist() for i in range(5)), strict=True):
        if kind:
            rows.append((block, shard, level, kind, data))
            continue
        who, train, at, token, more, last, *rest = unpack(data)
        p = np.where(at > 0, 2.0 ** (-more / STEPS), (model.counts(token, more) + 1.0) / (model.total + model.vocabulary + 1.0))
        before = [np.cumsum(last), *rest]
        small = np.uint32 if model.bound[-1] < 1 << 32 else np.uint64
        parts.append((np.unpackbits(train.astype(np.uint8), count=len(who)).astype(bool), at.astype(np.int8), p, token.astype(small), *(w.astype(small) for w in before)))
        held.append((block, shard, np.cumsum(who >> 1 ^ -(who & 1)).astype(np.int32)))
    if parts:
        train, level, p, token, *before = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        # contexts that nothing but their shard has in common are grown one part after another
        part = np.empty(len(token), np.int8)
        for d in range(model.depth):
            mine = np.flatnonzero(level == d)
            part[mine] = context_name([w[mine] for w in before], d + 1) >> np.uint64(40) & np.uint64(PARTS - 1)
        for k in range(PARTS):
            x = np.flatnonzero(part == k)
            p[x] = np.log10(grown(train[x], level[x], p[x], token[x], [w[x] for w in before], model))
        for (block, shard, who), mine in zip(held, np.split(p, np.cumsum([len(x[2]) for x in held])[:-1]), strict=True):
            ids, at = np.unique(who, return_inverse=True)
            rows.append((block, shard, 0, 0, pack(np.diff(ids.astype(np.int64), prepend=0), np.rint(-np.bincount(at, mine) * STEPS).astype(np.int64))))
    return table_of(rows)


def added(group):
    """The rows of a block's texts from the messages of all shards."""
    import numpy as np

    rows = group.to_pylist()
    out = []
    ids, held, n, known, logs, total = pickle.loads(next(r["data"] for r in rows if r["kind"]))
    for r in sorted((r for r in rows if not r["kind"]), key=lambda r: r["shard"]):
        who, score = unpack(r["data"])
        total[np.cumsum(who)] -= score / STEPS
    for row in zip(ids, held.tolist(), n.tolist(), known.tolist(), logs.tolist(), total.tolist(), strict=True):
        out.append(row)
    return table_of(out, OUT)


def suffix_tree_scores(docs: DataFrame, folds: int = 7, held_out: int = 2, depth: int = DEPTH, least: int = LEAST, gain: float = GAIN, block_bytes: int = BLOCK_BYTES, shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    The tree and the token counts come from the rows whose crc32(doc_id) mod folds isn't held_out (a null doc_id counts as the text 'null').
    Null and empty texts have one token, the end. Repeated rows count each time. Other columns are not read. A word of any length is one token.
    Without training texts every token has probability 1. Words and contexts go by 64-bit names.
    """
    spark = docs.sparkSession
    out = fold("doc_id", folds) == held_out
    blocks = packed_blocks(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", out.alias("held_out")), block_bytes, training_tokens)
    model = Model(shards or max(8, blocks.count()), depth, least, gain)
    told = split_contexts(blocks, model)
    shared = spark.sparkContext.broadcast(model)
    messages = by_block(blocks, told, lambda block, data, rows: sent(block, data, rows, shared.value))
    sums = messages.groupBy("shard").applyInArrow(lambda group: shard_scores(group, shared.value), ASK)
    scored = sums.groupBy("block").applyInArrow(added, OUT)
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(model.total + model.vocabulary + 1.0))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
