"""Scoring texts with a weighted backoff automaton over word bigrams.

The model interpolates bigrams under absolute discounting with add-one unigrams.
A word (or the start of a text) that occurs in training before some token is a
state. Each of its seen continuations is an arc with the smoothed
log-probability; a failure arc with the log of the state's backoff weight leads
to the root, which has an arc for every word, unknown ones included. A text is
read once from left to right: the walk carries the state, takes a failure arc
where the word has no arc, and adds up what the arcs weigh.

Nothing of the model is collected or broadcast. Documents are dealt by a hash
into parts of bounded size. Each part asks for what its texts need: its distinct
bigrams and words, together with how often its training rows have them. Requests
go, packed per part and shard of the keys, to the shard's task, which adds up the
counts of all parts and sends each part its totals in the order it asked. Out of
these a part builds the states and arcs that its texts can reach, and walks. So
memory follows the size of a part or a shard, never that of the corpus, and the
counts cover all training rows.

Bigrams go by a hash of both words, so a word that is a third of all tokens is
spread too. Of the parts that have a bigram in training rows its shard names one
its owner; each part counts the bigrams it owns by context, and these counts,
added up with those of the words, give each context's number of continuations.
Keys are XXH64 hashes of words, and 64-bit mixes of two of them for bigrams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quillmap.llm.text import encode

#: Keys of the start of a text, a context but no token, and of its end.
START, END = 1, 2

_MIX = np.uint64(0x9E3779B97F4A7C15)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct word keys of some texts, END and START last; each token's place
    among them, a text ending with END; and the number of tokens of each text."""
    raw = [encode(t) for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = np.frombuffer(b" ".join((b"", *raw, b"")).lower(), np.uint8)
    space = _SPACE[data]
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    n = np.diff(np.searchsorted(first, np.concatenate(([0], np.cumsum(size))), "left")) if raw else size
    ends = np.concatenate(([0], np.cumsum(last - first)))
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data[~space])]).dictionary_encode()
    keys = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    n = n + 1
    at = np.full(int(n.sum()), len(keys), np.int64)
    inside = np.ones(len(at), bool)
    inside[np.cumsum(n) - 1] = False
    at[inside] = words.indices.to_numpy(zero_copy_only=False)
    return np.concatenate((keys, np.array([END, START], np.uint64))), at, n


def before(at: np.ndarray, n: np.ndarray, start: int) -> np.ndarray:
    """The token before each token; ``start`` at the first of a text."""
    back = np.empty_like(at)
    back[1:] = at[:-1]
    back[np.cumsum(n) - n] = start
    return back


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    x = keys * _MIX
    return ((x ^ (x >> np.uint64(29))) * _MIX >> np.uint64(33)).astype(np.int64) % shards


def deltas(keys: np.ndarray) -> bytes:
    """Sorted keys as their packed differences."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).tobytes(), 1)


def sorted_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.uint64), dtype=np.uint64)


def squeeze(numbers: np.ndarray) -> bytes:
    """Counts, most of which fit a byte; the others stand behind."""
    small = zlib.compress(np.minimum(numbers, 255).astype(np.uint8).tobytes(), 1)
    return len(small).to_bytes(4, "little") + small + numbers[numbers >= 255].astype(np.int64).tobytes()


def numbers(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    out = np.frombuffer(zlib.decompress(packed[4 : 4 + n]), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(packed, np.int64, offset=4 + n) if len(packed) > 4 + n else np.zeros(0, np.int64)
    return out


def dealt(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each shard, in order within it."""
    by = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    found, first = np.unique(shard[by], return_index=True)
    yield from zip(found.tolist(), np.split(by, first[1:]))


class Part:
    """The texts of a part as tokens, numbered in the order of their keys; its distinct
    bigrams as context * width + word; and the training counts of both."""

    def __init__(self, texts: list[str | None], train: np.ndarray, shards: int):
        keys, at, self.n = tokens(texts)
        order = np.argsort(keys)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.keys, self.at, self.start, self.shards = keys[order], rank[at], int(rank[-1]), shards
        self.width = len(keys)
        learned = np.repeat(train, self.n)
        self.word_count = np.bincount(self.at[learned], minlength=self.width)
        # the training mark rides in the lowest bit, so that one plain sort counts both
        marked = np.sort((before(self.at, self.n, self.start) * self.width + self.at) * 2 + learned)
        pairs = marked >> 1
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        self.pairs = pairs[first]
        self.pair_count = np.add.reduceat(marked & 1, first) if len(first) else first

    def bigram_places(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard the places of its bigrams, in the order of their keys, and those."""
        context, word = (self.keys[x] for x in np.divmod(self.pairs, self.width))
        key = (context * _MIX + word) * _MIX
        key ^= key >> np.uint64(32)
        order = np.argsort(key)
        for shard, i in dealt(shard_of(key[order], self.shards)):
            yield shard, order[i], key[order[i]]

    def word_places(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for shard, i in dealt(shard_of(self.keys, self.shards)):
            yield shard, i, self.keys[i]

    def contexts(self) -> np.ndarray:
        return self.pairs // self.width


REQUEST = "part int, shard int, word binary, freq binary, kinds binary, sums binary"
ANSWER = "part int, shard int, kind string, total binary, kinds binary, sums binary, tokens long, words long"


def _asked(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "shard", "word", "freq", "kinds", "sums"])


def _ask_bigrams(part: Part, number: int) -> pd.DataFrame:
    return _asked([(number, s, deltas(k), squeeze(part.pair_count[i]), None, None) for s, i, k in part.bigram_places()])


def _bigram_totals(part: Part, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training count of each bigram of a part, and whether the part owns it."""
    got = {int(s): x for s, k, x in zip(answers["shard"], answers["kind"], answers["total"]) if k == "bigram"}
    total = np.zeros(len(part.pairs), np.int64)
    for s, i, _ in part.bigram_places():
        total[i] = numbers(got[s])
    return total >> 1, total & 1


def _ask_words(part: Part, number: int, answers: pd.DataFrame) -> pd.DataFrame:
    """Words of a part: counts, and what it adds to them as contexts."""
    _, owned = _bigram_totals(part, answers)
    context = part.contexts()
    kinds = np.bincount(context, owned, part.width).astype(np.int64)
    sums = np.bincount(context, part.pair_count, part.width).astype(np.int64)
    return _asked([(number, s, deltas(k), squeeze(part.word_count[i]), squeeze(kinds[i]), squeeze(sums[i])) for s, i, k in part.word_places()])


def _answers(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "shard", "kind", "total", "kinds", "sums", "tokens", "words"])


def _answer_bigrams(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each part, in the order it asked, twice the total of each bigram, and one more for its owner."""
    # in a fixed order, so that a task that runs again names the same owners
    pdf = pdf.sort_values("part", ignore_index=True)
    keys = [sorted_keys(x) for x in pdf["word"]]
    ends = np.cumsum([len(x) for x in keys])
    keys, count = np.concatenate(keys), np.concatenate([numbers(x) for x in pdf["freq"]])
    by = np.argsort(keys, kind="stable")
    ordered, learned = keys[by], count[by]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    total = np.add.reduceat(learned, first)
    owner = np.minimum.reduceat(np.where(learned > 0, np.arange(len(by)), len(by)), first)
    reply = 2 * np.repeat(total, np.diff(np.append(first, len(by))))
    reply[owner[owner < len(by)]] += 1
    each = np.empty_like(reply)
    each[by] = reply
    shard = int(pdf["shard"].iat[0])
    return _answers([(int(p), shard, "bigram", squeeze(x), None, None, None, None) for p, x in zip(pdf["part"], np.split(each, ends[:-1]))])


def _answer_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each part, in the order asked: counts of words, then continuations and counts as
    contexts; in part -1 the number of tokens and of distinct words in training here."""
    shard = int(pdf["shard"].iat[0])
    keys = [sorted_keys(x) for x in pdf["word"]]
    own, place = np.unique(np.concatenate(keys), return_inverse=True)
    places = np.split(place, np.cumsum([len(x) for x in keys])[:-1])
    sums = {c: np.zeros(len(own), np.int64) for c in ("freq", "kinds", "sums")}
    for c, out in sums.items():
        for at, x in zip(places, pdf[c]):
            out[at] += numbers(x)
    out = [(int(p), shard, "word", *(squeeze(x[at]) for x in sums.values()), None, None) for p, at in zip(pdf["part"], places)]
    return _answers([*out, (-1, shard, "size", None, None, None, int(sums["freq"].sum()), int((sums["freq"] > 0).sum()))])


class Automaton:
    """State -1 is the root; the others are contexts, under the number of their word.

    ``arcs[state * width + word]`` is the log-probability of an arc, ``fail`` the
    weight of each state's failure arc to the root, ``root`` that of the root's
    arcs, and ``after`` the state behind each word.
    """

    def __init__(self, part: Part, pair_total, word_total, kinds, sums, discount: float, tokens_: int, vocabulary: int):
        p_word = (word_total + 1.0) / (tokens_ + vocabulary + 1.0)
        self.width, self.root = part.width, np.log10(p_word).tolist()
        state = np.where(sums > 0, np.arange(part.width), -1)
        self.after, self.first = state.tolist(), int(state[part.start])
        total = np.maximum(sums, 1)
        backoff = np.where(sums > 0, discount * kinds / total, 1.0)
        self.fail = np.log10(np.where(backoff > 0, backoff, 1.0)).tolist()
        seen = np.flatnonzero(pair_total > 0)
        context, word = np.divmod(part.pairs[seen], part.width)
        p = (pair_total[seen] - discount) / total[context] + backoff[context] * p_word[word]
        self.arcs = dict(zip(part.pairs[seen].tolist(), np.log10(p).tolist()))

    def walk(self, text: list[int]) -> float:
        score, state, width = 0.0, self.first, self.width
        arc_of, fail, root, after = self.arcs.get, self.fail, self.root, self.after
        for word in text:
            if state >= 0:
                arc = arc_of(state * width + word)
                score += fail[state] + root[word] if arc is None else arc
            else:
                score += root[word]
            state = after[word]
        return score


def _score(part: Part, ids: list, held: list, answers: pd.DataFrame, discount: float) -> pd.DataFrame:
    tokens_, vocabulary = int(answers["all_tokens"].iat[0]), int(answers["all_words"].iat[0])
    pair_total, _ = _bigram_totals(part, answers)
    words = answers[answers["kind"] == "word"]
    got = {int(s): x for s, *x in zip(words["shard"], words["total"], words["kinds"], words["sums"])}
    word_total, kinds, sums = (np.zeros(part.width, np.int64) for _ in range(3))
    for s, i, _ in part.word_places():
        word_total[i], kinds[i], sums[i] = map(numbers, got[s])
    auto = Automaton(part, pair_total, word_total, kinds, sums, discount, tokens_, vocabulary)
    first = np.cumsum(part.n) - part.n
    base = np.add.reduceat(np.asarray(auto.root)[part.at], first)
    known = np.add.reduceat((word_total > 0).astype(np.int64)[part.at], first)
    score = [auto.walk(part.at[i : i + n].tolist()) for i, n in zip(first.tolist(), part.n.tolist())]
    return pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": part.n, "n_known": known, "train_tokens": tokens_, "base_score": base, "score": score})


def score(docs: DataFrame, train: Column, discount: float = 0.75, part_bytes: int = 6 << 20) -> DataFrame:
    """Score the whole text of every row of ``docs`` (doc_id, text).

    ``train`` marks the rows to learn from; all others are held out. Returns
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams) and score, both log10. A null text counts as empty: its end is
    its only token. Rows that repeat an id are scored one by one and learned
    from as often; a null id is kept. Without training rows all scores are 0.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    # ids go as text: pandas would make a column of longs with nulls one of doubles
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), train.alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // part_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shards = parts
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))

    def read(pdf: pd.DataFrame) -> Part:
        return Part(pdf["text"].tolist(), pdf["train"].to_numpy(bool), shards)

    def ask_bigrams(pdf: pd.DataFrame) -> pd.DataFrame:
        return _ask_bigrams(read(pdf), int(pdf["part"].iat[0]))

    def ask_words(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _ask_words(read(pdf), int(pdf["part"].iat[0]), answers)

    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [c.split()[0] for c in schema.split(", ")]

    def finish(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        # what is under part -1 was for others
        if pdf.empty:
            return pd.DataFrame([], columns=names)
        held = (~pdf["train"].to_numpy(bool)).tolist()
        return _score(read(pdf), pdf["doc_id"].tolist(), held, answers, discount)

    # one exchange of the texts by part serves all three readings
    bigrams = rows.groupBy("part").applyInPandas(ask_bigrams, REQUEST).groupBy("shard").applyInPandas(_answer_bigrams, ANSWER)
    words = rows.groupBy("part").cogroup(bigrams.groupBy("part")).applyInPandas(ask_words, REQUEST).groupBy("shard").applyInPandas(_answer_words, ANSWER)
    size = words.where("kind = 'size'").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
    answers = bigrams.unionByName(words).withColumns({"all_tokens": size.select("tokens").scalar(), "all_words": size.select("words").scalar()})
    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(finish, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
