"""Language-model scores from a weighted backoff automaton over the whole training part.

States are the contexts seen in training: the root, every word, and every pair of words,
begin of text included. A state's arcs are all n-grams seen after it, each with its
smoothed probability; its failure arc leads to the state of the context without its first
word and weighs what the arcs leave over; the root has an arc for every word, known or not.
Reading a word follows failure arcs until some state has an arc for it. One pass from left
to right carries the state and adds up log-probabilities.

Probabilities are interpolated with a Dirichlet prior: p(w | h) = (c(hw) + m p(w | h')) /
(c(h) + m), with h' the shorter context and m the prior's weight for the order; the root has
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). The failure arc of h so weighs m / (c(h) + m), and
a model needs n-gram counts alone, of every training text.

Counts grow with the corpus and are never gathered in one place: chunks of documents ask
count shards for their n-grams (see shards.py), and build the part of the automaton that
their texts can reach. Texts are read in pieces, all of a chunk's at once; the state after
two words depends on these alone, so a piece starts by reading the two words before it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import ANSWER, BEGIN_KEY, REPLY, TOTAL, Chunk, Level, ask, asked, gathered, n_shards, packed_counts, replies, texts, unpacked_counts, xor
from .shared import discard, written

ORDER = 3
#: Weights of the prior by order: of what follows one word, and of what follows two.
PRIOR = {2: 300.0, 3: 20.0}
FOLDS, HELD_OUT = 5, 1
#: Tokens of a piece of text.
PIECE = 256


def held_out(ids: list) -> np.ndarray:
    """Which ids fall into the held-out fold by the CRC-32 of their text; null counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT for i in ids], dtype=bool)


def training_counts(c: Chunk, found: list[Level]) -> list[np.ndarray]:
    """Occurrences in the chunk's training texts, for each order; the begin token counts texts."""
    trained = ~held_out(c.rows.field(0).to_pylist())
    inside = np.repeat(trained, c.n)
    out = [np.bincount(x.place[inside & (x.place >= 0)], minlength=len(x.key)) for x in found]
    out[0][c.begin] = np.count_nonzero(trained)
    return out


def add_up(table: pa.Table) -> pa.Table:
    """A shard's counts over all chunks: an answer to each, and the shard's part of N and V."""
    keys, sizes = asked(table)
    own = [unpacked_counts(x.as_py(), n) for x, n in zip(table.column("counts"), sizes)]
    distinct, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([*own, np.zeros(0, np.int64)]), minlength=len(distinct)).astype(np.int64)
    each, rows, at, shard = total[inverse], [], 0, table.column("shard")[0].as_py()
    for number, size in zip(table.column("chunk").to_pylist(), sizes):
        rows.append((ANSWER, shard, number, xor(keys[at : at + size]), 0, 0, packed_counts(each[at : at + size])))
        at += size
    known = total[(distinct & np.uint64(1) == 1) & (distinct != BEGIN_KEY)]
    rows.append((TOTAL, shard, -1, 0, int(known.sum()), int(np.count_nonzero(known)), None))
    return replies(rows)


class Automaton:
    """States by number with their arcs, sorted by (state, word), and one failure arc each.

    State 0 is the root, 1 + k the word k, 1 + words + k the pair of words k.
    """

    def __init__(self, c: Chunk, found: list[Level], counts: list[np.ndarray], total: int, distinct: int, prior: dict[int, float]) -> None:
        one, two, three = found
        c1, c2, c3 = counts
        m = self.m = len(c.hashes)
        self.root = (c1 + 0.5) / (total + 0.5 * (distinct + 1))
        p2 = (c2 + prior[2] * self.root[two.word]) / (c1[two.context] + prior[2])
        p3 = (c3 + prior[3] * p2[three.tail]) / (c2[three.context] + prior[3])
        of_word = np.where(c1 > 0, 1 + np.arange(m), 0)
        of_pair = np.where(c2 > 0, 1 + m + np.arange(len(c2)), of_word[two.word])
        seen2, seen3 = np.flatnonzero(c2), np.flatnonzero(c3)
        keys = np.concatenate((np.arange(m), of_word[two.context[seen2]] * m + two.word[seen2], of_pair[three.context[seen3]] * m + three.word[seen3]))
        by = np.argsort(keys, kind="stable")
        self.arc = keys[by]
        self.weight = np.log10(np.concatenate((self.root, p2[seen2], p3[seen3])))[by]
        self.to = np.concatenate((of_word, of_pair[seen2], of_pair[three.tail[seen3]]))[by]
        self.fail_to = np.concatenate(([0], np.zeros(m, dtype=np.int64), of_word[two.word]))
        self.fail_weight = np.log10(np.concatenate(([1.0], prior[2] / (c1 + prior[2]), prior[3] / (c2 + prior[3]))))
        self.begin = int(of_word[c.begin])

    def read(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Moves every state by its word, in place; gives the weights of the arcs taken."""
        out = np.zeros(len(state))
        at = np.arange(len(state))
        while len(at):
            key = state[at] * self.m + word[at]
            k = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            hit = self.arc[k] == key
            taken = k[hit]
            out[at[hit]] += self.weight[taken]
            state[at[hit]] = self.to[taken]
            at = at[~hit]
            out[at] += self.fail_weight[state[at]]
            state[at] = self.fail_to[state[at]]
        return out


def walk(machine: Automaton, c: Chunk, piece: int = PIECE) -> np.ndarray:
    """Log10 probability of each document: reads all texts left to right, a token of every piece at a time."""
    warm = ORDER - 1
    doc = np.repeat(np.arange(len(c.n)), -(-c.n // piece))
    nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
    first = c.starts[doc] + nth * piece
    skip = np.where(nth > 0, warm, 0)  # read for the state, not counted: the piece before has them
    first, last = first - skip, np.minimum(first + piece, (c.starts + c.n)[doc])
    length = last - first
    by = np.argsort(-length, kind="stable")
    first, length, skip = first[by], length[by], skip[by]
    state = np.where(nth[by] > 0, 0, machine.begin)
    total = np.zeros(len(by))
    live = len(by)
    for step in range(int(length[0]) if len(by) else 0):
        while length[live - 1] <= step:
            live -= 1
        weight = machine.read(state[:live], c.token[first[:live] + step].astype(np.int64))
        total[:live] += np.where(step >= skip[:live], weight, 0.0)
    return np.bincount(doc[by], weights=total, minlength=len(c.n))


def score_chunk(table: pa.Table, shards: int, total: int, distinct: int, prior: dict[int, float], piece: int) -> pa.Table:
    c, found, counts, _ = gathered(table, ORDER, shards)
    machine = Automaton(c, found, counts, total, distinct, prior)
    doc = np.repeat(np.arange(len(c.n)), c.n)
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=len(c.n))
    ids = c.rows.field(0)
    return pa.table(
        {
            "id": ids,
            "held_out": pa.array(held_out(ids.to_pylist())),
            "n_tokens": pa.array(c.n),
            "n_known": pa.array(per_doc(counts[0][c.token] > 0).astype(np.int64)),
            "base_score": pa.array(per_doc(np.log10(machine.root)[c.token])),
            "score": pa.array(walk(machine, c, piece)),
        }
    )


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int | None = None, piece: int = PIECE, prior: dict[int, float] = PRIOR) -> DataFrame:
    """For each row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text has one token, its end. A null id is in the training part.
    Repeated rows are trained on and scored each; an empty table gives no rows; other
    columns are ignored. The input must give the same rows in the same order to each read,
    as files do; answers that do not fit are an error, never a wrong score.
    """
    docs = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text).alias("text"))
    n = shards or n_shards(docs)
    replied = written(ask(docs, ORDER, n, training_counts).groupBy("shard").applyInArrow(add_up, REPLY), "answers")
    total, distinct = (x or 0 for x in replied.where(F.col("kind") == TOTAL).agg(F.sum("n"), F.sum("distinct")).first())
    every = texts(docs).unionByName(replied.where(F.col("kind") == ANSWER).select("kind", "shard", "chunk", "check", "answer"), allowMissingColumns=True)
    kind = docs.schema["row"].dataType["id"].dataType.simpleString()
    scored = written(every.groupBy("chunk").applyInArrow(lambda t: score_chunk(t, n, total, distinct, prior, piece), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    discard(replied)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
