"""Operator 9: language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public byte vocabulary. The probability of a
word (a run of non-space bytes after one space) is the sum over all its segmentations of the product of
their pieces, by the forward algorithm; a text's is the product over its words. All pieces of the vocabulary
count, also those that the sample lacks, and words of any length are scored whole: the forward state is
scaled up as it goes. Each distinct word of a run of texts is scored once for all languages.

Pieces are counted on the vocabulary's own segmentation of a bounded sample: for each language the rows
with the smallest hashes of doc_id, about ``max_rows``. Counts are smoothed towards the pooled ones.
The model (languages x vocabulary) is bounded by the vocabulary and broadcast.

Texts that are null or have no letter are ``und`` with score 0, as are all when nothing was learned;
equal scores go to the language first by code point. A null doc_id is neither learned from nor held out.
Repeated rows are learned from as often as they stand and get equal results; columns beside doc_id, text and lang
are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MAX_ROWS = 2000
SMOOTHING = 2000.0
#: Bytes after which the forward state is scaled, and cells of it at once.
SCALED, CELLS = 8, 1 << 19
RUN = 2 << 20


@functools.lru_cache(maxsize=2)
def _encoding(lines: bytes):
    """Ranks and encoder of a vocabulary file, which the driver reads and broadcasts."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return ranks, tiktoken.Encoding("fixed", pat_str=r" ?\S+|\s+", mergeable_ranks=ranks, special_tokens={})


def _read(spark, path: str):
    """The vocabulary file (a megabyte or two), broadcast: executors need no copy of it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _counts(shared):
    """(lang, text) to (lang, piece, n), summed over what the task reads."""

    def run(batches):
        ranks, encoding = _encoding(shared.value)
        pieces = {v: k for k, v in ranks.items()}
        sums: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                words = [b" " + w for w in text.encode().split()]
                got = sums.setdefault(lang, Counter())
                for w, times in Counter(words).items():
                    for t in encoding._core_bpe.encode_single_piece(w):
                        got[t] += times
        rows = [(lang, pieces[t], n) for lang, c in sums.items() for t, n in c.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "piece", "n"])

    return run


def train(docs: DataFrame, vocabulary: str = VOCABULARY, held_out: int = 2, folds: int = 4, max_rows: int = MAX_ROWS) -> DataFrame:
    """(lang, piece, n): pieces of each learned language."""
    rows = docs.select("doc_id", "text", "lang").filter((C.crc_mod("doc_id", folds) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).select("lang", (F.lit(float(max_rows)) / F.col("rows")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 40)) / float(1 << 40)
    # one row a language, as is the model: broadcast, so that texts are sampled where they are read
    sample = rows.join(F.broadcast(share), "lang").filter(place < F.col("share")).select("lang", "text")
    return sample.mapInArrow(_counts(_read(docs.sparkSession, vocabulary)), "lang string, piece binary, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """A trie over all pieces (those counted, the vocabulary's and single bytes) and each language's piece probabilities."""

    def __init__(self, rows: list[tuple[str, bytes, int]], vocabulary=()):
        self.langs = sorted({r[0] for r in rows}, key=lambda s: s.encode())
        single = [bytes([i]) for i in range(256)]
        pieces = sorted({r[1] for r in rows} | set(vocabulary) | set(single))
        self.longest = max(map(len, pieces))
        at = {p: i for i, p in enumerate(pieces)}
        count = np.zeros((len(pieces), max(len(self.langs), 1)))
        lang_at = {x: i for i, x in enumerate(self.langs)}
        for lang, piece, n in rows:
            count[at[piece], lang_at[lang]] += n
        pooled = count.sum(1) + 1
        pooled /= pooled.sum()
        self.prob = (count + SMOOTHING * pooled[:, None]) / (count.sum(0) + SMOOTHING)
        nodes: dict[bytes, int] = {b"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        self.step = np.full((len(nodes), 256), -1, np.int32)
        self.piece = np.full(len(nodes), -1, np.int32)
        for p, i in nodes.items():
            if p:
                self.step[nodes[p[:-1]], p[-1]] = i
                self.piece[i] = at.get(p, -1)

    def words(self, grid: np.ndarray) -> np.ndarray:
        """log probability (words x languages) of words of equal length, one a row of bytes."""
        n, length = grid.shape
        alpha = np.zeros((length + 1, n, self.prob.shape[1]))
        alpha[0] = 1.0
        scale = np.zeros((n, self.prob.shape[1]))
        for i in range(length):
            if i and i % SCALED == 0:
                ahead = alpha[i : i + self.longest]
                top = ahead.max(0)
                ahead /= top
                scale += np.log(top)
            alive = np.arange(n)
            node = np.zeros(n, np.int32)
            for j in range(i, min(length, i + self.longest)):
                node = self.step[node, grid[alive, j]]
                ok = node >= 0
                if not ok.all():
                    alive, node = alive[ok], node[ok]
                if not len(alive):
                    break
                piece = self.piece[node]
                some = piece >= 0
                if some.all():
                    alpha[j + 1, alive] += alpha[i, alive] * self.prob[piece]
                else:
                    to = alive[some]
                    alpha[j + 1, to] += alpha[i, to] * self.prob[piece[some]]
        return np.log(alpha[length]) + scale

    def text(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log probability (rows x languages) of texts one after another."""
        k = self.prob.shape[1]
        out = np.zeros((len(starts) - 1, k))
        h, row, first, last = C.words(data, starts, C.NOT_SPACE, C.BYTE_VALUES)
        if not len(h):
            return out
        _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        first, size = first[one], (last - first)[one]
        score = np.zeros((len(one), k))
        order = np.argsort(size, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            t = int(size[part[0]])
            most = max(1, CELLS // (t + 1))
            for at in range(0, len(part), most):
                w = part[at : at + most]
                grid = np.full((len(w), t + 1), 32, np.uint8)  # a space leads
                grid[:, 1:] = data[first[w][:, None] + np.arange(t)]
                score[w] = self.words(grid)
        for j in range(k):
            out[:, j] = np.bincount(row, score[inverse, j], len(out))
        return out


_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def _predict(shared, vocabulary):
    def run(batches):
        model = Model(shared.value, _encoding(vocabulary.value)[0] if shared.value else ())
        for b in batches:
            data, offsets = C.texts(b["text"])
            lang = ["und"] * len(b)
            score = np.zeros(len(b))
            for i, j in C.runs(offsets, RUN) if model.langs else ():
                d = data[offsets[i] : offsets[j]]
                st = offsets[i : j + 1] - offsets[i]
                logs = model.text(d, st)
                best = logs.argmax(1)
                sure = 1 / np.exp(logs - logs.max(1)[:, None]).sum(1)
                ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[d])])
                has = ascii_letters[st[1:]] > ascii_letters[st[:-1]]
                for r in range(j - i):
                    if has[r] or any(map(str.isalpha, bytes(d[st[r] : st[r + 1]]).decode("utf-8", "ignore"))):
                        lang[i + r], score[i + r] = model.langs[best[r]], sure[r]
            yield pa.record_batch([b["doc_id"], b["held_out"], pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, vocabulary: str = VOCABULARY, held_out: int = 2, folds: int = 4, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row a document."""
    model = [(r[0], bytes(r[1]), r[2]) for r in train(docs, vocabulary, held_out, folds, max_rows).collect()]  # at most languages x vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(C.crc_mod("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_predict(shared, _read(docs.sparkSession, vocabulary)), "doc_id long, held_out boolean, lang_pred string, score double")
