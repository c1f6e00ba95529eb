"""Quality rules whose votes are weighed by weak supervision."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SYMBOLS = b"#*$%&|<>"
#: The prior counts' weight as a share of all documents.
PRIOR_WEIGHT = 0.02
KEEP, ABSTAIN, REJECT = 1, 0, -1

#: Common words of the corpus languages; fixed values.
STOP_WORDS = frozenset(
    w.encode()
    for w in (
        "the be to of and that have with in is for "
        "der die das und ist nicht mit ein von zu den "
        "le la les de et est un une que dans pour des "
        "el los las del que en un una por con no"
    ).split()
)

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shout", "n_stop", "n_pipe")


def features(text: bytes | None) -> tuple[int, ...]:
    """The counts of ``_COUNTS`` over a whole text; zeros for a null one."""
    if not text:
        return (0,) * len(_COUNTS)
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(common.WHITE.encode())]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated, end = 0, 0
    if len(windows) < len(words) - 2:
        for i, w in enumerate(zip(words, words[1:], words[2:])):
            if windows[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    letters = joined.decode("utf-8", "replace") if not joined.isascii() else joined.decode("ascii")
    upper = sum(map(str.isupper, letters)) if letters != letters.lower() else 0
    return (
        len(words),
        chars,
        symbols,
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        upper,
        sum(map(str.isalpha, letters)),
        joined.count(b"!"),
        sum(w.lower().rstrip(b".,;:!?") in STOP_WORDS for w in words),
        words.count(b"|"),
    )


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and the counts behind ``prefix``; no shuffle."""
    common.prepare(docs.sparkSession)
    added = [f"{prefix}{c}" for c in _COUNTS]
    docs = docs.drop(*added)
    at, names = docs.columns.index(text), [*docs.columns, *added]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t) for t in common.text_bytes(batch.column(at))]
        columns = list(zip(*rows)) or [()] * len(_COUNTS)
        return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in columns]], names=names)

    schema = T.StructType([*docs.schema.fields, *[T.StructField(a, T.LongType()) for a in added]])
    return common.map_batches(docs, run, schema)


def _rule(reject: Column, keep: Column) -> Column:
    return F.when(reject, REJECT).when(keep, KEEP).otherwise(ABSTAIN)


def rules(prefix: str = "") -> dict[str, Column]:
    """Votes: -1 reject, 1 keep, 0 abstain.  A share is of words, lines or letters."""
    count = lambda a: F.col(prefix + a)
    share = lambda a, b: count(a) / F.greatest(count(b), F.lit(1))
    no = F.lit(False)
    return {
        "length": _rule(count("n_words") < 50, count("n_words") >= 100),
        "word_length": _rule(
            ~share("word_chars", "n_words").between(2.5, 11), share("word_chars", "n_words").between(3, 9)
        ),
        "symbols": _rule(share("n_symbols", "n_words") > 0.1, no),
        "pipes": _rule(share("n_pipe", "n_words") > 0.1, no),
        "dup_lines": _rule(share("n_dup_lines", "n_lines") > 0.3, no),
        "repeats": _rule(share("n_repeat_words", "n_words") > 0.3, share("n_repeat_words", "n_words") < 0.1),
        "capitals": _rule(share("n_upper", "n_letters") > 0.5, no),
        "shouting": _rule(share("n_shout", "n_words") > 0.2, no),
        "letters": _rule(share("n_letters", "word_chars") < 0.7, share("n_letters", "word_chars") > 0.85),
        "stop_words": _rule(no, share("n_stop", "n_words") > 0.05),
    }


class LabelModel:
    """Two classes, rules independent within each; rates by expectation-maximisation.

    A rule's rates are those of its three votes among good and among bad
    documents.  Prior counts (a share of all documents) say that a vote is more
    likely where it is right than where it is wrong, which names the classes;
    the data decide how much each vote is worth.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior_weight: float = PRIOR_WEIGHT, rounds: int = 200):
        counts = counts.astype(float)
        total = max(counts.sum(), 1.0)
        n_rules = patterns.shape[1]
        votes = np.stack([(patterns == v) for v in (REJECT, ABSTAIN, KEEP)], -1).astype(float)
        seen = (votes * counts[:, None, None]).sum(0) / total
        # (class, rule, vote): bad first
        prior = np.stack([np.tile([0.45, 0.4, 0.15], (n_rules, 1)), np.tile([0.01, 0.4, 0.59], (n_rules, 1))])
        # a rule that never votes to keep, or never to reject, has a prior of its two votes
        one_sided = seen[:, 2] == 0
        prior[0, one_sided], prior[1, one_sided] = [0.3, 0.7, 1e-6], [0.005, 0.995, 1e-6]
        one_sided = seen[:, 0] == 0
        prior[0, one_sided], prior[1, one_sided] = [1e-6, 0.7, 0.3], [1e-6, 0.3, 0.7]
        prior /= prior.sum(-1, keepdims=True)
        weight = prior_weight * total + 1
        self.rates, self.good = prior.copy(), 0.8
        for _ in range(rounds):
            posterior = self._posterior(votes)
            good = (posterior * counts).sum() / total
            new = np.stack(
                [(votes * (counts * q)[:, None, None]).sum(0) for q in (1 - posterior, posterior)]
            ) + weight * prior
            new /= new.sum(-1, keepdims=True)
            change = np.abs(new - self.rates).max()
            self.rates, self.good = new, float(np.clip((good * total + 0.8 * weight) / (total + weight), 0.01, 0.99))
            if change < 1e-9:
                break

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.einsum("prv,crv->cp", votes, np.log(np.maximum(self.rates, 1e-12)))
        log += np.log([1 - self.good, self.good])[:, None]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = np.stack([(patterns == v) for v in (REJECT, ABSTAIN, KEEP)], -1).astype(float)
        return self._posterior(votes)


def _votes(prefix: str = "") -> Column:
    return F.array(*[v.cast("int") for v in rules(prefix).values()])


def _verdicts(counted: DataFrame, votes: str, prior_weight: float) -> DataFrame:
    """(votes, quality) of every pattern of votes that occurs; no more rows than patterns."""
    seen = counted.groupBy(votes).agg(F.count("*").alias("n")).orderBy(votes).collect()
    quality = np.zeros(0)
    if seen:
        patterns = np.array([r[0] for r in seen])
        quality = LabelModel(patterns, np.array([r.n for r in seen]), prior_weight).posterior(patterns)
    rows = [(r[0], float(q)) for r, q in zip(seen, quality)]
    return counted.sparkSession.createDataFrame(rows, f"{votes} array<int>, {votes}_quality double")


def _failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n)


def judge(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, prior_weight: float = PRIOR_WEIGHT
) -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed, votes, quality, kept.

    Rules vote on counts of whole texts.  The numbers of documents with each
    pattern of votes (at most three to the power of the rules, counted over
    all documents) go to the driver, where expectation-maximisation finds each
    rule's rates; ``quality`` is the posterior probability of a good document.
    ``kept`` is false below 50 words or with over half the words in repeated
    windows (``base_failed``), else whether quality reaches ``threshold``.
    A null text has no words.  Repeated rows are each judged, with or without ids.
    """
    counted = measured(common.only(docs, doc_id=doc_id, text=text)).select(
        "doc_id", *_COUNTS[:5], _votes().alias("votes")
    )
    counted = common.stage(counted, "votes")
    found = counted.join(F.broadcast(_verdicts(counted, "votes", prior_weight)), "votes", "left")
    return found.select(
        "doc_id",
        *_COUNTS[:5],
        _failed().alias("base_failed"),
        F.map_from_arrays(F.array(*map(F.lit, rules())), "votes").alias("votes"),
        F.col("votes_quality").alias("quality"),
        (~_failed() & (F.col("votes_quality") >= threshold)).alias("kept"),
    )


def keep_good(
    docs: DataFrame, *, text: str = "text", threshold: float = 0.5, prior_weight: float = PRIOR_WEIGHT
) -> DataFrame:
    """The documents that :func:`judge` keeps; columns unchanged, nothing shuffled but vote counts.

    Texts are measured twice, once for the counts of votes and once for the
    verdict, which is cheaper than moving them.  Null, empty and short texts go,
    having fewer than 50 words; ids aren't looked at, so repeated rows and rows
    without an id are each judged; no documents give no rows.
    """
    p = common.free_prefix(docs, "__q_")
    votes = f"{p}votes"
    counts = measured(common.only(docs, text=text), prefix=p).select(_votes(p).alias(votes))
    verdicts = F.broadcast(_verdicts(counts, votes, prior_weight))
    found = measured(docs, text, p).withColumn(votes, _votes(p)).join(verdicts, votes, "left")
    kept = found.filter(~_failed(p) & (F.col(f"{votes}_quality") >= threshold))
    return kept.select(*[f"`{c}`" for c in docs.columns])
