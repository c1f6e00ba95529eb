"""Secret scan: native candidates, and a random forest that removes false positives.

Everything runs on DataFrame and SQL functions and Spark ML.  What is natural
language is told by the corpus itself: its frequent words, and how often one
letter follows another in all its words (:class:`Language`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Labelled findings that the forest is fitted on; the bound of the sample.
TRAINING_FINDINGS = 4000
CONTEXT_CHARS = 48
#: Words of the dictionary: the most frequent of three letters and more.
DICTIONARY_WORDS = 4096
#: Set around matches; where a text has it already it reads as the replacement character.
MARK = "\ue000"

#: The value of an assignment to a name with a telling part, or a long run of key characters; fixed values.
CANDIDATE = (
    r"""(?<![A-Za-z0-9])(?:[A-Za-z0-9_.\-]{0,64}?(?:(?i:password|passwd|pwd|secret|token|api[_\-]?key))[A-Za-z0-9_.\-]{0,64}["']?"""
    r"""[ \t]{0,2}[:=][ \t]{0,2}["']?[^\s"']{6,}|[A-Za-z0-9+/_\-]{16,})"""
)
ASSIGNED = r"""^[A-Za-z0-9_.\-]+["']?[ \t]{0,2}[:=][ \t]{0,2}["']?"""
#: Paths of files whose values are stand-ins; whole parts of names.
PATH_LIKE = r"(^|[^a-z])(tests?|testing|examples?|docs?|samples?|fixtures?)([^a-z]|$)"

#: Words that say what stands beside them; fixed values.
TELLING = "password passwd pwd secret token key credential auth aws login"
HARMLESS = "commit sha sha1 sha256 md5 hash checksum uuid version build revision image example sample test dummy id"

FEATURES = (
    "length", "letters", "digits", "upper", "lower", "other", "changes", "transitions", "distinct", "dictionary",
    "hexadecimal", "slashes", "separators", "telling", "harmless", "assigned", "path_like",
)
_PAIRS = r"(?=([a-z]{2}))"
_LETTERS = 26


@dataclass(frozen=True)
class Language:
    """Frequent words, and log10 probabilities of a letter after a letter (26 x 26, row by row)."""

    words: tuple[str, ...]
    transitions: tuple[float, ...]


def language(docs: DataFrame, *, text: str = "text", n_words: int = DICTIONARY_WORDS) -> Language:
    """The frequent words and letter transitions of all texts.

    Words are runs of the letters a to z, lower-cased, of up to 24; every one is
    counted.  Only the ``n_words`` most frequent and 676 numbers come to the driver.
    """
    found = F.explode(F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit("[a-z]+"), F.lit(0)))
    counts = docs.select(found.alias("word")).filter("length(word) between 2 and 24").groupBy("word").agg(F.count("*").alias("n"))
    counts = common.stage(counts, "words")
    pairs = (
        counts.select(F.explode(F.regexp_extract_all("word", F.lit(_PAIRS), F.lit(1))).alias("pair"), "n")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .collect()  # 676 at most
    )
    table = [[1.0] * _LETTERS for _ in range(_LETTERS)]
    for r in pairs:
        table[ord(r.pair[0]) - 97][ord(r.pair[1]) - 97] += r.n
    logs = tuple(math.log10(x / sum(row)) for row in table for x in row)
    top = counts.filter("length(word) >= 3").orderBy(F.desc("n"), "word").limit(n_words).collect()
    return Language(tuple(r.word for r in top), logs)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, path, position, candidate, assigned, before, after) of every candidate in every text.

    A candidate holds a digit, or is assigned to a telling name; a quoted value is
    taken whole, others without the punctuation behind them.  Positions
    count from 1.  A text is cut at its matches once; each match then has the pieces
    beside it, so the time grows with the text and not with its square.
    """
    own = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.col(f"`{path}`").cast("string") if path else F.lit(None).cast("string")).alias("path"),
        F.translate(F.col(f"`{text}`"), MARK, "\ufffd").alias("text"),
    )
    # pieces: text, match, text, match, ..., text
    pieces = own.select(
        "row", "doc_id", "path",
        F.split(F.regexp_replace("text", F.lit(CANDIDATE), F.lit(f"{MARK}$0{MARK}")), MARK, -1).alias("pieces"),
    ).filter(F.size("pieces") > 1)
    ends = pieces.select(
        "*",
        F.transform("pieces", lambda p: F.right(p, F.lit(CONTEXT_CHARS))).alias("tails"),
        F.transform("pieces", lambda p: F.left(p, F.lit(CONTEXT_CHARS))).alias("heads"),
    )
    # a match has six characters or more, so sixteen pieces hold the context
    each = ends.select(
        "row", "doc_id", "path",
        F.explode(F.expr(
            f"""transform(sequence(1, cast(size(pieces) div 2 as int)), k -> named_struct(
            'k', k, 'match', element_at(pieces, 2 * k), 'gap', length(element_at(pieces, 2 * k - 1)),
            'before', right(array_join(slice(tails, greatest(1, 2 * k - 16), least(16, 2 * k - 1)), ''), {CONTEXT_CHARS}),
            'after', left(array_join(slice(heads, 2 * k + 1, 16), ''), {CONTEXT_CHARS})))"""
        )).alias("m"),
    )
    # the matches of one text, which is a row of one task anyway
    order = W.partitionBy("row").orderBy("m.k").rowsBetween(W.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("m.gap") + F.length("m.match")).over(order))
    match = F.col("m.match")
    value = F.regexp_replace(match, ASSIGNED, "")
    name = F.length(match) - F.length(value)
    quoted = match.rlike(ASSIGNED.removesuffix("?") + ".")
    return placed.filter(match.rlike("[0-9]") | match.rlike(ASSIGNED + ".")).select(
        "doc_id",
        "path",
        (F.col("end") - F.length(value) + 1).cast("int").alias("position"),
        F.when(quoted, value).otherwise(F.regexp_replace(value, "[.,;:!?)]+$", "")).alias("candidate"),
        match.rlike(ASSIGNED + ".").alias("assigned"),
        F.concat(F.col("m.before"), F.left(match, name)).alias("before"),
        F.col("m.after").alias("after"),
    )


def with_features(findings: DataFrame, known: Language) -> DataFrame:
    """The forest's features of findings, as a vector in ``features``."""
    low = F.lower("candidate")
    quote = lambda w: "'%s'" % w  # noqa: E731 - words are of the letters a to z
    covered = F.lit(0)
    if known.words:
        covered = F.expr(
            "aggregate(filter(runs, r -> lower(r) in (%s)), 0, (s, r) -> s + length(r))" % ",".join(map(quote, known.words))
        )
    table = "array(%s)" % ",".join(f"{x:.6f}D" for x in known.transitions)
    pair = f"(ascii(g) - 97) * {_LETTERS} + ascii(right(g, 1)) - 96"
    likely = F.expr(f"aggregate(pairs, 0D, (s, g) -> s + element_at({table}, {pair})) / greatest(size(pairs), 1)")
    c = F.col("candidate")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    near = F.lower(F.concat_ws(" ", "before", "after"))
    word_of = lambda words: "(?<![a-z])(?:%s)(?![a-z])" % "|".join(words.split())
    values = {
        "length": F.length(c).cast("double"),
        "letters": _count(c, "[A-Za-z]") / n,
        "digits": _count(c, "[0-9]") / n,
        "upper": _count(c, "[A-Z]") / n,
        "lower": _count(c, "[a-z]") / n,
        "other": _count(c, "[^A-Za-z0-9]") / n,
        "changes": (
            _count(c, "(?<=[a-z])(?=[A-Z0-9])") + _count(c, "(?<=[A-Z])(?=[0-9])") + _count(c, "(?<=[0-9])(?=[A-Za-z])")
        )
        / n,
        "transitions": likely,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "dictionary": covered / n,
        "hexadecimal": c.rlike("^[0-9a-f]+$").cast("double"),
        "slashes": _count(c, "/").cast("double"),
        "separators": _count(c, "[-_]").cast("double"),
        "telling": _count(near, word_of(TELLING)).cast("double"),
        "harmless": _count(near, word_of(HARMLESS)).cast("double"),
        "assigned": F.coalesce(F.col("assigned"), F.lit(False)).cast("double"),
        "path_like": F.coalesce(F.lower("path").rlike(PATH_LIKE), F.lit(False)).cast("double"),
    }
    cut = findings.select(
        "*",
        F.regexp_extract_all(low, F.lit(_PAIRS), F.lit(1)).alias("pairs"),
        F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])"), F.lit(0)).alias("runs"),
    )
    measured = cut.select(
        *findings.columns, *[F.coalesce(values[k].cast("double"), F.lit(0.0)).alias(f"__{k}") for k in FEATURES]
    )
    vectors = VectorAssembler(inputCols=[f"__{k}" for k in FEATURES], outputCol="features").transform(measured)
    return vectors.drop(*[f"__{k}" for k in FEATURES])


def labelled_findings(spark: SparkSession, known: Language, n: int = TRAINING_FINDINGS) -> DataFrame:
    """``n`` findings of twenty kinds with labels: real key formats against hashes, versions, paths, names and stand-ins.

    A third lie in tests, examples, samples or documentation, a third in other
    files, the rest have no path.  A value assigned to a telling name is a
    stand-in in the first and a secret elsewhere; key formats that only a
    provider issues are secrets everywhere.

    Made from numbers by hash functions and from the words of ``known``, so that
    every run over the same corpus has the same rows.
    """
    vocabulary = [w for w in known.words if len(w) > 3][:512] or ["configuration", "release", "documentation"]
    own = spark.range(n).select(
        "id",
        F.sha2(F.col("id").cast("string"), 512).alias("hex"),
        F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), "id"), 512))), "=\n", "").alias("b64"),
        common.base32(F.sha1(F.concat(F.lit("k"), "id").cast("binary"))).alias("b32"),
        F.translate(F.substring(F.sha2(F.concat(F.lit("n"), "id"), 256), 1, 24), "abcdef", "135790").alias("number"),
        F.pmod("id", F.lit(20)).alias("kind"),
        F.pmod(F.xxhash64("id"), F.lit(9)).cast("int").alias("pick"),
        F.pmod(F.xxhash64("id", F.lit("path")), F.lit(12)).cast("int").alias("place"),
    )
    plain = F.element_at(
        F.array(*map(F.lit, ("over the", "we saw in", "und der", "von einer", "de la", "et les", "see", "that was", "in one"))),
        F.col("pick") + 1,
    )
    path = F.element_at(
        F.array(*map(F.lit, ("tests/login.py", "examples/setup.cfg", "docs/guide.md", "src/fixtures/users.json", "src/login.py", "config/prod.env", "deploy/latest.yml", "app/settings.json"))),
        F.when(F.col("place") < 8, F.col("place") + 1).otherwise(1),
    )
    stand_in = F.when(F.col("place") < 4, 0).otherwise(1)
    punctuated = F.translate(F.substring("b64", 5, 12), "aeiouAEI", "$!&@#%?*")
    # kind: (candidate, assigned, before, after, label)
    say = lambda word: F.concat(plain, F.lit(f" {word} "))
    bare = F.concat(plain, F.lit(" "))
    after = F.lit(" the rest")
    listed = F.expr("array(%s)" % ",".join(f"'{w}'" for w in vocabulary))
    word = F.element_at(listed, F.pmod(F.xxhash64("id", F.lit("word")), F.lit(len(vocabulary))).cast("int") + 1)
    other = F.element_at(listed, F.pmod(F.xxhash64("id", F.lit("other")), F.lit(len(vocabulary))).cast("int") + 1)
    quoted = F.lit('" the rest')
    no, yes = F.lit(False), F.lit(True)
    plan = [
        (F.concat(F.lit("AKIA"), F.substring("b32", 1, 16)), no, bare, after, 1),
        (F.concat(F.lit("AKIA"), F.substring("b32", 9, 16)), no, say("key"), after, 1),
        (F.substring("hex", 1, 40), yes, F.concat(plain, F.lit(' token = "')), quoted, stand_in),
        (F.substring("hex", 7, 18), yes, F.concat(plain, F.lit(" password=")), after, stand_in),
        (F.substring("b64", 1, 40), yes, F.concat(plain, F.lit(" secret: ")), after, stand_in),
        (F.concat(F.lit("ghp_"), F.translate(F.substring("b64", 1, 36), "+/", "xy")), no, bare, after, 1),
        (F.concat(F.lit("sk_live_"), F.translate(F.substring("b64", 9, 24), "+/", "xy")), yes, F.concat(plain, F.lit(" api_key=")), after, 1),
        (F.substring("b64", 3, 20), yes, F.concat(plain, F.lit(" Password: ")), after, stand_in),
        (punctuated, yes, F.concat(plain, F.lit(' {"password": "')), F.lit('"} the rest'), stand_in),
        (F.concat(F.substring("hex", 3, 6), F.lit("!"), F.substring("b32", 2, 4)), yes, F.concat(plain, F.lit(' secret_key = "')), quoted, stand_in),
        (F.substring("hex", 1, 40), no, say("commit"), after, 0),
        (F.substring("hex", 1, 64), no, say("sha256"), after, 0),
        (F.regexp_replace(F.substring("hex", 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), no, say("uuid"), after, 0),
        (F.concat(word, F.lit("-"), F.substring("id", 1, 3), F.lit("-"), other, F.lit("-release-2")), no, bare, after, 0),
        (F.concat(F.lit("usr/share/"), word, F.lit("/"), F.substring("id", 1, 2), F.lit("/"), other), no, bare, after, 0),
        (F.concat(F.initcap(word), F.initcap(other), word, F.col("id").cast("string")), no, bare, after, 0),
        (F.element_at(F.array(*map(F.lit, ("changeme", "your_password_here", "example123", "placeholder", "xxxxxxxx", "password1", "<password>", "dummy-token-1", "test_token_1"))), F.col("pick") + 1), yes, F.concat(plain, F.lit(" password=")), after, 0),
        (F.concat(F.lit("AKIA"), F.element_at(F.array(F.lit("IOSFODNN7EXAMPLE"), F.lit("EXAMPLE123456789"), F.lit("XXXXXXXXXXXXXXX1")), F.pmod("pick", F.lit(3)).cast("int") + 1)), no, say("example"), after, 0),
        (F.substring("number", 1, 16), no, bare, after, 0),
        (F.concat(F.substring("number", 3, 4), F.lit("-"), F.substring("number", 7, 4), F.lit("-"), F.substring("number", 11, 8)), no, bare, after, 0),
    ]
    pick = lambda i: F.element_at(F.array(*[F.lit(p[i]) if isinstance(p[i], int) else p[i] for p in plan]), F.col("kind").cast("int") + 1)
    return own.select(
        F.col("id").alias("doc_id"),
        F.col("kind").cast("int").alias("kind"),
        F.when(F.col("place") < 8, path).alias("path"),
        pick(0).alias("candidate"),
        pick(1).alias("assigned"),
        pick(2).alias("before"),
        pick(3).alias("after"),
        pick(4).cast("double").alias("label"),
    )


def train(findings: DataFrame, known: Language, *, trees: int = 40, depth: int = 8, seed: int = 7) -> PipelineModel:
    """Fit the forest on labelled findings (``label`` 1 for a secret); those without a label are left out."""
    rows = with_features(findings.filter("label is not null"), known).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False).fit(rows)


def scan(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    model=None,
    known: Language | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """One row for each candidate: doc_id, position, length, candidate_sha256, probability, is_secret.

    ``model`` is a forest from :func:`train` and ``known`` the language it was
    trained with; by default they are :func:`language` of these documents and a
    forest fitted on :func:`labelled_findings`.  Candidates are found and judged where the
    documents lie.  The secret itself isn't returned, only its hash.  Null and
    empty texts have no candidates; a null ``path`` counts as none; documents
    without an id and repeated rows give their rows like any other.
    """
    if model is not None and known is None:
        raise ValueError("a model needs the language it was trained with")
    common.prepare(docs.sparkSession)
    known = known or language(docs, text=text)
    model = model or train(labelled_findings(docs.sparkSession, known), known)
    judged = model.transform(with_features(candidates(docs, doc_id=doc_id, text=text, path=path), known))
    probability = vector_to_array("probability")[1]
    return judged.select(
        "doc_id",
        "position",
        F.length("candidate").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"),
        "assigned",
        probability.alias("probability"),
        (probability >= threshold).alias("is_secret"),
    )
