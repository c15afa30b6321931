"""Quality rules by distribution divergence.

A document's character classes and common words are compared with its language's by the
Jensen-Shannon distance. A language's reference is the mean histogram of its documents that
pass the base rules and are long enough, so long documents and junk don't bend it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.tables import keep, released, unused

# Frequent function words of each language, in no order of weight.
COMMON_WORDS = {
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei nach".split(),
    "en": "the of and a to in is was that for it with as on be by at are this from or an not have which you".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le".split(),
    "fr": "de la le et les des en un une du dans est que pour qui par sur au pas plus ne se ce avec il sont".split(),
}
COMMON = tuple(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))

CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "wide")
STOPS = b".,;:?!'\"()-"
SYMBOLS = b"#*$%&|<>"
SPACES = bytes([32, 9, 10, 11, 12, 13])


def _class_of(byte: int) -> int:
    if 97 <= byte <= 122:
        return 0
    if 65 <= byte <= 90:
        return 1
    if 48 <= byte <= 57:
        return 2
    if byte in SPACES:
        return 3
    if byte in STOPS:
        return 4
    return 5 if byte < 128 else 6


# Continuation bytes belong to the code point before them and count for no class.
CLASS_MATRIX = np.zeros((256, len(CLASSES)), np.int64)
for _b in range(256):
    if not 128 <= _b < 192:
        CLASS_MATRIX[_b, _class_of(_b)] = 1
COMMON_INDEX = {w.encode(): i for i, w in enumerate(COMMON)}
PPM = 1_000_000


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    distinct = dict.fromkeys(words)
    index = dict(zip(distinct, range(len(distinct))))
    ids, size = np.fromiter(map(index.__getitem__, words), np.int64, n), len(index)
    pairs = ids[:-2] * size + ids[1:-1]
    if size > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, window, counts = np.unique(pairs * size + ids[2:], return_inverse=True, return_counts=True)
    again = counts[window] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def measures(data: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Base figures, character classes, and counts of the common words with all others last."""
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    classes = seen @ CLASS_MATRIX
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    base = [len(words), int(classes.sum() - classes[3]), int(seen[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words)]
    get, other = COMMON_INDEX.get, len(COMMON)
    rows = [get(w.rstrip(b".,;:?!"), other) for w in data.lower().split()]
    return base, classes, np.bincount(rows, minlength=other + 1)


FEATURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "classes array<bigint>, common array<bigint>"
)


def features(docs: DataFrame, id_column: str, text_column: str, lang_column: str) -> DataFrame:
    """The measures of every row, with its id and language (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            base = np.array([x[0] for x in found], np.int64).reshape(-1, 5)
            arrays = [pa.array([x[k] for x in found], pa.list_(pa.int64())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), *[pa.array(c) for c in base.T.copy()], *arrays],
                ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"],
            )

    own = docs.select(
        docs[id_column].alias("doc_id"),
        F.coalesce(docs[lang_column].cast("string"), F.lit("")).alias("lang"),
        docs[text_column].cast("string").alias("text"),
    )
    id_type = docs.schema[id_column].dataType.simpleString()
    return own.mapInArrow(released(run), f"doc_id {id_type}, lang string, {FEATURES}")


def references(found: DataFrame, least_docs: int) -> DataFrame:
    """``(lang, class_reference, word_reference)`` of languages with ``least_docs`` usable documents.

    Shares are summed as whole parts per million, so the result doesn't depend on the order.
    """
    bins = len(CLASSES) + len(COMMON) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            shares = [np.array(batch.column(k).to_pylist(), np.int64) for k in ("classes", "common")]
            if not len(names):
                continue
            rows = np.hstack([PPM * s // np.maximum(1, s.sum(axis=1, keepdims=True)) for s in shares])
            for name in set(names):
                own = rows[names == name]
                sums[name] = sums.get(name, 0) + np.append(own.sum(axis=0), len(own))
        for name, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * (bins + 1), "bin": list(range(bins + 1)), "total": total.tolist()})

    per_bin = found.mapInArrow(released(run), "lang string, bin bigint, total bigint").groupBy("lang", "bin").agg(F.sum("total").alias("total"))
    totals = F.transform(F.array_sort(F.collect_list(F.struct("bin", "total"))), lambda x: x["total"])
    table = per_bin.groupBy("lang").agg(totals.alias("t"))

    def share(start: int, size: int) -> Column:
        part = F.slice("t", start, size)
        whole = F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.transform(part, lambda x: x / whole)

    return table.where(F.element_at("t", bins + 1) >= least_docs).select(
        "lang",
        share(1, len(CLASSES)).alias("class_reference"),
        share(len(CLASSES) + 1, len(COMMON) + 1).alias("word_reference"),
    )


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a count array from a share array; null without either."""
    whole = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(F.transform(counts, lambda x: x / whole), reference, lambda p, q: part(p, q) + part(q, p))
    half = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when((whole > 0) & reference.isNotNull(), F.sqrt(F.greatest(half, F.lit(0.0))))


def judge(
    docs: DataFrame,
    most: float = 0.39,
    slack: float = 1.0,
    least_words: int = 80,
    least_docs: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """One row for each input row: base figures, both distances and the verdict ``kept``.

    A document is rejected if it fails the base rules or its two distances add up to more than
    ``most + slack / sqrt(n_words)``; the second term is the noise of a short histogram.
    Guards: a document under ``least_words`` words, or whose language has fewer than
    ``least_docs`` usable documents, gets no distance and keeps the base verdict. Null and
    empty texts have no words and fail the base; a null language is a language of its own; null
    ids stay; repeated rows stay repeated; an empty table gives no rows; other columns are
    ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found, _ = keep(features(docs, id_column, text_column, lang_column).withColumn("base_failed", failed))
    long_enough = F.col("n_words") >= least_words
    known, _ = keep(references(found.where(long_enough & ~F.col("base_failed")), least_docs))
    apart = found.join(known, "lang", "left").select(
        *[c for c in found.columns if c not in ("classes", "common")],
        *[
            F.round(F.when(long_enough, distance(F.col(a), F.col(b))), 6).alias(c)
            for a, b, c in (("classes", "class_reference", "class_distance"), ("common", "word_reference", "word_distance"))
        ],
    )
    allowed = most + slack / F.sqrt(F.col("n_words"))
    far = F.coalesce(F.col("class_distance") + F.col("word_distance") > allowed, F.lit(False))
    return apart.withColumn("kept", ~F.col("base_failed") & ~far)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep them, all columns.

    Every row has the verdict of its own text and language, whatever its id: null and repeated
    ids make no difference.
    """
    id_column, text_column, lang_column = (options.get(f"{c}_column", d) for c, d in (("id", "doc_id"), ("text", "text"), ("lang", "lang")))
    key, text = unused(docs, "row_key"), docs[text_column].cast("string")
    own = F.struct(docs[id_column].alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), docs[lang_column].alias("lang"))
    keyed = docs.withColumn(key, own)
    bad, _ = keep(judge(keyed, **{**options, "id_column": key}).where(~F.col("kept")).select("doc_id").distinct())
    return keyed.join(bad, keyed[key].eqNullSafe(bad["doc_id"]), "left_anti").drop(key)
