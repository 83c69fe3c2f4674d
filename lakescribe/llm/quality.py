"""Quality rules: distance of a text's character classes and common words from language references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.llm.common import cut, fresh, map_arrow, per_text

SPACE = b"\x20\t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"

#: Common words for references that bring no words of their own, in lower case.
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "are", "this", "at"),
    "de": ("der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "im", "für", "auf", "nicht", "ein", "eine", "als", "auch", "es", "dem"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "pas", "plus"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"),
}
#: Character classes of lead bytes: small, capital, digit, blank, line end, stops, symbols, other ASCII, beyond ASCII.
N_CLASSES = 9
_IGNORED = N_CLASSES
_CLASS = np.full(256, 7, np.uint8)
for _k, _members in enumerate((
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:!?'\"()-", _SYMBOLS,
)):
    _CLASS[list(_members)] = _k
_CLASS[0x80:0xC0] = _IGNORED
_CLASS[0xC0:] = 8

_WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
_WORD_ID = {w.encode(): i for i, w in enumerate(_WORDS)}
N_WORDS = len(_WORDS) + 1  # the last bin: all other words


@dataclass(frozen=True)
class Limits:
    """Distances are square roots of Jensen-Shannon divergences in bits, 0 to 1.

    A distance counts only in texts long enough to give a steady histogram.
    """

    max_class_distance: float = 0.28
    min_chars: int = 200
    max_word_distance: float = 0.33
    min_words: int = 100
    #: A language has a reference from so many rows on, whatever its share.
    min_language_docs: int = 20
    #: So many words of each language, those in most of its rows, are its common words.
    common_words: int = 20


class References(dict):
    """Class and word counts by language, and the common words of all these languages, which the bins stand for."""

    words: tuple[bytes, ...] = tuple(_WORD_ID)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), len(text.translate(None, SPACE + _CONTINUED)), symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    key, n = ids[: len(ids) - width + 1], len(number)
    for j in range(1, width):
        if j > 1 and n**3 >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * n + ids[j : len(ids) - width + 1 + j]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[where] > 1
    if not again.any():
        return 0
    hit = np.zeros(len(words), bool)
    for j in range(width):
        hit[j : len(hit) - width + 1 + j] |= again
    return int(hit.sum())


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def histograms(text: bytes, word_id: Mapping[bytes, int] = _WORD_ID) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of common words; the last bin has all other words."""
    classes = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]
    other = len(word_id)
    words = np.zeros(other + 1, np.int64)
    get = word_id.get
    ids = [get(w, other) for w in text.lower().split()]
    if ids:
        words += np.bincount(ids, minlength=other + 1)
    return classes, words


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of a distribution from each row of q."""
    m = (p + q) / 2

    def divergence(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=-1)

    return np.sqrt(np.clip((divergence(p) + divergence(q)) / 2, 0, 1))


def common_words(parts: DataFrame, most: int) -> DataFrame:
    """(lang, word) of the words that stand in most rows of each language, from (lang, text); of equal ones, the first."""

    def run(batches):
        import pyarrow as pa

        from lakescribe.llm.common import text_bytes

        held: dict[str, Counter[bytes]] = {}

        def rows():
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                    names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                held.setdefault(lang, Counter()).update(set(text.lower().split()))
            if sum(map(len, held.values())) > 300_000:
                yield from rows()
        yield from rows()

    counts = map_arrow(parts, run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts.withColumn("place", place).where(F.col("place") <= most).select("lang", "word")


def language_references(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang") -> References:
    """Class and word counts by language, over all rows with a language that pass the base rules.

    The words are the common ones of each language with enough rows, found in all its rows.

    Counts leave each task already summed; the driver gets one short vector for each language with a
    reference. A table without such rows has no references.
    """

    def run(batches):
        import pyarrow as pa

        from lakescribe.llm.common import text_bytes

        sums: dict[str, np.ndarray] = {}

        def rows():
            return pa.RecordBatch.from_pydict({
                "lang": list(sums), "counts": [x.tolist() for x in sums.values()]},
                schema=pa.schema([("lang", pa.string()), ("counts", pa.list_(pa.int64()))]))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                words = text.split()
                if base_fails(len(words), repeated_words(words)):
                    continue
                row = np.concatenate([[1], *histograms(text, word_id)])
                sums[lang] = sums[lang] + row if lang in sums else row
            if len(sums) > 5_000:
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    known = docs.where(F.col(f"`{lang_col}`").isNotNull())
    parts = known.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    large = cut(parts.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= limits.min_language_docs).select("lang"))
    words = common_words(parts, limits.common_words).join(large, "lang", "left_semi").select("word").distinct()
    found = References()
    found.words = tuple(sorted(bytes(x) for x in words.toArrow().column("word").to_pylist()))
    word_id = {w: i for i, w in enumerate(found.words)}
    sums = (
        map_arrow(parts, run, "lang string, counts array<bigint>")
        .select("lang", F.posexplode("counts").alias("bin", "n"))
        .groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    )
    one = cut(sums.groupBy("lang").agg(
        F.max(F.when(F.col("bin") == 0, F.col("n"))).alias("docs"),
        F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins")))  # as many bins as the vectors have
    chosen = one.where(F.col("docs") >= limits.min_language_docs)
    for lang, bins in chosen.select("lang", F.col("bins.n").alias("n")).orderBy("lang").toLocalIterator():
        found[lang] = np.array(bins[1:], np.float64)
    return found


_SCHEMA = T.StructType([
    *[T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()),
])


class Judge:
    """Distances of a text from the nearest language reference."""

    def __init__(self, references: Mapping[str, np.ndarray], limits: Limits) -> None:
        self.limits = limits
        share = lambda x: x / x.sum()
        self.classes = np.array([share(x[:N_CLASSES]) for x in references.values()])
        self.words = np.array([share(x[N_CLASSES:]) for x in references.values()])
        self.word_id = {w: i for i, w in enumerate(getattr(references, "words", References.words))}

    def distances(self, text: bytes) -> tuple[float | None, float | None]:
        """None where the text is too short or there is no reference."""
        classes, words = histograms(text, self.word_id)
        by_class = by_word = None
        if len(self.classes) and classes.sum() >= self.limits.min_chars:
            by_class = float(js_distance(classes / classes.sum(), self.classes).min())
        if len(self.words) and words.sum() >= self.limits.min_words:
            own = np.flatnonzero(words)  # where the text has nothing, a reference's share counts whole
            p, q = words[own] / words.sum(), self.words[:, own]
            rest = np.append(q, 1 - q.sum(axis=1, keepdims=True).clip(0, 1), axis=1)
            by_word = float(js_distance(np.append(p, 0.0), rest).min())
        return by_class, by_word

    def row(self, text: bytes) -> tuple:
        n_words, word_chars, n_symbols, n_dup, n_repeat = base_counts(text)
        failed = base_fails(n_words, n_repeat)
        by_class, by_word = self.distances(text)
        far = (by_class or 0) > self.limits.max_class_distance or (by_word or 0) > self.limits.max_word_distance
        return n_words, word_chars, n_symbols, n_dup, n_repeat, failed, not failed and not far, by_class, by_word


def quality_rules(docs: DataFrame, references: Mapping[str, np.ndarray], limits: Limits = Limits(), keep: tuple[str, ...] = ("doc_id",), lang_col: str = "lang") -> DataFrame:
    """Base counts and verdict of every whole text.

    kept is false if base_failed, or if a text is long enough and farther than the limit from every
    reference. The nearest reference counts, whatever the language of the row, so texts in a wrongly named
    language are not dropped. If there is a column of languages, texts without one or in one that has no
    reference are not judged by their words (word_distance is null). Null and empty texts have no words and fail. Without references, texts
    pass on the base rules alone. Rows are independent; other columns are ignored.
    """

    def worker():
        judge = Judge(references, limits)
        return lambda texts: list(zip(*[judge.row(x) for x in texts], strict=True))

    if lang_col not in docs.columns:
        return per_text(docs, worker, _SCHEMA, keep)
    known = F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{lang_col}`").cast("string").isin(list(references))
    mark = fresh("known", [*docs.columns, *_SCHEMA.names])
    rows = per_text(docs.withColumn(mark, known), worker, _SCHEMA, (*keep, mark))
    near = F.coalesce("class_distance", F.lit(0.0)) <= limits.max_class_distance
    changed = {
        "kept": F.when(F.col(mark), F.col("kept")).otherwise(~F.col("base_failed") & near),
        "word_distance": F.when(F.col(mark), F.col("word_distance")),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in rows.columns if c != mark])
