"""Language identification by code lengths under byte context trees, one for each language."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.llm import ppm
from lakescribe.llm.common import chunks, cut, fold, fresh, map_arrow, text_bytes

UNKNOWN = "und"
#: Trees that are broadcast at one time, in bytes (one tree at least).
GROUP_BYTES = 128 << 20
_ASCII_LETTER = re.compile(rb"[A-Za-z]")

_SCHEMA = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode()))


@dataclass(frozen=True)
class Languages:
    """Written models (label, size, model) and their names in groups that are scored together, in the order of names."""

    models: DataFrame
    groups: list[list[str]]

    def load(self, group: list[str]) -> list[ppm.ContextTree]:
        rows = {r.label: r.model for r in self.models.where(F.col("label").isin(group)).select("label", "model").collect()}
        return [pickle.loads(rows[x]) for x in group]


def fit_languages(docs: DataFrame, training: Column, order: int = 2, text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Context trees of all languages of the training rows, with every context of their texts, each built by one task.

    Rows without text or language teach nothing. A tree of order 2 has 65,793 contexts at most, 135 MB; a few MB as a rule.
    """
    rows = ppm.labelled(docs.where(training & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()), F.col(f"`{lang_col}`"), text_col)
    models = cut(ppm.trees(ppm.window_counts(rows, order), order))
    sizes = models.select("label", "size").orderBy("label").collect()  # one small row for each language
    groups: list[list[str]] = []
    held = GROUP_BYTES
    for r in sizes:
        if held + r["size"] > GROUP_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(r.label)
        held += r["size"]
    return Languages(models, groups)


def identify_language(docs: DataFrame, languages: Languages, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns, lang_pred and score of every whole text.

    lang_pred is the language whose frozen tree gives the shortest code; of equal lengths, the first name.
    score is its share when each language is as likely beforehand. Null texts, texts without a letter, and
    all texts if there is no tree, are `und` with score 0. Rows are independent; other columns are ignored. One pass over the
    texts for each group of languages; nearly always there is one group.
    """
    kept = [c for c in keep if c not in _SCHEMA.names]
    text, best, share = (fresh(c, kept) for c in ("text", "best", "share"))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], *([F.col(f"`{text_col}`").cast("string").alias(text)] if text not in kept else []))
    rows = rows.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(None).cast("double").alias(best), F.lit(0.0).alias(share))
    for number, group in enumerate(languages.groups):
        rows = _scored(cut(rows) if number else rows, group, languages.load(group), text, best, share)
    return rows.select(*[F.col(f"`{c}`") for c in kept], "lang_pred", F.when(F.col(best).isNull(), 0.0).otherwise(1 / F.col(share)).alias("score"))


def _scored(rows: DataFrame, names: list[str], trees: list[ppm.ContextTree], text: str, best: str, share: str) -> DataFrame:
    """The rows with lang_pred, best (its log probability) and share (the sum of all languages' odds against it) after
    some more languages."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    fields, at = rows.columns, {c: rows.columns.index(c) for c in (text, "lang_pred", best, share)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(at[text]))
            for a, b in chunks(texts):
                part = batch.slice(a, b - a)
                chosen, log, total = (part.column(at[c]).to_pylist() for c in ("lang_pred", best, share))
                own = [i for i, x in enumerate(texts[a:b]) if has_letter(x)]
                if own:
                    lower = [texts[a + i].lower() for i in own]
                    logs = np.array([tree.score(lower) for tree in shared.value])
                    first, most = logs.argmax(axis=0), logs.max(axis=0)
                    odds = (10.0 ** np.clip(logs - most, -300, 0)).sum(axis=0)
                    for i, k, m, o in zip(own, first, most, odds, strict=True):
                        if log[i] is None or m > log[i]:
                            total[i] = o + (total[i] * 10.0 ** max(log[i] - m, -300) if log[i] is not None else 0.0)
                            chosen[i], log[i] = names[k], float(m)
                        else:
                            total[i] += o * 10.0 ** max(m - log[i], -300)
                made = {"lang_pred": pa.array(chosen, pa.string()), best: pa.array(log, pa.float64()), share: pa.array(total, pa.float64())}
                yield pa.RecordBatch.from_arrays([made.get(c, part.column(i)) for i, c in enumerate(fields)], names=fields)

    return map_arrow(rows, run, rows.schema)


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those outside fold 0 of 5."""
    held_out = fold(F.col("doc_id")) == 0
    found = identify_language(docs, fit_languages(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
