"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts with escape
probabilities, frozen after training; a text's language is the one whose tree
codes its bytes shortest. Trees are fitted on a sample of about ``per_language``
labelled texts of each language, chosen by a hash of the row; whole texts are used
both there and in prediction, very long ones too, and a tree holds every string of its
sample. Where there are more than 16 languages, each gets its part of the sample that 16
would have; where there are more than ``LANGUAGES``, the most common ones (ties: the smaller
name) are learnt, and rarer labels, as dirty tables have them, teach nothing.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
and every text when nothing could be learned; ties go to the smaller name; rows
with a null text or lang teach nothing; rows with null or repeated ids are learnt from
and predicted each; an empty table gives no rows. Extra columns are dropped by ``identify``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.llm._common import arrow_map, documents, keyed, share, slices, staged, table_bytes
from revscope.llm.ppm import Model, Scorer, gram_counts, model_of

UNKNOWN = "und"
ORDER = 3
#: The bound of the sample that the trees are fitted on: about so many texts of each language.
PER_LANGUAGE = 2000
#: The bound of the number of trees, which tasks hold and every text is scored by.
LANGUAGES = 256
SLICE = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER, languages: int = LANGUAGES) -> dict[str, Model]:
    """A tree for each of the ``languages`` most common values of ``lang`` in rows (doc_id, text, lang)."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").alias("model"))
    sizes = rows.groupBy("model").count().orderBy(F.desc("count"), "model").limit(languages).collect()
    if not sizes:
        return {}
    wanted = per_language * min(1.0, 16 / len(sizes))
    rates = rows.sparkSession.createDataFrame([(r.model, min(1.0, wanted / r["count"])) for r in sizes], "model string, rate double")
    drawn = rows.join(F.broadcast(rates), "model").where(share(F.struct("doc_id", "text"), 5) < F.col("rate")).drop("rate")
    return model_of(staged(gram_counts(drawn, order), "language-grams"), order)


def _guesser(docs: DataFrame, models: dict[str, Model]) -> Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]]:
    """A function for tasks: slices of a batch, the language of each row by its column text, and the scores."""
    names = sorted(models)
    shared = docs.sparkSession.sparkContext.broadcast([models[n] for n in names])
    scorers: list[Scorer] = []

    def guess(whole: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
        if names and not scorers:
            scorers.append(Scorer(shared.value, (1 << 19) >> max(0, (len(names) - 1).bit_length() - 4)))
        for batch in slices(whole, "text", SLICE):
            texts = batch.column(batch.schema.get_field_index("text"))
            lettered = [bool(t and _LETTER.search(t)) for t in texts.to_pylist()]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if scorers and any(lettered):
                nats = scorers[0].texts(*table_bytes(texts)) * np.log(10)
                best = nats.argmax(1)
                certain = 1 / np.exp(nats - nats.max(1, keepdims=True)).sum(1)
                langs = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered, strict=True)]
                scores = np.where(lettered, certain, 0.0)
            yield batch, langs, scores

    return guess


def predict(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """lang_pred and score for every whole text of (doc_id, text)."""
    guess = _guesser(docs, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, langs, scores in guess(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return arrow_map(docs, run, "doc_id long, lang_pred string, score double")


def _trained(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> dict[str, Model]:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return train(rows.where(~held_out()), per_language)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Train on the rows that are not held out, predict all rows."""
    models = _trained(docs, id_col, text_col, lang_col, per_language)
    return predict(keyed(docs, id_col, text_col), models).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that have a language; those predicted ``und`` go. All columns are kept, and each row is judged by itself."""
    guess = _guesser(docs, _trained(docs, "doc_id", "text", "lang", PER_LANGUAGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, langs, _ in guess(whole):
                yield batch.filter(pa.array([lang != UNKNOWN for lang in langs], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return identify(documents(spark, sf_dir))


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
