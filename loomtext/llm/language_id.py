"""Language ID by compression: a text belongs to the language whose dictionary compresses it best.

Every language gets one zstandard raw-content dictionary, filled from a bounded sample of
its labelled texts.  A text is lower-cased and compressed whole with each dictionary; the
smallest result names the language.  The score is the code-length posterior, 1 / sum(2 ** -(size - best)),
so one byte of margin against one rival gives 2/3; scores under ``least_score`` are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import digest_of, fields_of, held

#: The sample for each language: documents at most, and bytes of dictionary at most.
SAMPLE_DOCS, DICTIONARY_BYTES = 300, 96 * 1024
LEVEL, LEAST_SCORE = 6, 0.6


def learn_dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary for each language, from a bounded sample of labelled rows.

    A language's sample are the ``sample_docs`` distinct rows with the lowest 64-bit hash of
    key and text.  Rows are thinned by a bound on the hash that is set from the count of
    their own language, four times what is wanted, before the lowest are taken, so no
    language crowds out another and what is sorted stays small at any input size.  All
    languages are learned.  Rows with a null language or an empty text are not used.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("place")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = rows.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return {}
    bounds = spark.createDataFrame([(r["lang"], _bound(4 * sample_docs, r["count"])) for r in counts], "lang string, bound bigint")
    thinned = rows.join(F.broadcast(bounds), "lang").where(F.col("place") <= F.col("bound")).select("lang", "place", "text").distinct()
    lowest = thinned.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))).where(F.col("k") <= sample_docs)
    found: dict[str, list[tuple[int, bytes]]] = {}
    for row in lowest.select("lang", "k", "text").toLocalIterator():  # sample_docs texts a language
        found.setdefault(row["lang"], []).append((row["k"], row["text"].encode("utf-8", "replace")))
    out = {}
    for name, texts in sorted(found.items()):
        taken, size = [], 0
        for _, t in sorted(texts):
            if size and size + len(t) > dictionary_bytes:
                continue
            taken.append(t[-4 * dictionary_bytes:])
            size += len(t) + 1
        out[name] = b"\n".join(taken)[-4 * dictionary_bytes:]
    return out


def _bound(wanted: int, count: int) -> int:
    """The signed 64-bit hash below which about ``wanted`` of ``count`` rows lie."""
    return (1 << 63) - 1 if wanted >= count else (wanted << 64) // count - (1 << 63)


class Classifier:
    """Compressors that share one dictionary each; ties go to the name that sorts first."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as zstd

        self.names = sorted(dictionaries)
        self.compress = []
        for name in self.names:
            content = zstd.ZstdCompressionDict(dictionaries[name].decode("utf-8", "replace").lower().encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compress.append(zstd.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not (text.isalpha() or any(map(str.isalpha, text))):
            return "und", 0.0
        raw = text.lower().encode("utf-8", "replace")
        sizes = [len(f(raw)) for f in self.compress]
        best = min(sizes)
        return self.names[sizes.index(best)], 1 / sum(2.0 ** -min(s - best, 60) for s in sizes)


def identify_language(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``lang_accepted``; rows don't move.

    Null texts and texts without a letter are ``und`` with score 0 and not accepted.
    With no dictionary at all every text is ``und``.  Ties go to the name that sorts first;
    very long texts are compressed whole; columns named like an added one are replaced.
    """
    added = ("lang_pred", "score", "lang_accepted")
    kept = [c for c in df.columns if c not in added]
    schema = ", ".join(filter(None, (fields_of(df, kept), "lang_pred string, score double, lang_accepted boolean")))
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)  # 4 * DICTIONARY_BYTES a language at most
    name = "language " + digest_of(*(x for k, v in sorted(dictionaries.items()) for x in (k.encode(), v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = held(name, lambda: Classifier(shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                got = [classify(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[1] >= least_score for g in got], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, *columns], names=[*kept, *added])

    return df.mapInArrow(run, schema)
