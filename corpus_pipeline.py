"""The corpus pipeline: language ID, toxicity, line dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on, with the columns they came with; the last one
gives their packed pieces. A decision belongs to a row, not to its id: rows without an id, or of one id, are judged by
their own texts. Of rows that are equal in every column near-dedup keeps one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType

from eligo.llm import language, line_dedup, near, packing, toxicity
from eligo.llm.common import remove, row_key, shared_folder, slices


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language stays open, go. The declared language is a document's own, its
    source is its host."""
    found = language.identify(docs, language.learn(docs), "doc_id", "source", "text", "lang", keep=tuple(docs.columns))
    return found.where("kept").select("row.*")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    field = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(docs, field, keep=tuple(docs.columns)).where("score < 0.3").select("row.*")


def _rewrite(names: list[str]):
    text_at, bitmap_at, size_at = names.index("text"), len(names), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = batch.columns[:bitmap_at]
            texts = []
            for text, bitmap in zip(columns[text_at].to_pylist(), batch.column(bitmap_at).to_pylist(), strict=True):
                texts.append(text if bitmap is None else "\n".join(line_dedup.kept_lines(text, bitmap)[0]))
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if size_at is not None:
                columns[size_at] = pa.array([None if t is None else len(t) for t in texts], columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that a larger id repeats, n_chars follows; every document stays."""
    marked = line_dedup.with_bitmaps(docs, into="__keep")
    return marked.mapInArrow(_rewrite(docs.columns), StructType(docs.schema.fields))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that share four fifths of their shingles of five words, or are connected by such, are a group. The smallest id of
    each stays; of several such rows the one of the smallest hash, and of rows that are equal in every column one (maps and
    variants can't be hashed: rows that differ in those alone count as equal). A group without an id keeps one row as well."""
    hashed = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    keyed = docs.withColumns({"__a": row_key(hashed)["a"], "__b": row_key(hashed)["b"]})
    groups = near.verified_groups(keyed, ("__a", "__b"))
    ids = keyed.select(F.col("__a").alias("k_a"), F.col("__b").alias("k_b"), "doc_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k_a", "k_b")
    first = groups.join(ids, ["k_a", "k_b"]).groupBy("root").agg(F.min_by(F.struct("k_a", "k_b"), order).alias("k")).select(F.col("k.k_a").alias("__a"), F.col("k.k_b").alias("__b"))
    names = ["__a", "__b"]
    kept = keyed.join(first, names, "left_semi")
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(*names))
    return kept.withColumn("__nth", nth).where("__nth = 1").drop(*names, "__nth")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("toxicity", toxic_out), ("line dedup", line_dedup_stage), ("SimHash near-dedup", near_dedup), ("best-fit packing", packed)]
#: Learned models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What a stage wrote is removed once the next stage is written; the last output stays for the caller."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        at = shared_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs
