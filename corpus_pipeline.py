"""A training corpus from raw documents: language, duplicates, personal data, mixture, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parkflow.llm import langid, mixing, neardup, packing, pii
from parkflow.llm.common import saved, table
from parkflow.llm.queries import vocabulary

#: A language is accepted at this posterior (with four languages, an even guess has 0.25), and where a letter of the
#: text costs at most so many times what one costs on average in that language.
LEAST_SCORE, MOST_SURPRISE = 0.4, 3.0


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key each that stays the same however often they are read, so that decisions can be joined back row
    by row, and the key's name: where a row stands in its file, or, for rows that don't come straight from Parquet files,
    a number fixed by writing them."""
    key = _free(docs, "row_key")
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        place = docs.metadataColumn("_metadata")
        return docs.withColumn(key, F.concat_ws("-", F.md5(place["file_path"]), place["row_index"].cast("string"))), key
    return saved(docs.withColumn(key, F.monotonically_increasing_id().cast("string"))), key


def _content(docs: DataFrame) -> Column:
    """A hash of a row's values, each with whether it is null, for ties that shouldn't depend on how rows are laid out."""
    plain = lambda c, kind: F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if "map<" in kind else F.col(f"`{c}`")
    return F.xxhash64(F.lit(0), *[x for c, kind in docs.dtypes for x in (F.col(f"`{c}`").isNull(), plain(c, kind))])


def _whole(docs: DataFrame) -> Column:
    """128 bits of all that a row holds, nulls included."""
    named = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    return F.md5(F.to_json(named, {"ignoreNullFields": "false", "timestampFormat": micros, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: the text has a letter, and one of the learned languages fits it, both against the
    others (LEAST_SCORE) and by itself (MOST_SURPRISE: random letters or an unknown script fit none; the less was learned
    of a language, the less is expected).

    Null and empty texts and those without letters go; so does everything where no document has a language to learn.
    Repeated rows are judged each, and all columns are kept as they are. Only the texts go to Python.
    """
    path = vocabulary("piece_bpe_32k.model")
    model = langid.train(docs.filter(~F.coalesce(langid.held_out(), F.lit(False))), path)
    found = _free(docs, "language_found")
    fits = (F.col(f"{found}.lang_pred") != langid.UNDETERMINED) & (F.col(f"{found}.score") >= LEAST_SCORE) & (F.col(f"{found}.surprise") <= MOST_SURPRISE)
    return docs.withColumn(found, langid.language_of(spark, "text", model, path)).filter(fits).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (a similarity of 0.8 or more by shingles of five words).

    Every row is a document, whatever its doc_id: rows that share one, or have none, are compared by their texts like
    any others. Of a group the row with the smallest doc_id stays, nulls last, ties by a hash of the row. Null, empty and
    wordless texts are near-duplicates of nothing and stay, but of such rows that are repeated whole one does.
    """
    rows, key = _told_apart(docs)
    found = neardup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), width=5, percent=80, bands=40)
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = rows.select(F.col(key).alias("key"), F.col("doc_id").alias("id"), _content(docs).alias("content"), F.when(wordless, F.concat(F.lit("="), _whole(docs))).alias("alone"))
    found = found.select(F.col("doc_id").alias("key"), "component_id").join(own, "key")
    best = found.groupBy(F.coalesce("alone", "component_id").alias("group")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content", "key")).alias("best"))
    return rows.join(best.select(F.col("best.key").alias(key)), key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind in brackets.

    A null text stays null, an empty one empty; spans that overlap are replaced as one, by the kind of the first. Every
    row stays, repeated ones too, with its other columns.
    """
    spans = _free(docs, "pii_spans")
    found = pii.find_pii(docs, into=spans)
    return found.withColumn("text", pii.redact(F.col("text"), F.col(spans))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the mixture takes most of them (0 to 3 times), each copy where the curriculum comes
    to it. Within a source they stand by doc_id as in op8, those of null or equal ids by a hash of the row.

    A null source is a source. Null, empty and wordless texts hold no words to take, so they go. Repeated rows are
    documents each. An empty table stays empty.
    """
    rows, key = _told_apart(docs)
    numbers = rows.select("doc_id", "text", "source", _content(docs).alias("content"), F.col(key).alias("row"))
    mix = mixing.placed(numbers, ties=("content", "row")).filter("size > 0")
    mix = mix.withColumn("copies", F.round(F.col("taken") / F.col("size")).cast("int")).filter("copies > 0")
    mix = mix.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    position, content = _free(docs, "position_in_run"), _free(docs, "content_hash")
    copies = mix.select(F.col("row").alias(key), mixing.place_of_copy(F.col("copy")).alias(position), F.col("content").alias(content))
    taken = rows.join(copies, key)
    return taken.repartitionByRange(position, content).sortWithinPartitions(position, content).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end token alone, a long one is cut; repeated rows are packed each.
    """
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 2048)


STAGES = [
    ("language identification", language),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources", mixture),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as a table in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Languages, near-duplicates and packing aren't expressible in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None
