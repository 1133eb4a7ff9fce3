"""Readers that accept the shapes evaluation data comes in, and writers for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPES = ("samples", "questions", "data", "items")


def read_records(spark: SparkSession, path: str, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Records of a CSV, JSON Lines, JSON or Parquet file or folder.

    JSON may be a list of records, one record, or an envelope with the records under samples, questions, data or items.
    columns maps a wanted name to the names it may have, compared without case; a missing one raises ValueError.
    """
    low = path.rstrip("/").lower()
    if low.endswith(".csv"):
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    elif low.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif low.endswith(".jsonl"):
        df = spark.read.json(path)
    else:
        df = spark.read.json(path, multiLine=True)
    for name in ENVELOPES:
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType) and isinstance(df.schema[name].dataType.elementType, T.StructType):
            df = df.select(F.inline(name))
            break
    return resolve(df, columns) if columns else df


def resolve(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Renames columns: for each wanted name the first of its aliases, without regard to case or blanks around."""
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(c.strip().lower(), c)
    out = []
    for name, aliases in columns.items():
        found = next((have[a.lower()] for a in [name, *aliases] if a.lower() in have), None)
        if found is None:
            raise ValueError(f"no column for {name}; there are {df.columns}")
        out.append(F.col(f"`{found}`").alias(name))
    return df.select(*out)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """One query for each line that isn't blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> ''")


def read_query_map(spark: SparkSession, path: str) -> DataFrame:
    """qid, text of a JSON object that maps query ids to objects with a text."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<text:string>>").alias("m"))
    return whole.select(F.explode("m").alias("qid", "x")).select("qid", "x.text")


def read_texts(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """file, text: the files of a folder, at any depth, whose names end with a suffix, one row each."""
    name = F.regexp_extract(F.input_file_name(), rf"([^/]+){suffix.replace('.', chr(92) + '.')}$", 1)
    return spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{suffix}", recursiveFileLookup=True).select(name.alias("file"), F.col("value").alias("text"))


def rename_plan(spark: SparkSession, folder: str, old: str, new: str) -> DataFrame:
    """path, target, clash: the files of a folder, at any depth, that end with old, and their paths with new instead. Nothing is renamed.

    clash tells where several files would get the same path. Only names are read, no contents.
    """
    paths = spark.read.format("binaryFile").option("pathGlobFilter", f"*{old}").option("recursiveFileLookup", "true").load(folder).select("path")
    planned = paths.withColumn("target", F.concat(F.expr(f"left(path, length(path) - {len(old)})"), F.lit(new)))
    counts = planned.groupBy("target").agg(F.count("*").alias("n"))
    return planned.join(counts, "target").select("path", "target", (F.col("n") > 1).alias("clash"))


def read_examples(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Training examples of JSON Lines files, at most so many; null for all."""
    df = spark.read.json(path)
    return df if most is None else df.limit(most)


def valid_examples(df: DataFrame, ids: str, mask: str, most: int) -> DataFrame:
    """Examples whose mask is as long as their token ids and that have from 1 to most of them; nulls aren't valid."""
    n = F.size(ids)
    return df.where(F.col(ids).isNotNull() & F.col(mask).isNotNull() & (F.size(mask) == n) & (n > 0) & (n <= most))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, rel of judgements with query-id, corpus-id and score."""
    return resolve(spark.read.json(path, multiLine=True), {"qid": ["query-id"], "doc_id": ["corpus-id"], "rel": ["score"]}).select(F.col("qid").cast("string"), F.col("doc_id").cast("string"), F.col("rel").cast("int"))


def read_pairs(spark: SparkSession, folder: str, doc_suffix: str = ".md", code_suffix: str = ".abap") -> tuple[DataFrame, DataFrame]:
    """(pairs, unpaired): files of a folder joined by their base name; file, doc, code, and what misses its other side."""
    read = lambda suffix, name: read_texts(spark, folder, suffix).withColumnRenamed("text", name)
    both = read(doc_suffix, "doc").join(read(code_suffix, "code"), "file", "full")
    return both.where("doc IS NOT NULL AND code IS NOT NULL"), both.where("doc IS NULL OR code IS NULL").select("file", F.when(F.col("doc").isNull(), "doc").otherwise("code").alias("missing"))


def chunk_metadata(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Chunks with their JSON metadata as columns; missing texts become empty and a missing length 0."""
    schema = "previous_chunk_id STRING, next_chunk_id STRING, code_snippet STRING, length INT, filename STRING"
    m = F.from_json(metadata, schema)
    rest = [c for c in df.columns if c != metadata]
    return df.select(*rest, m["previous_chunk_id"].alias("previous_chunk_id"), m["next_chunk_id"].alias("next_chunk_id"), F.coalesce(m["code_snippet"], F.lit("")).alias("code_snippet"), F.coalesce(m["length"], F.lit(0)).alias("length"), F.coalesce(m["filename"], F.lit("")).alias("filename"))


def guess_columns(df: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Renames columns by ordered rules: each wanted name takes the first column not taken yet that holds one of its fragments, without regard to case.

    A wanted name without a column raises ValueError.
    """
    left, out = list(df.columns), []
    for name, fragments in rules:
        found = next((c for f in fragments for c in left if f.lower() in c.lower()), None)
        if found is None:
            raise ValueError(f"no column for {name}; there are {df.columns}")
        left.remove(found)
        out.append(F.col(f"`{found}`").alias(name))
    return df.select(*out)


def write_results(df: DataFrame, path: str, kind: str = "json", mode: str = "overwrite") -> None:
    """Writes results, or appends them with mode append; nested columns become JSON text in CSV."""
    if kind == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).csv(path, header=True, escape='"')
    else:
        df.write.mode(mode).format(kind).save(path)


def write_with_statistics(df: DataFrame, statistics: DataFrame, path: str, kind: str = "json") -> None:
    """Writes results under path/results and their statistics (a few rows) under path/statistics, instead of one file around both."""
    write_results(df, f"{path}/results", kind)
    write_results(statistics.coalesce(1), f"{path}/statistics", kind)


def append_conversations(store: DataFrame, new: DataFrame, collection: str) -> DataFrame:
    """Rows to append to a store of conversations: conversation_id (conv_ and a number after those in the store), at, collection, messages.

    store: conversation_id; new: messages and key, a unique column that gives the order. The greatest number of the store counts, so ids stay unique after deletions.
    """
    from docskein.operators.evaluation import numbered

    number = F.regexp_extract("conversation_id", r"^conv_(\d+)$", 1)
    last = store.agg(F.coalesce(F.max(number.try_cast("long")), F.lit(0)).alias("last"))
    rows = numbered(new.select("key", "messages"), "key", "n").crossJoin(F.broadcast(last))  # one row
    return rows.select(F.concat(F.lit("conv_"), (F.col("last") + F.col("n")).cast("string")).alias("conversation_id"), F.current_timestamp().alias("at"), F.lit(collection).alias("collection"), "messages")
