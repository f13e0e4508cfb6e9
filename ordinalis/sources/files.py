"""File sources and sinks: listings as CSV, photo folders, the submission file, and the stage cache."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinalis.sources.tables import pad_id

# Picture endings and the form of a photo's file name.
PHOTO_NAME = r"^([0-9a-f]+)-(\d+)$"
PHOTO_ENDINGS = r"(?i)\.(?:jpg|jpeg|png)$"


def read_listings(spark: SparkSession, path: str, labelled: bool) -> DataFrame:
    """The listing CSV: ids are read as text (some look like floats) and padded, null texts become empty, line breaks inside quoted
    texts are kept. The schema is given, so the file is read once."""
    schema = "PetID string, Description string" + (", AdoptionSpeed int" if labelled else "")
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.withColumn("PetID", pad_id("PetID")).withColumn("Description", F.coalesce("Description", F.lit("")))


def photo_columns(path: Column) -> dict[str, Column]:
    """PetID, img_idx and split as the file name gives them; all null where the ending or the name does not fit."""
    flat = F.regexp_replace(path, r"\\", "/")
    base = F.regexp_extract(flat, "([^/]*)$", 1)
    stem = F.regexp_replace(base, PHOTO_ENDINGS, "")
    fits = base.rlike(PHOTO_ENDINGS) & stem.rlike(PHOTO_NAME)
    return {
        "PetID": F.when(fits, F.regexp_extract(stem, PHOTO_NAME, 1)),
        "img_idx": F.when(fits, F.regexp_extract(stem, PHOTO_NAME, 2).try_cast("int")),
        "split": F.when(fits, F.regexp_extract(flat, "([^/]*)/[^/]*$", 1)),
    }


def index_photos(paths: DataFrame, path: str = "path") -> DataFrame:
    """(PetID, path, img_idx, split) of the paths that are photos."""
    return paths.select(F.col(path).alias("path"), *(c.alias(n) for n, c in photo_columns(F.col(path)).items())).where("PetID is not null").select("PetID", "path", "img_idx", "split")


def scan_photos(spark: SparkSession, folder: str) -> DataFrame:
    """The photo index of a folder tree with the files' sizes; contents are pruned, so no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = files.select("path", *(c.alias(n) for n, c in photo_columns(F.col("path")).items()), "length")
    return named.where("PetID is not null").select("PetID", "path", "img_idx", "split", "length")


def submission(raw_ids: DataFrame, predictions: DataFrame) -> DataFrame:
    """(PetID, AdoptionSpeed) under the raw spelling of each id.

    ``raw_ids`` has PetID as delivered, ``predictions`` has PetID (padded) and pred. Raises ValueError unless the two hold the same
    ids, each once.
    """
    raw = raw_ids.select(F.col("PetID").alias("raw"), pad_id("PetID").alias("id"))
    both = raw.groupBy("id").agg(F.count("*").alias("n"), F.first("raw").alias("raw")).join(predictions.groupBy(F.col("PetID").alias("id")).agg(F.count("*").alias("m"), F.first("pred").alias("pred")), "id", "full")
    bad = both.where("n is null or m is null or n <> 1 or m <> 1").count()
    if bad:
        raise ValueError(f"prediction ids do not match the delivered ids: {bad} differ or repeat")
    return both.select(F.col("raw").alias("PetID"), F.col("pred").cast("int").alias("AdoptionSpeed"))


def write_submission(raw_ids: DataFrame, predictions: DataFrame, path: str) -> None:
    """The submission as CSV, in the order of the ids."""
    submission(raw_ids, predictions).orderBy("PetID").write.mode("overwrite").option("header", True).csv(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, vector) of every ``.npy`` matrix below ``path``: half, single or double precision becomes ``array<float>`` or, for
    doubles, loses no more than single precision does. A vector file is a matrix of one column. Files are read where they lie, one
    task a file, and their rows leave in blocks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                matrix = matrix.reshape(len(matrix), -1)
                for a in range(0, len(matrix), 4096):
                    part = matrix[a : a + 4096].astype(np.float32)
                    yield pd.DataFrame({"file": name, "row_no": np.arange(a, a + len(part)), "vector": list(part)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInPandas(rows, "file string, row_no long, vector array<float>")


def npy_bytes(df: DataFrame, group: str, order: str, vector: str, dtype: str = "float16") -> DataFrame:
    """(group, content): the rows of every group, in order, as the bytes of one ``.npy`` matrix. A group is a file, so it must fit a task."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        np.save(held, np.stack(part.sort_values(order)[vector].to_list()).astype(dtype), allow_pickle=False)
        return pd.DataFrame({group: [part[group].iloc[0]], "content": [held.getvalue()]})

    return df.select(group, order, vector).groupBy(group).applyInPandas(pack, f"{group} {df.schema[group].dataType.simpleString()}, content binary")


def fingerprint(spark: SparkSession, inputs: list[str]) -> str:
    """Changes when a file below one of the paths is added, removed, resized or written anew; contents are not read."""
    jvm, seen = spark.sparkContext._jvm, []
    for path in sorted(inputs):
        root = jvm.org.apache.hadoop.fs.Path(path)
        listed = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
        while listed.hasNext():
            f = listed.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(seen)).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, stage: str, parameters: dict, build, inputs: list[str] | None = None) -> DataFrame:
    """The stage's result from ``folder`` if it was written with the same parameters from the same input files, else built and written.
    Both are part of the name, so a change of either never reads a stale result; a broken write leaves no success mark and is rebuilt."""
    made_of = [parameters, fingerprint(spark, inputs or [])]
    mark = hashlib.sha256(json.dumps(made_of, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder}/{stage}-{mark}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
