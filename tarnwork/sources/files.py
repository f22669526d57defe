"""File readers: JSON arrays of commits, maps of clusters, text trees, listings, README choice, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.text import decode_bytes

COMMIT = "hash string, author string, date string, message string, modified_files_count int, modified_files array<string>, github_commit_url string, contains_optimization_keyword boolean, modified_func_count int, modified_other boolean, modified_func array<string>, is_opt_ds_simple string"

# Names of a README at the root, in order of preference; docs/README.md comes last.
README_NAMES = [
    "README.md", "readme.md", "README.MD", "ReadMe.md", "Readme.md", "README.markdown", "readme.markdown", "README.rst", "readme.rst", "ReadMe.rst", "README", "readme",
    "README.txt", "readme.txt", "README.adoc", "README.org", "README.asciidoc", "README.Md",
]


def commits_by_repository(spark: SparkSession, root: str, stage: str = "all_commit", schema: str = COMMIT, lines: bool = False) -> DataFrame:
    """JSON arrays in <root>/<repository>/<stage>.json; the repository is the folder's name. Missing keys are null.

    With ``lines``, folders repository_name=<repository> of JSON lines, as ``write_json`` leaves them; these can be split.
    """
    if lines:
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:[^/=]+=)?([^/]+)/[^/]+$", 1)
        df = spark.read.schema(schema).json(f"{root}/*/")
        return df.select(F.when(name != "__HIVE_DEFAULT_PARTITION__", F.url_decode(name)).alias("repository_name"), "*")
    df = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{stage}.json")
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+\.json$", 1).alias("repository_name"), "*")


def commits(spark: SparkSession, path: str, schema: str = "repository_name string, " + COMMIT, lines: bool = False) -> DataFrame:
    """A JSON array of commits, or JSON lines."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def clusters(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object of clusters by id as rows (cluster_id, fields)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias("cluster_id", "c")).select("cluster_id", "c.*")


def text_tree(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """(path, name, content, valid_utf8) of the files below a folder, decoded as UTF-8 or else ISO-8859-1."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), decode_bytes(F.col("content")).alias("content"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid_utf8"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, parent, name, length, modified) of the files below a folder, without reading them."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def attempt_files(files: DataFrame) -> DataFrame:
    """Files named <digits>.txt, with their number."""
    return files.where(F.col("name").rlike(r"^\d+\.txt$")).withColumn("attempt", F.regexp_extract("name", r"^(\d+)", 1).cast("int"))


def choose_readme(files: DataFrame, repository: str, path: str) -> DataFrame:
    """(repository, path) of each repository's README by the order of ``README_NAMES``; paths are relative to it."""
    order = F.array(*[F.lit(n) for n in README_NAMES], F.lit("docs/README.md"))
    rank = F.array_position(order, F.col(path))
    return files.where(rank > 0).groupBy(repository).agg(F.min_by(path, rank).alias(path))


def bytes_by_kind(files: DataFrame, kind: str, size: str) -> DataFrame:
    """(kind, files, bytes, mb) with a grand total under a null kind."""
    return files.rollup(kind).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.round(F.sum(size) / (1024 * 1024), 6).alias("mb"))


def results_by_interval(lo: int, hi: int, count, most: int = 1000) -> list[tuple[int, int]]:
    """Splits [lo, hi] in halves while more than or exactly ``most`` results are counted in it; the leaves, in order."""
    if count(lo, hi) >= most and lo < hi:
        mid = (lo + hi) // 2
        return results_by_interval(lo, mid, count, most) + results_by_interval(mid + 1, hi, count, most)
    return [(lo, hi)]
