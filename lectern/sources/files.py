"""Text, CSV and binary sources of the corpus: questions, id lists, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.text import stem_of_path


class InvalidInput(ValueError):
    """A source that must not be used, with what is wrong in it."""


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines: line_no (from 1, per file), raw, row (null if malformed). Blank and ``//`` lines are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "raw"))
    rows = lines.where((F.trim("raw") != "") & ~F.startswith(F.trim("raw"), F.lit("//")))
    return rows.select((F.col("at") + 1).alias("line_no"), "raw", F.from_json("raw", schema, {"mode": "PERMISSIVE"}).alias("row"))


def read_questions(spark: SparkSession, path: str, allow_stub: bool = False) -> DataFrame:
    """Validated questions; InvalidInput names the line of the first fault."""
    from ..operators.guards import is_stub, question_faults

    if is_stub(path) and not allow_stub:
        raise InvalidInput(f"{path} is a stub and holds no real questions")
    rows = read_jsonl(spark, path, schemas.QUESTION)
    faults = question_faults(rows).where("size(faults) > 0").orderBy("line_no").limit(1).collect()
    if faults:
        raise InvalidInput(f"{path}:{faults[0].line_no}: {'; '.join(faults[0].faults)}")
    questions = rows.select("row.*")
    twice = questions.groupBy("id").count().where("count > 1").orderBy("id").limit(1).collect()
    if twice:
        raise InvalidInput(f"{path}: question {twice[0].id} occurs {twice[0]['count']} times")
    if questions.isEmpty():
        raise InvalidInput(f"{path} has no questions")
    return questions


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids (id): text after ``#`` and blank lines are dropped; stubs and empty lists are refused."""
    from ..operators.guards import is_stub

    if is_stub(path):
        raise InvalidInput(f"{path} is a stub and names no real ids")
    ids = spark.read.text(path).select(F.trim(F.substring_index("value", "#", 1)).alias("id")).where("id <> ''").distinct()
    if ids.isEmpty():
        raise InvalidInput(f"{path} names no ids")
    return ids


def build_manifest(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """external_id, filename, sha256, size_bytes of a folder's files; InvalidInput if none or an id twice."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    out = files.select(stem_of_path(F.col("path")).alias("external_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    counts = out.groupBy("external_id").count()
    worst = counts.agg(F.count("*"), F.max("count")).first()
    if not worst[0]:
        raise InvalidInput(f"no {pattern} in {folder}")
    if worst[1] > 1:
        raise InvalidInput(f"an id occurs twice in {folder}")
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.MANIFEST)


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.EXCLUSION)


def write_report(df: DataFrame, path: str) -> None:
    """A JSON report, one object a line."""
    df.write.mode("overwrite").json(path)
