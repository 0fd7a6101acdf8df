"""Raw question and answer files: CSV with a header, every field read as text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

QUESTION_FIELDS = ["Id", "Score", "Title", "Body"]
ANSWER_FIELDS = ["Id", "ParentId", "Score", "Body"]


def _any_case(file_name: str) -> str:
    """Glob that matches a file name whatever its case."""
    return "".join(
        f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in file_name
    )


def read_text_csv(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Read the file's columns as text, in file order, and drop malformed rows.

    ``fields`` names all columns of the file. Quoted fields may hold commas and
    line ends, and a doubled quote stands for one. Column pruning is off:
    with it Spark would not notice a row of the wrong length.
    """
    schema = ", ".join(f"`{name}` string" for name in fields)
    reader = spark.read.schema(schema).options(
        header=True,
        mode="DROPMALFORMED",
        multiLine=True,
        escape='"',
        columnPruning=False,
        enforceSchema=True,
    )
    return reader.csv(path)


def header_fields(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line of a file."""
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError(f"{path} is empty")
    return [name.strip().strip('"') for name in line[0].lstrip("\ufeff").split(",")]


def read_raw_table(spark: SparkSession, folder: str, file_name: str, needed: list[str]) -> DataFrame:
    """Find a CSV file, or a folder of parts, by name and read it.

    The exact name wins; without it any spelling that differs in case does.
    """
    path = f"{folder.rstrip('/')}/{file_name}"
    try:
        fields = header_fields(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        path = f"{folder.rstrip('/')}/{_any_case(file_name)}"
        fields = header_fields(spark, path)
    missing = sorted(set(needed) - set(fields))
    if missing:
        raise ValueError(f"{file_name} lacks columns: {', '.join(missing)}")
    return read_text_csv(spark, path, fields).select(*needed)


def read_questions(spark: SparkSession, folder: str) -> DataFrame:
    return read_raw_table(spark, folder, "Questions.csv", QUESTION_FIELDS)


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    return read_raw_table(spark, folder, "Answers.csv", ANSWER_FIELDS)
