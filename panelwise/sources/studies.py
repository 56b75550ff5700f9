"""Trial study folders: tab exports, else dumps, of the four study tables; laboratory results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.operators.joins import subject_table
from panelwise.operators.panel import pivot_panel
from panelwise.schemas import LAB_RESULTS, STUDY_TABLES, TRIAL_TABLES
from panelwise.sources.delimited import _PATH, read_delimited, read_dump
from panelwise.vocabulary import STUDY_TAGS

_STUDY = r"(SDY\d+)"


def find_files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Paths under ``root`` whose file name fits the pattern; only names are read."""
    try:
        listing = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern)
            .load(root)
        )
        return sorted(r["path"] for r in listing.select("path").collect())
    except AnalysisException:
        return []


def _study_of(path: str) -> str | None:
    import re

    found = re.search(_STUDY, path)
    return found.group(1) if found else None


def read_study_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table of all studies with its ``study`` column.

    A study's tab export is read if there is one, its dump otherwise. Each format is one scan over
    the files of all studies.
    """
    schema = TRIAL_TABLES[table].schema
    paths = find_files(spark, root, f"{table}.txt")
    tabs = [p for p in paths if "/Tab/" in p]
    with_tab = {_study_of(p) for p in tabs}
    dumps = [p for p in paths if "/MySQL/" in p and _study_of(p) not in with_tab]
    rows = read_delimited(spark, tabs, schema, with_path=True) if tabs else None
    if dumps:
        dumped = read_dump(spark, dumps, schema, with_path=True)
        rows = dumped if rows is None else rows.unionByName(dumped)
    if rows is None:
        return spark.createDataFrame([], schema).withColumn("study", F.lit(None).cast("string"))
    return rows.withColumn("study", F.regexp_extract(_PATH, _STUDY, 1)).drop(_PATH)


def read_lab_results(spark: SparkSession, root: str) -> DataFrame:
    """Laboratory results of all studies; a file that lies in two places counts once."""
    paths = [p for p in find_files(spark, root, "*[iI][gG][eE]*.txt") if "/StudyFiles/" in p]
    rows = read_delimited(spark, paths, LAB_RESULTS.schema)
    return rows.distinct().withColumnRenamed("Accession", "subject_accession")


def read_studies(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    tables = {t: read_study_table(spark, root, t) for t in STUDY_TABLES}
    tables["lab_results"] = read_lab_results(spark, root)
    return tables


def lab_panel(results: DataFrame, antigens: list[str], by=("subject_accession",)) -> DataFrame:
    """Average antibody result per antigen and antibody: columns ``{antigen}_{antibody}``."""
    tagged = results.withColumn("assay", F.concat_ws("_", "IGEANTIG", "IGEANTIB"))
    return pivot_panel(tagged, by, "assay", "IGERESL", antigens)


def trial_table(tables: dict[str, DataFrame], assays: list[str]) -> DataFrame:
    """Subjects of all studies with their exposures and laboratory panel; studies are tagged."""
    tag = F.create_map(*[F.lit(x) for pair in STUDY_TAGS.items() for x in pair])
    joined = subject_table(
        tables["subject"], tables["immune_exposure"].drop("study"), lab_panel(tables["lab_results"], assays)
    )
    return joined.withColumn("study", F.coalesce(tag[F.col("study")], F.col("study")))
