"""What a stage gives: fact tables by name, hypotheses and errors apart; and how further analyses are hooked in."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.sinks import swap

#: Columns of the tables that every artifact has.
HYPOTHESES, ERRORS = "kind string, subject string, detail string", "code string, subject string, n long"


@dataclass
class Artifact:
    """Facts by collection; hypotheses (kind, subject, detail) and errors (code, subject, n) never mix with them."""

    name: str
    facts: dict[str, DataFrame]
    hypotheses: DataFrame | None = None
    errors: DataFrame | None = None

    def collections(self, spark: SparkSession) -> dict[str, DataFrame]:
        """All tables, empty ones of the fixed shape where a stage has no hypotheses or errors."""
        none = lambda schema: spark.createDataFrame([], schema)
        return {**self.facts, "hypotheses": self.hypotheses if self.hypotheses is not None else none(HYPOTHESES), "errors": self.errors if self.errors is not None else none(ERRORS)}

    def save(self, spark: SparkSession, workspace: str) -> dict[str, str]:
        """One table a collection under the workspace, each swapped in whole; gives their paths."""
        paths = {}
        for name, rows in self.collections(spark).items():
            paths[name] = f"{workspace.rstrip('/')}/{self.name}/{name}"
            swap(rows, paths[name])
        return paths

    def summary(self, spark: SparkSession) -> DataFrame:
        """(collection, n), counted where each table is read."""
        counted = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("collection"), "n") for name, rows in self.collections(spark).items()]
        out = counted[0]
        for c in counted[1:]:
            out = out.union(c)
        return out


def load(spark: SparkSession, workspace: str, name: str, collections: Iterable[str]) -> dict[str, DataFrame]:
    """The tables that a stage saved."""
    return {c: spark.read.parquet(f"{workspace.rstrip('/')}/{name}/{c}") for c in collections}


Stage = Callable[[SparkSession, dict[str, DataFrame]], Artifact]


class Plugin(Protocol):
    """M1: a further analysis over the tables of the stages before it."""

    name: str

    def analyze(self, spark: SparkSession, tables: dict[str, DataFrame]) -> Artifact: ...


def run_plugins(spark: SparkSession, tables: dict[str, DataFrame], plugins: Iterable[Plugin]) -> dict[str, Artifact]:
    """M1: plugins in order of their names, results by name; two of one name are an error."""
    ordered = sorted(plugins, key=lambda p: p.name)
    names = [p.name for p in ordered]
    if len(set(names)) < len(names):
        raise ValueError("plugins of one name")
    return {p.name: p.analyze(spark, dict(tables)) for p in ordered}


@dataclass
class Workspace:
    """M5: stages in order over shared tables; each stage sees the inputs and what the stages before it gave, as stage.collection."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    path: str | None = None
    artifacts: dict[str, Artifact] = field(default_factory=dict)

    def run(self, stages: Iterable[tuple[str, Stage]]) -> dict[str, Artifact]:
        """Each artifact is written and read back where the workspace has a path, so that a stage never repeats the work of another."""
        for name, stage in stages:
            made = stage(self.spark, self.tables)
            made.name = name
            if self.path:
                made.save(self.spark, self.path)
                read = load(self.spark, self.path, name, [*made.facts, "hypotheses", "errors"])
                made = Artifact(name, {k: v for k, v in read.items() if k in made.facts}, read["hypotheses"], read["errors"])
            self.artifacts[name] = made
            self.tables = {**self.tables, **{f"{name}.{k}": v for k, v in made.facts.items()}}
        return self.artifacts
