"""Sinks. All are idempotent: writing again replaces what was there."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.config import Config


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet, partitioned by `by`; rows of a partition value are brought together first."""
    out = df.repartition(*by) if by else df
    w = out.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines that keep null fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """One CSV folder per value of `by`, with header."""
    df.repartition(*by).write.mode("overwrite").option("header", True).partitionBy(*by).csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def table_inventory(tables: DataFrame) -> DataFrame:
    """Tables without their texts, with `has_nll`."""
    return tables.withColumn("has_nll", F.coalesce(F.trim("nll") != "", F.lit(False))).drop("markdown", "nll")


def summary_json(df: DataFrame, path: str | Path) -> None:
    """A one-row frame as a JSON file on the driver."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    Path(path).write_text(json.dumps(rows[0].asDict(recursive=True), indent=2, default=str))


def read_or_build(spark, path: str, build) -> DataFrame:
    """The table at `path`; if there is none, `build()` is written there first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        write_table(build(), path)
    return spark.read.parquet(path)


def write_run(df: DataFrame, path: str, run_at: str) -> None:
    """A run's rows beside those of earlier runs, under `run_ts`; the same run again replaces its own."""
    df.write.mode("overwrite").parquet(f"{path}/run_ts={run_at}")


def write_chunks(chunks: DataFrame, path: str, kind: str = "kind") -> dict[str, int]:
    """Chunks by kind under `path`/chunks, with the counts by kind in `path`/counts; the counts come back."""
    write_table(chunks, f"{path}/chunks", (kind,))
    counts = chunks.sparkSession.read.parquet(f"{path}/chunks").groupBy(F.col(kind).cast("string").alias(kind)).agg(F.count(F.lit(1)).alias("n"))
    write_json(counts.coalesce(1), f"{path}/counts")
    return {r[kind]: r["n"] for r in chunks.sparkSession.read.json(f"{path}/counts").limit(1000).collect()}


def write_knowledge_base(chunks: DataFrame, meta: DataFrame, path: str) -> None:
    """The tables kb_chunks and kb_meta."""
    write_table(chunks, f"{path}/kb_chunks")
    write_table(meta, f"{path}/kb_meta")


def write_config(config: Config, path: str | Path) -> None:
    """A config as JSON, as `load_config` reads it."""
    Path(path).write_text(json.dumps(dataclasses.asdict(config), indent=2, ensure_ascii=False))


def content_key(spark, paths: Sequence[str], config: Config) -> str:
    """16 digits that change with the files under `paths` (name, size, time of change) or with the config."""
    hadoop, parts = spark._jvm.org.apache.hadoop.fs, []
    for p in sorted(paths):
        at = hadoop.Path(p)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
        parts += sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found)
    whole = "|".join(parts) + json.dumps(dataclasses.asdict(config), sort_keys=True)
    return hashlib.sha256(whole.encode()).hexdigest()[:16]


def markdown_report(title: str, sections: Sequence[tuple[str, DataFrame]], path: str | Path, most: int = 1000) -> None:
    """A report of small results as Markdown tables; a result of more than `most` rows is an error."""
    out = [f"# {title}"]
    for name, df in sections:
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
        out += [f"## {name}", "\n".join([line(df.columns), line("---" for _ in df.columns), *map(line, rows)])]
    Path(path).write_text("\n\n".join(out) + "\n")
