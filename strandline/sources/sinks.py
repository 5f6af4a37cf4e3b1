"""Sinks: result tables, FASTA, species files, ledger, configuration with backups, run log."""

from __future__ import annotations

import json
import logging
import logging.handlers
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.names import slug

#: The header of the result table.
RESULT_COLUMNS = (
    "query_id", "name", "source_name", "ref_start", "ref_end", "start", "end", "strand", "method", "status", "coverage", "identity", "score",
    "has_start_codon", "has_stop_codon", "in_frame", "rescue_target", "rescue_offset", "rescue_action", "length",
)


def result_rows(lifted: DataFrame) -> DataFrame:
    """The twenty columns of the result table as text: nulls are empty, booleans True or False."""
    rows = lifted.withColumns({"query_id": F.col("record_id"), "start": F.col("query_start"), "end": F.col("query_end"), "length": F.length("sequence")})
    kinds = dict(rows.dtypes)
    text = lambda c: F.initcap(F.col(c).cast("string")) if kinds[c] == "boolean" else F.col(c).cast("string")
    return rows.select(*((text(c) if c in kinds else F.lit(None).cast("string")).alias(c) for c in RESULT_COLUMNS))


def write_results(lifted: DataFrame, path: str, single: bool = False) -> None:
    """Tab-separated results with a header, also where there are no rows. single: one file, for small results."""
    rows = result_rows(lifted)
    (rows.coalesce(1) if single else rows).write.option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated rows with a header, also where there are none."""
    rows.write.option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_fasta(rows: DataFrame, path: str, by_gene: bool = True) -> None:
    """rows as summary.fasta_rows() gives them: a folder for each gene, or one of all."""
    if by_gene:
        rows.select("gene", F.col("fasta").alias("value")).repartition("gene").sortWithinPartitions("gene").write.partitionBy("gene").text(path)
    else:
        rows.orderBy("gene", "record_id", "query_start").select(F.col("fasta").alias("value")).write.text(path)


def write_species(records: DataFrame, path: str) -> None:
    """records (virus, text): a folder of flat files for each species, the texts as they came."""
    name = F.when(F.col("virus").isNull(), F.lit("_unmatched")).otherwise(slug(F.col("virus")))
    records.select(name.alias("slug"), F.col("text").alias("value")).write.partitionBy("slug").option("lineSep", "\n//\n").text(path)


def write_manifest(table: DataFrame, path: str) -> None:
    table.write.option("header", True).csv(path)


def append_ledger(table: DataFrame, path: str) -> None:
    """The new accessions of a manifest, added to the ledger folder."""
    table.where("status = 'new'").select("accession").distinct().write.mode("append").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object for each row; null fields are left out."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def save_config(config: dict, path: str, backups: str | None = None) -> str | None:
    """Write a configuration; what was there before goes to the backup folder, whose file is returned."""
    p, kept = Path(path), None
    if p.exists():
        folder = Path(backups) if backups else p.parent / "backups"
        folder.mkdir(parents=True, exist_ok=True)
        kept = folder / f"{p.stem}_{datetime.now():%Y%m%d_%H%M%S_%f}{p.suffix}"
        kept.write_bytes(p.read_bytes())
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(config, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return str(kept) if kept else None


def archive_config(path: str, folder: str | None = None) -> str | None:
    """Move a configuration that is no longer used to an archive folder, under a name with the time; None where there is none."""
    p = Path(path)
    if not p.exists():
        return None
    to = Path(folder) if folder else p.parent / "archive"
    to.mkdir(parents=True, exist_ok=True)
    return str(p.rename(to / f"{p.stem}_{datetime.now():%Y%m%d_%H%M%S_%f}{p.suffix}"))


def run_logger(path: str, most: int = 2_000_000, kept: int = 5) -> logging.Logger:
    """A logger of run events to a rotating file."""
    logger = logging.getLogger(f"strandline.run.{path}")
    if not logger.handlers:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handler = logging.handlers.RotatingFileHandler(path, maxBytes=most, backupCount=kept, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s | %(message)s"))
        logger.addHandler(handler)
        logger.setLevel(logging.INFO)
    return logger


def log_event(logger: logging.Logger, event: str, **fields) -> None:
    logger.info(" | ".join([event, *(f"{k}={v}" for k, v in fields.items())]))
