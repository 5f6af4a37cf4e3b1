"""GenBank flat files: a parser, a Data Source named `genbank`, and a writer.

A record ends with a line of two slashes. The source cuts files into ranges of bytes; a record belongs to the range in which
it begins, and a range finds its first record behind the first such line. It reads what file systems pyarrow knows, parses
only what the asked schema needs (without seq no sequence is built, without features none is read), and tells records by
record_id, name or organism before it parses the rest. read_genbank() reads any store through Spark's own text reader with
that line as separator. Locations collapse to their outer hull; the strand is + only where every part is; positions count
from 1.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from strandline.functions.names import filled
from strandline.schema import RECORD

LOCATION = re.compile(r"[<>]?(\d+)")


def parse_location(text: str) -> tuple[int, int, str]:
    """(start, end, strand) of a location: the outer hull, + unless some part is on the complement."""
    numbers = [int(n) for n in LOCATION.findall(re.sub(r"[A-Za-z_0-9.]+:", "", text))]
    return (min(numbers), max(numbers), "-" if "complement" in text else "+") if numbers else (0, 0, "-")


def parse_record(text: str, wanted: frozenset | None = None) -> dict | None:
    """One record; None where the text has no LOCUS line. wanted: the fields that are asked for, else all.

    Features are read for organism too, which they may have to give.
    """
    if wanted is not None and not wanted & {"seq", "seq_len"}:
        text = re.split(r"(?m)^ORIGIN", text, maxsplit=1)[0]
    if wanted is not None and "features" not in wanted and re.search(r"(?m)^  ORGANISM +\S", text):
        text = re.sub(r"(?ms)^FEATURES.*?(?=^\S|\Z)", "", text, count=1)
    lines = text.splitlines()
    if not any(line.startswith("LOCUS") for line in lines):
        return None
    out = {"record_id": "", "name": "", "description": "", "organism": "", "seq": "", "features": []}
    section, feature, key, bases, definition, locus, version, accession = "", None, None, [], [], "", "", ""
    for line in lines:
        head = line[:12].strip()
        if line[:1].strip():
            section = head
        if section == "LOCUS" and head == "LOCUS":
            locus = line[12:].split()[0] if line[12:].split() else ""
        elif section == "DEFINITION":
            definition.append(line[12:].strip())
        elif head == "ACCESSION":
            accession = (line[12:].split() or [""])[0]
        elif head == "VERSION":
            version = (line[12:].split() or [""])[0]
        elif head == "ORGANISM":
            out["organism"] = line[12:].strip()
        elif section == "FEATURES":
            if line.startswith("     ") and line[5:6].strip():
                feature = {"type": line[5:21].strip(), "location": line[21:].strip(), "qualifiers": {}}
                out["features"].append(feature)
                key = None
            elif feature is not None and line[:21].strip() == "":
                part = line[21:].rstrip()
                if part.startswith("/") and (m := re.match(r"/([\w-]+)(?:=(.*))?$", part)):
                    key = m[1]
                    feature["qualifiers"].setdefault(key, []).append(m[2] or "")
                elif key is None:
                    feature["location"] += part.strip()
                else:
                    values = feature["qualifiers"][key]
                    values[-1] += ("" if key == "translation" else " ") + part.strip()
        elif section == "ORIGIN" and head != "ORIGIN":
            bases.append(re.sub(r"[^A-Za-z]", "", line))
    for f in out["features"]:
        f["start"], f["end"], f["strand"] = parse_location(f.pop("location"))
        f["qualifiers"] = {k: [v.strip().strip('"').replace('""', '"') for v in vs] for k, vs in f["qualifiers"].items()}
    source = next((f for f in out["features"] if f["type"] == "source"), None)
    out["organism"] = out["organism"] or ((source or {}).get("qualifiers", {}).get("organism") or [""])[0]
    out |= {"record_id": version or accession or locus, "name": locus, "description": " ".join(definition).rstrip("."), "seq": "".join(bases).upper()}
    return out | {"seq_len": len(out["seq"])}


def _row(r: dict) -> tuple:
    features = [(f["type"], f["start"], f["end"], f["strand"], f["qualifiers"]) for f in r["features"]]
    return r["record_id"], r["name"], r["description"], r["organism"], r["seq"], r["seq_len"], features


FIELDS = ("record_id", "name", "description", "organism", "seq", "seq_len", "features")
#: Bytes of a range, and bytes before it in which the line that ends a record may begin.
SPLIT, BEFORE = 32 << 20, 64
#: Fields that a record's first lines tell.
EARLY = ("record_id", "name", "organism")


def file_system(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, or of the one file, in order; names that begin with _ or . are left out."""
    from pyarrow import fs

    system, inner = file_system(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in ("_", "."))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def range_records(path: str, start: int, end: int) -> Iterator[str]:
    """The texts of the records that begin at the bytes from start to before end."""
    system, inner = file_system(path)
    with io.BufferedReader(system.open_input_file(inner), 1 << 20) as f:
        at = max(0, start - BEFORE)
        f.seek(at)
        inside, held = start == 0, []
        skip = at > 0  # most likely within a line
        while line := f.readline():
            at += len(line)
            if skip:
                skip = False
            elif line.rstrip() == b"//":
                if held:
                    yield b"".join(held).decode("utf-8", "replace")
                held, inside = [], at >= start
                if at >= end:
                    return
            elif inside:
                held.append(line)
        if held:
            yield b"".join(held).decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fields: tuple[str, ...]):
        self.path, self.split = options.get("path"), int(options.get("splitBytes", SPLIT))
        if not self.path:
            raise ValueError("format genbank needs a path")
        self.fields, self.equal = fields, []

    def partitions(self) -> list[InputPartition]:
        return [_Range(p, s, min(s + self.split, size)) for p, size in listed(self.path) for s in range(0, size, self.split)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        wanted, told = frozenset(self.fields), frozenset(f for f, _ in self.equal)
        for text in range_records(partition.path, partition.start, partition.end):
            if told:
                first = parse_record(text, told)
                if first is None or any(first[f] not in values for f, values in self.equal):
                    continue
            if r := parse_record(text, wanted):
                row = dict(zip(FIELDS, _row(r)))
                yield tuple(row[f] for f in self.fields)


class _FilteringReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equal and in tests on what a record's first lines tell are done here; Spark does the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in EARLY:
                self.equal.append((f.attribute[0], frozenset(f.value) if isinstance(f, In) else frozenset([f.value])))
            else:
                yield f


class GenBankSource(DataSource):
    """register(spark); spark.read.format("genbank").load(path).

    A schema of some of the fields, given to the reader, is all that is parsed. Option splitBytes: the bytes of a range.
    Option pushFilters, true where register() was called: records are told by their first lines.
    """

    @classmethod
    def name(cls) -> str:
        return "genbank"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        unknown = [f for f in schema.names if f not in FIELDS]
        if unknown:
            raise ValueError(f"format genbank has no field {unknown[0]}")
        pushed = str(self.options.get("pushFilters", "false")).lower() == "true"
        return (_FilteringReader if pushed else _Reader)(self.options, tuple(schema.names))


def register(spark: SparkSession) -> None:
    """Make format genbank known, and let Spark give it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GenBankSource)


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """(value, file_path, file_block_start): the text of each record, with either kind of line end, and where it stands."""
    rows = spark.read.option("lineSep", "\n//").text(path).select(F.regexp_replace("value", r"^\s*\n|\r$", "").alias("value"), "_metadata.file_path", "_metadata.file_block_start")
    return rows.where("length(trim(value)) > 0")


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Rows of schema.RECORD from files in any store that Spark reads."""
    import pandas as pd

    names = ["record_id", "name", "description", "organism", "seq", "seq_len", "features"]

    def run(batches):
        for batch in batches:
            rows = [_row(r) for text in batch.value if (r := parse_record(text))]
            out = pd.DataFrame(rows, columns=names)
            out["features"] = [[dict(zip(("type", "start", "end", "strand", "qualifiers"), f)) for f in fs] for fs in out["features"]]
            yield out

    return raw_records(spark, path).select("value").mapInPandas(run, RECORD)


def single_genbank(spark: SparkSession, path: str) -> DataFrame:
    """The one record of a file; an error where there are none or several."""
    rows = read_genbank(spark, path)
    n = rows.limit(2).count()
    if n != 1:
        raise ValueError(f"{path} has {'no record' if n == 0 else 'several records'}; one is expected")
    return rows


def features_of(records: DataFrame, *kinds: str) -> DataFrame:
    """A row for each feature (of the kinds given): coordinates, relative positions, order within its kind, six qualifiers, name."""
    from strandline.functions.names import QUALIFIERS, display_name

    kept = F.filter("features", lambda f: f["type"].isin(*kinds)) if kinds else F.col("features")
    rows = records.select("record_id", "seq_len", F.posexplode(kept).alias("_pos", "f")).select("record_id", "seq_len", "_pos", "f.*")
    first = [F.try_element_at(F.try_element_at(F.col("qualifiers"), F.lit(q)), F.lit(1)).alias(q) for q in QUALIFIERS]
    rows = rows.select("record_id", "seq_len", F.col("_pos").alias("place"), "type", "start", "end", "strand", *first)
    from pyspark.sql import Window

    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("record_id", "type").orderBy("place")))
    rows = rows.withColumns({"length": F.col("end") - F.col("start") + 1, "rel_start": F.col("start") / F.col("seq_len"), "rel_end": F.col("end") / F.col("seq_len")})
    return rows.withColumn("name", display_name(F.col("type"), F.col("ord"), *(F.col(q) for q in QUALIFIERS))).drop("seq_len", "place")


def organism_of(records: DataFrame) -> DataFrame:
    """records with organism from the annotation, else the first source feature, else ''."""
    source = F.try_element_at(F.filter("features", lambda f: f["type"] == "source"), F.lit(1))
    other = F.try_element_at(F.try_element_at(source["qualifiers"], F.lit("organism")), F.lit(1))
    return records.withColumn("organism", F.coalesce(filled(F.col("organism")), filled(other), F.lit("")))


def _location(f: dict) -> str:
    return f"complement({f['start']}..{f['end']})" if f["strand"] == "-" else f"{f['start']}..{f['end']}"


def format_record(record_id: str, name: str, description: str, organism: str, seq: str, features) -> str:
    """A flat-file text that parse_record() reads back to the same record."""
    out = [f"LOCUS       {name or record_id} {len(seq)} bp    RNA     linear   VRL", f"DEFINITION  {description}.", f"ACCESSION   {record_id.split('.')[0]}", f"VERSION     {record_id}", f"SOURCE      {organism}", f"  ORGANISM  {organism}", "FEATURES             Location/Qualifiers"]
    for f in features:
        out.append(f"     {f['type']:<16}{_location(f)}")
        for key, values in dict(f["qualifiers"]).items():
            out += [f'                     /{key}="{v.replace(chr(34), chr(34) * 2)}"' for v in values]
    out.append("ORIGIN")
    for i in range(0, len(seq), 60):
        out.append(f"{i + 1:>9} " + " ".join(seq[i : i + 60][j : j + 10].lower() for j in range(0, 60, 10)).rstrip())
    return "\n".join(out) + "\n//\n"
