"""A crawl's outputs as one transaction: species files, manifest and ledger are committed together or not at all.

    spark.dataSource.register(CrawlSink)
    rows.write.format("crawl").option("ledger", ledger).mode("append").save(output)

rows: accession, organism, length, matched_virus, output_file, status, text. Tasks write under a folder of the write alone,
and each names its files in its commit message; a task that is repeated leaves files that no message names. The driver puts
all moves on record in one file, whose appearance is the commit, and then makes them; what a crash left undone is made by
the next write, or by recovered(). So the ledger has an accession if and only if its species file and manifest row are there.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from strandline.sources.genbank import file_system

FIELDS = ("accession", "organism", "length", "matched_virus", "output_file", "status", "text")
MANIFEST = FIELDS[:-1]
RECORD = "_commit-"


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


def _put(path: str, data: bytes) -> None:
    system, inner = file_system(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner) as f:
        f.write(data)


def _moved(source: str, target: str) -> None:
    """Move a file, if that is not done already."""
    from pyarrow import fs

    system, inner = file_system(source)
    if system.get_file_info(inner).type == fs.FileType.NotFound:
        return
    to = file_system(target)[1]
    system.create_dir(to.rpartition("/")[0], recursive=True)
    system.move(inner, to)


def recovered(path: str) -> int:
    """Make the moves of commits that are on record and were not finished; their number."""
    from pyarrow import fs

    system, inner = file_system(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return 0
    found = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith(RECORD) and f.base_name.endswith(".json")]
    for record in sorted(found):
        with system.open_input_stream(record) as f:
            moves = json.loads(f.read())
        for source, target in moves:
            _moved(source, target)
        system.delete_file(record)
    return len(found)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.ledger = options["path"].rstrip("/"), options.get("ledger", "").rstrip("/")
        missing = [f for f in FIELDS if f not in names]
        if missing or not self.ledger:
            raise ValueError(f"format crawl needs {'the column ' + missing[0] if missing else 'the option ledger'}")
        self.id = uuid.uuid4().hex
        self.staged = f"{self.path}/_staged-{self.id}"
        recovered(self.path)

    def write(self, iterator: Iterator) -> Written:
        task = uuid.uuid4().hex
        species: dict[str, list[str]] = {}
        rows, new, listed = 0, [], io.StringIO()
        table = csv.writer(listed, lineterminator="\n")
        table.writerow(MANIFEST)
        for r in iterator:
            table.writerow(["" if r[c] is None else r[c] for c in MANIFEST])
            rows += 1
            if r["status"] == "new":
                new.append(r["accession"])
                species.setdefault(r["output_file"] or "_unmatched.gb", []).append(f"{(r['text'] or '').rstrip()}\n//\n")
        if not rows:
            return Written([])
        files = [(f"species/{name.removesuffix('.gb')}/part-{self.id[:8]}-{task}.gb", "".join(texts)) for name, texts in species.items()]
        files.append((f"manifest/part-{self.id[:8]}-{task}.csv", listed.getvalue()))
        moves = []
        for name, text in files:
            _put(f"{self.staged}/{task}/{name}", text.encode())
            moves.append((f"{self.staged}/{task}/{name}", f"{self.path}/{name}"))
        if new:
            _put(f"{self.staged}/{task}/ledger.txt", "".join(f"{a}\n" for a in new).encode())
            moves.append((f"{self.staged}/{task}/ledger.txt", f"{self.ledger}/part-{self.id[:8]}-{task}.txt"))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        moves = sorted((m for x in messages if x for m in x.moves), key=lambda m: m[1].startswith(f"{self.ledger}/"))
        _put(f"{self.path}/{RECORD}{self.id}.tmp", json.dumps(moves).encode())
        _moved(f"{self.path}/{RECORD}{self.id}.tmp", f"{self.path}/{RECORD}{self.id}.json")
        recovered(self.path)
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs

        system, inner = file_system(self.staged)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir(inner)


class CrawlSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("format crawl appends")
        return _Writer(self.options, schema.names)
