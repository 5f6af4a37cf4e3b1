"""Entrez as a Data Source: format `entrez`, for batches and for streams whose offsets are pages of the history server.

    spark.dataSource.register(EntrezSource)
    spark.readStream.format("entrez").options(email=..., query=..., progress=folder).load()

Rows are (page, value): a raw record and the page it came on. A page is `batch` records of the query's result, or `batch`
accessions of the file `accessions`, which tasks read for themselves. A stream takes `pages` of them a trigger; the offset
of what has been planned lies in the folder `progress` too, so that after a restart the stream goes on at the page that was
lost, and pages that are done are not asked for again. A batch read is all pages. One partition fetches, because the service
limits a client's rate. Option base: another address of the service.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from strandline.sources.genbank import file_system
from strandline.sources.ncbi import BASE, Entrez, split_records


class _Pages(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _Service:
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        get = self.options.get
        self.batch, self.most, self.db = int(get("batch", 200)), int(get("retmax", 10_000)), get("db", "nuccore")
        self.query, self.listed = get("query"), get("accessions")
        if bool(self.query) == bool(self.listed):
            raise ValueError("format entrez needs either a query or a file of accessions")
        self.client()

    def client(self) -> Entrez:
        return Entrez(self.options.get("email", ""), self.options.get("api_key"), base=self.options.get("base", BASE))

    def accessions(self) -> list[str]:
        system, inner = file_system(self.listed)
        with system.open_input_stream(inner) as f:
            lines = f.read().decode("utf-8", "replace").splitlines()
        return list(dict.fromkeys(x for line in lines if not line.lstrip().startswith("#") for x in line.replace(",", " ").split()))

    def pages(self) -> int:
        n = min(self.client().count(self.query, self.db), self.most) if self.query else len(self.accessions())
        return -(-n // self.batch)

    def read(self, part: _Pages) -> Iterator[tuple]:
        client = self.client()
        if self.query:
            found = client.history(self.query, self.db)
            last = min(int(found["count"]), self.most)
            texts = ((n, client.page(found, n * self.batch, min(self.batch, last - n * self.batch), self.db)) for n in range(part.first, part.end) if n * self.batch < last)
        else:
            every = self.accessions()
            texts = ((n, next(client.batches(some, self.batch, self.db))) for n in range(part.first, part.end) if (some := every[n * self.batch : (n + 1) * self.batch]))
        for n, text in texts:
            for record in split_records(text):
                yield n, record


class _Reader(_Service, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [_Pages(0, self.pages())]


class _StreamReader(_Service, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.step = int(self.options.get("pages", 1))
        if not self.options.get("progress"):
            raise ValueError("a stream of format entrez needs the option progress")
        self.folder = self.options["progress"].rstrip("/")
        self.planned = self._progress()

    def _progress(self) -> int:
        from pyarrow import fs

        system, inner = file_system(f"{self.folder}/pages")
        if system.get_file_info(inner).type == fs.FileType.NotFound:
            return 0
        with system.open_input_stream(inner) as f:
            return int(f.read() or 0)

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": max(self.planned, min(self.planned + self.step, self.pages()))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["page"] > self.planned:
            self.planned = end["page"]
            system, inner = file_system(self.folder)
            system.create_dir(inner, recursive=True)
            with system.open_output_stream(f"{inner}/pages.new") as f:
                f.write(str(self.planned).encode())
            system.move(f"{inner}/pages.new", f"{inner}/pages")
        return [_Pages(start["page"], end["page"])]

    def commit(self, end: dict) -> None:
        pass


class EntrezSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "entrez"

    def schema(self) -> str:
        return "page int, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)
