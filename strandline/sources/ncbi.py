"""The Entrez service: pages of a query through its history server, or batches of accessions; a page is a request."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request

BASE = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/"
#: Seconds between requests, without and with a key.
DELAY, DELAY_WITH_KEY = 0.383, 0.12
#: How often a request that fails is made in all.
TRIES = 4


def _open(url: str) -> str:
    with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310
        return r.read().decode("utf-8", "replace")


class Entrez:
    def __init__(self, email: str, api_key: str | None = None, open_url=_open, base: str = BASE):
        if not email or "@" not in email:
            raise ValueError("an e-mail address is required to use the service")
        self.base, self.common, self.open, self.delay, self.last = base, {"email": email} | ({"api_key": api_key} if api_key else {}), open_url, DELAY_WITH_KEY if api_key else DELAY, 0.0

    def ask(self, tool: str, **options) -> str:
        for left in reversed(range(TRIES)):
            wait = self.last + self.delay - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            self.last = time.monotonic()
            try:
                return self.open(f"{self.base}{tool}.fcgi?{urllib.parse.urlencode(options | self.common)}")
            except OSError:
                if not left:
                    raise
                time.sleep(self.delay * 2 ** (TRIES - left))

    def count(self, query: str, db: str = "nuccore") -> int:
        return int(json.loads(self.ask("esearch", db=db, term=query, retmax=0, retmode="json"))["esearchresult"]["count"])

    def pages(self, query: str, retmax: int = 10_000, batch: int = 200, db: str = "nuccore"):
        found = self.history(query, db)
        for start in range(0, min(int(found["count"]), retmax), batch):
            yield self.page(found, start, min(batch, retmax - start), db)

    def history(self, query: str, db: str = "nuccore") -> dict:
        """count, querykey and webenv of a query that the history server keeps."""
        return json.loads(self.ask("esearch", db=db, term=query, retmax=0, usehistory="y", retmode="json"))["esearchresult"]

    def page(self, found: dict, start: int, n: int, db: str = "nuccore") -> str:
        return self.ask("efetch", db=db, query_key=found["querykey"], WebEnv=found["webenv"], retstart=start, retmax=n, rettype="gbwithparts", retmode="text")

    def batches(self, accessions: list[str], batch: int = 200, db: str = "nuccore"):
        for i in range(0, len(accessions), batch):
            yield self.ask("efetch", db=db, id=",".join(accessions[i : i + batch]), rettype="gbwithparts", retmode="text")


def split_records(page: str) -> list[str]:
    return [p.strip("\n") for p in page.split("\n//") if "LOCUS" in p]
