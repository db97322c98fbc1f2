"""Services that answer in pages behind a cursor, as a stream; and a store of files by content.

Both are Spark data sources. What they talk to is a small class with one method, so that another service is another
class; the ones here read answers from files and keep contents in a folder that all workers share.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage


@dataclass
class Page(InputPartition):
    """A request that a task makes: what lies behind one cursor, up to another."""

    after: str
    upto: str


class CursorReader(DataSourceStreamReader):
    """Hits behind a cursor, ascending by their sort values; the stream's offset is the cursor of the last hit.

    service.page(after): the hits of the page behind a cursor (a JSON list of sort values, or null for the start),
    each with `sort`, `_id` and `_source`. The driver follows cursors only, `pages` of them a batch; the
    hits are asked for again by the tasks, so a lost task is asked for again too, with the same cursor.
    """

    def __init__(self, service, pages: int) -> None:
        self.service, self.pages, self.known = service, pages, None

    def initialOffset(self) -> dict:
        return {"after": "null"}

    def latestOffset(self) -> dict:
        after = self.known or "null"
        for _ in range(self.pages):
            hits = self.service.page(json.loads(after))
            if not hits:
                break
            after = json.dumps(hits[-1]["sort"])
        self.known = after
        return {"after": after}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        pages, after = [], start["after"]
        while after != end["after"]:
            hits = self.service.page(json.loads(after))
            if not hits:
                break
            upto = json.dumps(hits[-1]["sort"])
            if json.loads(upto) > json.loads(end["after"]):
                upto = end["after"]
            pages.append(Page(after, upto))
            after = upto
        self.known = max(self.known or "null", end["after"], key=lambda x: json.loads(x) or [])
        return pages

    def read(self, partition: Page) -> Iterator[tuple]:
        for hit in self.service.page(json.loads(partition.after)):
            if hit["sort"] <= json.loads(partition.upto):
                yield json.dumps(hit["sort"]), str(hit["_id"]), json.dumps(hit["_source"], ensure_ascii=False, sort_keys=True)

    def commit(self, end: dict) -> None:
        pass


class PageFiles:
    """A service whose answers lie in files: {"hits": {"hits": [...]}}. Files come later, hits are sorted within and over them by name."""

    def __init__(self, folder: str, size: int) -> None:
        self.folder, self.size = folder, size

    def page(self, after: list | None) -> list[dict]:
        found: list[dict] = []
        for path in sorted(glob.glob(f"{self.folder}/*.json")):
            with open(path, encoding="utf-8") as file:
                hits = json.load(file)["hits"]["hits"]
            if hits and (after is None or hits[-1]["sort"] > after):
                found += [hit for hit in hits if after is None or hit["sort"] > after]
                if len(found) >= self.size:
                    break
        return found[: self.size]


class PagedHits(DataSource):
    """Options: path, page_size (100), pages (per batch, 10). Columns: sort (the cursor as JSON), id, hit (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged_hits"

    def schema(self) -> str:
        return "sort string, id string, hit string"

    def streamReader(self, schema) -> CursorReader:
        return CursorReader(PageFiles(self.options["path"], int(self.options.get("page_size", 100))), int(self.options.get("pages", 10)))


@dataclass
class Written(WriterCommitMessage):
    """Contents that a task has written: temporary file and final name."""

    files: list[tuple[str, str]]


class ContentWriter(DataSourceWriter):
    """Rows (tenant, name, content) to root/tenant/sha256-name; a content that is there is not written again.

    Tasks write temporary files; the commit moves them to their names, an abort deletes them. What a failed task
    leaves is below root/_new and nothing reads it.
    """

    def __init__(self, root: str, columns: list[str]) -> None:
        self.root, self.columns, self.job = root, columns, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        import re

        files, folder = [], f"{self.root}/_new/{self.job}"
        for row in iterator:
            content = bytes(row["content"] or b"")
            name = f"{hashlib.sha256(content).hexdigest()}-{re.sub(r'[^A-Za-z0-9._-]+', '_', row['name'] or 'file')}"
            final = f"{self.root}/{row['tenant']}/{name}"
            if os.path.exists(final):
                continue
            os.makedirs(folder, exist_ok=True)
            new = f"{folder}/{uuid.uuid4().hex}"
            with open(new, "wb") as file:
                file.write(content)
            files.append((new, final))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for new, final in (x for message in messages if message for x in message.files):
            os.makedirs(os.path.dirname(final), exist_ok=True)
            os.replace(new, final)  # equal content, so the last of several wins without a difference
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        folder = f"{self.root}/_new/{self.job}"
        if os.path.isdir(folder):
            for name in os.listdir(folder):
                os.unlink(f"{folder}/{name}")
            os.rmdir(folder)


class ContentStore(DataSource):
    """Option path: a folder that driver and executors share. Columns tenant, name, content (binary)."""

    @classmethod
    def name(cls) -> str:
        return "content_store"

    def writer(self, schema, overwrite: bool) -> ContentWriter:
        return ContentWriter(self.options["path"].rstrip("/"), schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session by their names."""
    spark.dataSource.register(PagedHits)
    spark.dataSource.register(ContentStore)
