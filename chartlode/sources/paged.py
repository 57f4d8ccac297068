"""SRC-09, SRC-10. A paged service as a Spark data source: users are dealt over partitions, each reads its users' pages one after another.

The pages are files that a fetcher has left, `bucket=B/user_id=U/page=P/*`, or lines `{"user_id": U, "page": P, "payload": ".."}` of
files `bucket=B/*`, each user's in one file together: a file for each page costs more than what stands in it when users are many.
A live service overrides PagedReader.fetch(). Register with
spark.dataSource.register(PagedActivities), then spark.read.format("paged_activities").option("path", ..).load(), or
readStream for pages as they come.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "user_id long, page int, external_id string, error string"


class Bucket(InputPartition):
    """The users of one bucket, and the pages after one and up to another."""

    def __init__(self, path: str, after: int, upto: int | None):
        self.path, self.after, self.upto = path, after, upto


def listed(path: str, key: str) -> list[tuple[str, str]]:
    """(value, path) of the folders key=value in a folder, in order of their names."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    infos = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((i.base_name.removeprefix(f"{key}="), prefix + i.path) for i in infos if i.base_name.startswith(f"{key}="))


class PagedReader:
    """What both readers share. max_pages: pages of a user that are asked for at most."""

    def __init__(self, options: dict[str, str]):
        self.path, self.max_pages = options["path"], int(options.get("max_pages", 3))

    def fetch(self, user: str, page: int) -> str | None:
        """The answer for a page, null where there is none."""
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(user) if "://" in user or user.startswith("file:") else (fs.LocalFileSystem(), user)
        files = store.get_file_info(fs.FileSelector(f"{at}/page={page}", allow_not_found=True))
        texts = [store.open_input_stream(i.path).read().decode() for i in files if i.is_file and not i.base_name.startswith(("_", "."))]
        return "".join(texts) if texts else None

    def users(self, part: Bucket) -> Iterator[tuple[int, Callable[[int], str | None]]]:
        """Each user of a bucket and what answers for a page. Of lines, one user's pages are held at a time; one that is torn stops the read, as nobody knows whose page it was."""
        from pyarrow import fs

        for user, folder in listed(part.path, "user_id"):
            yield int(user), lambda page, folder=folder: self.fetch(folder, page)
        store, at = fs.FileSystem.from_uri(part.path) if "://" in part.path or part.path.startswith("file:") else (fs.LocalFileSystem(), part.path)
        for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if info.is_file and not info.base_name.startswith(("_", ".")):
                with store.open_input_stream(info.path) as raw:
                    lines = map(json.loads, io.TextIOWrapper(raw, "utf-8", newline="\n"))
                    for user, own in groupby(lines, lambda x: x["user_id"]):
                        pages = {x["page"]: x["payload"] for x in own if x["page"] <= self.max_pages}
                        yield int(user), pages.get

    def rows(self, part: Bucket) -> Iterator[tuple]:
        """A user's pages until one is empty or absent. A page that can't be read is a row with its error, and no others stop for it."""
        for user, answered in self.users(part):
            for page in range(1, self.max_pages + 1 if part.upto is None else min(self.max_pages, part.upto) + 1):
                try:
                    answer = answered(page)
                    found = [] if answer is None else json.loads(answer)
                    ids = [str(x["activityId"]) for x in found]
                except (ValueError, TypeError, KeyError, OSError) as e:
                    if page > part.after:
                        yield user, page, None, f"{type(e).__name__}: {e}"[:200]
                    continue
                if not ids:
                    break
                if page > part.after:
                    yield from ((user, page, i, None) for i in ids)


class BatchReader(PagedReader, DataSourceReader):
    def partitions(self) -> list[Bucket]:
        return [Bucket(p, 0, None) for _, p in listed(self.path, "bucket")] or [Bucket(f"{self.path}/none", 0, None)]

    def read(self, partition: Bucket) -> Iterator[tuple]:
        return self.rows(partition)


class StreamReader(PagedReader, DataSourceStreamReader):
    """A page of every user a micro-batch; the offset is the last page taken. Reading a page again gives the same rows."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.page = 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        self.page = min(self.page + 1, self.max_pages)
        return {"page": self.page}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        self.page = max(self.page, end["page"])
        return [Bucket(p, start["page"], end["page"]) for _, p in listed(self.path, "bucket")]

    def read(self, partition: Bucket) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedActivities(DataSource):
    """user_id, page, external_id, and error for a page that couldn't be read."""

    @classmethod
    def name(cls) -> str:
        return "paged_activities"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options)
