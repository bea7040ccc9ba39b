"""A streaming source of feed pages: newest first, walked back to the mark of the last run.

    spark.dataSource.register(FeedPages)
    spark.readStream.format("feed_pages").options(at=..., forms="8-K,NPORT-P").load()

A row is a page (form, page, since, until, content): its Atom text, and the marks between which its entries are new;
quarry.streaming.feed.new_entries() parses pages into the entries after since, up to until. The offset is a mark for each
form, the time of its newest entry, so a restart from a checkpoint goes on behind what was taken. Each form is a task of
its own; of an archive, each SHARE pages are, or more where that would be more than WALKS tasks, each of which reads the list.

`at` is the address of a site, where a page is a request and a walk ends after `most` pages (25) as the site's own clients
do, or the folder of an archive: Parquet of pages (form, newest, oldest, content; times in microseconds), read through pyarrow from any file
system that it knows, whole and without a bound. Pages of an archive may overlap each other and the mark. Options besides:
since (a first mark, else everything), overlap (seconds that a walk goes back behind its mark, for entries that come late
or at the mark's own time; what follows must then take each entry once), count (entries asked for a page), agent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

PAGE, MOST, SHARE, WALKS = 40, 25, 16, 200
SCHEMA = "form string, page int, since timestamp, until timestamp, content string"
_UPDATED = re.compile(r"<updated>\s*([^<\s]+)\s*</updated>")


def _time(mark: str | None) -> datetime | None:
    return datetime.fromisoformat(mark) if mark else None


def _mark(at: datetime) -> str:
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat(timespec="microseconds")


def _micros(at: datetime) -> int:
    return round((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def times_of(content: str) -> list[datetime]:
    """When the entries of a page were updated; those without a time don't count."""
    out = []
    for text in _UPDATED.findall(content[max(content.find("<entry"), 0) :]):
        try:
            out.append(datetime.fromisoformat(text))
        except ValueError:
            continue
    return [t if t.tzinfo else t.replace(tzinfo=timezone.utc) for t in out]


@dataclass
class Walk(InputPartition):
    """The pages of a form between two marks; of an archive, those from one to another in its list."""

    form: str
    since: str | None
    until: str
    first: int = 0
    last: int | None = None


class Archive:
    """Pages of a folder of Parquet."""

    def __init__(self, at: str):
        from pyarrow import dataset, fs

        system, path = fs.FileSystem.from_uri(at if "://" in at or at.startswith("file:") else f"file://{at}")
        self.pages = dataset.dataset(path, filesystem=system, format="parquet")

    def _index(self, form: str, since: datetime | None, columns: list[str]) -> list[dict]:
        """The form's pages that reach behind the mark, newest first."""
        from pyarrow import dataset

        wanted = dataset.field("form") == form
        if since:
            wanted &= dataset.field("newest") > _micros(since)
        return sorted(self.pages.to_table(columns=columns, filter=wanted).to_pylist(), key=lambda r: (r["newest"], r["oldest"]), reverse=True)

    def newest(self, form: str) -> datetime | None:
        rows = self._index(form, None, ["newest", "oldest"])
        return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=rows[0]["newest"]) if rows else None

    def walks(self, form: str, since: str | None, until: str) -> list[Walk]:
        n = len(self._index(form, _time(since), ["newest", "oldest"]))
        share = max(SHARE, -(-n // WALKS))
        return [Walk(form, since, until, k, min(k + share, n)) for k in range(0, n, share)]

    def contents(self, walk: Walk) -> Iterator[str]:
        """Those of the walk's share; the list is short of texts until its share is known."""
        from pyarrow import dataset

        share = self._index(walk.form, _time(walk.since), ["newest", "oldest"])[walk.first : walk.last]
        if share:
            between = (dataset.field("form") == walk.form) & (dataset.field("newest") >= share[-1]["newest"]) & (dataset.field("newest") <= share[0]["newest"])
            keys = {(r["newest"], r["oldest"]) for r in share}
            for b in self.pages.to_batches(columns=["newest", "oldest", "content"], filter=between, batch_size=SHARE):
                yield from (r["content"] for r in b.to_pylist() if (r["newest"], r["oldest"]) in keys)


class Site:
    """Pages of a site, one request each; a request asks for entries up to the day of the last one seen."""

    def __init__(self, at: str, count: int, most: int, agent: str):
        self.at, self.count, self.most, self.agent = at, count, most, agent

    def _page(self, form: str, before: str) -> str:
        from quarry.sources.live import got
        from quarry.sources.settings import Settings

        url = self.at.format(form=form, before=before, count=self.count)
        status, content, error = got(url, self.agent, Settings(), {})
        if content is None:
            raise OSError(f"{url}: {status} {error}")
        return content

    def newest(self, form: str) -> datetime | None:
        return max(times_of(self._page(form, "")), default=None)

    def walks(self, form: str, since: str | None, until: str) -> list[Walk]:
        return [Walk(form, since, until)]

    def contents(self, walk: Walk) -> Iterator[str]:
        before, since = "", _time(walk.since)
        for _ in range(self.most):
            content = self._page(walk.form, before)
            times = times_of(content)
            if not times:
                return
            yield content
            if since and times[-1] <= since:
                return
            before = f"{times[-1]:%Y%m%d}"


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.forms = options.get("forms", "").split(",")
        self.since, self.overlap = options.get("since"), timedelta(seconds=float(options.get("overlap", 0)))
        self.options = options

    def _store(self) -> Archive | Site:
        at = self.options["at"]
        if not at.startswith(("http:", "https:")):
            return Archive(at)
        return Site(at, int(self.options.get("count", PAGE)), max(1, int(self.options.get("most", MOST))), self.options["agent"])

    def initialOffset(self) -> dict:
        return {form: _mark(_time(self.since)) if self.since else "" for form in self.forms}

    def latestOffset(self) -> dict:
        store = self._store()
        newest = {form: store.newest(form) for form in self.forms}
        self.seen = {form: max(_mark(at) if at else "", getattr(self, "seen", {}).get(form, "")) for form, at in newest.items()}
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Walk]:
        store, out = self._store(), []
        for form in self.forms:
            since, until = start.get(form, ""), end.get(form, "")
            if until and until > since:
                out += store.walks(form, _mark(_time(since) - self.overlap) if since else None, until)
        return out

    def read(self, partition: Walk) -> Iterator[tuple]:
        for n, content in enumerate(self._store().contents(partition)):
            yield partition.form, partition.first + n, _time(partition.since), _time(partition.until), content


class FeedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options))
