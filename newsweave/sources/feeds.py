"""Feed files (RSS or Atom) as a Python data source, for batch and stream: format ``newsfeed``, option ``path``.

One partition a file; at most ``maxItems`` entries of each (default 30); titles and summaries with white space
collapsed; summary falls back to description, published to updated; entries without a link are skipped. A file that
isn't XML gives no rows.
"""

from __future__ import annotations

import glob
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, DataSourceStreamReader

SCHEMA = "feed_key string, feed string, title string, url string, published string, summary string, pos int"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def read_feed(path: str, most: int) -> Iterator[tuple]:
    try:
        root = ET.parse(path).getroot()
    except (ET.ParseError, OSError):
        return
    squeeze = lambda s: re.sub(r"\s+", " ", s or "").strip()
    key = os.path.basename(path).rsplit(".", 1)[0]
    name = next((squeeze(e.text) for e in root.iter() if _local(e.tag) == "title"), key)
    entries = [e for e in root.iter() if _local(e.tag) in ("item", "entry")]
    for pos, e in enumerate(entries[:most]):
        got: dict[str, str] = {}
        for c in e:
            t = _local(c.tag)
            text = c.attrib.get("href", "") if t == "link" and not (c.text or "").strip() else "".join(c.itertext())
            if squeeze(text) and t not in got:
                got[t] = squeeze(text)
        if got.get("link"):
            yield key, name, got.get("title", ""), got["link"], got.get("pubdate") or got.get("published") or got.get("updated") or "", got.get("summary") or got.get("description") or "", pos


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("maxItems", 30))

    def partitions(self):
        return [_File(p) for p in sorted(glob.glob(os.path.join(self.path, "*.xml")))] or [_File("")]

    def read(self, partition):
        if partition.path:
            yield from read_feed(partition.path, self.most)


class _Stream(DataSourceStreamReader):
    """Files are taken in order of name; the offset is the last name seen. The driver lists names, tasks read files, one
    partition a file."""

    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("maxItems", 30))

    def _names(self) -> list[str]:
        return sorted(os.path.basename(p) for p in glob.glob(os.path.join(self.path, "*.xml")))

    def initialOffset(self):
        return {"last": ""}

    def latestOffset(self):
        return {"last": (self._names() or [""])[-1]}

    def partitions(self, start, end):
        return [_File(os.path.join(self.path, n)) for n in self._names() if start["last"] < n <= end["last"]]

    def read(self, partition):
        yield from read_feed(partition.path, self.most)


class NewsFeed(DataSource):
    @classmethod
    def name(cls):
        return "newsfeed"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)
