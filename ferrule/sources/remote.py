"""Rows behind REST interfaces as Spark sources: by offset and length, and by cursor.

Where the number of rows asked for is known, each page is a partition of its own and pages are
fetched by the executors at once; a page that comes short, or empty, gives fewer rows.

A service that names the next page only with the one before is walked once without its payload;
the cursors found make the partitions, whose rows the executors fetch.  As a stream, the cursor
is the offset: a query that starts again goes on behind the last page it has committed.
"""

from __future__ import annotations

import json
import urllib.parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..services import request_json
from .documents import CASE_SCHEMA

# Rows a page, and rows an import asks for.
PAGE, LIMIT = 100, 120


class Page(InputPartition):
    def __init__(self, offset: int, length: int):
        super().__init__(offset)
        self.offset, self.length = offset, length


class RestRowsReader(DataSourceReader):
    def __init__(self, names: list[str], options):
        self.names, self.options = names, options  # names of options have no case

    def partitions(self):
        limit, page = int(self.options.get("limit", LIMIT)), int(self.options.get("pageSize", PAGE))
        return [Page(at, min(page, limit - at)) for at in range(0, limit, page)]

    def read(self, partition):
        asked = {k: self.options[k] for k in ("dataset", "config", "split") if k in self.options}
        query = urllib.parse.urlencode(asked | {"offset": partition.offset, "length": partition.length})
        rows = request_json("GET", f"{self.options['url']}?{query}").get("rows", [])
        for item in rows[: partition.length]:
            row = item.get("row", {})
            told = [row.get(name) for name in self.names]
            yield tuple(v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in told)


class RestRows(DataSource):
    """Options: url; dataset, config and split are passed on; limit; pageSize."""

    @classmethod
    def name(cls):
        return "rest_rows"

    def schema(self):
        return CASE_SCHEMA

    def reader(self, schema):
        return RestRowsReader(schema.names, self.options)


class CursorPage(InputPartition):
    def __init__(self, cursor):
        super().__init__(cursor)
        self.cursor = cursor


#: Columns of rows behind a cursor: an id, everything said of it as JSON, and a vector if there is one.
CURSOR_SCHEMA = "id string, payload string, vector array<double>"
#: Rows a page, and pages a micro-batch.
CURSOR_PAGE, CURSOR_BATCH = 256, 16


class Cursor:
    """Pages of ``url``: POST {limit, offset, with_payload, with_vector} answers {result: {points, next_page_offset}}."""

    def __init__(self, options):
        self.url, self.limit = options["url"], int(options.get("pageSize", CURSOR_PAGE))
        told = options.get("cursor")  # as JSON: a number, or a text in quotes
        self.start, self.batch = None if told is None else json.loads(told), int(options.get("pagesPerBatch", CURSOR_BATCH))

    def page(self, cursor, whole: bool = True) -> tuple[list[dict], object]:
        body = {"limit": self.limit, "with_payload": whole, "with_vector": whole} | ({} if cursor is None else {"offset": cursor})
        result = request_json("POST", self.url, body)["result"]
        return result["points"], result.get("next_page_offset")

    @staticmethod
    def row(point: dict) -> tuple:
        vector = point.get("vector")
        if isinstance(vector, dict):  # named vectors: the first by name
            vector = vector[min(vector)] if vector else None
        return str(point["id"]), json.dumps(point.get("payload") or {}, ensure_ascii=False, sort_keys=True), None if vector is None else [float(x) for x in vector]


class CursorReader(DataSourceReader):
    def __init__(self, options):
        self.service = Cursor(options)

    def partitions(self):
        out, cursor = [], self.service.start
        while True:
            out.append(CursorPage(cursor))
            cursor = self.service.page(cursor, whole=False)[1]
            if cursor is None:
                return out

    def read(self, partition):
        yield from map(self.service.row, self.service.page(partition.cursor)[0])


class CursorStream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.service = Cursor(options)

    def initialOffset(self):
        return {"cursor": self.service.start, "ended": False}

    def read(self, start):
        """Some pages behind ``start``; the last page ends the stream."""
        rows, at = [], start
        for _ in range(self.service.batch):
            if at["ended"]:
                break
            points, cursor = self.service.page(at["cursor"])
            rows += map(self.service.row, points)
            at = {"cursor": at["cursor"] if cursor is None else cursor, "ended": cursor is None}
        return iter(rows), at

    def readBetweenOffsets(self, start, end):
        at = start
        while at != end and not at["ended"]:
            points, cursor = self.service.page(at["cursor"])
            yield from map(self.service.row, points)
            at = {"cursor": at["cursor"] if cursor is None else cursor, "ended": cursor is None}


class CursorRows(DataSource):
    """Options: url; pageSize; cursor, where to begin, as JSON; pagesPerBatch, of a stream."""

    @classmethod
    def name(cls):
        return "cursor_rows"

    def schema(self):
        return CURSOR_SCHEMA

    def reader(self, schema):
        return CursorReader(self.options)

    def simpleStreamReader(self, schema):
        return CursorStream(self.options)


def read_cursor_rows(spark: SparkSession, url: str, stream: bool = False, **options) -> DataFrame:
    """Rows of a service that is read by cursor, once or as a stream."""
    spark.dataSource.register(CursorRows)
    return (spark.readStream if stream else spark.read).format("cursor_rows").options(url=url, **options).load()


def read_rest_rows(spark: SparkSession, url: str, limit: int = LIMIT, page: int = PAGE, required: bool = True, **asked) -> DataFrame:
    """Case rows (all columns text; what is no text stays JSON); none at all is an error."""
    spark.dataSource.register(RestRows)
    rows = spark.read.format("rest_rows").options(url=url, limit=limit, pageSize=page, **asked).load()
    if required and rows.isEmpty():
        raise RuntimeError(f"{url} gave no rows")
    return rows


def read_dataset(spark: SparkSession, path: str | None, url: str, limit: int = LIMIT, **asked) -> DataFrame:
    """Case rows from a local copy, or else over REST; where neither works the error names both."""
    from .documents import read_cases

    first = "no local copy is named"
    if path:
        try:
            rows = read_cases(spark, path, limit)
            rows.schema  # resolves the path
            return rows
        except Exception as e:  # whatever keeps the copy from being read
            first = str(e).splitlines()[0]
    try:
        return read_rest_rows(spark, url, limit, **asked)
    except Exception as e:
        raise RuntimeError(f"no dataset rows. Local copy: {first}. REST: {str(e).splitlines()[0]}. Is a proxy needed, or a mirror?") from e
