"""Lists that come in pages: landed as one JSON text a page, read through a data source whose partitions are pages or blocks of them.

A folder holds either a folder of each page (page=1, page=2: as they come), or one of each block of BLOCK pages (block=0:
as `land` writes them), with a line of number, tab and text for each page.

A list ends with its first page that isn't full, whatever lies behind it. No page can know that of itself, so the source
gives each item its page and that page's size, and `paginated` cuts behind the first short page. Filters on the page
number are pushed into the source: pages that they rule out are not opened.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from faultline.operators.numbering import numbered

PER_PAGE, MAX_PAGES, BLOCK = 100, 10, 100
_TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b}


class _Page(InputPartition):
    def __init__(self, number: int, files: list[str]):
        super().__init__(number)
        self.number, self.files = number, files


class _Block(_Page):
    """BLOCK pages, by the number of their block."""


class PageReader(DataSourceReader):
    """page, size, item (JSON text) of each item; a page without items is one row without item, as is any with the option sizes."""

    def __init__(self, options: dict):
        self.folder, self.key = options["path"].rstrip("/"), options.get("itemkey", "items")
        self.most, self.sizes, self.tests = int(options.get("maxpages", MAX_PAGES)), options.get("sizes") == "true", []

    def partitions(self) -> list[InputPartition]:
        """Pages from 1 on to the first one that isn't there, of those that the filters leave; or blocks from 0 on likewise."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        found: dict[str, dict[int, list[str]]] = {"page": {}, "block": {}}
        for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if f.is_file and (m := re.search(r"/(page|block)=(\d+)/[^/_.][^/]*$", f.path)):
                found[m[1]].setdefault(int(m[2]), []).append(f.path)
        out, blocks = [], found["block"]
        k = 0 if blocks else 1
        while k in (blocks or found["page"]) and (k * BLOCK + 1 if blocks else k) <= self.most:
            if any(map(self.asked, self.numbers(k))) if blocks else self.asked(k):
                out.append(_Block(k, sorted(blocks[k])) if blocks else _Page(k, sorted(found["page"][k])))
            k += 1
        return out or [_Page(0, [])]

    def asked(self, k: int) -> bool:
        return all(test(k) for test in self.tests)

    def numbers(self, block: int) -> range:
        return range(block * BLOCK + 1, min((block + 1) * BLOCK, self.most) + 1)

    def read(self, page: _Page):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        there = set()
        for path in page.files:
            with store.open_input_stream(path) as f:
                text = f.read().decode()
            if not isinstance(page, _Block):
                yield from self.items(page.number, text)
                continue
            for line in filter(None, text.split("\n")):
                k, _, body = line.partition("\t")
                there.add(int(k))
                if int(k) <= self.most and self.asked(int(k)):
                    yield from self.items(int(k), body)
        if isinstance(page, _Block):
            # the list ends where a page isn't there, as if it were empty
            gone = next((k for k in self.numbers(page.number) if k not in there), None)
            if gone is not None and self.asked(gone):
                yield gone, 0, None

    def items(self, number: int, text: str):
        items = json.loads(text).get(self.key) or []
        for item in [] if self.sizes else items:
            yield number, len(items), json.dumps(item, ensure_ascii=False)
        if self.sizes or not items:
            yield number, len(items), None


class PushingPageReader(PageReader):
    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("page",):
                self.tests.append(lambda k, test=_TESTS[type(f)], value=f.value: test(k, value))
            else:
                yield f


class PageSource(DataSource):
    """Options: path (a URI), itemKey, maxPages; sizes: "true" for a row a page in place of its items; pushdown: "true" where the session lets data sources take filters."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page int, size int, item string"

    def reader(self, schema):
        return (PushingPageReader if self.options.get("pushdown") == "true" else PageReader)(self.options)


def land(pages: DataFrame, folder: str, item_key: str = "items") -> None:
    """Writes each page's items (page, place, item: a struct) as one JSON text, a line in a file of its block of pages."""
    body = F.to_json(F.struct(F.count("*").alias("total_count"), F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias(item_key)))
    # all pages of a block come to one task, so a block is one file
    dealt = pages.withColumn("block", F.floor((F.col("page") - 1) / BLOCK)).repartition("block")
    dealt.groupBy("block", "page").agg(F.concat_ws("\t", F.col("page").cast("string"), body).alias("body")).drop("page").write.mode("overwrite").partitionBy("block").text(folder)


def land_all(rows: DataFrame, order: list, folder: str, per_page: int = PER_PAGE, item_key: str = "items") -> None:
    """Lands the rows in this order, so many a page, from page 1 on."""
    placed = numbered(rows.select(F.struct(*rows.columns).alias("item"), *[F.col(c).alias(f"by_{k}") for k, c in enumerate(order)]), [f"by_{k}" for k in range(len(order))])
    land(placed.select((F.floor(F.col("place") / per_page) + 1).cast("int").alias("page"), "place", "item"), folder, item_key)


def paginated(spark: SparkSession, folder: str, schema: str, *, item_key: str = "items", per_page: int = PER_PAGE, max_pages: int = MAX_PAGES) -> DataFrame:
    """page and the fields of this schema of each item, up to the first page with fewer than per_page items, that one included."""
    spark.dataSource.register(PageSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")

    def rows(sizes: bool = False) -> DataFrame:
        # loaded anew for each use: filters that are pushed into one use of a load count for all of them
        return spark.read.format("pages").option("itemKey", item_key).option("maxPages", max_pages).option("pushdown", pushed).option("sizes", str(sizes).lower()).load(folder)

    # one number of all pages
    short = rows(sizes=True).where(F.col("size") < per_page).agg(F.min("page").alias("last"))
    ended = rows().join(F.broadcast(short)).where((F.col("page") <= F.coalesce("last", F.lit(max_pages))) & F.col("item").isNotNull())
    return ended.select("page", F.from_json("item", schema).alias("item")).select("page", "item.*")
