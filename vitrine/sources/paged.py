"""Landed store pages as a data source of its own: one partition a brand, pages read in order until the list ends.

    spark.dataSource.register(LandedPages)
    spark.read.format("landed_pages").option("path", folder).load()        # a batch
    spark.readStream.format("landed_pages").option("path", folder).load()  # pages as they land

    bodies.write.format("landed_pages").mode("append").option("path", folder).save()  # (brand, page, body)

The folder holds brand=<slug>/page=<number>/ with one JSON body of {"products": [..]} in each.  A list ends with the
first page that is short, empty or not there.  A store that tires answers with bodies whose variants have no price: when
the first page has prices and a later one has none, that page and what follows is not data, and is not returned.

Rows: brand, page, products (their number), body, note; note stands at a brand's last page and says how its list ended:
null (as it should), "missing" (the next page was never landed) or "priceless" (the next page lost its prices).

Filters on brand choose the partitions, so other brands' pages are not opened (spark.sql.python.filterPushdown.enabled
has to be set, as Spark refuses a reader that takes filters otherwise).  Files are reached through pyarrow's
file systems by the folder's address, so any store that they know can hold the pages.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

SCHEMA = "brand string, page int, products int, body string, note string"
FULL_PAGE = 250
MISSING, PRICELESS = "missing", "priceless"


def priced(products: list[dict]) -> int:
    """How many products have a variant with a price."""
    found = 0
    for p in products:
        for v in p.get("variants") or []:
            try:
                if float(v.get("price") or 0) > 0:
                    found += 1
                    break
            except ValueError:
                continue
    return found


class Pages:
    """The landed folder: what is there, and a page's body."""

    def __init__(self, path: str) -> None:
        self.files, self.root = fs.FileSystem.from_uri(path if re.match(r"^[a-z][a-z0-9+.-]*:/", path) else f"file://{quote(path)}")

    def _folders(self, folder: str, prefix: str) -> dict[str, str]:
        found = self.files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {unquote(f.base_name[len(prefix) :]): f.path for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(prefix)}

    def brands(self) -> list[str]:
        return sorted(self._folders(self.root, "brand="))

    def _of(self, brand: str) -> str:
        """A brand's folder, its name escaped as Spark escapes those of partitions."""
        name = re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda c: f"%{ord(c[0]):02X}", brand)
        return f"{self.root}/brand={name}"

    def pages(self, brand: str) -> dict[int, str]:
        return {int(n): path for n, path in self._folders(self._of(brand), "page=").items() if n.isdecimal()}

    def body(self, folder: str) -> str | None:
        for f in sorted(self.files.get_file_info(fs.FileSelector(folder)), key=lambda f: f.base_name):
            if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.size:
                with self.files.open_input_stream(f.path) as stream:
                    return stream.read().decode("utf-8")
        return None

    def land(self, brand: str, page: int, body: str) -> None:
        """Put a page in its place, whole or not at all; one that is landed again takes the place of the older."""
        folder = f"{self._of(brand)}/page={page}"
        self.files.create_dir(folder, recursive=True)
        made = f"{folder}/_{uuid.uuid4().hex}"
        with self.files.open_output_stream(made) as stream:
            stream.write(body.encode("utf-8"))
        self.files.move(made, f"{folder}/body.txt")


def walk(pages: Pages, brand: str, full: int, most: int | None, first: int = 1) -> Iterator[tuple[str, int, int, str, str | None]]:
    """A brand's pages from `first` on, each held back until it is known how the list goes on."""
    there = pages.pages(brand)
    products_of = lambda body: body and json.loads(body).get("products")
    opening = priced(products_of(pages.body(there[1])) or []) if first > 1 and 1 in there else 0
    held = None
    for number in count(first) if most is None else range(first, most + 1):
        body = pages.body(there[number]) if number in there else None
        try:
            products = products_of(body)
        except ValueError:
            products = None
        if not isinstance(products, list):
            if held:
                yield (*held[:4], MISSING)
            return
        if not products:
            break
        n = priced(products)
        opening = n if number == 1 else opening
        if number > 1 and opening and not n:
            if held:
                yield (*held[:4], PRICELESS)
            return
        if held:
            yield held
        held = (brand, number, len(products), body, None)
        if len(products) < full:
            break
    if held:
        yield held


@dataclass
class BrandPages(InputPartition):
    brand: str
    first: int = 1
    last: int | None = None


class PageReader(DataSourceReader):
    def __init__(self, path: str, full: int, most: int | None) -> None:
        self.path, self.full, self.most = path, full, most
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("brand",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("brand",):
                self._only(set(f.value))
            else:
                yield f

    def _only(self, brands: set[str]) -> None:
        self.wanted = brands if self.wanted is None else self.wanted & brands

    def partitions(self) -> list[BrandPages]:
        return [BrandPages(b) for b in Pages(self.path).brands() if self.wanted is None or b in self.wanted]

    def read(self, partition: BrandPages | None) -> Iterator[tuple]:
        if partition is not None:  # Spark asks once where there are no partitions
            yield from walk(Pages(self.path), partition.brand, self.full, self.most)


class PageStreamReader(DataSourceStreamReader):
    """Offsets are how many pages of each brand have landed; a page is read once, in the batch it is first seen in."""

    def __init__(self, path: str, full: int, most: int | None) -> None:
        self.path, self.full, self.most = path, full, most

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        pages = Pages(self.path)
        found = {}
        for brand in pages.brands():
            there, n = pages.pages(brand), 0
            while n + 1 in there and (self.most is None or n < self.most):
                n += 1
            if n:
                found[brand] = n
        return found

    def partitions(self, start: dict, end: dict) -> list[BrandPages]:
        return [BrandPages(b, start.get(b, 0) + 1, n) for b, n in sorted(end.items()) if n > start.get(b, 0)]

    def read(self, partition: BrandPages) -> Iterator[tuple]:
        for row in walk(Pages(self.path), partition.brand, self.full, partition.last, partition.first):
            yield row


class PageWriter(DataSourceWriter):
    """Each task lands its own pages, each at once at its own address; a task that is run again lands the same ones."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        pages = Pages(self.path)
        for row in iterator:
            pages.land(row.brand, row.page, row.body)
        return WriterCommitMessage()


class LandedPages(DataSource):
    """Options: path, full (products of a page that is not the last; 250), most (pages of a brand; all)."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def _made(self, kind: type):
        most = self.options.get("most")
        return kind(self.options["path"], int(self.options.get("full", FULL_PAGE)), None if most is None else int(most))

    def reader(self, schema) -> PageReader:
        return self._made(PageReader)

    def streamReader(self, schema) -> PageStreamReader:
        return self._made(PageStreamReader)

    def writer(self, schema, overwrite: bool) -> PageWriter:
        if overwrite:
            raise ValueError("pages are landed beside those that are there: mode append")
        return PageWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known to a session; its code goes with it, as executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LandedPages)


def land_pages(products: DataFrame, path: str, full: int = FULL_PAGE) -> None:
    """Write products (brand, pos, product: struct) as landed pages, `full` to a page in the order of pos, or by a column `page`.

    Written by the source itself: as Spark's text files each page would be a checksum and two renames more, some of them the
    driver's.  As many tasks as cores, since starting one takes longer than landing thousands of pages.  Products without a
    brand are in no list.
    """
    register(products.sparkSession)
    tasks = products.sparkSession.sparkContext.defaultParallelism
    products = products.filter(F.col("brand").isNotNull())
    if "page" not in products.columns:
        place = F.row_number().over(Window.partitionBy("brand").orderBy("pos")) - 1
        products = products.withColumn("page", (F.floor(place / full) + 1).cast("int"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "product"))), lambda x: x["product"])  # a page's at most
    bodies = products.groupBy("brand", "page").agg(F.to_json(F.struct(rows.alias("products"))).alias("body"))
    bodies.repartition(tasks, "brand", "page").write.format("landed_pages").mode("append").option("path", path).save()
