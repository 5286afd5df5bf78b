"""Records inside web pages and nested responses, and versioned tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from fieldmill.operators.shaping import table_digest

PRODUCT = "array<struct<`@type`:string,sku:string,name:string,description:string,offers:struct<price:string,priceCurrency:string>>>"


def script(html: Column, ident: str) -> Column:
    """The body of the script element of that id."""
    return F.regexp_extract(html, rf"(?is)<script\b[^>]*\bid\s*=\s*[\"']{ident}[\"'][^>]*>(.*?)</script>", 1)


def product(html: Column) -> Column:
    """The first product of a page's linked data: struct(sku, name, description, price in cents, currency); null without one."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    items = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(b, PRODUCT), F.array().cast(PRODUCT))))
    p = F.get(F.filter(items, lambda x: x["@type"] == "Product"), 0)
    price = F.regexp_replace(p["offers"]["price"], "[^0-9.]", "").try_cast("double")
    return F.when(p.isNotNull(), F.struct(p["sku"].alias("sku"), p["name"].alias("name"), p["description"].alias("description"), F.when(price > 0, F.round(price * 100).cast("long")).alias("price"), p["offers"]["priceCurrency"].alias("currency")))


def _links(text: str | None, mark: str, base: str) -> list[str]:
    """Links of the first feed object of a graph whose numbers point at its other members."""
    try:
        nodes = json.loads(text or "null")
    except ValueError:
        return []
    if not isinstance(nodes, list):
        return []
    of = lambda v: nodes[v] if isinstance(v, int) and not isinstance(v, bool) and 0 <= v < len(nodes) else v
    for feed in nodes:
        if isinstance(feed, dict) and {"total", "data", "limit"} <= feed.keys():
            rows = of(feed["data"])
            posts = [of(of(r).get("data")) for r in (rows.values() if isinstance(rows, dict) else rows if isinstance(rows, list) else []) if isinstance(of(r), dict)]
            found = [x for p in posts if isinstance(p, dict) and isinstance(x := of(p.get("link")), str) and mark in x]
            if found:
                return list(dict.fromkeys(x if x.startswith("http") else base + x for x in found))
    return []


def feed_links(pages: DataFrame, html: str, ident: str, mark: str, base: str, most: int) -> DataFrame:
    """A row for each link of a feed page's graph, with its position; pages without a graph give none. `most` is the feed's page size."""

    @F.pandas_udf(ArrayType(StringType()))
    def links(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: _links(t, mark, base)[:most])

    return pages.select("*", F.posexplode(links(script(F.col(html), ident))).alias("position", "link"))


def _stories(text: str | None, kind: str, body: str) -> list[str]:
    """Nodes of that type, or with that member, as JSON; the walk does not look inside a node that it has found."""
    try:
        todo = [json.loads(text or "null")]
    except ValueError:
        return []
    out = []
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, dict):
            if isinstance(v.get(body), (dict, list)) or (v.get("__typename") == kind and any(v.get(k) is not None for k in ("id", "post_id"))):
                out.append(json.dumps(v, ensure_ascii=False))
            else:
                todo += reversed(list(v.values()))
    return out


def nested_posts(payloads: DataFrame, column: str, kind: str = "Story", body: str = "comet_sections") -> DataFrame:
    """A row (node: JSON) for each post anywhere in nested responses; malformed ones give none."""

    @F.pandas_udf(ArrayType(StringType()))
    def nodes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: _stories(t, kind, body))

    return payloads.select("*", F.explode(nodes(column)).alias("node"))


def save_version(df: DataFrame, folder: str, keep: int = 21, stamp: str | None = None) -> str:
    """Writes a version of a table, reads it again to verify it, and then drops all but the newest `keep` versions. Returns its path.

    A version whose rows differ from df is an error, and no other version is dropped. df must give the same rows each time.
    """
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    path, spark = f"{folder}/version-{stamp}", df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    if table_digest(df).first() != table_digest(spark.read.parquet(path).select(*df.columns)).first():
        raise RuntimeError(f"{path} differs from what was written")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if re.match(r"version-\w+$", s.getPath().getName()))
    for name in names[: max(len(names) - keep, 0)]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    return path


def append_events(events: DataFrame, path: str) -> None:
    """Appends events by day; a day's folder is all that a report of a period reads."""
    events.withColumn("day", F.to_date("ts")).repartition("day", F.pmod(F.xxhash64(*events.columns), F.lit(16))).write.mode("append").partitionBy("day").parquet(path)
