"""Batches of source rows: declared schemas, remapping, content hashes, and the tables' own rows as batches."""

from __future__ import annotations

import hashlib
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.skew import tasks

FIELDS = ["name", "email", "phone", "whatsapp", "website", "facebook", "instagram", "youtube", "linkedin", "fb_category", "niche", "city", "followers", "source", "matched_query", "relevance"]


class SchemaMismatchError(ValueError):
    """A batch's columns are not those declared for it."""


@dataclass(frozen=True)
class Batch:
    """One declared batch: header -> canonical field, its order, and defaults for fields it lacks."""

    name: str
    sequence: int
    columns: dict[str, str]
    defaults: dict[str, str] = field(default_factory=dict)


def validate_schema(df: DataFrame, batch: Batch) -> int:
    """The number of columns; raises unless they are exactly the declared ones."""
    have, want = {c.strip() for c in df.columns}, set(batch.columns)
    if have != want:
        raise SchemaMismatchError(f"{batch.name}: missing {sorted(want - have)}, unexpected {sorted(have - want)}")
    return len(df.columns)


def remap(df: DataFrame, batch: Batch) -> DataFrame:
    """Canonical columns; a default fills only nulls and is marked as inferred."""
    validate_schema(df, batch)
    named = df.select(*[F.col(f"`{c}`").cast("string").alias(batch.columns[c.strip()]) for c in df.columns])
    for name, value in batch.defaults.items():
        named = named.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in named.columns else F.lit(value))
    return named.select("*", F.lit(batch.name).alias("batch"), F.lit(batch.sequence).alias("batch_seq"), F.lit(bool(batch.defaults)).alias("source_inferred"))


def union_batches(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def row_text(df: DataFrame, columns: list[str]):
    """"key=value" lines in the order of keys; a null value is left out."""
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string"), F.lit("\n")) for c in sorted(columns)]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def row_hash(df: DataFrame, columns: list[str]):
    """SHA-256 of a row's text."""
    return F.sha2(row_text(df, columns), 256)


def file_hash(path: str, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def read_xlsx(path: str) -> dict[str, list[list[str | None]]]:
    """Rows of cell texts of each sheet, header first. Workbooks are small by format; the driver reads them."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns):
            rows = []
            for row in ElementTree.fromstring(z.read("xl/" + targets[sheet.get(rel)].removeprefix("/xl/"))).iter(f"{{{ns['m']}}}row"):
                cells: dict[int, str | None] = {}
                for c in row.findall("m:c", ns):
                    at = 0
                    for ch in re.match("[A-Z]+", c.get("r"))[0]:
                        at = 26 * at + ord(ch) - 64
                    v = c.find("m:v", ns)
                    text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                    cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            out[sheet.get("name")] = rows
        return out


def xlsx_batches(spark: SparkSession, path: str, batches: list[Batch]) -> DataFrame:
    """All declared sheets of a workbook as canonical rows with row_no from 1; an undeclared or missing sheet is an error."""
    sheets = read_xlsx(path)
    if set(sheets) != {b.name for b in batches}:
        raise SchemaMismatchError(f"sheets {sorted(sheets)} are not {sorted(b.name for b in batches)}")
    parts = []
    for b in sorted(batches, key=lambda b: b.sequence):
        head, *rows = sheets[b.name]
        head = [(h or "").strip() for h in head]
        rows = [[*r, *[None] * (len(head) - len(r))][: len(head)] for r in rows]
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], ", ".join([*(f"`{h}` string" for h in head), "`row_no` int"]))
        parts.append(remap(df, Batch(b.name, b.sequence, b.columns | {"row_no": "row_no"}, b.defaults)).withColumn("row_no", F.col("row_no").cast("int")))
    return union_batches(parts)


#: The columns of a source row as they were read.
RAW = ["name", "email", "phone", "website", "facebook", "city", "followers"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of contact rows derived from customer, supplier and part (see FIXTURES.md)."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    one = c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("niche"))
    none = F.lit(None).cast("string").alias("niche")
    two = s.select((F.col("s_suppkey") + 1_000_000).alias("k"), F.col("s_nationkey").alias("nk"), none)
    three = c.where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"), none)
    rows = union_batches([d.select(F.lit(f"batch_{i}").alias("batch"), F.lit(i).alias("batch_seq"), "*") for i, d in ((1, one), (2, two), (3, three))])
    part, nation, region = (table(spark, sf_dir, t) for t in ("part", "nation", "region"))
    # these rows are few bytes, so that one file's split holds most of them, and all that is derived of them would stay in its task
    rows = rows.repartition(tasks(rows), "batch_seq", "k")
    part = F.broadcast(part.where("p_partkey between -199 and 199"))  # all that a remainder by 200 can be
    rows = rows.join(part, part.p_partkey == rows.k % 200).join(nation, nation.n_nationkey == rows.nk).join(region, region.r_regionkey == nation.n_regionkey)
    e = F.expr
    return rows.select(
        "batch", "batch_seq", e("case when batch_seq = 2 then 'supplier' else 'customer' end").alias("source_file"), e("batch_seq * 10000000L + k").alias("row_id"), F.col("k").alias("row_no"), "k",
        e("case when k % 97 = 0 then 'Advertiser ' || (13000000 + k) when k % 11 = 1 then 'Dr. ' || p_name when k % 11 = 2 then 'UNIT' || (k - k % 3) || '  ' || p_name || ' Pvt Ltd' when k % 11 = 3 then 'Unit' || (k - k % 3) || ' ' || p_name || ' Clinic' else 'Unit' || (k - k % 3) || ' ' || p_name end").alias("name"),
        e("case k % 9 when 0 then ' U' || k || '@Gmail.com ' when 1 then 'u' || k || '@gamil.com' when 2 then 'u' || k || '@gmaill.com' when 3 then 'info@biz' || k || '.test' when 4 then 'sales+x@biz' || k || '.test' when 5 then 'not-an-email' when 6 then 'u' || k || '@mailinator.com' when 8 then 'u' || k || '@yahoo.com' end").alias("email"),
        e("case when k % 50 = 1 then '+91 9' || lpad(k - 1, 9, '0') when k % 23 = 5 then '+91 12' else '+91 9' || lpad(k, 9, '0') end").alias("phone"),
        e("case k % 8 when 0 then 'http://www.megaportal.test/' when 1 then 'https://linktr.ee/someone' when 2 then null when 3 then 'http://www.nodots/' else 'HTTP://www.Biz' || (k - k % 3) || '.test//shop/?utm_source=fb&id=' || k || '&fbclid=z#top' end").alias("website"),
        e("case when k % 3 = 0 then 'https://www.facebook.com/' || (61500000000000 + k) else 'https://facebook.com/Page.' || k || '/' end").alias("facebook"),
        e("case k % 4 when 0 then 'Road' when 1 then n_name when 2 then lower(n_name) else r_name end").alias("city"),
        e("case when k % 10 = 0 then null else p_type end").alias("fb_category"), "niche",
        e("case k % 6 when 0 then null when 1 then '0' when 2 then cast(k + batch_seq as string) when 3 then '1.4K' when 4 then (k % 900) || 'K' else 'many' end").alias("followers"),
        e("case when batch_seq = 2 then null else 'query ' || ((k * batch_seq) % 171) end").alias("matched_query"),
        e("case when batch_seq = 1 then element_at(array('High', 'Medium', 'Low'), cast(k % 3 + 1 as int)) end").alias("relevance"),
        e("batch_seq = 3").alias("source_inferred"),
    )


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as cities, regions as states, and one address fragment; a city beats a state of the same key."""
    from sievework.functions.text import key, slug

    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cities = n.join(r, n.n_regionkey == r.r_regionkey).select(key(F.col("n_name")).alias("key"), F.lit("exact").alias("match"), slug(F.col("n_name")).alias("slug"), F.col("n_name").alias("name"), F.col("r_name").alias("state"))
    states = r.select(key(F.col("r_name")).alias("key"), F.lit("state").alias("match"), slug(F.col("r_name")).alias("slug"), F.col("r_name").alias("name"), F.col("r_name").alias("state")).join(cities.select("key"), "key", "left_anti")
    other = spark.createDataFrame([("road", "fragment", None, None, None)], "key string, match string, slug string, name string, state string")
    return cities.unionByName(states.select(*cities.columns)).unionByName(other)


#: Verticals of the derived rows' categories.
VERTICALS = [("economy", "unclassified"), ("promo", "unclassified"), ("standard", "professional_services"), ("medium", "technology"), ("small", "retail_ecommerce"), ("machinery", "technology"), ("building", "real_estate"), ("automobile", "retail_ecommerce"), ("furniture", "retail_ecommerce")]


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VERTICALS, "alias string, slug string")
