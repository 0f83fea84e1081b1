"""Readers and writers of datasets, rankings, images, vector indexes and reports."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPTIONS = "array<struct<caption_id:string,text:string>>"


#: Fixed value: the path of an image that opens a group.
JPEG = re.compile(r"(?:^|/)([0-9]+)\.jpg$", re.IGNORECASE)


class _CaptionPage(HTMLParser):
    """Links to JPEG files open a group, list items are its captions, a notice opens a group without file.

    Such a group is numbered by its place among all groups of the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.records: list[dict] = []
        self.item: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (file := JPEG.search(urlsplit(dict(attrs).get("href") or "").path)):
            self.records.append({"group_id": file[1], "filename": f"{file[1]}.jpg", "captions": []})
        elif tag == "li" and self.records:
            self.item = []

    def handle_endtag(self, tag):
        if tag == "li" and self.item is not None:
            text = " ".join("".join(self.item).split())
            if text:
                group = self.records[-1]
                group["captions"].append({"caption_id": f"{group['group_id']}#{len(group['captions'])}", "text": text})
            self.item = None

    def handle_data(self, data):
        if data.strip().casefold() == "image not found":
            self.records.append({"group_id": f"missing-source-image-{len(self.records) + 1:06d}", "filename": None, "captions": []})
        if self.item is not None:
            self.item.append(data)


def parse_caption_page(html: str | None) -> list[dict]:
    page = _CaptionPage()
    page.feed(html or "")
    page.close()
    return page.records


def caption_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, group_id, filename, captions) of caption pages; a null page has none."""
    schema = f"page_id long, group_id string, filename string, captions {CAPTIONS}"
    kind = pa.list_(pa.struct([("caption_id", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, r) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in parse_caption_page(h)]
            columns = [pa.array([i for i, _ in rows], pa.int64()), *[pa.array([r[k] for _, r in rows], t) for k, t in (("group_id", pa.string()), ("filename", pa.string()), ("captions", kind))]]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "group_id", "filename", "captions"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), html).mapInArrow(run, schema)


def coco_captions(spark: SparkSession, path: str, prefix: str = "coco2017_val#") -> DataFrame:
    """(group_id, filename, captions) of a COCO caption file: images with their annotations in file order."""
    schema = "images array<struct<id:long,file_name:string>>, annotations array<struct<id:long,image_id:long,caption:string>>"
    file = spark.read.schema(schema).json(path, multiLine=True)
    images = file.select(F.explode("images").alias("i")).select(F.col("i.id").alias("id"), F.col("i.file_name").alias("filename"))
    notes = file.select(F.posexplode("annotations").alias("at", "a"))
    texts = notes.groupBy(F.col("a.image_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("at", F.concat(F.lit(prefix), F.col("a.id").cast("string")).alias("caption_id"), F.trim("a.caption").alias("text")))).alias("c")
    )
    captions = F.transform("c", lambda x: F.struct(x["caption_id"].alias("caption_id"), x["text"].alias("text")))
    return images.join(texts, "id", "left").select(F.col("id").cast("string").alias("group_id"), "filename", F.coalesce(captions, F.array().cast(CAPTIONS)).alias("captions")).orderBy(F.col("group_id").cast("long"))


def composed_queries(spark: SparkSession, path: str) -> DataFrame:
    """Composed queries (reference, modification text, targets) with `findings`: the rules each breaks."""
    schema = "id long, reference_img_id string, relative_caption string, target_img_id string, gt_img_ids array<string>, semantic_aspects array<string>, shared_concept string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    ids = lambda c: normal_id(F.col(c))
    rows = rows.withColumn("reference_img_id", ids("reference_img_id")).withColumn("target_img_id", ids("target_img_id"))
    rows = rows.withColumn("gt_img_ids", F.transform(F.coalesce("gt_img_ids", F.array().cast("array<string>")), normal_id))
    gt = F.col("gt_img_ids")
    rules = {
        "empty_modification": F.trim(F.coalesce("relative_caption", F.lit(""))) == "",
        "no_ground_truth": F.size(gt) == 0,
        "reference_in_ground_truth": F.array_contains(gt, F.col("reference_img_id")),
        "target_not_in_ground_truth": F.col("target_img_id").isNotNull() & ~F.array_contains(gt, F.col("target_img_id")),
        "repeated_ground_truth": F.size(F.array_distinct(gt)) < F.size(gt),
    }
    return rows.withColumn("findings", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))


def normal_id(c):
    """Digits as a number without leading zeros; anything else null."""
    return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).cast("decimal(38,0)").cast("string"))


def rankings(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, candidate_id, score, rank, task, system_id) of ranking files; a file's defaults hold for its queries."""
    query = "struct<query_id:string,task:string,candidate_ids:array<string>,scores:array<double>,relevant_ids:array<string>>"
    rows = spark.read.schema(f"task string, system_id string, experiment_id string, split string, queries array<{query}>").json(path, multiLine=True)
    q = rows.select("task", "system_id", F.explode("queries").alias("q"))
    pairs = F.posexplode(F.arrays_zip(F.col("q.candidate_ids").alias("candidate_id"), F.col("q.scores").alias("score"))).alias("at", "x")
    flat = q.select(F.col("q.query_id").alias("query_id"), F.coalesce("q.task", "task").alias("task"), "system_id", pairs)
    return flat.select("query_id", "x.candidate_id", "x.score", (F.col("at") + 1).cast("long").alias("rank"), "task", "system_id")


def write_manifest(records: DataFrame, path: str, **properties: str) -> str:
    """Writes records as Parquet beside one JSON row of properties; returns the order-free digest of the records."""
    digest = content_digest(records)
    records.write.mode("overwrite").parquet(f"{path}/records")
    head = json.dumps({"schema_version": 1, "sha256": digest, **properties}, sort_keys=True)
    records.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return digest


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of a manifest; ValueError for another version or when they aren't those that were written."""
    head = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if head.get("schema_version") != 1:
        raise ValueError(f"manifest version {head.get('schema_version')} isn't known")
    records = spark.read.parquet(f"{path}/records")
    if content_digest(records) != head["sha256"]:
        raise ValueError("the records have changed since the manifest was written")
    return records


def content_digest(rows: DataFrame) -> str:
    """A digest of a table's rows in any order: the sum of their 128 leading hash bits, and their number."""
    h = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda a: F.sum(F.conv(F.substring(h, a, 8), 16, 10).cast("decimal(38,0)"))
    sums = rows.agg(F.count(F.lit(1)), *[part(a) for a in (1, 9, 17, 25)]).first()
    import hashlib

    return hashlib.sha256("|".join(str(x) for x in sums).encode()).hexdigest()


def save_index(vectors: DataFrame, path: str, **parameters) -> str:
    """Writes (id, embedding) with a fingerprint of contents and parameters."""
    return write_manifest(vectors.select("id", "embedding"), path, parameters=json.dumps(parameters, sort_keys=True))


def load_index(spark: SparkSession, path: str, **parameters) -> DataFrame:
    """The vectors of save_index; ValueError when parameters or contents differ."""
    head = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if head.get("parameters") != json.dumps(parameters, sort_keys=True):
        raise ValueError("the index was built with other parameters")
    return read_manifest(spark, path)


def image_header(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from the first bytes of PNG, GIF, JPEG, WebP and PPM files."""
    found = image_metadata(data)
    return found[:3] if found else None


#: Channels and mode of a PNG's colour type, and the mode of a JPEG's number of components.
PNG_KINDS = {0: (1, "L"), 2: (3, "RGB"), 3: (1, "P"), 4: (2, "LA"), 6: (4, "RGBA")}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}


def image_metadata(data: bytes) -> tuple[str, int, int, int | None, str | None] | None:
    """(format, width, height, channels, mode); the last two null where the header doesn't tell."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 26:
        return ("png", *struct.unpack(">II", data[16:24]), *PNG_KINDS.get(data[25], (None, None)))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("gif", *struct.unpack("<HH", data[6:10]), 3, "P")
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X" and len(data) >= 30:
        size = lambda at: 1 + int.from_bytes(data[at : at + 3], "little")
        return ("webp", size(24), size(27), None, None)
    if data[:2] == b"\xff\xd8":
        return _jpeg_frame(data)
    pixels = read_ppm(data)
    return ("ppm", len(pixels[0]), len(pixels), *((3, "RGB") if data[1:2] == b"6" else (1, "L"))) if pixels else None


def _jpeg_frame(data: bytes) -> tuple[str, int, int, int | None, str | None] | None:
    """The first frame header of a JPEG: segments may be led by any number of fill bytes, and markers without a length stand alone."""
    at = 2
    while (at := data.find(b"\xff", at)) >= 0:
        while data[at : at + 1] == b"\xff":
            at += 1
        if at + 3 > len(data):
            return None
        marker, at = data[at], at + 1
        if marker == 0 or marker in (0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
            continue
        length = int.from_bytes(data[at : at + 2], "big")
        if length < 2 or at + length > len(data):
            return None
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and length >= 8:
            height, width, parts = struct.unpack(">HHB", data[at + 3 : at + 8])
            return ("jpeg", width, height, parts, JPEG_MODES.get(parts))
        at += length
    return None


def image_complete(data: bytes) -> bool:
    """Whether a file has a known header and, where its format has one, its terminator."""
    found = image_metadata(data)
    if found is None:
        return False
    end = {"png": b"IEND\xaeB`\x82", "jpeg": b"\xff\xd9", "gif": b";"}.get(found[0], b"")
    return data.rstrip(b"\0").endswith(end) or data.endswith(end)


def read_ppm(data: bytes) -> list[list[tuple[int, int, int]]] | None:
    """Rows of RGB pixels of a binary PPM or PGM of 8 bits; None if it is none or cut short."""
    if data[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.find(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
            if at == 0:
                return None
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if not data[at:end].isdigit():
            return None
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields
    depth, body = (3 if data[1:2] == b"6" else 1), data[at + 1 :]
    if not width or not height or not 0 < top < 256 or len(body) < width * height * depth:
        return None
    pixel = lambda k: tuple(body[k : k + 3]) if depth == 3 else (body[k],) * 3
    return [[pixel((y * width + x) * depth) for x in range(width)] for y in range(height)]


def colour_histogram(pixels: list[list[tuple[int, int, int]]], bins: int = 8, grid: int = 2) -> list[float]:
    """Histograms of each channel over the image and over grid x grid cells, together of sum 1: 3 * bins * (1 + grid**2) values."""
    height, width = len(pixels), len(pixels[0])
    out: list[float] = []
    first = lambda i, n: -(-i * n // grid)  # the first place of n whose cell is i
    cells = [(0, height, 0, width)] + [(first(i, height), first(i + 1, height), first(j, width), first(j + 1, width)) for i in range(grid) for j in range(grid)]
    for a, b, c, d in cells:
        for channel in range(3):
            counts, n = [0] * bins, (b - a) * (d - c)
            for row in pixels[a:b]:
                for p in row[c:d]:
                    counts[min(bins - 1, p[channel] * bins // 256)] += 1
            out += [x / n if n else 0.0 for x in counts]
    total = sum(out)
    return [x / total for x in out] if total else out


def images(files: DataFrame) -> DataFrame:
    """binaryFile rows -> (path, bytes, sha256, format, width, height, channels, mode, complete, histogram); unreadable files have null sizes."""
    schema = "path string, bytes long, sha256 string, format string, width int, height int, channels int, mode string, complete boolean, histogram array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, pixels = image_metadata(content or b""), read_ppm(content or b"")
                out.append((path, len(content or b""), hashlib.sha256(content or b"").hexdigest(), *(head or (None,) * 5), image_complete(content or b""), colour_histogram(pixels) if pixels else None))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 10, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return files.select("path", "content").mapInArrow(run, schema)


def image_statistics(scanned: DataFrame, small: int = 64, large: int = 10_000_000) -> DataFrame:
    """One row about readable images: sizes, small, large and long ones, and those whose contents repeat."""
    known = scanned.filter(F.col("width").isNotNull())
    ratio = F.col("width") / F.col("height")
    numbers = lambda c, n: [F.min(c).alias(f"{n}_min"), F.round(F.percentile(c, 0.5), 6).alias(f"{n}_median"), F.max(c).alias(f"{n}_max")]
    sums = known.agg(
        F.count(F.lit(1)).alias("images"),
        *numbers(F.col("width"), "width"),
        *numbers(F.col("height"), "height"),
        F.round(F.avg(ratio), 6).alias("aspect_mean"),
        F.count_if((F.col("width") < small) | (F.col("height") < small)).alias("small"),
        F.count_if(F.col("bytes") > large).alias("large"),
        F.count_if((ratio < 0.5) | (ratio > 2.0)).alias("extreme_aspect"),
    )
    unread = scanned.agg(F.count_if(F.col("width").isNull()).alias("unreadable"))
    twice = scanned.groupBy("sha256").count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate_groups"))
    return sums.crossJoin(F.broadcast(unread)).crossJoin(F.broadcast(twice))  # one row each


def histogram_search(scanned: DataFrame, query_paths: list[str], k: int) -> DataFrame:
    """(query_id, candidate_id, score, rank) by histogram intersection; the queries are a stated list of paths, themselves left out."""
    h = scanned.filter(F.col("histogram").isNotNull())
    q = h.filter(F.col("path").isin(query_paths)).select(F.col("path").alias("query_id"), F.col("histogram").alias("q"))
    pairs = h.select(F.col("path").alias("candidate_id"), "histogram").join(F.broadcast(q), F.col("candidate_id") != F.col("query_id"))
    scores = pairs.select("query_id", "candidate_id", F.round(intersection(F.col("q"), F.col("histogram")), 6).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def gallery(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, filename, finding) of an image list, a JSON array or an object with `images`; ids as numbers, in any order.

    finding tells of ids that are no numbers, file names that are empty or hold a path, and ids that repeat.
    """
    entry = "array<struct<id:string,file_name:string>>"
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    entries = F.when(F.col("value").startswith("["), F.from_json("value", entry)).otherwise(F.from_json("value", f"images {entry}")["images"])
    rows = text.select(F.explode(entries).alias("e")).select(normal_id(F.col("e.id")).alias("image_id"), F.trim(F.coalesce("e.file_name", F.lit(""))).alias("filename"))
    twice = F.count(F.lit(1)).over(W.partitionBy("image_id")) > 1
    finding = F.when(F.col("image_id").isNull(), "invalid_id").when((F.col("filename") == "") | F.col("filename").rlike(r"[/\\]"), "invalid_filename").when(twice, "duplicate_id")
    return rows.withColumn("finding", finding)


def settings(text: str, defaults: dict, least: dict | None = None) -> dict:
    """A TOML document's values over defaults, section by section; ValueError for unknown keys, other types, and numbers below `least`."""
    import tomllib

    def merge(base: dict, given: dict, place: str) -> dict:
        if unknown := sorted(set(given) - set(base)):
            raise ValueError(f"unknown settings: {', '.join(place + k for k in unknown)}")
        out = dict(base)
        for k, v in given.items():
            if isinstance(base[k], dict) != isinstance(v, dict) or (not isinstance(v, dict) and type(v) is not type(base[k]) and not (isinstance(base[k], float) and isinstance(v, int))):
                raise ValueError(f"{place}{k} must be like {base[k]!r}")
            out[k] = merge(base[k], v, f"{place}{k}.") if isinstance(v, dict) else v
        return out

    found = merge(defaults, tomllib.loads(text), "")
    for key, low in (least or {}).items():
        value = found
        for part in key.split("."):
            value = value[part]
        if value < low:
            raise ValueError(f"{key} must be at least {low}")
    return found


def manifest_summary(records: DataFrame, **properties: str) -> DataFrame:
    """One row about records (group_id, filename, captions): properties, groups, captions and groups without a file."""
    names = [F.lit(v).alias(k) for k, v in sorted(properties.items())]
    return records.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.size("captions")).alias("captions"), F.count_if(F.col("filename").isNull()).alias("without_file")).select(*names, "*")


def intersection(a, b):
    """Likeness of two histograms: the sum of the smaller shares."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)


def markdown(rows: DataFrame, limit: int = 200) -> str:
    """A Markdown table of a small report."""
    head = rows.columns
    lines = ["| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |"]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect()]) + "\n"


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON and CSV with a header."""
    rows.write.mode("overwrite").json(f"{path}/json")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def first_per(rows: DataFrame, category: str, *order: str) -> DataFrame:
    """One exemplar of each category, the first in that order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(category).orderBy(*order))).filter("_n = 1").drop("_n")
