"""Readers and writers: what is written to the shared folder comes back, and small files of every format are read."""

from __future__ import annotations

import json
import struct
import uuid

from pyspark.sql import functions as F

from ..sources import records
from ..streaming.events import shared_dir
from .text_queries import C, captions, table

Q: dict = {}


def query(sql=None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def _path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file(spark, name, value):
    """A text file of one value in the shared folder."""
    path = _path(spark, name)
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(path)
    return path


COCO = {
    "images": [{"id": 2, "file_name": "b.jpg"}, {"id": 1, "file_name": "a.jpg"}, {"id": 3, "file_name": "c.jpg"}],
    "annotations": [{"id": 11, "image_id": 2, "caption": " two "}, {"id": 10, "image_id": 1, "caption": "one"}, {"id": 7, "image_id": 2, "caption": "second"}],
}


@query("select * from (values ('1', 'a.jpg', 'coco2017_val#10', 'one'), ('2', 'b.jpg', 'coco2017_val#11', 'two'), ('2', 'b.jpg', 'coco2017_val#7', 'second'), ('3', 'c.jpg', null, null)) v(group_id, filename, caption_id, text)")
def coco_source(spark, sf):
    found = records.coco_captions(spark, _file(spark, "coco", COCO))
    return found.select("group_id", "filename", F.explode_outer("captions").alias("c")).select("group_id", "filename", "c.caption_id", "c.text")


COMPOSED = [
    {"id": 1, "reference_img_id": "007", "relative_caption": "in the rain", "target_img_id": "20", "gt_img_ids": ["20", "30"], "semantic_aspects": ["cardinality"], "shared_concept": "dog"},
    {"id": 2, "reference_img_id": "20", "relative_caption": " ", "target_img_id": "5", "gt_img_ids": ["20", "20"], "semantic_aspects": [], "shared_concept": "cat"},
    {"id": 3, "reference_img_id": "x", "relative_caption": "older", "target_img_id": None, "gt_img_ids": [], "semantic_aspects": [], "shared_concept": "cat"},
]


@query("select * from (values (1, '7', '20', ''), (2, '20', '5', 'empty_modification reference_in_ground_truth target_not_in_ground_truth repeated_ground_truth'), (3, null, null, 'no_ground_truth')) v(id, reference_img_id, target_img_id, findings)")
def composed_source(spark, sf):
    found = records.composed_queries(spark, _file(spark, "composed", COMPOSED))
    return found.select("id", "reference_img_id", "target_img_id", F.array_join("findings", " ").alias("findings"))


RANKING = {"task": "t2i", "system_id": "s", "queries": [{"query_id": "q1", "candidate_ids": ["a", "b"], "scores": [0.9, 0.5]}, {"query_id": "q2", "task": "i2t", "candidate_ids": ["c"], "scores": [0.25]}]}


@query("select * from (values ('q1', 'a', 0.9::double, 1, 't2i', 's'), ('q1', 'b', 0.5::double, 2, 't2i', 's'), ('q2', 'c', 0.25::double, 1, 'i2t', 's')) v(query_id, candidate_id, score, rank, task, system_id)")
def ranking_source(spark, sf):
    return records.rankings(spark, _file(spark, "ranking", RANKING))


GALLERY = {"images": [{"id": "0012", "file_name": "x.jpg"}, {"id": 3, "file_name": " y.jpg "}, {"id": "4", "file_name": "a/b.jpg"}, {"id": "z", "file_name": "q.jpg"}, {"id": 5, "file_name": "v.jpg"}, {"id": "5", "file_name": "w.jpg"}]}


@query("select * from (values ('12', 'x.jpg', null), ('3', 'y.jpg', null), ('4', 'a/b.jpg', 'invalid_filename'), (null, 'q.jpg', 'invalid_id'), ('5', 'v.jpg', 'duplicate_id'), ('5', 'w.jpg', 'duplicate_id')) v(image_id, filename, finding)")
def gallery_source(spark, sf):
    return records.gallery(spark, _file(spark, "gallery", GALLERY))


def _manifest(spark, sf):
    c = captions(spark, sf).groupBy(F.col("group_id").cast("string").alias("group_id")).agg(F.collect_list(F.struct("caption_id", F.coalesce("text", F.lit("")).alias("text"))).alias("captions"))
    return c.select("group_id", F.concat("group_id", F.lit(".jpg")).alias("filename"), "captions")


@query(f"with {C} select group_id::varchar as group_id, caption_id, text from c")
def manifest_round_trip(spark, sf):
    path = _path(spark, "manifest")
    records.write_manifest(_manifest(spark, sf), path, dataset="conversations")
    return records.read_manifest(spark, path).select("group_id", F.explode("captions").alias("c")).select("group_id", "c.caption_id", "c.text")


@query(f"with {C} select 'conversations' as dataset, count(distinct group_id) as groups, count(*) as captions, 0 as without_file from c")
def manifest_summary(spark, sf):
    return records.manifest_summary(_manifest(spark, sf), dataset="conversations")


@query("select vec_id as id, len(embedding)::bigint as dimension, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) as total from embeddings")
def index_round_trip(spark, sf):
    path = _path(spark, "index")
    records.save_index(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), path, kind="flat", lists=1)
    back = records.load_index(spark, path, kind="flat", lists=1)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return back.select("id", F.size("embedding").cast("long").alias("dimension"), F.round(total, 5).alias("total"))


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 640, 480, 8, 6, 0, 0, 0) + b"data"
FILES = {
    "a.png": PNG + b"IEND\xaeB`\x82",
    "b.png": PNG,
    "c.jpg": b"\xff\xd8\xff\xff\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x0b\x08\x00\x10\x00\x40\x03\x00\x00\x00\xff\xd9",
    "d.gif": b"GIF89a" + struct.pack("<HH", 30, 100) + b";",
    "e.ppm": b"P6\n2 1\n255\n" + bytes([255, 0, 0] * 2),
    "f.ppm": b"P6\n2 1\n255\n" + bytes([0, 0, 255] * 2),
    "g.ppm": b"P6\n2 1\n255\n" + bytes([255, 0, 0, 0, 0, 255]),
    "h.txt": b"not an image",
    "i.txt": b"not an image",
}


def _scanned(spark):
    return records.images(spark.createDataFrame([(n, bytearray(d)) for n, d in FILES.items()], "path string, content binary"))


@query(
    "select * from (values ('a.png', 'png', 640, 480, 4, 'RGBA', true), ('b.png', 'png', 640, 480, 4, 'RGBA', false), ('c.jpg', 'jpeg', 64, 16, 3, 'RGB', true), ('d.gif', 'gif', 30, 100, 3, 'P', true), ('e.ppm', 'ppm', 2, 1, 3, 'RGB', true),"
    " ('f.ppm', 'ppm', 2, 1, 3, 'RGB', true), ('g.ppm', 'ppm', 2, 1, 3, 'RGB', true), ('h.txt', null, null, null, null, null, false), ('i.txt', null, null, null, null, null, false)) v(path, format, width, height, channels, mode, complete)"
)
def image_scan(spark, sf):
    return _scanned(spark).select("path", "format", "width", "height", "channels", "mode", "complete")


@query("select 7 as images, 2 as width_min, 30.0::double as width_median, 640 as width_max, 1 as height_min, 16.0::double as height_median, 480 as height_max, round((640 / 480 * 2 + 4 + 0.3 + 6) / 7, 6) as aspect_mean, 5 as small, 0 as large, 2 as extreme_aspect, 2 as unreadable, 1 as duplicate_groups")
def image_statistics(spark, sf):
    return records.image_statistics(_scanned(spark))


@query("select * from (values ('e.ppm', 'g.ppm', 0.666667::double, 1), ('e.ppm', 'f.ppm', 0.333333::double, 2)) v(query_id, candidate_id, score, rank)")
def histogram_search(spark, sf):
    return records.histogram_search(_scanned(spark), ["e.ppm"], 2)
