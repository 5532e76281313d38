"""Face tables derived from the `embeddings` table: labels stand for people, five events, photos of up to two faces of
one event, re-uploads, and hard faces between two people. The same views in DuckDB are in PRELUDE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumweave.operators.pairs import BLOCK, blocks_of

_BASE = """
SELECT concat('e', cast(vec_id % 5 AS string)) AS event_id, vec_id AS row_ix, concat('f', cast(vec_id AS string)) AS face_id,
       concat('p', cast(vec_id % 5 AS string), '-', cast(cast(floor(vec_id / 10) AS bigint) AS string)) AS photo_id,
       label, cast(40 + (vec_id * 37) % 160 AS double) AS face_width, cast(1000 + (vec_id * 7) % 3 * 1000 AS double) AS image_long_side,
       CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN concat('prevx-', cast(label AS string))
            ELSE concat('prev-', cast(label AS string)) END AS prev_cluster_id, {v} AS v
FROM {embeddings}"""
_SPARK_V = "concat(transform(sequence(0, 9), k -> if(k = label, 0.8D, 0D)), transform(embedding, x -> 0.6D * cast(x AS double)))"
_DUCK_V = """list_concat(list_transform(range(10), lambda k: cast(CASE WHEN k = label THEN 0.8 ELSE 0 END AS double)),
                   list_transform(embedding, lambda x: cast(0.6 AS double) * cast(x AS double)))"""
_FACES = """
SELECT event_id, row_ix, face_id, photo_id, label, face_width, image_long_side, prev_cluster_id, v FROM {base}
UNION ALL
SELECT event_id, row_ix + 100000, concat(face_id, 'r'), concat(photo_id, 'r'), label, face_width, image_long_side, NULL, v FROM {base} WHERE row_ix % 24 = 0"""
_HARD = """
SELECT event_id, row_ix + 200000 AS row_ix, concat(face_id, 'h') AS face_id, concat(photo_id, 'h', cast(row_ix AS string)) AS photo_id, label, face_width, image_long_side,
       cast(NULL AS string) AS prev_cluster_id, v AS base_v,
       cast(CASE cast(floor(row_ix / 13) AS bigint) % 5 WHEN 0 THEN 0.75 WHEN 3 THEN 0.20 ELSE 0.45 END AS double) AS wa,
       cast(CASE cast(floor(row_ix / 13) AS bigint) % 5 WHEN 0 THEN 0.10 WHEN 2 THEN 0.43 WHEN 4 THEN 0.35 ELSE 0.05 END AS double) AS wb
FROM {base} WHERE row_ix % 13 = 0"""
_HARD_SPARK = """
SELECT event_id, row_ix, face_id, photo_id, label, face_width, image_long_side, prev_cluster_id,
       concat(transform(sequence(0, 9), k -> CASE WHEN k = label THEN wa WHEN k = (label + 1) % 10 THEN wb ELSE 0D END),
              transform(slice(base_v, 11, 64), x -> x / 0.6D * sqrt(1D - wa * wa - wb * wb))) AS v
FROM {hard}"""
_HARD_DUCK = """
SELECT event_id, row_ix, face_id, photo_id, label, face_width, image_long_side, prev_cluster_id,
       list_concat(list_transform(range(10), lambda k: cast(CASE WHEN k = label THEN wa WHEN k = (label + 1) % 10 THEN wb ELSE 0 END AS double)),
                   list_transform(base_v[11:74], lambda x: x / cast(0.6 AS double) * sqrt(1 - wa * wa - wb * wb))) AS v
FROM hard_base"""
_SCORED = """
SELECT a.event_id, a.face_id AS source_face_id, b.face_id AS rep_face_id,
       cast(CASE WHEN a.label = b.label THEN 86 + (a.row_ix + b.row_ix) % 14 ELSE (a.row_ix * 3 + b.row_ix) % 60 END AS double) AS similarity
FROM {faces} a JOIN {faces} b ON a.event_id = b.event_id AND a.row_ix < b.row_ix"""
_LABELS = """
SELECT event_id, face_id, cast(80 + row_ix % 20 AS double) AS doll, cast(row_ix % 50 AS double) AS toy,
       cast(50 + row_ix % 31 AS double) AS sculpture, cast(row_ix % 40 AS double) AS statue, cast(row_ix % 3 AS int) AS n_faces FROM {faces}"""
_DETECTIONS = """
SELECT event_id, photo_id, face_id, row_ix, face_width * cast(CASE WHEN row_ix % 4 = 0 THEN 3 ELSE 1 END AS double) AS w,
       face_width * cast(CASE WHEN row_ix % 4 = 0 THEN 3 ELSE 1 END AS double) * cast(0.9 + (row_ix % 9) / 10.0 AS double) AS h,
       cast(0.5 + (row_ix % 50) / 100.0 AS double) AS score, image_long_side AS long_side FROM {faces}"""
_LOG = """
SELECT a.event_id, cast(a.row_ix * 1000 + (b.row_ix % 1000) AS bigint) AS seq,
       CASE WHEN (a.row_ix + b.row_ix) % 3 = 0 THEN 'cannot' ELSE 'must' END AS kind, a.face_id AS a, b.face_id AS b
FROM {faces} a JOIN {faces} b ON a.event_id = b.event_id AND b.row_ix = a.row_ix + 5 WHERE a.row_ix % 2 = 0"""


def face_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_BASE.replace("{v}", _SPARK_V), embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_FACES, base=face_base(spark, sf_dir))


def hard_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_HARD_SPARK, hard=spark.sql(_HARD, base=face_base(spark, sf_dir)))


def scored_pairs(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """All scored pairs; or those of `wanted`, pairs (event_id, source_face_id, rep_face_id) or whole sources (event_id,
    source_face_id), whose faces are looked up, so that no table of all pairs is made."""
    rows = faces(spark, sf_dir).drop("v")
    if wanted is None:
        return spark.sql(_SCORED, faces=rows)
    keys = [c for c in ("event_id", "source_face_id", "rep_face_id") if c in wanted.columns]
    rep = " AND b.face_id = w.rep_face_id" if len(keys) == 3 else ""
    from_ = f"FROM {{wanted}} w JOIN {{faces}} a ON a.event_id = w.event_id AND a.face_id = w.source_face_id JOIN {{faces}} b ON b.event_id = w.event_id{rep} AND a.row_ix < b.row_ix"
    return spark.sql(_SCORED[: _SCORED.index("FROM {faces} a")] + from_, faces=rows, wanted=wanted.select(keys).distinct())


#: The columns of `scored_cells` that name a pair's cell.
CELL = ("event_id", "label", "i", "j")


def scored_cells(faces: DataFrame, block: int = BLOCK) -> DataFrame:
    """The scored pairs of faces of one label, which are all pairs with a score of 60 or more, with the columns of `CELL`.
    A label's faces are dealt into blocks, and a block of sources meets a block of others in one cell: faces are shuffled,
    once for each of their cells, and pairs lie where they are made. The shards are as many as there are shuffle
    partitions, since a few MB of faces make very many pairs."""
    rows = blocks_of(faces.drop("v"), block, ("event_id", "label"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    shards = int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sources, others = (rows.withColumn(a, F.col("block")).withColumn(b, other).repartition(shards, *CELL) for a, b in ("ij", "ji"))
    select = _SCORED[: _SCORED.index("FROM {faces} a")].replace("SELECT ", "SELECT /*+ MERGE(b) */ a.label, a.i, a.j, ", 1)
    from_ = "FROM {sources} a JOIN {others} b ON a.event_id = b.event_id AND a.label = b.label AND a.i = b.i AND a.j = b.j AND a.row_ix < b.row_ix"
    return faces.sparkSession.sql(select + from_, sources=sources, others=others)


def face_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LABELS, faces=faces(spark, sf_dir))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_DETECTIONS, faces=faces(spark, sf_dir))


def pair_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LOG, faces=faces(spark, sf_dir))


_TABLES = [
    ("face_base", _BASE.replace("{v}", _DUCK_V).replace("{embeddings}", "embeddings")),
    ("faces", _FACES.replace("{base}", "face_base")),
    ("hard_base", _HARD.replace("{base}", "face_base")),
    ("hard_faces", _HARD_DUCK),
    ("scored_pairs", _SCORED.replace("{faces}", "faces")),
    ("face_labels", _LABELS.replace("{faces}", "faces")),
    ("detections", _DETECTIONS.replace("{faces}", "faces")),
    ("pair_log", _LOG.replace("{faces}", "faces")),
    ("dots", "SELECT a.event_id, a.row_ix AS a_ix, b.row_ix AS b_ix, a.face_id AS a, b.face_id AS b, a.photo_id AS a_photo, b.photo_id AS b_photo, list_inner_product(a.v, b.v) AS s FROM faces a JOIN faces b ON a.event_id = b.event_id AND a.row_ix < b.row_ix"),
    ("means", "SELECT event_id, label, pos, avg(x) AS x FROM (SELECT event_id, label, unnest(v) AS x, unnest(range(74)) AS pos FROM faces) GROUP BY ALL"),
    ("cents", "SELECT event_id, label, list(x / n ORDER BY pos) AS c FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY event_id, label)) AS n FROM means) GROUP BY ALL"),
    ("everyone", "SELECT * FROM faces UNION ALL SELECT * FROM hard_faces"),
    ("everyone_cents", "SELECT event_id, label, list(x / n ORDER BY pos) AS c FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY event_id, label)) AS n FROM (SELECT event_id, label, pos, avg(x) AS x FROM (SELECT event_id, label, unnest(v) AS x, unnest(range(74)) AS pos FROM everyone) GROUP BY ALL)) GROUP BY ALL"),
]


def prelude(*names: str) -> str:
    """WITH RECURSIVE clauses of the named views and those that they use, in order."""
    import re

    text, wanted = dict(_TABLES), set(names)
    for name, sql in reversed(_TABLES):
        if name in wanted:
            wanted |= {other for other, _ in _TABLES if re.search(rf"\b{other}\b", sql) and other != name}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({text[n]})" for n, _ in _TABLES if n in wanted)
