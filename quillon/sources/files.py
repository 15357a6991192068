"""Sources: nested catalogues, job lists, configurations within pages, tables in files of any format."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder

from ..functions.text import or_default

STAGE = "struct<id:string,titulo:string,titulo_bloqueado:string,acceso:string,requiere:array<string>,piezas:array<string>>"
PIECE = (
    "struct<id:string,tipo:string,titulo:string,titulo_bloqueado:string,etapa:string,orden:int,paquete:string,ruta:string,miniatura:string,"
    "recursos:array<string>,recursos_de_otras_piezas:array<string>,dependencias:array<string>,interaccion:array<string>,duracion_estimada_min:array<int>>"
)
JOB = "html string, out string, width int, height int, dpr double, selector string, transparent boolean, query string, scroll int, fullPage boolean"


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stages, pieces) of a JSON catalogue, one row each, with pos for their order in the file."""
    whole = spark.read.schema(f"etapas array<{STAGE}>, piezas array<{PIECE}>").option("multiLine", True).json(path)
    rows = lambda name: whole.select(F.posexplode(name).alias("pos", "x")).select("pos", "x.*")
    pieces = rows("piezas")
    spread = F.struct(F.get("duracion_estimada_min", F.lit(0)).alias("low"), F.get("duracion_estimada_min", F.lit(1)).alias("high"))
    return rows("etapas"), pieces.withColumn("minutes", spread)


def stage_minutes(stages: DataFrame, pieces: DataFrame) -> DataFrame:
    """Summed bounds of the minutes of each stage's pieces."""
    listed = stages.select(F.col("id").alias("stage"), F.explode("piezas").alias("piece"))
    return listed.join(pieces, F.col("piece") == F.col("id")).groupBy("stage").agg(F.sum("minutes.low").alias("low"), F.sum("minutes.high").alias("high"))


def open_stages(stages: DataFrame, solved: DataFrame, bought: bool) -> DataFrame:
    """id and open of each stage. solved: id of what has been solved. A stage tests only what it lists itself."""
    needs = stages.select("id", F.explode_outer("requiere").alias("need")).filter("need is null or need <> 'compra'")
    met = needs.join(solved.select(F.col("id").alias("done")).distinct(), F.col("need") == F.col("done"), "left")
    every = met.groupBy("id").agg(F.bool_and(F.col("need").isNull() | F.col("done").isNotNull()).alias("all_met"))
    rows = stages.select("id", "acceso").join(every, "id", "left")
    return rows.select("id", ((F.col("acceso") == "gratis") | (F.lit(bought) & F.coalesce("all_met", F.lit(True)))).alias("open"))


def read_jobs(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """Render jobs of a JSON array with their defaults; `only` keeps those whose output contains it, at the scan."""
    jobs = spark.read.schema(JOB).option("multiLine", True).json(path)
    if only:
        jobs = jobs.filter(F.contains("out", F.lit(only)))
    return jobs.withColumns({"width": or_default(F.col("width"), 1000), "height": or_default(F.col("height"), 800), "dpr": or_default(F.col("dpr"), 1.0)})


def page_config(pages: DataFrame, schema: str, name: str = "D", column: str = "html") -> DataFrame:
    """pages with config: the JSON object that a page's script assigns to `name`; null where there is none."""
    body = F.regexp_extract(column, rf"<script>(?:var |window\.)?{name}\s*=\s*(\{{.*?\}});?</script>", 1)
    return pages.withColumn("config", F.from_json(F.nullif(body, F.lit("")), schema))


def stored(rows: DataFrame, kind: str, **options) -> DataFrame:
    """The rows after a round through files of that format in the shared folder, read with their schema."""
    path = f"{shared_folder(rows.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    rows.write.format(kind).options(**options).save(path)
    return rows.sparkSession.read.format(kind).schema(rows.schema).options(**options).load(path)
