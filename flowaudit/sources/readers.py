"""Scans of flow, telemetry and log files with explicit schemas."""
from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column layouts of the three flow exporters and of the telemetry.
ZEEK_FLOWS = ("uid STRING, src_ip STRING, src_port BIGINT, dst_ip STRING, dst_port BIGINT, proto STRING, service STRING, "
              "duration DOUBLE, src_bytes DOUBLE, dst_bytes DOUBLE, conn_state STRING, missed_bytes BIGINT, history STRING, "
              "src_pkts BIGINT, src_ip_bytes BIGINT, dst_pkts BIGINT, dst_ip_bytes BIGINT, ip_proto BIGINT, "
              "http_trans_depth BIGINT, attack_category STRING, attack_type STRING, files_total_bytes DOUBLE, "
              "is_GET_mthd BIGINT, http_status_error BIGINT, is_file_transfered BIGINT, traffic_type BIGINT")
TELEMETRY = ("dlBytes BIGINT, dlMcs BIGINT, dlBler DOUBLE, ulBytes BIGINT, ulMcs BIGINT, ulBler DOUBLE, ri BIGINT, phr BIGINT, "
             "pcmax BIGINT, rsrq DOUBLE, sinr DOUBLE, rsrp BIGINT, rssi DOUBLE, cqi BIGINT, pucchSnr DOUBLE, puschSnr DOUBLE, "
             "ue_id DOUBLE, timestamp DOUBLE, cellid DOUBLE, in_sync DOUBLE, rnti STRING, pmi STRING, traffic_type BIGINT, "
             "attack_category STRING, attack_subcategory STRING")
NFSTREAM_FLOWS = ("bidirectional_duration_ms BIGINT, src2dst_bytes BIGINT, dst2src_bytes BIGINT, src2dst_packets BIGINT, "
                  "dst2src_packets BIGINT, protocol BIGINT, tunnel_id BIGINT, label STRING")
THIRD_CORPUS_FILES = {"004-syn-flood.csv": "syn_flood", "005-icmp-flood.csv": "icmp_flood", "003a-pfcp.csv": "pfcp_deletion"}
THIRD_CORPUS_LABELS = {"malicious": 1, "benign": 0, "background": 0}
ZEEK_LOG_TYPES = {"duration": "double", "orig_bytes": "double", "resp_bytes": "double", "orig_pkts": "bigint",
                  "orig_ip_bytes": "bigint", "resp_pkts": "bigint", "resp_ip_bytes": "bigint"}


def _nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def scan_flows_csv(spark: SparkSession, path: str | list[str], schema: str, columns: list[str] | None = None) -> DataFrame:
    """S1, S2. Flow CSV with a given schema; NaN reads as NULL. A projection prunes the scan."""
    df = _nan_to_null(spark.read.schema(schema).option("header", True).csv(path))
    return df.select(*columns) if columns else df


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """S5."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_telemetry_table(spark: SparkSession, path: str | None = None, columns: list[str] | None = None, jdbc: dict | None = None) -> DataFrame:
    """S3, S4. A landed Parquet copy, or a JDBC table; both prune to the wanted columns.

    `jdbc` holds url, dbtable and, for a parallel read, partitionColumn with its bounds.
    """
    df = spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_json_lines(spark: SparkSession, path: str | list[str], schema: str = TELEMETRY) -> tuple[DataFrame, DataFrame]:
    """S6. (rows by time and device, malformed lines per file).

    Blank lines are skipped. A line that is no JSON object or has no timestamp counts as
    malformed.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_name").alias("file")).filter(F.col("line") != "")
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_bad", T.StringType())])
    d = lines.select("file", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    d = d.select("file", "r.*").withColumn("_ok", F.col("_bad").isNull() & F.col("timestamp").isNotNull())
    bad = d.groupBy("file").agg(F.count_if(~F.col("_ok")).alias("malformed"))
    rows = d.filter("_ok").drop("_bad", "_ok").withColumn("ts", F.col("timestamp") / 1000.0)
    return rows.orderBy("ts", F.coalesce("ue_id", F.lit(0.0))), bad


def scan_zeek_log(spark: SparkSession, path: str) -> DataFrame:
    """S7. Column names from the #fields line; # lines dropped; '-' is NULL. All logs of a path share one layout."""
    head = spark.read.text(path).filter(F.col("value").startswith("#fields")).limit(1).collect()
    if not head:
        raise ValueError(f"{path}: no #fields line")
    names = head[0][0].rstrip("\n").split("\t")[1:]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("nullValue", "-").option("quote", "").csv(path)
    return df.select(*[F.expr(f"try_cast(`{n}` AS {ZEEK_LOG_TYPES[n]})").alias(n) if n in ZEEK_LOG_TYPES else F.col(f"`{n}`") for n in names])


def scan_zipped_csv(spark: SparkSession, paths: list[str], member: str, schema: str, chunk_rows: int = 50_000) -> DataFrame:
    """S8. A CSV member of zip archives on a shared path; one archive per task, streamed in chunks."""
    fields = T._parse_datatype_string(schema).fields
    names = [f.name for f in fields]
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                with zipfile.ZipFile(p.removeprefix("file:")) as z, z.open(member) as fh:
                    for part in pd.read_csv(fh, usecols=names, dtype=str, chunksize=chunk_rows):
                        yield part[names].astype(object).where(part[names].notna(), None)
    src = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    d = src.mapInPandas(read, text)
    return d.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in fields])


def scan_many(spark: SparkSession, paths: list[str], schema: str, kinds: dict[str, str] = THIRD_CORPUS_FILES,
              label: str = "label", attack: str = "malicious") -> DataFrame:
    """S9. Several files in one scan, with the file name and the attack each file stands for."""
    d = spark.read.schema(schema).option("header", True).csv(paths)
    d = d.select("*", F.col("_metadata.file_name").alias("file"))
    kind: Column = F.element_at(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))]), F.col("file"))
    return d.withColumn("category", F.when(F.col(label) == attack, kind).otherwise(F.col(label)))


def scan_shards(spark: SparkSession, paths: list[str], keys: list[str], fmt: str = "parquet") -> DataFrame:
    """S12. Union of shard outputs; of a repeated key the row of the first path is kept."""
    parts = [spark.read.format(fmt).load(p).withColumn("_o", F.lit(i)) for i, p in enumerate(paths)]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    cols = [c for c in u.columns if c != "_o"]
    first = u.groupBy(*keys).agg(F.min_by(F.struct(*cols), "_o").alias("_r"))
    return first.select("_r.*")


def load_spec(path: str) -> dict:
    """S20. A small JSON or YAML mapping, read by the driver."""
    with open(path, encoding="utf-8") as fh:
        text = fh.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package; use JSON") from e
        return yaml.safe_load(text)
    return json.loads(text)


def label_map(spark: SparkSession, mapping: dict, key: str = "label", value: str = "canonical") -> DataFrame:
    """S20. A mapping as a dimension table."""
    return spark.createDataFrame([(str(k), v) for k, v in mapping.items()], [key, value])
