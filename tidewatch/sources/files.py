"""CSV recordings, labelled file sets, text logs and stored matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.entropy import cell_entropy
from tidewatch.functions.network import syn_ack_ratio
from tidewatch.session import prepare

# fixed values: accepted names of each quantity, the first one present wins
LIVE_NAMES: dict[str, list[str]] = {
    "t_vol": ["flow_byts_s", "T_vol"],
    "n_req": ["flow_pkts_s", "N_req"],
    "s_len": ["pkt_len_mean", "S_len"],
    "iat_mean": ["iat_mean", "IAT_mean"],
    "sa_ratio": ["syn_ack_ratio", "SA_ratio"],
    "jaccard_score": ["Jaccard_score", "jaccard_score"],
    "domain": ["Domain", "domain"],
}
RECORDED_NAMES: dict[str, list[str]] = LIVE_NAMES | {
    "t_vol": ["Flow Byts/s", "flow_byts_s", "T_vol"],
    "n_req": ["Flow Pkts/s", "flow_pkts_s", "N_req"],
    "s_len": ["Pkt Len Mean", "pkt_len_mean", "S_len"],
    "iat_mean": ["Flow IAT Mean", "iat_mean", "IAT_mean"],
    "syn_count": ["SYN Flag Cnt"],
    "ack_count": ["ACK Flag Cnt"],
}


def first_present(df: DataFrame, names: Sequence[str]) -> Column | None:
    for name in names:
        if name in df.columns:
            return F.col(f"`{name}`")
    return None


def number_or_zero(df: DataFrame, names: Sequence[str]) -> Column:
    """First present column as a double, 0.0 when none is there. Null cells stay null."""
    found = first_present(df, names)
    return F.lit(0.0) if found is None else found.cast("double")


def feature_columns(df: DataFrame, names: Mapping[str, Sequence[str]] = LIVE_NAMES) -> dict[str, Column]:
    """The volumes and the four ready-made features of a recording."""
    picked = {
        c: number_or_zero(df, names[c])
        for c in ("t_vol", "n_req", "s_len", "iat_mean", "jaccard_score")
    }
    ratio = first_present(df, names["sa_ratio"])
    if ratio is None:
        counts = [number_or_zero(df, names.get(c, [])) for c in ("syn_count", "ack_count")]
        picked["sa_ratio"] = syn_ack_ratio(*counts)
    else:
        picked["sa_ratio"] = ratio.cast("double")
    domain = first_present(df, names["domain"])
    picked["entropy_shannon"] = F.lit(0.0) if domain is None else cell_entropy(domain)
    return picked


def read_csv(spark: SparkSession, paths: Sequence[str], schema: str | None = None) -> DataFrame:
    """CSV with header, plain or gzip. Row order inside each file is kept in two columns:
    the start of the file split and a number that grows along it."""
    prepare(spark)
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(list(paths)).withColumns(
        {
            "file": F.col("_metadata.file_path"),
            "split_start": F.col("_metadata.file_block_start"),
            "split_row": F.monotonically_increasing_id(),
        }
    )


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths that exist, on whatever file system they name."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            found.append(path)
        else:
            print(f"warning: {path} not found, skipped")
    return found


def read_labelled(
    spark: SparkSession,
    benign: Sequence[str],
    attacks: Sequence[str],
    schema: str | None = None,
) -> DataFrame | None:
    """Recordings of two classes with their label; missing files are skipped."""
    sets = []
    for paths, label in ((benign, 0), (attacks, 1)):
        found = existing_paths(spark, paths)
        if found:
            sets.append(read_csv(spark, found, schema).withColumn("label", F.lit(label)))
    if not sets:
        return None
    return sets[0] if len(sets) == 1 else sets[0].unionByName(sets[1], allowMissingColumns=True)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines that are not blank, trimmed."""
    prepare(spark)
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(line.alias("line")).filter(F.col("line") != "")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Stored training rows: six features and a label."""
    prepare(spark)
    return spark.read.parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, predicates: Sequence[str], properties: Mapping[str, str]
) -> DataFrame:
    """Database scan, one partition per predicate; further filters are pushed down."""
    prepare(spark)
    return spark.read.jdbc(url, table, predicates=list(predicates), properties=dict(properties))
