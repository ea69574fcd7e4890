"""R2 evidence text rules: CSV quoting, sections only for present modalities."""

from pyspark.sql import functions as F

from faultlens.operators.evidence import MODALITY_NAMES, MODALITY_SEPARATOR, csv_line, evidence_bundle


def test_csv_quoting(spark):
    df = spark.createDataFrame([("a,b", 'say "hi"', None, 1.5)], "x string, y string, z string, d double")
    assert df.select(csv_line(df, ["x", "y", "z", "d"])).first()[0] == '"a,b","say ""hi""",,1.500000'


def test_bundle_only_present_modalities(spark):
    logs = spark.createDataFrame([("u1", "n", "s", "p-0", "boom", 3)],
                                 "uuid string, node_name string, service_name string, pod_name string, "
                                 "message string, occurrence_count long")
    trace = spark.createDataFrame([], "uuid string, node_name string, service_name string, parent_pod string, "
                                      "child_pod string, operation_name string, normal_avg_duration double, "
                                      "anomaly_avg_duration double, anomaly_count_text string, rank int")
    status = spark.createDataFrame([("u2", "n", "s", "N/A", "p-1", "op", "13", "m", "x:1", 1)],
                                   "uuid string, node_name string, service_name string, parent_pod string, "
                                   "child_pod string, operation_name string, status_code string, "
                                   "status_message string, occurrence_text string, rank int")
    metrics = spark.createDataFrame([], "uuid string, source string, entity string, metric string, "
                                        "normal_mean double, fault_mean double, mean_ratio double")
    got = {r.uuid: r for r in evidence_bundle(logs, trace, status, metrics).collect()}
    assert got["u1"].modalities == MODALITY_NAMES[0] and got["u1"].trace_section is None
    assert got["u1"].log_section.splitlines()[1] == "n,s,p-0,boom,3"
    assert got["u2"].modalities == MODALITY_NAMES[1] and got["u2"].log_section is None
    assert got["u2"].n_status_rows == 1 and got["u2"].metric_section is None
    both = evidence_bundle(logs.withColumn("uuid", F.lit("u2")), trace, status, metrics).first()
    assert both.modalities == MODALITY_SEPARATOR.join(MODALITY_NAMES[:2])
