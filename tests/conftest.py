import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("marketlens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def devices(spark):
    return spark.createDataFrame(
        [
            ("K041628", "Test system DS DNA", None, ["Antinuclear antibody"], "Acme", "Substantially Equivalent", "2004-09-01", "IM"),
            ("K900001", "Anticardiolipin IgG kit", None, None, "Acme", "Substantially Equivalent", "1999-01-05", "IM"),
            ("K900002", "GAD65 autoantibody assay", None, ["Gad", "Islet antibody"], "Beta", "Substantially Equivalent", "2011-03-31", "IM"),
            ("K900003", "RF ablation probe", "rheumatoid factor, RF", None, "Gamma", "Not Substantially Equivalent", "2015-07-07", "SU"),
            ("DEN140001", "Novel assay", None, None, "Beta", "Substantially Equivalent", "2014-02-02", "CH"),
        ],
        "k_number string, device_name string, statement_or_summary string, openfda_device_names array<string>, "
        "applicant string, decision_description string, decision_date string, panel string",
    ).withColumn("decision_date", __import__("pyspark.sql.functions", fromlist=["x"]).col("decision_date").cast("date"))


@pytest.fixture(scope="session")
def terms(spark):
    names = ["PSA", "HbA1c", "Anti-GAD65", "Anti-GAD65 IgG", "Anti-β2-GP1", "dsDNA",
             "Anti-Cardiolipin IgG", "GAD IgG4", "anti IgG", "-", "RF"]
    return spark.createDataFrame(list(enumerate(names)), "term_id int, term string")
