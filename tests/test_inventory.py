import pytest

from cellwright.operators import inventory as I


def _inventory(spark, rows, **columns):
    base = "file_id int, ordinal int, name string, standard_name string, long_name string, units string, flag_values string, flag_meanings string, n_cells int, n_valid int"
    return spark.createDataFrame([(1, n, r[0], r[1] if len(r) > 1 else None, None, r[2] if len(r) > 2 else None, None, None, 10, r[3] if len(r) > 3 else 9) for n, r in enumerate(rows)], base)


@pytest.mark.parametrize("name, standard, role, confidence", [
    ("product/radiative_cloud_frac", None, "context", "medium"),
    ("product/o3_below_cloud", None, "retrieval-metadata", "medium"),
    ("amf_cloud_fraction", None, "retrieval-metadata", "medium"),
    ("ColumnAmountNO2CloudScreened", None, "science", "low"),
    ("vertical_column_troposphere_uncertainty", None, "quality", "medium"),
    ("product/main_data_quality_flag", None, "quality", "medium"),
    ("qa_statistics/num_column_samples", None, "quality", "high"),
    ("geolocation/relative_thing", None, "context", "high"),
    ("SolarZenithAngle", None, "context", "medium"),
    ("processing_version", None, "unclassified", None),
    ("product/vertical_column", None, "science", "high"),
    ("anything", "atmosphere_mole_content_of_ozone", "science", "high"),
    ("anything", "status_flag", "quality", "high"),
    ("lon", None, "context", "high"),
    ("AOD_550_Mean", None, "science", "low"),
])
def test_roles(spark, name, standard, role, confidence):
    got = I.classify_variables(_inventory(spark, [(name, standard)])).collect()[0]
    assert (got["role"], got["confidence"]) == (role, confidence)


def test_variable_of_a_file(spark):
    def resolve(rows):
        return I.resolve_variable(_inventory(spark, rows)).collect()[0]

    clear = resolve([("terra/Mean", None, "1"), ("terra/Pixel_Counts", None, "1"), ("aqua/Mean", None, "1", 0)])
    assert (clear["variable"], clear["resolution_confidence"], clear["scientific_ambiguity"], clear["excluded_empty"]) == ("terra/Mean", "high", "low", 1)
    fork = resolve([("aqua/Mean", None, "1"), ("terra/Mean", None, "1")])
    assert (fork["variable"], fork["scientific_ambiguity"]) == ("terra/Mean", "high")
    assert fork["disclosure"].endswith("the file could as well be about aqua/Mean")
    many = resolve([(f"g{k}/no2_column_{k}", None, "1") for k in range(9)])  # all of them are named, not the first few
    assert many["disclosure"] is None or len(many["disclosure"].split("about ")[1].split(", ")) == 8
    weak = resolve([("no2_a",), ("no2_b",)])
    assert (weak["variable"], weak["resolution_confidence"]) == (None, "low")
    single = resolve([("no2_a",)])
    assert (single["variable"], single["resolution_confidence"]) == ("no2_a", "medium")
    sparse = resolve([("no2_a", None, "1", 0), ("no2_b", None, "1", 0)])
    assert (sparse["variable"], sparse["excluded_empty"]) == (None, 2)


def test_coverage_outranks_preference(spark):
    rows = [("terra/Mean", None, "1", 3), ("aqua/Mean", None, "1", 9)]
    assert [r["name"] for r in I.rank_variables(_inventory(spark, rows)).orderBy("rank").collect()] == ["aqua/Mean", "terra/Mean"]


def test_exact_uncertainty_spelling_wins(spark):
    inventory = I.classify_variables(_inventory(spark, [("col_precision",), ("col_uncertainty",), ("col",), ("cloud_pressure",)]))
    plotted = spark.createDataFrame([(1, "product/col", "product/flag")], "file_id int, plotted string, quality_flag_var string")
    got = I.related_variables(plotted, inventory).collect()[0]
    assert (got["variable"], got["qa_sibling"], got["uncertainty_sibling"], got["context_siblings"]) == ("col", "flag", "col_uncertainty", ["cloud_pressure"])


def test_merged_names(spark):
    rows = [("product/a",), ("support/a",), ("product/b",), ("b",), ("product/c",), ("lat",)]
    got = [(r["merged_name"], r["shadowed"]) for r in I.merge_group_variables(_inventory(spark, rows)).orderBy("ordinal").collect()]
    assert got == [("product/a", False), ("support/a", False), ("b", True), ("b", False), ("c", False), ("lat", False)]
