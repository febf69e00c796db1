"""A sample of catalogue queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sieveline.plans import catalog

FOLDER = "/root/testdata/sf0.001"
NAMES = ["flagship", "QN05_chi_squared", "QU13_t_test", "QC05_correlation_distance", "QR01_ssd_complement", "QB04_absolute_risk", "QK07_lr_covariance", "RF05_bins", "RF07_best_interval", "RF04_best_value_set", "SR06_breadth_first", "WN08_subranking_loss", "AG15_base_intervals", "PP05_grouping", "VA09_folds", "VA09_results_by_fold", "SR10_per_target_value", "QM04_kullback_leibler_2d_rounded", "AG28_quantiles_of_prices",
         "AG20_bdeu", "QS01_subranking_loss", "QO04_abs_wmw_ranks", "QU16_squared_hellinger", "QN20_bayesian_score", "QN21_prop_score_wracc", "QC06_correlation_p", "QR05_cooks_distance", "SR02_roc_beam", "TK03_bounded_beam",
         "PP01_minimum_improvement", "PP04_pattern_team", "PP06_roc_hull", "PP09_threshold_areas", "VA05_result_p_values", "IO05_fields", "IO16_knowledge", "WN07_score_order", "ST01_windowed_qualities"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    own = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(own.columns)
    theirs = con.execute(catalog.ORACLE_SQL[name]).df()[columns]
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.itertuples(index=False, name=None))
    assert rows(own.toPandas()[columns]) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def ties(spark, tmp_path_factory):
    """A line table where two line numbers agree in quality to six digits only: the one of 303 rows is below the one of 300 by 2.5e-7."""
    rows = []
    for line, n, hits in [(1, 300, 120), (2, 303, 121), (3, 700, 220), (4, 697, 206)]:
        rows += [("R" if i < hits else "A", "F" if i % 11 < 1 else "O", line, 0.06 if i % 3 else 0.01) for i in range(n)]
    folder = str(tmp_path_factory.mktemp("ties"))
    df = spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_linenumber int, l_tax double")
    df.coalesce(1).toPandas().to_parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["TK01_bounded_results", "TK02_admission", "TK04_result_order", "TK09_delete_results", "SR04_best_first"])
def test_ranks_are_those_of_rounded_qualities(spark, ties, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{ties}/lineitem.parquet'")
    own = catalog.QUERIES[name](spark, ties)
    rows = lambda x: sorted(map(repr, x))
    assert rows(map(tuple, own.collect())) == rows(con.execute(catalog.ORACLE_SQL[name]).fetchall())


def test_gates_are_those_of_the_sql_on_larger_tables(spark, tmp_path):
    """120,000 rows: 0.4 of them are more than the SQL's 24,000."""
    rows = spark.range(120_000).selectExpr("if(id % 7 < 3, 'R', 'A') as l_returnflag", "if(id % 5 = 0 or id % 7 = 1, 'F', 'O') as l_linestatus", "int(id % 4 + if(id % 21 = 0, 1, 0)) as l_linenumber", "if(id % 11 < 4, 0.06, 0.01) as l_tax")
    rows.toPandas().to_parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    own = catalog.QUERIES["RF11_gates"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, own))) == sorted(map(repr, con.execute(catalog.ORACLE_SQL["RF11_gates"]).fetchall()))
    assert catalog.QUERIES["RF03_nominal_equals"](spark, str(tmp_path)).where("coverage > 24000 and coverage <= 48000 and quality > 0").count()
