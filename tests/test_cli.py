"""The command line builds the same leaderboard as the library call."""

import __spark_entry__ as E
from conftest import SF_SMALL
from patronage.__main__ import build_parser, main, run
from patronage.plans.leaderboards import holder_leaderboard
from patronage.sources.fixture import TEST_NOW, TEST_SNAPSHOT, fixture_contracts, fixture_tables


def test_cli_matches_library(spark):
    args = build_parser().parse_args(
        ["holders", "--fixture", SF_SMALL, "--addresses", ";".join(fixture_contracts()),
         "--snapshot", TEST_SNAPSHOT, "--now", TEST_NOW]
    )
    got = run(args, spark).collect()
    want = holder_leaderboard(fixture_tables(spark, SF_SMALL), E.fixture_params()).collect()
    assert got == want and len(got) == 10


def test_cli_brand_choice_runs(spark):
    args = build_parser().parse_args(["fees", "--fixture", SF_SMALL, "--brand", "Memeland", "--now", TEST_NOW])
    df = run(args, spark)
    assert df.columns[:2] == ["rank", "ens_or_wallet"]
    assert df.count() == 0  # the test data has no Memeland contracts


def test_main_runs_in_the_callers_session(spark, capsys):
    master = spark.sparkContext.master
    assert main(["fees", "--fixture", SF_SMALL, "--addresses", ";".join(fixture_contracts()), "--now", TEST_NOW]) == 0
    assert "# RANK" in capsys.readouterr().out
    assert spark.sparkContext.master == master
