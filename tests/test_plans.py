"""Plan shape: filters reach the Parquet scan, top-k is one ordered limit,
no nested-loop or cartesian join, current owner is an aggregate."""

import re

import pytest

import __spark_entry__ as E
from conftest import CORE_KEYS, SF_SMALL, contract, wallet
from test_edges import _sale, _transfer
from patronage.plans.leaderboards import fee_leaderboard, holder_leaderboard, holding_period_leaderboard
from patronage.plans.params import Params
from patronage.sources.tables import load_tables
from patronage import operators as ops
from patronage.operators import names

C1, C2 = contract("a"), contract("b")


def plan_of(df) -> str:
    """The plan as text; a subquery that is named in several places (and runs once)
    is written out in the first only."""
    seen, kept, skipping = set(), [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if skipping is not None and depth > skipping:
            continue
        skipping = None
        named = re.match(r"[ :+-]*Subquery (subquery#\d+)", line)
        if named and named[1] in seen:
            skipping = depth
        elif named:
            seen.add(named[1])
        kept.append(line)
    return "\n".join(kept)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from conftest import NAMES_SCHEMA, SALES_SCHEMA, TOKEN_PRICES_SCHEMA, TRANSFERS_SCHEMA, ts

    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    root = tmp_path_factory.mktemp("tables")
    transfers = [_transfer(C1, i, "2024-01-10 01:00:00", wallet(0), wallet(5 + i), i) for i in range(5)]
    sales = [_sale(wallet(5), C1, "2024-01-10 01:00:00", 1, "APE", contract("d"), 1.0, 2.0, 0.1, 0.2)]
    prices = [(ts("2024-01-10 01:00:00"), contract("d"), "APE", 2.0)]
    names = [(wallet(5), "alice", "Y")]
    paths = {}
    for name, rows, schema in [
        ("transfers", transfers, TRANSFERS_SCHEMA),
        ("sales", sales, SALES_SCHEMA),
        ("token_prices", prices, TOKEN_PRICES_SCHEMA),
        ("names", names, NAMES_SCHEMA),
    ]:
        path = str(root / name)
        spark.createDataFrame(rows, schema).write.parquet(path)
        paths[name] = path
    return load_tables(spark, paths)


PARAMS = Params(addresses=f"{C1};{C2}", snapshot_time="2024-01-25 00:00:00", now="2024-02-01 10:30:00")


def test_filters_pushed_to_scans(stored):
    plan = plan_of(holder_leaderboard(stored, PARAMS))
    assert "PushedFilters: [IsNotNull(block_timestamp), LessThanOrEqual(block_timestamp,2024-01-25T00:00)" in plan
    assert "In(nft_address, [" in plan
    assert "IsNull(erc1155_value)" in plan
    assert "GreaterThan(price_usd,0.0)" in plan
    assert "LessThanOrEqual(hour,2024-01-25T00:00)" in plan
    assert "EqualTo(ens_set,Y)" in plan


def test_scans_read_only_needed_columns(stored):
    plan = plan_of(holder_leaderboard(stored, PARAMS))
    transfer_scans = [l for l in plan.splitlines() if "ReadSchema" in l and "tokenid" in l]
    assert transfer_scans
    for line in transfer_scans:
        schema = line.split("ReadSchema: ")[1]
        assert "nft_from_address" not in schema  # owner needs no sender


@pytest.mark.parametrize("fn", [fee_leaderboard, holder_leaderboard, holding_period_leaderboard])
def test_topk_is_one_ordered_limit(stored, fn):
    plan = plan_of(fn(stored, PARAMS))
    # one over the wallets, one over the few named rows of the page
    assert plan.count("TakeOrderedAndProject(limit=10") == 2


def test_current_owner_is_an_aggregate(stored):
    ct = ops.contract_transfers(stored.transfers, PARAMS.addresses, PARAMS.snapshot())
    plan = plan_of(ops.current_owner(ct))
    assert "max(" in plan or "max_by" in plan
    assert "Window" not in plan


@pytest.mark.parametrize("name", CORE_KEYS)
def test_no_pairwise_joins(spark, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct"):
        assert bad not in plan, name


def test_days_held_windows_are_per_wallet(stored):
    ct = ops.contract_transfers(stored.transfers, PARAMS.addresses, PARAMS.snapshot())
    plan = plan_of(ops.days_held(ct, PARAMS.snapshot()))
    windows = [l for l in plan.splitlines() if l.strip().startswith("+- Window") or l.strip().startswith("Window")]
    assert windows
    for line in windows:
        assert "windowspecdefinition(wallet" in line


@pytest.fixture
def no_automatic_broadcasts(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    held = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def _values(stored, **limits):
    return ops.sale_eth_values(stored.sales, stored.token_prices, PARAMS.addresses, PARAMS.snapshot(), **limits)


@pytest.mark.parametrize("limits", [{}, {"small_bytes": 0}])
def test_sales_are_priced_where_they_lie(stored, no_automatic_broadcasts, limits):
    """Small prices, by Spark's estimate or by the count of their hours, are broadcast
    whatever the session's thresholds: one scan each, no exchange of sales."""
    plan = plan_of(_values(stored, **limits))
    assert _scans_per_table(plan) == {"sales": 1, "token_prices": 1}
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(span" in plan  # the prices, once
    assert "BroadcastHashJoin [_currency" in plan and "SortMergeJoin" not in plan


def test_sales_beyond_the_limit_are_dealt_by_currency(stored, no_automatic_broadcasts):
    """Then the sales that need no price are spread and no null key gathers rows."""
    df = _values(stored, small_bytes=0, broadcast_cells=0)
    plan = plan_of(df)
    assert _scans_per_table(plan) == {"sales": 1, "token_prices": 1}
    assert "SortMergeJoin [_currency" in plan and "no currency" in plan
    assert [r["price_eth"] for r in df.collect()] == [r["price_eth"] for r in _values(stored).collect()]


BOARDS = [fee_leaderboard, holder_leaderboard, holding_period_leaderboard]


@pytest.mark.parametrize("fn", BOARDS)
@pytest.mark.parametrize("kind", ["text", "list", "catalog", "few", "broadcast", "shuffle"])
def test_no_contract_lands_in_one_task(spark, stored, monkeypatch, fn, kind):
    """However the contracts are given: no exchange deals transfers or sales by
    contract, and names and short tables reach the scan as a literal list."""
    from patronage.operators import contracts
    from patronage.sources.catalog import COLLECTIONS, choose_addresses

    some = spark.createDataFrame([(C1,), (C2,)], "address string")
    if kind == "broadcast":
        monkeypatch.setattr(contracts.in_contracts, "__defaults__", (None, 1, contracts.BROADCAST_ADDRESSES))
    if kind == "shuffle":
        monkeypatch.setattr(contracts.in_contracts, "__defaults__", (None, 1, 1))
    addresses = {
        "text": f"{C1};{C2}",
        "list": [C1, C2],
        "catalog": choose_addresses(brands=[b for b, _, _ in COLLECTIONS]),
    }.get(kind, some)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if kind == "shuffle":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        params = Params(addresses=addresses, snapshot_time=PARAMS.snapshot_time, now=PARAMS.now)
        plan = plan_of(fn(stored, params))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "hashpartitioning(nft_" not in plan
    if kind in ("text", "list", "catalog", "few"):
        assert "In(nft_address, [" in plan
    if kind == "catalog":
        assert len(addresses) == 19
    if fn is not fee_leaderboard:
        assert "hashpartitioning(token_id" in plan


def test_nineteen_contracts_are_pushed_as_a_list(spark):
    assert int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")) >= 19


def test_day_folders_are_skipped(spark, stored, tmp_path):
    from pyspark.sql import functions as F

    from patronage.sources.tables import conform

    path = str(tmp_path / "by_day")
    stored.transfers.withColumn("on_day", F.col("block_timestamp").cast("date")).write.partitionBy("on_day").parquet(path)
    transfers = conform(spark.read.parquet(path), "transfers", keep=["on_day"])
    ct = ops.contract_transfers(transfers, PARAMS.addresses, PARAMS.snapshot(), day_column="on_day")
    check = ops.check_snapshot(transfers, PARAMS.snapshot(), PARAMS.now, day_column="on_day")
    for df in (ct, check):
        assert "PartitionFilters: [isnotnull(on_day" in plan_of(df)
    assert ct.count() == 5


def _scans_per_table(plan: str) -> dict:
    import re

    counts = {}
    for m in re.finditer(r"FileScan parquet .*?Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*/(\w+)\]", plan):
        counts[m.group(1)] = counts.get(m.group(1), 0) + 1
    return counts


@pytest.mark.parametrize(
    "fn,expected",
    [
        (fee_leaderboard, {"sales": 1, "token_prices": 1, "names": 1}),
        (holder_leaderboard, {"transfers": 1, "sales": 1, "token_prices": 1, "names": 1}),
        # transfers once more for days held
        (holding_period_leaderboard, {"transfers": 2, "sales": 1, "token_prices": 1, "names": 1}),
    ],
)
def test_no_subtree_computed_twice(stored, fn, expected):
    assert _scans_per_table(plan_of(fn(stored, PARAMS))) == expected


def test_holder_plans_hold_no_sets(stored):
    """Lists are made of the hours of a price span and of the rows of the page alone."""
    plan = plan_of(holder_leaderboard(stored, PARAMS))
    lists = [line for line in plan.splitlines() if "ObjectHashAggregate" in line or "collect_" in line]
    assert lists and all("token_address" in line or "keys=[], functions=[" in line or "_cells" in line for line in lists)
    assert "collect_set" not in plan


@pytest.mark.parametrize("fn", BOARDS)
@pytest.mark.parametrize("options", [{}, {"smallest_name": True}, {"validate": False}])
def test_small_names_are_broadcast(stored, no_automatic_broadcasts, fn, options):
    params = Params(addresses=PARAMS.addresses, snapshot_time=PARAMS.snapshot_time, now=PARAMS.now, **options)
    plan = plan_of(fn(stored, params))
    assert "BroadcastHashJoin [wallet" in plan and "SortMergeJoin [_owner" not in plan
    if "smallest_name" not in options:
        assert not re.search(r"Exchange hashpartitioning\((owner|ens_name)", plan)
    assert _scans_per_table(plan)["names"] == 1 and plan.count("TakeOrderedAndProject(limit=10") == 2


@pytest.mark.parametrize("fn", BOARDS)
@pytest.mark.parametrize("options", [{}, {"smallest_name": True}, {"validate": False}])
def test_names_stay_where_they_are(stored, no_automatic_broadcasts, monkeypatch, fn, options):
    """With all automatic broadcasts off: the names are read once and joined with the
    broadcast page before anything is dealt; what is dealt are the page's names."""
    monkeypatch.setattr(names, "SMALL_BYTES", -1)
    params = Params(addresses=PARAMS.addresses, snapshot_time=PARAMS.snapshot_time, now=PARAMS.now, **options)
    plan = plan_of(fn(stored, params))
    lines = plan.splitlines()
    scan = next(k for k, line in enumerate(lines) if "FileScan parquet [owner" in line)
    above = lines[: scan + 1][::-1]
    depth = len(above[0])
    path = []  # from the scan up to the root
    for line in above:
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            depth = indent
            path.append(line.lstrip(" :+-"))
    steps = [x.split(" ")[0] for x in path if re.match("Exchange|BroadcastHashJoin|SortMergeJoin|BroadcastExchange", x)]
    assert steps[0] == "BroadcastHashJoin", steps
    assert "SortMergeJoin [wallet" not in "\n".join(path) and "BroadcastExchange" in steps
    assert _scans_per_table(plan)["names"] == 1 and plan.count("TakeOrderedAndProject(limit=10") == 2


@pytest.mark.parametrize("fn", BOARDS)
def test_leaderboards_skip_day_folders(spark, stored, tmp_path, fn):
    from pyspark.sql import functions as F

    paths = {}
    for name, time in (("transfers", "block_timestamp"), ("sales", "block_timestamp"), ("token_prices", "hour"), ("names", None)):
        table = getattr(stored, name)
        paths[name] = str(tmp_path / name)
        if time is None:
            table.write.parquet(paths[name])
            continue
        late = table.withColumn(time, F.col(time) + F.expr("INTERVAL 60 DAYS"))
        late = late.withColumns({c: late[c] for c in table.columns})
        days = table.union(late.select(table.columns)).withColumn("on_day", F.col(time).cast("date"))
        days.write.partitionBy("on_day").parquet(paths[name])
    tables = load_tables(spark, paths, keep=["on_day"])
    want = fn(stored, PARAMS).collect()
    for column in (None, "on_day"):
        params = Params(addresses=PARAMS.addresses, snapshot_time=PARAMS.snapshot_time, now=PARAMS.now, day_column=column)
        df = fn(tables, params)
        assert df.collect() == want
        scans = [x for x in plan_of(df).splitlines() if "FileScan parquet" in x and "nft_" in x or "token_address" in x and "FileScan" in x]
        assert scans
        for scan in scans:
            assert ("PartitionFilters: [isnotnull(on_day" in scan) == (column is not None)
