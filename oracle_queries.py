"""DuckDB SQL for the registered queries over the driver's tables.

Written from the meaning of each step, with computations of its own rather than
those of the Spark code: owners by ``arg_max``, balances from one list of signed
moves, days held from the intervals between a wallet's changes, ETH values from
a rate per hour and currency. Doubles are rounded to 6 places on both sides;
ties are broken by wallet, then name.
"""

from __future__ import annotations

CHOSEN = ["0x" + "a" * 40, "0x" + "b" * 40]
SNAPSHOT = "2024-01-25 00:00:00"
NOW = "2024-02-01 10:30:00"
PAGE = 10
BURNT = ["0x" + "0" * 36 + "dead", "0x" + "0" * 40, "0x" + "0" * 39 + "1"]


def _texts(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# The four tables from events and customer (the mapping of the test data).
STEPS: dict[str, str] = {
    "kinds": """SELECT * FROM (VALUES ('view', 'a', 'WETH'), ('purchase', 'b', 'b'), ('click', 'c', 'c'),
        ('error', 'd', 'APE'), ('signup', 'e', 'e')) AS k(event_type, letter, symbol)""",
    "happened": """SELECT e.event_id AS n, e.ts, e.value, '0x' || lpad(e.user_id::VARCHAR, 40, '0') AS who,
        '0x' || repeat(k.letter, 40) AS contract, k.symbol, regexp_extract(e.props, '[0-9]+') AS token
        FROM events e LEFT JOIN kinds k USING (event_type)""",
    "names": """SELECT '0x' || lpad(c_custkey::VARCHAR, 40, '0') AS owner, c_name || '.eth' AS shown
        FROM customer WHERE c_acctbal > 2000""",
    "until": f"""SELECT least(date_trunc('day', TIMESTAMP '{SNAPSHOT}'), date_trunc('day', TIMESTAMP '{NOW}')) AS cutoff""",
    # single transfers, the sender being whoever had the token before
    "single": f"""SELECT contract, token, ts, n, who AS taker,
        coalesce(lag(who) OVER (PARTITION BY contract, token ORDER BY n), '0x' || repeat('0', 40)) AS giver
        FROM happened WHERE n % 10 <> 0""",
    "moved": f"""SELECT s.* FROM single s, until WHERE ts <= cutoff AND contract IN {_texts(CHOSEN)}""",
    "batches": f"""SELECT h.contract, h.token, h.who AS taker, h.n % 7 + 1 AS amount
        FROM happened h, until WHERE n % 10 = 0 AND ts <= cutoff AND contract IN {_texts(CHOSEN)}""",
    "owners": """SELECT contract, token, arg_max(taker, n) AS wallet FROM moved GROUP BY ALL""",
    "balances": """SELECT m.wallet, contract, token, sum(m.d)::BIGINT AS num_held FROM (
            SELECT contract, token, unnest([{'wallet': taker, 'd': amount},
                                            {'wallet': '0x' || repeat('0', 40), 'd': -amount}]) AS m FROM batches)
        GROUP BY ALL HAVING sum(m.d) > 0""",
    "held": f"""SELECT wallet, count(DISTINCT contract) AS num_collections, count(*) AS num_held
        FROM owners WHERE wallet NOT IN {_texts(BURNT)} GROUP BY wallet""",
    "changes": """SELECT m.wallet, date_trunc('day', ts)::TIMESTAMP AS day, sum(m.d)::BIGINT AS net FROM (
            SELECT ts, unnest([{'wallet': taker, 'd': 1}, {'wallet': giver, 'd': -1}]) AS m FROM moved)
        GROUP BY ALL""",
    "first_got": """SELECT taker AS wallet, min(ts) AS time_first_acquisition FROM moved GROUP BY taker""",
    # each change stands for the days up to the next one, the last up to the snapshot's day
    "stretches": """SELECT wallet, sum(net) OVER w AS balance,
        date_diff('day', day, coalesce(lead(day) OVER w, (SELECT cutoff + INTERVAL 1 DAY FROM until))) AS days
        FROM changes WINDOW w AS (PARTITION BY wallet ORDER BY day)""",
    "stayed": """SELECT wallet, sum(days)::BIGINT AS days_held FROM stretches WHERE balance > 0
        GROUP BY wallet HAVING sum(days) > 0""",
    # ETH per unit of a currency in an hour: its average price over that of WETH
    "hourly": """SELECT date_trunc('hour', ts) AS hour, contract AS currency, symbol, avg(value) AS price
        FROM happened GROUP BY ALL""",
    "rates": """SELECT hour, currency, price / nullif(max(price) FILTER (symbol = 'WETH') OVER (PARTITION BY hour), 0) AS rate
        FROM hourly""",
    "offers": f"""SELECT who AS wallet, n // 2 AS tx_hash, ts, value AS price, value * 2 AS price_usd,
        CASE WHEN n % 9 <> 0 THEN value * 0.05 END AS fee, CASE WHEN n % 9 <> 0 THEN value * 0.1 END AS fee_usd,
        (['ETH', 'WETH', 'APE', NULL])[n % 4 + 1] AS symbol,
        CASE n % 4 WHEN 2 THEN '0x' || repeat('d', 40) END AS currency
        FROM happened, until
        WHERE ts <= cutoff AND contract IN {_texts(CHOSEN)} AND n % 13 <> 0 AND value > 0 AND (n % 9 = 0 OR n % 17 <> 0)""",
    "valued": """SELECT o.*, CASE WHEN symbol IN ('ETH', 'WETH') THEN 1.0 ELSE r.rate END AS in_eth
        FROM offers o LEFT JOIN rates r ON r.currency = o.currency AND r.hour = date_trunc('hour', o.ts)""",
    "sellers": """SELECT wallet, sum(price * in_eth) AS vol_eth, sum(fee * in_eth) AS creator_fee_eth,
        sum(price_usd) AS vol_usd, sum(fee_usd) AS creator_fee_usd, count(DISTINCT tx_hash) AS num_txns
        FROM valued GROUP BY wallet""",
    "holders": """SELECT h.wallet, coalesce(shown, h.wallet) AS ens_or_wallet, num_held, num_collections,
        creator_fee_usd, creator_fee_eth, creator_fee_usd / vol_usd AS creator_fee_perc, days_held
        FROM held h LEFT JOIN sellers USING (wallet) LEFT JOIN stayed USING (wallet)
        LEFT JOIN names ON owner = h.wallet""",
    "payers": """SELECT wallet, coalesce(shown, wallet) AS ens_or_wallet, coalesce(creator_fee_usd, 0) AS creator_fee_usd,
        creator_fee_eth, coalesce(creator_fee_usd / nullif(vol_usd, 0), 0) AS creator_fee_perc
        FROM sellers LEFT JOIN names ON owner = wallet""",
}


def _sql(body: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in STEPS.items()) + "\n" + body


def _rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _page(rows: str, order: str, columns: str) -> str:
    return _sql(
        f"""SELECT rank, ens_or_wallet, {columns} FROM (
        SELECT *, row_number() OVER (ORDER BY {order}, wallet, ens_or_wallet) AS rank FROM {rows})
        WHERE rank <= {PAGE} ORDER BY rank"""
    )


_FEES = _rounded("creator_fee_usd", "creator_fee_eth", "creator_fee_perc")
_SUMS = _rounded("vol_eth", "creator_fee_eth", "vol_usd", "creator_fee_usd")
_BY_HOLDING = "num_held DESC, num_collections DESC, creator_fee_usd DESC NULLS FIRST"
_MOVED = "contract AS nft_contract_address, token AS token_id"

QUERIES: dict[str, str] = {
    "fee_leaderboard": _page("payers", "creator_fee_usd DESC", _FEES),
    "holder_leaderboard": _page("holders", _BY_HOLDING, "num_held, num_collections, " + _FEES),
    "holding_period_leaderboard": _page(
        "holders", "days_held DESC NULLS LAST, " + _BY_HOLDING, "days_held, num_held, num_collections, " + _FEES
    ),
    "sales_by_seller": _sql(f"SELECT wallet, {_SUMS}, true AS num_txns_close FROM sellers"),
    "sales_by_seller_exact": _sql(f"SELECT wallet, {_SUMS}, num_txns FROM sellers"),
    "sales_by_seller_merged": _sql(f"SELECT wallet, {_SUMS}, true AS num_txns_close FROM sellers"),
    "sales_of_contract_table": _sql(
        f"SELECT contract AS nft_address, count(*) AS num_sales FROM happened WHERE contract IN {_texts(CHOSEN)} GROUP BY contract"
    ),
    "eth_value": _sql(
        f"""SELECT wallet, tx_hash, ts AS block_timestamp, symbol AS currency_symbol, {_rounded('price', 'price_usd')},
        round(price * in_eth, 6) AS price_eth, round(fee * in_eth, 6) AS creator_fee_eth FROM valued"""
    ),
    "unpriced_sales": _sql(
        """SELECT symbol AS currency_symbol, count(*) AS num_sales, count(*) FILTER (in_eth IS NULL) AS num_unpriced
        FROM valued GROUP BY symbol"""
    ),
    "nft_transfers": _sql(
        f"""SELECT {_MOVED}, ts AS block_time, date_trunc('day', ts)::TIMESTAMP AS day, giver AS from_address,
        taker AS to_address, 1::BIGINT AS amount, false AS is_erc1155, n AS block_number, 0 AS event_index,
        count(*) OVER (PARTITION BY contract, token ORDER BY n DESC) AS rank_desc FROM moved"""
    ),
    "transfer_rank_asc": _sql(
        f"SELECT {_MOVED}, n AS block_number, count(*) OVER (PARTITION BY contract, token ORDER BY n) AS rank_asc FROM moved"
    ),
    "transfer_ranks": _sql(
        f"""SELECT {_MOVED}, n AS block_number, count(*) OVER (PARTITION BY contract, token ORDER BY n DESC) AS rank_desc,
        count(*) OVER (PARTITION BY contract, token ORDER BY n) AS rank_asc FROM moved"""
    ),
    "erc721_holdings": _sql(f"SELECT wallet, {_MOVED}, 1::BIGINT AS num_held FROM owners"),
    "erc1155_holdings": _sql(f"SELECT wallet, {_MOVED}, num_held FROM balances"),
    "all_holdings_both": _sql(
        f"""SELECT wallet, {_MOVED}, num_held FROM balances
        UNION ALL SELECT wallet, {_MOVED}, 1 FROM owners"""
    ),
    "all_holdings_kept_up": _sql(
        f"""SELECT wallet, {_MOVED}, num_held FROM balances
        UNION ALL SELECT wallet, {_MOVED}, 1 FROM owners"""
    ),
    "current_holders": _sql("SELECT wallet, num_collections, num_held FROM held"),
    "first_acquisition": _sql("SELECT * FROM first_got"),
    "calendar": _sql(
        """SELECT unnest(generate_series((SELECT date_trunc('day', min(ts))::TIMESTAMP FROM moved),
                                         (SELECT cutoff::TIMESTAMP FROM until), INTERVAL 1 DAY)) AS time"""
    ),
    "daily_change": _sql("SELECT day AS time, wallet, net AS daily_change FROM changes"),
    "days_held": _sql("SELECT wallet, days_held, time_first_acquisition FROM stayed JOIN first_got USING (wallet)"),
    "days_held_kept_up": _sql("SELECT wallet, days_held, time_first_acquisition FROM stayed JOIN first_got USING (wallet)"),
    "snapshot_check": """SELECT t.name AS "case", CASE WHEN (SELECT max(ts) FROM events e
            WHERE e.ts > t.clock - INTERVAL 1 DAY) < t.planned THEN t.planned - INTERVAL 1 DAY ELSE t.planned END AS actual_snapshot_time
        FROM (VALUES ('back', TIMESTAMP '2024-01-31', TIMESTAMP '2024-01-31 00:10:00'),
                     ('kept', TIMESTAMP '2024-01-25', TIMESTAMP '2024-01-30 12:00:00')) AS t(name, planned, clock)""",
    "resolve_names": _sql(
        "SELECT wallet, coalesce(shown, wallet) AS ens_or_wallet FROM held LEFT JOIN names ON owner = wallet"
    ),
}
