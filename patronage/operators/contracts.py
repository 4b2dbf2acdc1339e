"""Restricting a table to the chosen contracts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.addresses import parse_contract_list, valid_addresses

Contracts = str | Iterable[str] | DataFrame

#: A DataFrame of at most this many addresses becomes a literal list (about 60 KB).
LITERAL_ADDRESSES = 1_000
#: One of at most this many is broadcast (about 60 MB).
BROADCAST_ADDRESSES = 1_000_000
#: Words of 64 bits in the Bloom filter of a longer one, at most, and addresses a word
#: below that: 64 MB, and about 1 of 60 other rows let through.
BLOOM_WORDS, BLOOM_ADDRESSES_A_WORD = 4_000_000, 4


def in_contracts(
    df: DataFrame,
    column: str,
    contracts: Contracts,
    also: Column | None = None,
    literal: int = LITERAL_ADDRESSES,
    broadcast: int = BROADCAST_ADDRESSES,
) -> DataFrame:
    """Rows of ``df`` whose ``column`` is one of the chosen contracts (and that
    satisfy ``also``, applied in the same filter).

    A string or list is parsed on the spot and becomes a literal IN list, which
    the Parquet reader uses to skip row groups. A DataFrame (first column holds
    the addresses) is validated with the same rule and counted first, up to the
    limits: few addresses become a literal list, more are broadcast, and beyond
    that the rows are joined by shuffle, after a Bloom filter of the addresses has
    taken out nearly all rows of other contracts (``maybe_in``). The shuffle key is a
    struct around the address, so the rows do not count as dealt by contract
    afterwards: a later aggregate by token deals them anew instead of leaving one
    contract to one task.
    """
    if not isinstance(contracts, DataFrame):
        cond = F.col(column).isin(parse_contract_list(contracts))
        return df.filter(cond if also is None else also & cond)
    kept = df.filter(also) if also is not None else df
    first = contracts.columns[0]
    wanted = contracts.select(F.explode(valid_addresses(F.col(first).cast("string"))).alias("_address")).distinct()
    n = wanted.limit(broadcast + 1).count()
    if n <= literal:
        return kept.filter(F.col(column).isin([r[0] for r in wanted.limit(literal).collect()]))
    key = wanted.select(F.struct("_address").alias("_wanted"))
    same = F.struct(F.col(column).alias("_address")) == F.col("_wanted")
    if n <= broadcast:
        return kept.join(F.broadcast(key), same, "left_semi")
    # the addresses are distinct; Spark would move a semi join below the filter's join
    return maybe_in(kept, column, wanted, wanted.count()).join(key, same).select(*df.columns)


def _word_and_bits(address: Column, words: int) -> tuple[Column, Column]:
    """The word of the filter that an address falls on, and its four bits there."""
    place = F.xxhash64(F.lit(1), address)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(place, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.xxhash64(address), F.lit(words)), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def maybe_in(df: DataFrame, column: str, wanted: DataFrame, n: int, most_words: int = BLOOM_WORDS) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be one of the ``n`` addresses of ``wanted``
    (its first column): all that are, and few others. Null is none of them.

    A blocked Bloom filter: an address sets four bits in one word of 64, the words are
    combined by a bitwise or (map-side first), and rows look their word up in
    the broadcast words. These are at most ``most_words`` whatever ``n`` is; with more
    addresses than they are made for, more other rows pass.
    """
    words = max(1, min(most_words, -(-n // BLOOM_ADDRESSES_A_WORD)))
    word, bits = _word_and_bits(F.col(wanted.columns[0]), words)
    bloom = wanted.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_held"))
    word, bits = _word_and_bits(F.col(column), words)
    found = df.filter(F.col(column).isNotNull()).withColumns({"_word": word, "_bits": bits}).join(F.broadcast(bloom), "_word")
    return found.filter(F.col("_held").bitwiseAND(F.col("_bits")) == F.col("_bits")).select(*df.columns)
