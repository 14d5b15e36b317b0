"""Columns of the canonical transaction table, and all thresholds.

``tx`` has one row for each transaction as seen from a subject wallet:
``wallet, stream (0 normal, 1 internal), ord, ts, src, dst, value, gas_price, gas_used, nonce, is_error, input, contract,
tx_hash``. ``value`` is in wei, DECIMAL(38,0); ``ts`` in Unix seconds. Ties on time are settled by (stream, ord).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

ORDER = ["ts", "stream", "ord"]

WEI = 10**18

# Four-byte selectors.
OWNERSHIP = ["0xf2fde38b", "0x13af4035", "0xa6f9dae1"]
REMOVE_LIQUIDITY = ["baa2abde", "02751cec", "af2979eb", "ded9382a"]
ADD_LIQUIDITY = ["f305d719", "e8e33700", "2f2d783d"]
TOKEN_TRANSFER = "a9059cbb"
SIGNIFICANT = ["0xa9059cbb", "0xbaa2abde", "0x02751cec", "0x7ff36ab5", "0x18cbafe5", "0x791ac947", "0xfb3bdb41"]

# Amounts in ETH that count as round.
ROUND_AMOUNTS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0]

# Categories of funding sources.
SOURCES = ["CEX", "MIXER", "BRIDGE", "DEX", "FRESH_WALLET", "KNOWN_EOA", "UNKNOWN_EOA"]

# Points by severity.
POINTS = {"CRITICAL": 40, "HIGH": 25, "MEDIUM": 10, "LOW": 5}


#: Other thresholds than in production, for a query that shows them at work.
STRICTER = {"RUG-002": {"high_funding_cv": 0.3, "medium_funding_cv": 0.5}, "RUG-004": {"high_deployment_count": 14, "medium_deployment_count": 12}, "RUG-VS-4": {"medium_outbound_dust_count": 1}, "RUG-POST-7": {"high_retained_ratio": 0.5}}


@dataclass(frozen=True)
class Config:
    """Thresholds. The defaults are those of production."""

    large_eth: float = 10.0
    burst_seconds: int = 300
    burst_count: int = 5
    fanout: int = 20
    dormant_days: float = 180.0
    bucket_days: float = 30.0
    bucket_factor: float = 3.0
    round_count: int = 3
    new_hours: float = 24.0
    new_eth: float = 0.1
    funding_hours: int = 72
    dry_run_hours: int = 6
    setup_hours: int = 24
    owner_hours: int = 48
    fresh_hours: float = 48.0
    min_edge_wei: int = 5 * 10**15
    selector_mode: str = "lstrip"
    dormancy_days: float = 30.0
    as_of: int = 1_735_689_600


DEFAULT = Config()


def eth(column):
    """Wei as ETH in double precision."""
    return F.col(column).cast("double") / F.lit(1e18) if isinstance(column, str) else column.cast("double") / F.lit(1e18)
