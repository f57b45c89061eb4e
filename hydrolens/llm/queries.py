"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op7_decontaminate, op7_sql
from .filter_audit import op12_filter_audit, op12_sql
from .host_quality import op3_host_quality, op3_sql
from .language_id import op8_language_id
from .licences import op6_licences
from .mixing import op2_mixing
from .secret_scan import op11_secret_scan, op11_sql
from .sharding import op5_sharding
from .simhash import op10_simhash
from .suffix_dedup import op9_suffix_dedup
from .token_store import op1_token_store
from .url_lists import op4_sql, op4_url_lists
from .whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_mixing": op2_mixing,
    "op3_host_quality": op3_host_quality,
    "op4_url_lists": op4_url_lists,
    "op5_sharding": op5_sharding,
    "op6_licences": op6_licences,
    "op7_decontaminate": op7_decontaminate,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_simhash": op10_simhash,
    "op11_secret_scan": op11_secret_scan,
    "op12_filter_audit": op12_filter_audit,
    "op13_whitening": op13_whitening,
}

#: Where SQL can't express a query, tests hold it against brute force.
ORACLES: dict[str, Callable[[], str]] = {
    "op3_host_quality": op3_sql,
    "op4_url_lists": op4_sql,
    "op7_decontaminate": op7_sql,
    "op11_secret_scan": op11_sql,
    "op12_filter_audit": op12_sql,
}
