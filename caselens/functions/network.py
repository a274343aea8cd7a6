"""Address, port and URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselens.schema import blank_to_null

# Ports and URL marks that raise the severity.
RISKY_PORTS = [4444, 1337, 6667, 8080]
HIGH_RISK_URL = ["onion", "torproject"]
MEDIUM_RISK_URL = [".exe", ".zip", ".msi", ".ps1"]


def is_private_ip(col: Column) -> Column:
    """10/8, 127/8, 172.16/12, 192.168/16; a port suffix is tolerated."""
    parts = F.split(F.trim(F.split(col, ":")[0]), r"\.")
    a, b = F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")
    inside = (
        a.isin(10, 127)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
    )
    return F.coalesce((F.size(parts) == 4) & inside, F.lit(False))


def is_risky_port(col: Column) -> Column:
    return F.coalesce(col.isin(RISKY_PORTS), F.lit(False))


def direction(source_ip: Column) -> Column:
    return F.when(is_private_ip(source_ip), "outbound").otherwise("inbound")


def domain_of(url: Column, strip_mode: str = "prefix") -> Column:
    """Host of a URL in lower case without a leading ``www.``; NULL when there is none.

    ``strip_mode='charset'`` removes any leading run of ``w`` and ``.``.
    """
    full = F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(
        F.concat(F.lit("http://"), url)
    )
    host = F.lower(F.regexp_extract(full, r"^https?://(?:[^/?#]*@)?([^/?#:]*)", 1))
    pattern = r"^[w.]+" if strip_mode == "charset" else r"^www\."
    return blank_to_null(F.regexp_replace(host, pattern, ""))


def url_severity(url: Column) -> Column:
    low = F.lower(url)

    def any_of(words: list[str]) -> Column:
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        return test

    return F.when(any_of(HIGH_RISK_URL), "high").when(any_of(MEDIUM_RISK_URL), "medium").otherwise("info")
