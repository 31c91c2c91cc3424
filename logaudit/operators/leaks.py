"""What still identifies someone in a text that is about to go out. It shares no code with redaction."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logaudit.functions.text import address_class, ipv4_number

# The shapes that count as an address, a mail or a path; they must be the same as those that are redacted.
QUAD = r"(?<![\w.-])((?:\d{1,3}\.){3}\d{1,3})(?![\w.-])"
DASHED = r"(?<![\w.-])((?:\d{1,3}-){3}\d{1,3})(?![\w-])"
COLONS = r"(?<![\w:.])((?=[0-9A-Fa-f.]*:)[0-9A-Fa-f:.]{3,45})(?![\w:.])"
MAIL = r"(?<![\w.-])([\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24})(?![\w.-])"
PATH = r"(?<![\w.@/-])((?:/[\w.@+-]+)+/?)"
# Paths that any such host has.
ALLOWED_PATHS = (
    "/etc/fail2ban", "/etc/dovecot", "/etc/postfix", "/etc/docker", "/etc/systemd", "/var/lib/fail2ban",
    "/var/lib/docker/containers", "/var/log", "/dev", "/usr", "/proc",
)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def find_leaks(text: Column, paths: tuple[str, ...] = ALLOWED_PATHS) -> Column:
    """The tokens of a text that identify a host or a person, by class and in order: dotted and dashed IPv4,
    IPv6, mail, paths off the list. Only colon-separated candidates are confirmed in Python."""

    @F.pandas_udf("array<string>")
    def confirmed(values: pd.Series) -> pd.Series:
        def good(x: str) -> bool:
            try:
                ipaddress.ip_address(x)
            except ValueError:
                return False
            return True

        return pd.Series([None if v is None else [x for x in v if good(x)] for v in values], dtype=object)

    colons = _all(text, COLONS)
    none = F.array().cast("array<string>")
    kept = F.filter(_all(text, PATH), lambda p: ~F.greatest(*[(p == a) | p.startswith(a + "/") for a in paths]))
    return F.concat(
        F.filter(_all(text, QUAD), lambda a: ipv4_number(a).isNotNull()),
        F.filter(_all(text, DASHED), lambda a: ipv4_number(F.translate(a, "-", ".")).isNotNull()),
        F.when(F.size(colons) > 0, confirmed(F.when(F.size(colons) > 0, colons))).otherwise(none),
        _all(text, MAIL),
        kept,
    )


def gate(rows: DataFrame, where: str) -> DataFrame:
    """The rows as they are, unless any holds a leak once serialised: then the job that writes them fails.

    The first column carries the check, so it isn't a filter that the optimizer would copy below the expressions
    that made the rows; a job that reads the other columns alone goes unchecked.
    """
    own = [F.col(f"`{c}`") for c in rows.columns]
    body = rows.withColumn("_body", F.to_json(F.struct(*own)))
    found = body.withColumn("_leaks", find_leaks(F.col("_body")))
    stop = F.raise_error(F.concat(F.lit(f"leak in {where}: "), F.array_join(F.transform("_leaks", lambda x: F.left(x, F.lit(3))), " ")))
    checked = F.when(F.size("_leaks") == 0, own[0]).otherwise(stop.cast(rows.schema[0].dataType)).alias(rows.columns[0])
    return found.select(checked, *own[1:])


def routable(text: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Globally routable IPv4 addresses of a text that aren't on a list."""
    return F.filter(_all(text, QUAD), lambda a: (address_class(a) == "global") & ~a.isin(*allowed))
