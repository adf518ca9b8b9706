"""Column functions over the fields of a flow record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The log format.
FIELDS = [
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p",
    "proto", "service", "duration", "orig_bytes", "resp_bytes",
    "conn_state", "local_orig", "local_resp", "missed_bytes", "history",
    "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
    "tunnel_parents   label   detailed-label",
]
HEADER = ",".join(FIELDS)
COMMON_PORTS = ["21", "22", "23", "53", "80", "123", "443", "1883", "6667", "8080", "8883"]
OTHER_PORT, UNKNOWN = "__OTHER_PORT__", "__UNKNOWN__"
BENIGN, MALICIOUS = ["benign", "Benign"], ["malicious", "Malicious"]
BASE_NUMERICS = ["duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes"]
FLAGS = {"h_syn": "[Ss]", "h_synack": "[Hh]", "h_ack": "[Aa]", "h_data": "[Dd]", "h_fin": "[Ff]", "h_rst": "[Rr]"}
WINDOW_STATS = ["win_flow_count", "win_unique_resp_p", "win_unique_resp_h", "win_same_port_ratio"]
CATEGORIES = ["proto", "service", "conn_state"]

#: Feature sets: (numerics, categoricals).
REPRESENTATIONS = {
    "baseline": (BASE_NUMERICS, CATEGORIES),
    "light": ([*BASE_NUMERICS, "missed_bytes"], [*CATEGORIES, "id.resp_p"]),
    "behavioral": ([*BASE_NUMERICS, "missed_bytes", *FLAGS, *WINDOW_STATS], [*CATEGORIES, "id.resp_p"]),
}

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def number(c: Column) -> Column:
    """The double that a text spells, or null; suffixes such as 1d or 1f aren't numbers."""
    text = stripped(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def measure(c: Column, log: bool = True) -> Column:
    """A finite number of at least zero, as its log1p if ``log``; otherwise null."""
    x = number(c)
    valid = F.when((x >= 0) & (x < float("inf")), x)
    return F.log1p(valid) if log else valid


def label_parts(c: Column) -> Column:
    """The three parts of the combined label (tunnel, label, detail); null unless there are three."""
    found = F.split(stripped(c), r"\s+", 3)
    return F.when(F.size(found) == 3, found)


def binary_label(c: Column) -> Column:
    """0 benign, 1 malicious, null for any other spelling."""
    return binary_of(label_parts(c))


def binary_of(parts: Column) -> Column:
    """The same of the parts of a label."""
    label = F.get(parts, 1)
    return F.when(label.isin(BENIGN), F.lit(0)).when(label.isin(MALICIOUS), F.lit(1)).cast("byte")


def port_bucket(c: Column) -> Column:
    """A well-known port as it is, any other as one class."""
    port = stripped(c)
    return F.when(port.isin(COMMON_PORTS), port).otherwise(F.lit(OTHER_PORT))


def flag_counts(history: Column) -> dict[str, Column]:
    """How often each connection event occurs in a history, in either case."""
    return {name: F.regexp_count(history, F.lit(letters)).cast("double") for name, letters in FLAGS.items()}


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole isn't positive."""
    return F.when(whole > 0, part.cast("double") / F.when(whole > 0, whole)).otherwise(F.lit(0.0))
