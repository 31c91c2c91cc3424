"""Column functions over log text. Java regular expressions; ``(?U)`` where Unicode classes are meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line shapes of the watched daemons.
SMTP_AUTH = r"(?i)postfix/([\w.-]+(?:/[\w.-]+)*)\[\d+\]: warning: [^\[]*\[([^\]]+)\](?::\d+)?: SASL ([A-Za-z0-9-]+) authentication failed"
SMTP_USER = r"sasl_username=([^,\s]+)"
RELAY = r"(?i)postfix/([\w.-]+(?:/[\w.-]+)*)\[\d+\]: NOQUEUE: reject: RCPT from [^\[]*\[([^\]]+)\](?::\d+)?: (\d{3} \d\.\d\.\d).*Relay access denied"
SENT = r"\bstatus=sent\b"
BOX_FAILED = r"(?i)(pop3|imap|managesieve|submission)-login: .*?auth failed, (\d+) attempts.*?\brip=([^,\s]+)"
BOX_USER = r"user=<([^>]*)>"
BOX_LOGIN = r"(?i)(pop3|imap|managesieve|submission)-login: Info: Login: user=<([^>]*)>.*?\brip=([^,\s]+)"
STAMPED = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z) (.*)$"
ENGINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d+\s+(fail2ban\.\w+)\s+\[\d+\]:\s+\w+\s+\[([^\]]+)\]\s+(Restore Ban|Found|Ban|Unban)\b(.*)$"
ENGINE_TAIL = r"-\s+(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
ENGINE_START = "Starting Fail2ban"
#: The logger whose word counts for an action.
LOGGER_OF = {"Found": "fail2ban.filter", "Ban": "fail2ban.actions", "Unban": "fail2ban.actions", "Restore Ban": "fail2ban.actions"}
TOOL_MATCHED = r"(?i)Lines:.*?(\d+) matched"
QUEUE_COUNT = r"--\s*[\d.]+\s*\w?bytes in (\d+) Request"
IPV4 = r"(?<![\w.\-])\d{1,3}(?:\.\d{1,3}){3}(?![\w.\-])"
EMAIL = r"(?<![\w.\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}(?![\w.\-])"


def group(text: Column, pattern: str, n: int) -> Column:
    """A group of the first match; null if there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def series_key(name: Column, labels: Column) -> Column:
    """``name{a=1,b=2}`` with labels in order of their names; the bare name without labels."""
    pairs = F.transform(F.sort_array(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(labels.isNull() | (F.size(labels) == 0), name).otherwise(
        F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    )


def moment(text: Column) -> Column:
    """RFC 3339 text to a timestamp, null where it is none."""
    return F.try_to_timestamp(text)


def numbers(text: Column) -> Column:
    """The distinct unsigned numbers of a text as doubles, in order of appearance; digits of any script count."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\d+(?:\.\d+)?"), F.lit(0))
    plain = F.transform(found, lambda x: F.translate(x, "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩", "01234567890123456789").try_cast("double"))
    return F.array_distinct(F.array_compact(plain))


def digest12(text: Column) -> Column:
    """The first 12 hex digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def pseudonym(salt: bytes, kind: str, value: Column, digits: int = 6) -> Column:
    """HMAC-SHA256 of ``kind NUL lower(value)`` under a salt, its first hex digits. The two padded keys are
    literals; collisions of 24 bits are likely from about five thousand values on, so widen ``digits`` then."""
    import hashlib

    block = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    message = F.concat(F.lit(inner), F.lit(kind.encode() + b"\0"), F.encode(F.lower(value), "utf-8"))
    return F.substring(F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(message, 256))), 256), 1, digits)


def cut(text: Column, limit: int) -> Column:
    """At most ``limit`` characters: a longer text ends in three dots, without blanks before them."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("...")))


def ipv4_number(address: Column) -> Column:
    """A dotted quad as a number, null if an octet is over 255 or has a leading zero."""
    parts = F.split(address, r"\.")
    octets = [F.get(parts, F.lit(i)) for i in range(4)]
    valid = F.lit(True)
    total = F.lit(0).cast("long")
    for o in octets:
        n = o.try_cast("int")
        valid = valid & n.between(0, 255) & (n.cast("string") == o)
        total = total * 256 + n
    return F.when(valid & (F.size(parts) == 4), total)


def _cidr(text: str) -> tuple[int, int]:
    address, bits = text.split("/")
    a, b, c, d = map(int, address.split("."))
    low = (a << 24) | (b << 16) | (c << 8) | d
    return low, low + (1 << (32 - int(bits))) - 1


#: IPv4 ranges that aren't globally routable, and those for documentation, which stand for the public.
LOOPBACK = "127.0.0.0/8"
DOCUMENTATION = ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")
NOT_GLOBAL = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "240.0.0.0/4",
)


def address_class(address: Column) -> Column:
    """loopback, documentation, private or global; null if the text is no IPv4 address."""

    def of(n: Column) -> Column:
        within = lambda ranges: F.greatest(F.lit(False), *[n.between(*_cidr(r)) for r in ranges])
        return (
            F.when(n.isNull(), F.lit(None).cast("string"))
            .when(within([LOOPBACK]), "loopback")
            .when(within(DOCUMENTATION), "documentation")
            .when(within(NOT_GLOBAL), "private")
            .otherwise("global")
        )

    # The number is bound to the variable of a one-element array: it is computed once, and the code stays small.
    return F.get(F.transform(F.array(ipv4_number(address)), of), F.lit(0))
